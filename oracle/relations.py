"""The expected relations in DuckDB SQL, as CTEs over the derived extracts.

Written independently of the Spark code (QUALIFY, correlated counts, set operators), so that the
comparison means something.
"""

from oracle.extracts import EXTRACTS

PEPPER = "testbed-pepper-not-secret"
DEMO_PEPPER = "public-browser-demo-not-secret"
POLICY = "CUSTOMER_DELETION_V1"
SPECIAL = "SPECIAL_DELETION"
FULL = "FULL_GOVERNED_OUTPUT_DELETION"
RUN_TS = "TIMESTAMP '2026-03-01 00:00:00'"
SECOND_RUN_TS = "TIMESTAMP '2026-03-02 00:00:00'"
EARLY_CUTOFF = "TIMESTAMP '2026-02-20 00:00:00'"
AS_OF = "DATE '1999-01-01'"
ERASED = "'-99999'"

# Fixed values.
TARGETS = [
    ("layer1", "quarantine_customer_events", "TABLE", "DELETE_CURRENT_ROWS", "DELETE_CURRENT_ROWS"),
    ("layer1", "quarantine_customer_services", "TABLE", "DELETE_CURRENT_ROWS", "DELETE_CURRENT_ROWS"),
    ("layer1", "quarantine_invoices", "TABLE", "DELETE_CURRENT_ROWS", "DELETE_CURRENT_ROWS"),
    ("priva_map", "fa_pd_customer", "TABLE", "DELETE_CURRENT_ROWS", "DELETE_CURRENT_ROWS"),
    ("priva_map", "fa_pd_service_address", "TABLE", "DELETE_CURRENT_ROWS", "DELETE_CURRENT_ROWS"),
    ("layer2", "int_customer_protected", "TABLE", "DELETE_CURRENT_ROWS", "DELETE_CURRENT_ROWS"),
    ("layer2", "int_customer_events_resolved", "TABLE", "DELETE_CURRENT_ROWS", "REASSIGN_TO_ERASED_MEMBER"),
    ("layer2", "int_customer_services_resolved", "TABLE", "DELETE_CURRENT_ROWS", "DELETE_CURRENT_ROWS"),
    ("layer2", "int_invoices_resolved", "TABLE", "DELETE_CURRENT_ROWS", "REASSIGN_TO_ERASED_MEMBER"),
    ("layer3", "dim_customer", "TABLE", "DELETE_CURRENT_ROWS", "DELETE_CURRENT_ROWS"),
    ("layer3", "dim_service", "TABLE", "DELETE_CURRENT_ROWS", "DELETE_CURRENT_ROWS"),
    ("layer3", "fct_customer_event", "TABLE", "DELETE_CURRENT_ROWS", "REASSIGN_TO_ERASED_MEMBER"),
    ("layer3", "fct_invoice", "TABLE", "DELETE_CURRENT_ROWS", "REASSIGN_TO_ERASED_MEMBER"),
    ("layer3_case", "case_dim_customer", "VIEW", "EXCLUDE_DELETED_ROWS", "EXCLUDE_ERASED_ROWS"),
    ("layer3_case", "case_dim_service", "VIEW", "EXCLUDE_DELETED_ROWS", "EXCLUDE_ERASED_ROWS"),
    ("layer3_case", "case_fct_customer_event", "VIEW", "EXCLUDE_DELETED_ROWS", "EXCLUDE_ERASED_ROWS"),
    ("layer3_case", "case_fct_invoice", "VIEW", "EXCLUDE_DELETED_ROWS", "EXCLUDE_ERASED_ROWS"),
]
TEACHING_TARGETS = [
    ("layer1", "int_current_customers", "DELETE_CURRENT_ROWS", "DELETE_CURRENT_ROWS"),
    ("priva_map", "demo_customer_map", "DELETE_CURRENT_ROWS", "DELETE_CURRENT_ROWS"),
    ("layer2", "int_customer_protected", "DELETE_CURRENT_ROWS", "DELETE_CURRENT_ROWS"),
    ("layer2", "int_invoices_resolved", "DELETE_CURRENT_ROWS", "REASSIGN_TO_ERASED_MEMBER"),
    ("layer1", "quarantine_invoices", "DELETE_CURRENT_ROWS", "DELETE_CURRENT_ROWS"),
    ("layer3", "dim_customer", "DELETE_CURRENT_ROWS", "DELETE_CURRENT_ROWS"),
]


def values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


def canon(expr: str, kind: str = "text") -> str:
    if kind == "ssn":
        return f"replace(trim({expr}), '-', '')"
    if kind == "phone":
        return f"regexp_replace({expr}, '[^0-9]', '', 'g')"
    if kind == "date":
        return f"strftime(CAST({expr} AS DATE), '%Y-%m-%d')"
    return f"nullif(lower(regexp_replace(trim(CAST({expr} AS VARCHAR)), '\\s+', ' ', 'g')), '')"


def hashed(canonical: str, domain: str, version: str = "v1", pepper: str = PEPPER) -> str:
    purpose = "gdpr_personal_data_pseudonym"
    head = (
        f"purpose_length={len(purpose)}|purpose={purpose}|version_length={len(version)}|version={version}"
        f"|domain_length={len(domain)}|domain={domain}|value_length="
    )
    tail = f"|pepper_length={len(pepper)}|pepper={pepper}"
    return f"('{version}:' || sha256('{head}' || length({canonical}) || '|value=' || {canonical} || '{tail}'))"


def key(expr: str, domain: str, kind: str = "text", version: str = "v1", pepper: str = PEPPER) -> str:
    return hashed(canon(expr, kind), domain, version, pepper)


def ssn_key(expr: str = "customer_ssn") -> str:
    return key(expr, "customer.ssn", "ssn")


def address(prefix: str, line: str) -> str:
    p = prefix
    return (
        f"nullif(concat_ws(', ', {p}{line}1, {p}{line}2, concat_ws(' ', {p}postal_code, {p}city), "
        f"{p}country_code), '')"
    )


CUSTOMER_KEYS = [
    ("customer_key", "customer_ssn_value", "customer.ssn", "ssn"),
    ("customer_pk_key", "customer_pk_value", "customer.source_pk", "text"),
    ("customer_id_key", "customer_id_value", "customer.id", "text"),
    ("first_name_key", "first_name_value", "customer.first_name", "text"),
    ("last_name_key", "last_name_value", "customer.last_name", "text"),
    ("full_name_key", "full_name_value", "customer.full_name", "text"),
    ("email_key", "email_value", "customer.email", "text"),
    ("phone_key", "phone_value", "customer.phone", "phone"),
    ("birth_date_key", "birth_date_value", "customer.birth_date", "date"),
    ("address_key", "address_value", "customer.address", "text"),
]
KEY_NAMES = [k for k, *_ in CUSTOMER_KEYS]


def customer_key_list(version: str = "v1", pepper: str = PEPPER) -> str:
    return ", ".join(f"{key(v, d, kind, version, pepper)} AS {k}" for k, v, d, kind in CUSTOMER_KEYS)


def values_of(source: str) -> str:
    return f"""
        SELECT CAST(customer_pk AS VARCHAR) AS customer_pk_value, customer_id AS customer_id_value,
               customer_ssn AS customer_ssn_value, first_name AS first_name_value, last_name AS last_name_value,
               nullif(concat_ws(' ', first_name, last_name), '') AS full_name_value, email AS email_value,
               phone AS phone_value, strftime(birth_date, '%Y-%m-%d') AS birth_date_value,
               {address('', 'address_line')} AS address_value, customer_segment, is_active, source_updated_at
        FROM {source}"""


def opt(col: str) -> str:
    return f"nullif(trim({col}), '')"


EVENT_TAIL = "event_type, occurred_at, measure_value, measure_unit, source_updated_at"
SERVICE_TAIL = "service_type, is_valid, valid_from, valid_to, source_updated_at"
INVOICE_TAIL = "amount, currency_code, issued_date, due_date, is_paid, paid_at"


def ledger_sql(plan: str, run_ts: str) -> str:
    """First-run ledger from a plan."""
    return f"""
        SELECT e.decision_revision_id, e.deletion_request_id, e.customer_key, e.authorized_at,
               e.authorization_recorded_at, e.deletion_mode, e.deletion_policy_version,
               i.decision_revision_id AS initial_decision_revision_id,
               i.deletion_request_id AS initial_deletion_request_id, i.deletion_mode AS initial_deletion_mode,
               i.deletion_policy_version AS initial_deletion_policy_version,
               i.authorized_at AS initial_authorized_at,
               i.authorization_recorded_at AS initial_authorization_recorded_at,
               {run_ts} AS suppression_recorded_at,
               CASE WHEN i.deletion_mode = '{SPECIAL}' AND e.deletion_mode = '{FULL}' THEN {run_ts} END
                 AS mode_escalated_at
        FROM (SELECT * FROM {plan} QUALIFY row_number() OVER (PARTITION BY customer_key
                ORDER BY (deletion_mode = '{FULL}') DESC, authorization_recorded_at DESC,
                         decision_revision_id DESC) = 1) e
        JOIN (SELECT * FROM {plan} QUALIFY row_number() OVER (PARTITION BY customer_key
                ORDER BY authorization_recorded_at, decision_revision_id) = 1) i USING (customer_key)"""


def complete_sql(plan: str) -> str:
    return f"""
        SELECT p.decision_revision_id, p.deletion_request_id, p.customer_key, p.deletion_mode,
               p.deletion_policy_version, min(p.authorization_recorded_at) AS authorization_recorded_at,
               min(p.authorized_at) AS authorized_at,
               CAST(count(DISTINCT p.target_layer || '.' || p.target_relation) AS INTEGER) AS matched_target_count
        FROM {plan} p SEMI JOIN targets t
          ON (p.target_layer, p.target_relation, p.target_kind) = (t.target_layer, t.target_relation, t.target_kind)
         AND p.planned_action = CASE p.deletion_mode WHEN '{FULL}' THEN t.full_action ELSE t.special_action END
        WHERE p.plan_status = 'AUTHORIZED'
        GROUP BY ALL HAVING count(DISTINCT p.target_layer || '.' || p.target_relation) = {len(TARGETS)}"""


def plan_sql(history: str) -> str:
    return f"""
        SELECT h.decision_revision_id, h.deletion_request_id, h.customer_key, h.deletion_mode,
               h.deletion_policy_version, h.authorization_recorded_at, t.target_layer, t.target_relation,
               t.target_kind, CASE h.deletion_mode WHEN '{FULL}' THEN full_action ELSE special_action END
                 AS planned_action, 'AUTHORIZED' AS plan_status, h.authorized_at
        FROM {history} h, targets t"""


def historical_sql(history: str) -> str:
    return f"""
        SELECT DISTINCT a.decision_revision_id, a.deletion_request_id, {ssn_key('s.customer_ssn')} AS customer_key,
               a.deletion_mode, a.deletion_policy_version, a.recorded_at AS authorization_recorded_at,
               a.decided_at AS authorized_at
        FROM {history} a JOIN stg_customer s USING (customer_id)
        WHERE a.authorization_status = 'AUTHORIZED' AND s.customer_ssn IS NOT NULL"""


def history_sql(decisions: str) -> str:
    return f"""
        SELECT d.decision_revision_id, r.* EXCLUDE (detection_status), d.decision_status, d.deletion_mode,
               d.recorded_at, d.decided_at, d.decided_by_role, d.decision_reason, d.legal_hold,
               d.deletion_policy_version,
               CASE WHEN d.legal_hold IS NULL THEN 'INVALID' WHEN d.legal_hold THEN 'HELD'
                    WHEN d.decision_status = 'CONFIRMED' THEN
                      CASE WHEN d.deletion_mode IN ('{SPECIAL}', '{FULL}') AND d.deletion_policy_version = '{POLICY}'
                            AND coalesce(CAST(d.recorded_at AS VARCHAR) || CAST(d.decided_at AS VARCHAR)
                                         || d.decided_by_role || d.decision_reason, '') <> ''
                           THEN 'AUTHORIZED' ELSE 'INVALID' END
                    WHEN d.decision_status = 'REJECTED' THEN 'REJECTED' ELSE 'PENDING' END AS authorization_status
        FROM requests r JOIN {decisions} d USING (deletion_request_id)"""


def reason_cases(ordinary: str, mapped: bool) -> str:
    lookups = (
        f"""WHEN {ordinary} AND mapped = 0 THEN 'SERVICE_MAP_ENTRY_NOT_FOUND'
            WHEN {ordinary} AND mapped > 1 THEN 'SERVICE_VERSION_AMBIGUOUS'"""
        if mapped
        else ""
    )
    return f"""CASE WHEN {ordinary} AND NOT found THEN 'CUSTOMER_NOT_FOUND'
            WHEN any_period = 0 THEN 'SERVICE_NOT_FOUND'
            WHEN own_period = 0 THEN 'CUSTOMER_SERVICE_MISMATCH'
            WHEN ok_period = 0 THEN 'SERVICE_INVALID'
            WHEN effective = 0 THEN 'SERVICE_NOT_VALID_ON_ISSUE_DATE'
            WHEN effective > 1 THEN 'SERVICE_VERSION_AMBIGUOUS'
            {lookups}
            WHEN due_date < issued_date THEN 'INVALID_INVOICE_DATE_RANGE'
            WHEN is_paid AND paid_at IS NULL THEN 'PAYMENT_DATE_MISSING'
            WHEN NOT is_paid AND paid_at IS NOT NULL THEN 'PAYMENT_DATE_UNEXPECTED'
            WHEN paid_at < issued_date THEN 'PAYMENT_BEFORE_ISSUE_DATE'
            ELSE 'ACCEPTED' END"""


def stats_sql(invoices: str, services: str, customer: str, service: str, version: str) -> str:
    own = f"s.{customer} = i.{customer}"
    ok = f"{own} AND s.is_valid AND s.valid_to >= s.valid_from"
    effective = f"{ok} AND i.issued_date >= s.valid_from AND i.issued_date <= s.valid_to"
    return f"""
        SELECT i.invoice_id, count(s.{service}) AS any_period, count(*) FILTER ({own}) AS own_period,
               count(*) FILTER ({ok}) AS ok_period, count(*) FILTER ({effective}) AS effective,
               max(s.{version}) FILTER ({effective}) AS source_version
        FROM {invoices} i LEFT JOIN {services} s
          ON s.{service} = i.{service} AND (i.deletion_mode IS NOT NULL OR s.deletion_mode IS NULL)
        GROUP BY i.invoice_id"""


CTES = {
    **EXTRACTS,
    "targets": f"""
        SELECT * FROM (VALUES {values(TARGETS)})
          t(target_layer, target_relation, target_kind, full_action, special_action)""",
    "teaching_targets": f"""
        SELECT * FROM (VALUES {values(TEACHING_TARGETS)})
          t(target_layer, target_relation, full_action, special_action)""",
    # staging
    "stg_customer": f"""
        SELECT trim(customer_change_id) AS customer_change_id, CAST(customer_pk AS BIGINT) AS customer_pk,
               trim(customer_id) AS customer_id, trim(customer_ssn) AS customer_ssn,
               {', '.join(f"{opt(c)} AS {c}" for c in ('first_name', 'last_name', 'email', 'phone'))},
               CAST({opt('birth_date')} AS DATE) AS birth_date,
               {', '.join(f"{opt(c)} AS {c}" for c in ('address_line1', 'address_line2', 'city', 'postal_code'))},
               upper({opt('country_code')}) AS country_code, {opt('customer_segment')} AS customer_segment,
               CAST(is_active AS BOOLEAN) AS is_active, upper(trim(source_operation)) AS source_operation,
               CAST(source_updated_at AS TIMESTAMP) AS source_updated_at
        FROM x_customer""",
    "stg_all_decisions": f"""
        SELECT trim(decision_revision_id) AS decision_revision_id, trim(deletion_request_id) AS deletion_request_id,
               upper(trim(decision_status)) AS decision_status, upper({opt('deletion_mode')}) AS deletion_mode,
               upper({opt('deletion_policy_version')}) AS deletion_policy_version,
               CAST({opt('recorded_at')} AS TIMESTAMP) AS recorded_at,
               CAST({opt('decided_at')} AS TIMESTAMP) AS decided_at, {opt('decided_by_role')} AS decided_by_role,
               {opt('decision_reason')} AS decision_reason, CAST(legal_hold AS BOOLEAN) AS legal_hold
        FROM x_decisions""",
    "stg_early_decisions": f"""
        SELECT * FROM stg_all_decisions WHERE recorded_at IS NULL OR recorded_at <= {EARLY_CUTOFF}""",
    "stg_events": """
        SELECT trim(event_id) AS event_id, trim(customer_ssn) AS customer_ssn, upper(trim(event_type)) AS event_type,
               CAST(occurred_at AS TIMESTAMP) AS occurred_at, CAST(measure_value AS DECIMAL(18,2)) AS measure_value,
               upper(trim(measure_unit)) AS measure_unit, CAST(source_updated_at AS TIMESTAMP) AS source_updated_at
        FROM x_events""",
    "stg_services": f"""
        SELECT trim(service_id) AS service_id, trim(customer_ssn) AS customer_ssn,
               upper(trim(service_type)) AS service_type,
               {', '.join(f"{opt('installation_' + c)} AS installation_{c}"
                          for c in ('address_line1', 'address_line2', 'city', 'postal_code'))},
               upper({opt('installation_country_code')}) AS installation_country_code,
               CAST(is_valid AS BOOLEAN) AS is_valid, CAST(valid_from AS DATE) AS valid_from,
               CAST(valid_to AS DATE) AS valid_to, CAST(source_updated_at AS TIMESTAMP) AS source_updated_at
        FROM x_services""",
    "stg_invoices": f"""
        SELECT trim(invoice_id) AS invoice_id, trim(customer_ssn) AS customer_ssn, trim(service_id) AS service_id,
               CAST(amount AS DECIMAL(18,2)) AS amount, upper(trim(currency_code)) AS currency_code,
               CAST(issued_date AS DATE) AS issued_date, CAST(due_date AS DATE) AS due_date,
               CAST(is_paid AS BOOLEAN) AS is_paid, CAST({opt('paid_at')} AS DATE) AS paid_at,
               CAST(is_due AS BOOLEAN) AS is_due, CAST(source_updated_at AS TIMESTAMP) AS source_updated_at
        FROM x_invoices""",
    # controls
    "requests": f"""
        SELECT customer_change_id AS deletion_request_id, customer_id, customer_ssn,
               source_updated_at AS source_deleted_at, {RUN_TS} AS detected_at, 'DETECTED' AS detection_status
        FROM stg_customer WHERE source_operation = 'DELETE'""",
    "history": history_sql("stg_all_decisions"),
    "early_history": history_sql("stg_early_decisions"),
    "authorizations": f"""
        SELECT r.* EXCLUDE (detection_status), h.decision_revision_id,
               coalesce(h.decision_status, 'PENDING') AS decision_status, h.deletion_mode, h.recorded_at,
               h.decided_at, h.decided_by_role, h.decision_reason, h.legal_hold,
               CASE WHEN h.decision_revision_id IS NULL THEN '{POLICY}' ELSE h.deletion_policy_version END
                 AS deletion_policy_version,
               coalesce(h.authorization_status, 'PENDING') AS authorization_status
        FROM requests r LEFT JOIN (
            SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY deletion_request_id
              ORDER BY recorded_at DESC NULLS LAST, decision_revision_id DESC) = 1) h USING (deletion_request_id)""",
    "historical_keys": historical_sql("history"),
    "early_historical_keys": historical_sql("early_history"),
    "plan": plan_sql("historical_keys"),
    "early_plan": plan_sql("early_historical_keys"),
    "complete": complete_sql("plan"),
    "early_complete": complete_sql("early_plan"),
    "ledger": ledger_sql("complete", RUN_TS),
    "early_ledger": ledger_sql("early_complete", RUN_TS),
    "late_candidates": ledger_sql("complete", SECOND_RUN_TS),
    "ledger_after_second_run": f"""
        SELECT CASE WHEN moves THEN c_revision ELSE o_revision END AS decision_revision_id,
               CASE WHEN moves THEN c_request ELSE o_request END AS deletion_request_id, customer_key,
               CASE WHEN moves THEN c_authorized ELSE o_authorized END AS authorized_at,
               CASE WHEN moves THEN c_recorded ELSE o_recorded END AS authorization_recorded_at,
               CASE WHEN moves THEN c_mode ELSE o_mode END AS deletion_mode,
               CASE WHEN moves THEN c_policy ELSE o_policy END AS deletion_policy_version,
               i1 AS initial_decision_revision_id, i2 AS initial_deletion_request_id, i3 AS initial_deletion_mode,
               i4 AS initial_deletion_policy_version, i5 AS initial_authorized_at,
               i6 AS initial_authorization_recorded_at, suppressed AS suppression_recorded_at,
               CASE WHEN o_mode IS NULL THEN c_escalated
                    WHEN o_mode = '{SPECIAL}' AND c_mode = '{FULL}' THEN {SECOND_RUN_TS}
                    ELSE o_escalated END AS mode_escalated_at
        FROM (
          SELECT customer_key, o.customer_key IS NULL
                   OR (c.customer_key IS NOT NULL AND (
                        (o.deletion_mode = '{SPECIAL}' AND c.deletion_mode = '{FULL}')
                        OR (o.deletion_mode = c.deletion_mode
                            AND (c.authorization_recorded_at, c.decision_revision_id)
                              > (o.authorization_recorded_at, o.decision_revision_id)))) AS moves,
                 c.decision_revision_id AS c_revision, o.decision_revision_id AS o_revision,
                 c.deletion_request_id AS c_request, o.deletion_request_id AS o_request,
                 c.authorized_at AS c_authorized, o.authorized_at AS o_authorized,
                 c.authorization_recorded_at AS c_recorded, o.authorization_recorded_at AS o_recorded,
                 c.deletion_mode AS c_mode, o.deletion_mode AS o_mode,
                 c.deletion_policy_version AS c_policy, o.deletion_policy_version AS o_policy,
                 coalesce(o.initial_decision_revision_id, c.initial_decision_revision_id) AS i1,
                 coalesce(o.initial_deletion_request_id, c.initial_deletion_request_id) AS i2,
                 coalesce(o.initial_deletion_mode, c.initial_deletion_mode) AS i3,
                 coalesce(o.initial_deletion_policy_version, c.initial_deletion_policy_version) AS i4,
                 coalesce(o.initial_authorized_at, c.initial_authorized_at) AS i5,
                 coalesce(o.initial_authorization_recorded_at, c.initial_authorization_recorded_at) AS i6,
                 coalesce(o.suppression_recorded_at, {SECOND_RUN_TS}) AS suppressed,
                 c.mode_escalated_at AS c_escalated, o.mode_escalated_at AS o_escalated
          FROM early_ledger o FULL JOIN late_candidates c USING (customer_key))""",
    # maps
    "latest_upserts": """
        SELECT * FROM stg_customer WHERE source_operation = 'UPSERT'
        QUALIFY row_number() OVER (PARTITION BY customer_id
          ORDER BY source_updated_at DESC, customer_change_id DESC) = 1""",
    "active_upserts": "SELECT * FROM latest_upserts WHERE is_active",
    "active_values": values_of("active_upserts"),
    "customer_map": f"""
        SELECT * FROM (SELECT {customer_key_list()}, * FROM active_values)
        WHERE customer_key NOT IN (SELECT customer_key FROM ledger)""",
    "keyed_services": f"""
        SELECT service_id, {ssn_key()} AS customer_key, {key('service_id', 'service.id')} AS service_key,
               {key("service_id || '|' || strftime(valid_from, '%Y-%m-%d')", 'service.version')}
                 AS service_version_key,
               {key(address('installation_', 'address_line'), 'service.installation_address')}
                 AS installation_address_key,
               {SERVICE_TAIL}, customer_ssn, {address('installation_', 'address_line')} AS installation_address
        FROM stg_services""",
    "service_map": f"""
        SELECT customer_key, service_key, service_version_key, installation_address_key,
               service_id AS service_id_value, customer_ssn AS customer_ssn_value,
               installation_address AS installation_address_value, {SERVICE_TAIL}
        FROM keyed_services
        WHERE is_valid AND valid_to >= valid_from AND customer_key IN (SELECT customer_key FROM customer_map)""",
    # resolutions
    "keyed_events": f"SELECT event_id, {ssn_key()} AS customer_key, {EVENT_TAIL} FROM stg_events",
    "event_resolution": f"""
        SELECT event_id, CASE WHEN l.deletion_mode IS NULL THEN e.customer_key ELSE {ERASED} END AS customer_key,
               {EVENT_TAIL},
               CASE WHEN l.deletion_mode IS NULL AND e.customer_key NOT IN (SELECT customer_key FROM customer_map)
                    THEN 'CUSTOMER_NOT_FOUND' ELSE 'ACCEPTED' END AS resolution_status,
               l.deletion_mode IS NOT NULL AS is_erased_customer
        FROM keyed_events e LEFT JOIN ledger l USING (customer_key)
        WHERE l.deletion_mode IS DISTINCT FROM '{FULL}'""",
    "service_resolution": f"""
        SELECT service_id, customer_key, service_key, service_version_key, installation_address_key, {SERVICE_TAIL},
               CASE WHEN customer_key NOT IN (SELECT customer_key FROM customer_map) THEN 'CUSTOMER_NOT_FOUND'
                    WHEN NOT is_valid THEN 'INVALID_VALIDITY_FLAG'
                    WHEN valid_to < valid_from THEN 'INVALID_VALIDITY_PERIOD'
                    WHEN NOT EXISTS (FROM service_map m WHERE m.service_version_key = k.service_version_key
                       AND m.customer_key = k.customer_key AND m.service_key = k.service_key
                       AND m.installation_address_key = k.installation_address_key)
                      THEN 'PRIVA_MAP_ENTRY_NOT_FOUND'
                    ELSE 'ACCEPTED' END AS resolution_status
        FROM keyed_services k WHERE customer_key NOT IN (SELECT customer_key FROM ledger)""",
    "accepted_services": f"""
        SELECT customer_key, service_key, service_version_key, installation_address_key, {SERVICE_TAIL}
        FROM service_resolution WHERE resolution_status = 'ACCEPTED'""",
    "keyed_invoices": f"""
        SELECT invoice_id, {ssn_key()} AS customer_key, {key('service_id', 'service.id')} AS service_key,
               {INVOICE_TAIL}, is_due AS source_is_due, source_updated_at
        FROM stg_invoices""",
    "marked_invoices": "SELECT i.*, l.deletion_mode FROM keyed_invoices i LEFT JOIN ledger l USING (customer_key)",
    "marked_services": "SELECT s.*, l.deletion_mode FROM keyed_services s LEFT JOIN ledger l USING (customer_key)",
    "invoice_stats": stats_sql(
        "marked_invoices", "marked_services", "customer_key", "service_key", "service_version_key"
    ),
    "mapped_stats": """
        SELECT i.invoice_id, count(s.service_version_key) AS mapped, max(s.service_version_key) AS mapped_version
        FROM marked_invoices i LEFT JOIN accepted_services s
          ON s.customer_key = i.customer_key AND s.service_key = i.service_key
         AND i.issued_date >= s.valid_from AND i.issued_date <= s.valid_to
        GROUP BY i.invoice_id""",
    "classified_invoices": f"""
        SELECT *, {reason_cases('deletion_mode IS NULL', True)} AS resolution_status
        FROM (SELECT i.*, s.* EXCLUDE (invoice_id), m.* EXCLUDE (invoice_id),
                     i.customer_key IN (SELECT customer_key FROM customer_map) AS found
              FROM marked_invoices i JOIN invoice_stats s USING (invoice_id) JOIN mapped_stats m USING (invoice_id))""",
    "invoice_resolution": f"""
        SELECT invoice_id, CASE WHEN erased THEN {ERASED} ELSE customer_key END AS customer_key,
               CASE WHEN erased THEN {ERASED} ELSE service_key END AS service_key,
               CASE WHEN erased THEN {ERASED} ELSE mapped_version END AS resolved_service_version_key,
               {INVOICE_TAIL}, source_is_due, source_updated_at, resolution_status, erased AS is_erased_customer
        FROM (SELECT *, deletion_mode IS NOT NULL AS erased FROM classified_invoices
              WHERE deletion_mode IS DISTINCT FROM '{FULL}')""",
    "accepted_events": """
        SELECT * EXCLUDE (resolution_status) FROM event_resolution WHERE resolution_status = 'ACCEPTED'""",
    "accepted_invoices": f"""
        SELECT invoice_id, customer_key, service_key, resolved_service_version_key AS service_version_key,
               {INVOICE_TAIL}, source_is_due, NOT is_paid AND due_date <= {AS_OF} AS is_due, source_updated_at,
               is_erased_customer
        FROM invoice_resolution WHERE resolution_status = 'ACCEPTED'""",
    "quarantined_events": f"""
        SELECT s.*, r.resolution_status AS quarantine_reason, {RUN_TS} AS quarantined_at
        FROM stg_events s JOIN event_resolution r USING (event_id) WHERE r.resolution_status <> 'ACCEPTED'""",
    "quarantined_services": f"""
        SELECT s.*, r.resolution_status AS quarantine_reason, {RUN_TS} AS quarantined_at
        FROM stg_services s JOIN service_resolution r USING (service_id, valid_from)
        WHERE r.resolution_status <> 'ACCEPTED'""",
    "quarantined_invoices": f"""
        SELECT s.* EXCLUDE (is_due), s.is_due AS source_is_due, r.resolution_status AS quarantine_reason,
               {RUN_TS} AS quarantined_at
        FROM stg_invoices s JOIN invoice_resolution r USING (invoice_id)
        WHERE r.resolution_status <> 'ACCEPTED' AND NOT r.is_erased_customer""",
    # star
    "protected": f"SELECT {', '.join(KEY_NAMES)}, customer_segment, is_active, source_updated_at FROM customer_map",
    "dim_customer": f"""
        SELECT * FROM protected UNION ALL
        SELECT {', '.join([ERASED] * len(KEY_NAMES))}, 'ERASED_SUBJECT', false, TIMESTAMP '1900-01-01 00:00:00'""",
    "dim_service": f"""
        SELECT * FROM accepted_services UNION ALL
        SELECT {', '.join([ERASED] * 4)}, 'ERASED_SUBJECT', false, DATE '1900-01-01', DATE '1900-01-01',
               TIMESTAMP '1900-01-01 00:00:00'""",
    "dim_date": """
        SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS date_day,
               CAST(year(d) AS INTEGER) AS calendar_year, CAST(quarter(d) AS INTEGER) AS calendar_quarter,
               CAST(month(d) AS INTEGER) AS month_number, strftime(d, '%B') AS month_name,
               CAST(day(d) AS INTEGER) AS day_of_month, CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week,
               strftime(d, '%A') AS day_name, CAST(weekofyear(d) AS INTEGER) AS iso_week_number,
               dayofweek(d) IN (0, 6) AS is_weekend
        FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2002-01-01', INTERVAL 1 DAY) t(d)""",
    "fct_event": """
        SELECT event_id AS event_key, customer_key, CAST(strftime(occurred_at, '%Y%m%d') AS INTEGER) AS event_date_key,
               occurred_at, event_type, measure_value, measure_unit, source_updated_at, is_erased_customer
        FROM accepted_events""",
    "fct_invoice": """
        SELECT invoice_id AS invoice_key, customer_key, service_key, service_version_key,
               CAST(strftime(issued_date, '%Y%m%d') AS INTEGER) AS issue_date_key,
               CAST(strftime(due_date, '%Y%m%d') AS INTEGER) AS due_date_key,
               CAST(strftime(paid_at, '%Y%m%d') AS INTEGER) AS paid_date_key,
               amount, currency_code, is_paid, source_is_due, is_due, source_updated_at, is_erased_customer
        FROM accepted_invoices WHERE customer_key NOT IN (SELECT customer_key FROM ledger)""",
    # case views
    "case_customer": """
        SELECT d.customer_key, d.customer_id_key, d.full_name_key, d.email_key, d.address_key, d.customer_segment,
               d.is_active, m.customer_id_value AS customer_id, m.full_name_value AS full_name,
               m.email_value AS email, m.address_value AS customer_address
        FROM dim_customer d JOIN customer_map m
          USING (customer_key, customer_id_key, full_name_key, email_key, address_key)""",
    "case_service": """
        SELECT d.customer_key, d.service_key, d.service_version_key, d.installation_address_key, d.service_type,
               d.is_valid, d.valid_from, d.valid_to, m.service_id_value AS service_id,
               m.installation_address_value AS installation_address
        FROM dim_service d JOIN service_map m
          USING (customer_key, service_key, service_version_key, installation_address_key)""",
    "case_event": """
        SELECT f.event_key, f.customer_key, m.full_name_key, m.email_key, f.event_date_key, f.occurred_at,
               f.event_type, f.measure_value, f.measure_unit, m.full_name_value AS full_name, m.email_value AS email
        FROM fct_event f JOIN customer_map m USING (customer_key)
        WHERE NOT f.is_erased_customer AND m.full_name_key IS NOT NULL AND m.email_key IS NOT NULL""",
    "case_invoice": """
        SELECT f.invoice_key, f.customer_key, f.service_key, f.service_version_key, m.full_name_key, m.email_key,
               s.installation_address_key, f.issue_date_key, f.due_date_key, f.paid_date_key, f.amount,
               f.currency_code, f.is_paid, f.is_due, m.full_name_value AS full_name, m.email_value AS email,
               s.service_id_value AS service_id, s.installation_address_value AS installation_address
        FROM fct_invoice f JOIN customer_map m USING (customer_key)
        JOIN service_map s USING (customer_key, service_key, service_version_key)
        WHERE NOT f.is_erased_customer AND m.full_name_key IS NOT NULL AND m.email_key IS NOT NULL
          AND s.installation_address_key IS NOT NULL""",
    # teaching variant
    "t_decisions": f"""
        SELECT * REPLACE (upper(trim(deletion_mode)) AS deletion_mode,
                          upper(trim(deletion_policy_version)) AS deletion_policy_version)
        FROM (SELECT a.* EXCLUDE (deletion_mode, deletion_policy_version), x.deletion_mode, x.deletion_policy_version
              FROM stg_all_decisions a JOIN x_decisions x ON trim(x.decision_revision_id) = a.decision_revision_id)""",
    "t_authorizations": f"""
        SELECT r.deletion_request_id, r.customer_id, r.customer_ssn, r.source_deleted_at, d.decision_revision_id,
               coalesce(d.decision_status, 'PENDING') AS decision_status, d.deletion_mode, d.deletion_policy_version,
               d.recorded_at, d.decided_at, d.legal_hold,
               CASE WHEN d.decision_revision_id IS NULL THEN 'PENDING' WHEN d.legal_hold IS NULL THEN 'INVALID'
                    WHEN d.legal_hold THEN 'HELD'
                    WHEN d.decision_status = 'CONFIRMED' AND d.deletion_mode IN ('{SPECIAL}', '{FULL}')
                     AND d.deletion_policy_version = '{POLICY}' AND d.recorded_at IS NOT NULL
                     AND d.decided_at IS NOT NULL AND d.decided_by_role IS NOT NULL
                     AND d.decision_reason IS NOT NULL THEN 'AUTHORIZED'
                    WHEN d.decision_status = 'REJECTED' THEN 'REJECTED' ELSE 'INVALID' END AS authorization_status
        FROM requests r LEFT JOIN (
          SELECT * FROM t_decisions QUALIFY row_number() OVER (PARTITION BY deletion_request_id
            ORDER BY recorded_at DESC NULLS LAST, decision_revision_id DESC) = 1) d USING (deletion_request_id)""",
    "t_plan": f"""
        SELECT DISTINCT a.deletion_request_id, s.customer_ssn, a.deletion_mode, a.deletion_policy_version,
               t.target_layer, t.target_relation,
               CASE a.deletion_mode WHEN '{FULL}' THEN t.full_action ELSE t.special_action END AS planned_action,
               'AUTHORIZED' AS plan_status, a.decided_at AS authorized_at
        FROM t_authorizations a JOIN stg_customer s USING (customer_id), teaching_targets t
        WHERE a.authorization_status = 'AUTHORIZED' AND s.customer_ssn IS NOT NULL""",
    "t_modes": f"""
        SELECT customer_ssn, CASE WHEN bool_or(deletion_mode = '{FULL}') THEN '{FULL}' ELSE '{SPECIAL}' END
                 AS deletion_mode
        FROM (SELECT deletion_request_id, customer_ssn, deletion_mode FROM t_plan GROUP BY ALL
              HAVING count(DISTINCT target_relation) = {len(TEACHING_TARGETS)})
        GROUP BY customer_ssn""",
    "t_current": """
        SELECT * FROM active_upserts WHERE customer_ssn NOT IN (SELECT customer_ssn FROM t_modes)""",
    "t_values": values_of("t_current"),
    "t_map": f"SELECT {customer_key_list('demo-v1', DEMO_PEPPER)}, * FROM t_values",
    "t_invoices": """
        SELECT i.* EXCLUDE (is_due), i.is_due AS source_is_due, m.deletion_mode
        FROM stg_invoices i LEFT JOIN t_modes m USING (customer_ssn)""",
    "t_services": "SELECT s.*, m.deletion_mode FROM stg_services s LEFT JOIN t_modes m USING (customer_ssn)",
    "t_stats": stats_sql("t_invoices", "t_services", "customer_ssn", "service_id", "service_id"),
    "t_invoice_resolution": f"""
        SELECT invoice_id, CASE WHEN erased THEN {ERASED} ELSE customer_ssn END AS customer_ssn,
               CASE WHEN erased THEN {ERASED} ELSE service_id END AS service_id,
               {INVOICE_TAIL}, source_is_due, source_updated_at,
               {reason_cases('deletion_mode IS NULL', False)} AS resolution_status, erased AS is_erased_customer
        FROM (SELECT i.*, s.* EXCLUDE (invoice_id), i.deletion_mode IS NOT NULL AS erased,
                     i.customer_ssn IN (SELECT customer_ssn FROM t_current) AS found
              FROM t_invoices i JOIN t_stats s USING (invoice_id)
              WHERE i.deletion_mode IS DISTINCT FROM '{FULL}')""",
}
