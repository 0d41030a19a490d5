"""The derived source extracts in DuckDB SQL, as CTEs over the driver's tables."""

CURRENT, UNKNOWN, HISTORICAL = 100_000_000, 300_000_000, 600_000_000


def pad(key: str, width: int = 10) -> str:
    return f"lpad(CAST({key} AS VARCHAR), {width}, '0')"


def ssn(key: str, base: int) -> str:
    d = f"CAST({key} + {base} AS VARCHAR)"
    dashed = f"substr({d},1,3) || '-' || substr({d},4,2) || '-' || substr({d},6,4)"
    written = f"(CASE WHEN {key} % 2 = 0 THEN {dashed} ELSE {d} END)"
    return f"(CASE WHEN {key} % 7 = 0 THEN ' ' || {written} || ' ' ELSE {written} END)"


def day(date: str, offset: int) -> str:
    return f"CAST(CAST({date} + INTERVAL ({offset}) DAY AS DATE) AS VARCHAR)"


EXTRACTS = {
    "feed_variants": """
        SELECT c.*, t.v FROM customer c, (VALUES ('U1', 1), ('U2', 10), ('D1', 17), ('U3', 51)) t(v, n)
        WHERE c.c_custkey % t.n = 0""",
    "x_customer": f"""
        SELECT (CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE '' END) || 'CCHG-' || {pad('c_custkey')} || '-' || v
                 AS customer_change_id,
               CAST(c_custkey AS VARCHAR) AS customer_pk,
               'CUST-' || {pad('c_custkey')} AS customer_id,
               CASE WHEN v = 'U1' AND c_custkey % 50 = 0 THEN {ssn('c_custkey', HISTORICAL)}
                    ELSE {ssn('c_custkey', CURRENT)} END AS customer_ssn,
               CASE WHEN v = 'D1' THEN '' ELSE '  ' || c_name END AS first_name,
               CASE WHEN v = 'D1' OR c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END AS last_name,
               CASE WHEN v = 'D1' OR c_custkey % 13 = 0 THEN ''
                    ELSE ' User' || c_custkey || '@Example.Invalid' END AS email,
               CASE WHEN v = 'D1' OR c_custkey % 23 = 0 THEN ''
                    ELSE '+358 (' || {pad('c_custkey % 1000', 3)} || ') ' || {pad('c_custkey % 10000', 4)} END AS phone,
               CASE WHEN v = 'D1' THEN ''
                    ELSE CAST(DATE '1950-01-01' + CAST(c_custkey % 20000 AS INTEGER) AS VARCHAR) END AS birth_date,
               CASE WHEN v = 'D1' OR c_custkey % 29 = 0 THEN '' ELSE c_custkey || ' Demo  Street' END AS address_line1,
               CASE WHEN v <> 'D1' AND c_custkey % 3 = 0 THEN 'Rear' ELSE '' END AS address_line2,
               CASE WHEN v = 'D1' OR c_custkey % 29 = 0 OR c_custkey % 19 = 0 THEN ''
                    ELSE ' City ' || c_nationkey END AS city,
               CASE WHEN v = 'D1' OR c_custkey % 29 = 0 THEN '' ELSE {pad('c_custkey % 100000', 5)} END AS postal_code,
               CASE WHEN v = 'D1' OR c_custkey % 58 = 0 THEN '' ELSE ' fi' END AS country_code,
               CASE v WHEN 'D1' THEN '' WHEN 'U2' THEN 'UPGRADED' ELSE c_mktsegment END AS customer_segment,
               CASE WHEN v = 'D1' OR c_acctbal < 0 OR (v = 'U2' AND c_custkey % 70 = 0)
                    THEN 'False' ELSE 'True' END AS is_active,
               CASE WHEN v = 'D1' THEN 'delete' WHEN c_custkey % 2 = 0 THEN 'UPSERT' ELSE ' upsert ' END
                 AS source_operation,
               CASE WHEN v = 'U1' OR (v = 'U2' AND c_custkey % 30 = 0)
                      THEN '2026-01-' || {pad('1 + c_custkey % 20', 2)} || 'T09:00:00'
                    WHEN v = 'U2' THEN '2026-01-25T09:00:00'
                    WHEN v = 'D1' THEN '2026-02-1' || (c_custkey % 10) || 'T12:00:00'
                    ELSE '2026-02-24T12:00:00' END AS source_updated_at
        FROM feed_variants""",
    "decision_cases": """
        SELECT c_custkey AS k, (c_custkey // 17) % 10 AS m, r
        FROM customer, (VALUES ('1'), ('2')) t(r)
        WHERE c_custkey % 17 = 0 AND (c_custkey // 17) % 10 <> 6
          AND (r = '1' OR (c_custkey // 17) % 10 IN (1, 8, 9))""",
    "x_decisions": f"""
        SELECT 'DEC-' || {pad('k')} || '-' || r AS decision_revision_id,
               'CCHG-' || {pad('k')} || '-D1 ' AS deletion_request_id,
               CASE WHEN r = '1' AND m = 4 THEN ' rejected' WHEN r = '1' AND m = 7 THEN 'pending'
                    WHEN r = '2' AND m = 1 THEN 'REJECTED' ELSE 'confirmed' END AS decision_status,
               CASE WHEN (r = '1' AND m IN (4, 7)) OR (r = '2' AND m = 1) THEN ''
                    WHEN (r = '1' AND m = 1) OR (r = '2' AND m = 8) THEN 'FULL_GOVERNED_OUTPUT_DELETION'
                    ELSE 'special_deletion' END AS deletion_mode,
               CASE WHEN m = 5 AND k % 2 = 0 THEN 'customer_deletion_v0' ELSE 'CUSTOMER_DELETION_V1' END
                 AS deletion_policy_version,
               CASE WHEN m = 5 AND k % 2 <> 0 THEN ''
                    WHEN r = '1' THEN '2026-02-16T08:00:00' ELSE '2026-02-25T08:00:00' END AS recorded_at,
               CASE r WHEN '1' THEN '2026-02-16T08:00:00' ELSE '2026-02-25T08:00:00' END AS decided_at,
               CASE WHEN m = 5 AND k % 3 = 0 THEN '' ELSE 'privacy_admin' END AS decided_by_role,
               'VERIFIED_SOURCE_DELETION' AS decision_reason,
               CASE m WHEN 2 THEN 'True' WHEN 3 THEN NULL ELSE 'False' END AS legal_hold
        FROM decision_cases""",
    "x_events": f"""
        SELECT 'EVT-' || {pad('event_id', 12)} AS event_id,
               CASE WHEN event_id % 50 = 0 THEN {ssn('user_id', UNKNOWN)} ELSE {ssn('user_id', CURRENT)} END
                 AS customer_ssn,
               event_type || ' ' AS event_type,
               strftime(ts, '%Y-%m-%dT%H:%M:%S') AS occurred_at,
               CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS measure_value,
               CASE WHEN event_type IN ('view', 'click') THEN 'gb ' ELSE 'minutes' END AS measure_unit,
               strftime(ts, '%Y-%m-%d') || 'T23:00:00' AS source_updated_at
        FROM events""",
    "service_variants": """
        SELECT c.*, t.v FROM customer c, (VALUES ('A'), ('B'), ('O'), ('X')) t(v)
        WHERE CASE t.v WHEN 'A' THEN c_custkey % 43 <> 0 WHEN 'B' THEN c_custkey % 3 = 0
                       WHEN 'O' THEN c_custkey % 41 = 0 ELSE c_custkey % 53 = 0 END""",
    "x_services": f"""
        SELECT CASE WHEN c_custkey % 2 = 0 THEN sid ELSE lower(sid) END AS service_id,
               CASE WHEN v = 'X' THEN {ssn('c_custkey', UNKNOWN)} ELSE {ssn('c_custkey', CURRENT)} END AS customer_ssn,
               CASE WHEN v = 'B' THEN ' mobile' ELSE 'internet' END AS service_type,
               CASE WHEN c_custkey % 59 = 0 THEN '' ELSE (c_custkey + 200) || ' Socket Lane' END
                 AS installation_address_line1,
               CASE WHEN c_custkey % 59 <> 0 AND v = 'B' THEN 'Rear' ELSE '' END AS installation_address_line2,
               CASE WHEN c_custkey % 59 = 0 THEN '' ELSE 'City ' || c_nationkey END AS installation_city,
               CASE WHEN c_custkey % 59 = 0 THEN '' ELSE {pad('c_custkey % 100000', 5)} END
                 AS installation_postal_code,
               CASE WHEN c_custkey % 59 = 0 THEN '' ELSE 'fi' END AS installation_country_code,
               CASE WHEN v = 'A' AND c_custkey % 31 = 0 THEN 'False' ELSE 'True' END AS is_valid,
               CASE WHEN v = 'O' THEN '1996-01-01'
                    ELSE CAST(DATE '1994-06-01' + CAST(c_custkey % 200 AS INTEGER) AS VARCHAR) END AS valid_from,
               CASE WHEN v = 'A' AND c_custkey % 37 = 0 THEN '1993-12-31'
                    WHEN v = 'A' AND c_custkey % 47 = 0 THEN '1998-06-30' ELSE '2003-12-31' END AS valid_to,
               '2026-02-01T10:00:00' AS source_updated_at
        FROM (SELECT *, 'SVC-' || {pad('c_custkey')} || '-' || replace(v, 'O', 'A') AS sid FROM service_variants)""",
    "order_owners": """
        SELECT o_orderkey AS o, o_custkey AS k, o_orderstatus AS status, o_totalprice,
               CAST(o_orderdate AS DATE) AS issued,
               CASE WHEN o_orderkey % 23 = 0 THEN o_custkey + 1 ELSE o_custkey END AS owner
        FROM orders""",
    "x_invoices": f"""
        SELECT 'INV-' || {pad('o', 12)} AS invoice_id,
               CASE WHEN o % 41 = 0 THEN {ssn('k', UNKNOWN)}
                    WHEN o % 13 = 0 AND k % 50 = 0 THEN {ssn('k', HISTORICAL)}
                    ELSE {ssn('k', CURRENT)} END AS customer_ssn,
               CASE WHEN o % 61 = 0 THEN 'SVC-NONE-' || o
                    ELSE 'SVC-' || {pad('owner')} || CASE WHEN owner % 3 = 0 AND o % 2 = 1 THEN '-B' ELSE '-A' END
               END AS service_id,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount,
               ' eur' AS currency_code,
               CAST(issued AS VARCHAR) AS issued_date,
               CASE WHEN o % 29 = 0 THEN {day('issued', -5)} ELSE {day('issued', 30)} END AS due_date,
               CASE WHEN o % 97 = 0 THEN NULL WHEN status = 'F' THEN 'True' ELSE 'False' END AS is_paid,
               CASE WHEN status = 'F' AND o % 19 = 0 THEN ''
                    WHEN status = 'F' AND o % 37 = 0 THEN {day('issued', -3)}
                    WHEN status = 'F' THEN {day('issued', 10)}
                    WHEN o % 31 = 0 THEN {day('issued', 5)} ELSE '' END AS paid_at,
               CASE WHEN status = 'O' THEN 'True' ELSE 'False' END AS is_due,
               '2026-02-28T18:00:00' AS source_updated_at
        FROM order_owners""",
}
