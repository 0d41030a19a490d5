"""Declared relations: extract columns, contracts, keys, column tags and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwright.sources.tables import Checks

# Extracts arrive with every column as string.
# Fixed values.
EXTRACT_COLUMNS = {
    "customer": (
        "customer_change_id", "customer_pk", "customer_id", "customer_ssn", "first_name",
        "last_name", "email", "phone", "birth_date", "address_line1", "address_line2", "city",
        "postal_code", "country_code", "customer_segment", "is_active", "source_operation",
        "source_updated_at",
    ),
    "customer_deletion_confirmations": (
        "decision_revision_id", "deletion_request_id", "decision_status", "deletion_mode",
        "deletion_policy_version", "recorded_at", "decided_at", "decided_by_role",
        "decision_reason", "legal_hold",
    ),
    "customer_events": (
        "event_id", "customer_ssn", "event_type", "occurred_at", "measure_value", "measure_unit",
        "source_updated_at",
    ),
    "customer_services": (
        "service_id", "customer_ssn", "service_type", "installation_address_line1",
        "installation_address_line2", "installation_city", "installation_postal_code",
        "installation_country_code", "is_valid", "valid_from", "valid_to", "source_updated_at",
    ),
    "invoices": (
        "invoice_id", "customer_ssn", "service_id", "amount", "currency_code", "issued_date",
        "due_date", "is_paid", "paid_at", "is_due", "source_updated_at",
    ),
}


def extract_schema(name: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in EXTRACT_COLUMNS[name]])


_TYPES = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "decimal(18,2)": T.DecimalType(18, 2),
}


def _ddl(text: str) -> T.StructType:
    """Declared columns as a StructType; needs no running session."""
    pairs = (column.split(" ") for column in text.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


_CUSTOMER_KEY_DDL = (
    "customer_key string, customer_pk_key string, customer_id_key string, first_name_key string, "
    "last_name_key string, full_name_key string, email_key string, phone_key string, "
    "birth_date_key string, address_key string"
)
_CUSTOMER_TAIL_DDL = "customer_segment string, is_active boolean, source_updated_at timestamp"
_SERVICE_TAIL_DDL = (
    "service_type string, is_valid boolean, valid_from date, valid_to date, source_updated_at timestamp"
)
_EVENT_TAIL_DDL = (
    "event_type string, occurred_at timestamp, measure_value decimal(18,2), measure_unit string, "
    "source_updated_at timestamp"
)
_INVOICE_DATES_DDL = (
    "amount decimal(18,2), currency_code string, issued_date date, due_date date, is_paid boolean, "
    "paid_at date"
)
_REQUEST_DDL = (
    "deletion_request_id string, customer_id string, customer_ssn string, "
    "source_deleted_at timestamp, detected_at timestamp"
)
_DECISION_TAIL_DDL = (
    "decision_status string, deletion_mode string, recorded_at timestamp, decided_at timestamp, "
    "decided_by_role string, decision_reason string, legal_hold boolean, "
    "deletion_policy_version string, authorization_status string"
)

# Contract of every published relation.
# Fixed values.
CONTRACTS = {
    name: _ddl(text)
    for name, text in {
        "customer_deletion_requests": f"{_REQUEST_DDL}, detection_status string",
        "customer_deletion_authorization_history": (
            f"decision_revision_id string, {_REQUEST_DDL}, {_DECISION_TAIL_DDL}"
        ),
        "customer_deletion_authorizations": (
            f"{_REQUEST_DDL}, decision_revision_id string, {_DECISION_TAIL_DDL}"
        ),
        "int_customer_deletion_plan": (
            "decision_revision_id string, deletion_request_id string, customer_key string, "
            "deletion_mode string, deletion_policy_version string, "
            "authorization_recorded_at timestamp, target_layer string, target_relation string, "
            "target_kind string, planned_action string, plan_status string, authorized_at timestamp"
        ),
        "int_terminal_deleted_customer_keys": (
            "decision_revision_id string, deletion_request_id string, customer_key string, "
            "authorized_at timestamp, authorization_recorded_at timestamp, deletion_mode string, "
            "deletion_policy_version string, initial_decision_revision_id string, "
            "initial_deletion_request_id string, initial_deletion_mode string, "
            "initial_deletion_policy_version string, initial_authorized_at timestamp, "
            "initial_authorization_recorded_at timestamp, suppression_recorded_at timestamp, "
            "mode_escalated_at timestamp"
        ),
        "fa_pd_customer": (
            f"{_CUSTOMER_KEY_DDL}, customer_pk_value string, customer_id_value string, "
            "customer_ssn_value string, first_name_value string, last_name_value string, "
            "full_name_value string, email_value string, phone_value string, "
            f"birth_date_value string, address_value string, {_CUSTOMER_TAIL_DDL}"
        ),
        "fa_pd_service_address": (
            "customer_key string, service_key string, service_version_key string, "
            "installation_address_key string, service_id_value string, customer_ssn_value string, "
            f"installation_address_value string, {_SERVICE_TAIL_DDL}"
        ),
        "int_customer_protected": f"{_CUSTOMER_KEY_DDL}, {_CUSTOMER_TAIL_DDL}",
        "int_customer_events_resolved": (
            f"event_id string, customer_key string, {_EVENT_TAIL_DDL}, is_erased_customer boolean"
        ),
        "int_customer_services_resolved": (
            "customer_key string, service_key string, service_version_key string, "
            f"installation_address_key string, {_SERVICE_TAIL_DDL}"
        ),
        "int_invoices_resolved": (
            "invoice_id string, customer_key string, service_key string, "
            f"service_version_key string, {_INVOICE_DATES_DDL}, source_is_due boolean, "
            "is_due boolean, source_updated_at timestamp, is_erased_customer boolean"
        ),
        "quarantine_customer_events": (
            f"event_id string, customer_ssn string, {_EVENT_TAIL_DDL}, quarantine_reason string, "
            "quarantined_at timestamp"
        ),
        "quarantine_customer_services": (
            "service_id string, customer_ssn string, service_type string, "
            "installation_address_line1 string, installation_address_line2 string, "
            "installation_city string, installation_postal_code string, "
            "installation_country_code string, is_valid boolean, valid_from date, valid_to date, "
            "source_updated_at timestamp, quarantine_reason string, quarantined_at timestamp"
        ),
        "quarantine_invoices": (
            f"invoice_id string, customer_ssn string, service_id string, {_INVOICE_DATES_DDL}, "
            "source_is_due boolean, source_updated_at timestamp, quarantine_reason string, "
            "quarantined_at timestamp"
        ),
        "dim_customer": f"{_CUSTOMER_KEY_DDL}, {_CUSTOMER_TAIL_DDL}",
        "dim_service": (
            "customer_key string, service_key string, service_version_key string, "
            f"installation_address_key string, {_SERVICE_TAIL_DDL}"
        ),
        "dim_date": (
            "date_key int, date_day date, calendar_year int, calendar_quarter int, "
            "month_number int, month_name string, day_of_month int, day_of_week int, "
            "day_name string, iso_week_number int, is_weekend boolean"
        ),
        "fct_customer_event": (
            "event_key string, customer_key string, event_date_key int, occurred_at timestamp, "
            "event_type string, measure_value decimal(18,2), measure_unit string, "
            "source_updated_at timestamp, is_erased_customer boolean"
        ),
        "fct_invoice": (
            "invoice_key string, customer_key string, service_key string, "
            "service_version_key string, issue_date_key int, due_date_key int, paid_date_key int, "
            "amount decimal(18,2), currency_code string, is_paid boolean, source_is_due boolean, "
            "is_due boolean, source_updated_at timestamp, is_erased_customer boolean"
        ),
    }.items()
}

# Unique keys of the durable controls; also the keys they are archived and restored by.
# Fixed values.
CONTROL_KEYS = {
    "customer_deletion_requests": ("deletion_request_id",),
    "int_customer_deletion_plan": (
        "decision_revision_id", "customer_key", "target_layer", "target_relation",
        "deletion_mode", "deletion_policy_version",
    ),
    "int_terminal_deleted_customer_keys": ("customer_key",),
}

# Columns of published relations that may be null; all others of these relations must not be.
# Fixed values.
_OPTIONAL = {
    "customer_deletion_requests": "",
    "customer_deletion_authorizations": (
        "decision_revision_id deletion_mode recorded_at decided_at decided_by_role decision_reason legal_hold deletion_policy_version"
    ),
    "int_customer_deletion_plan": "",
    "int_terminal_deleted_customer_keys": (
        "initial_decision_revision_id initial_deletion_request_id initial_deletion_policy_version initial_authorized_at "
        "initial_authorization_recorded_at mode_escalated_at"
    ),
    "int_customer_protected": "customer_segment",
    "int_customer_events_resolved": "",
    "int_customer_services_resolved": "",
    "int_invoices_resolved": "paid_at",
    "quarantine_customer_events": "",
    "quarantine_customer_services": (
        "installation_address_line1 installation_address_line2 installation_city installation_postal_code installation_country_code"
    ),
    "quarantine_invoices": "paid_at",
    "dim_customer": "customer_segment",
    "dim_service": "",
    "dim_date": "",
    "fct_customer_event": "",
    "fct_invoice": "paid_date_key",
}
# Fixed values.
_MODES = ("SPECIAL_DELETION", "FULL_GOVERNED_OUTPUT_DELETION")
_ACCEPTED = {
    "customer_deletion_requests": {"detection_status": ("DETECTED",)},
    "int_customer_deletion_plan": {
        "deletion_mode": _MODES,
        "target_kind": ("TABLE", "VIEW"),
        "planned_action": ("DELETE_CURRENT_ROWS", "REASSIGN_TO_ERASED_MEMBER", "EXCLUDE_ERASED_ROWS", "EXCLUDE_DELETED_ROWS"),
        "plan_status": ("AUTHORIZED",),
    },
    "int_terminal_deleted_customer_keys": {"deletion_mode": _MODES, "initial_deletion_mode": _MODES},
}
_CONDITIONS = {
    "int_invoices_resolved": {"due no earlier than issued": "due_date >= issued_date"},
    "int_customer_services_resolved": {"valid to no earlier than from": "valid_to >= valid_from"},
}

#: Row rules of published relations, counted while they are written.
CHECKS = {
    name: Checks(
        tuple(c for c in CONTRACTS[name].names if c not in optional.split()), _ACCEPTED.get(name, {}), _CONDITIONS.get(name, {})
    )
    for name, optional in _OPTIONAL.items()
}

# Column, category, and for readable columns the key column that masks them.
_CUSTOMER_TAGS = (
    ("customer_key", "NATIONAL_IDENTIFIER", None),
    ("customer_pk_key", "SOURCE_RECORD_IDENTIFIER", None),
    ("customer_id_key", "CUSTOMER_IDENTIFIER", None),
    ("first_name_key", "NAME", None),
    ("last_name_key", "NAME", None),
    ("full_name_key", "NAME", None),
    ("email_key", "EMAIL", None),
    ("phone_key", "PHONE", None),
    ("birth_date_key", "BIRTH_DATE", None),
    ("address_key", "ADDRESS", None),
    ("customer_pk_value", "SOURCE_RECORD_IDENTIFIER", "customer_pk_key"),
    ("customer_id_value", "CUSTOMER_IDENTIFIER", "customer_id_key"),
    ("customer_ssn_value", "NATIONAL_IDENTIFIER", "customer_key"),
    ("first_name_value", "NAME", "first_name_key"),
    ("last_name_value", "NAME", "last_name_key"),
    ("full_name_value", "NAME", "full_name_key"),
    ("email_value", "EMAIL", "email_key"),
    ("phone_value", "PHONE", "phone_key"),
    ("birth_date_value", "BIRTH_DATE", "birth_date_key"),
    ("address_value", "ADDRESS", "address_key"),
)
_SERVICE_TAGS = (
    ("customer_key", "NATIONAL_IDENTIFIER", None),
    ("service_key", "SERVICE_IDENTIFIER", None),
    ("service_version_key", "SERVICE_IDENTIFIER", None),
    ("installation_address_key", "ADDRESS", None),
    ("service_id_value", "SERVICE_IDENTIFIER", "service_key"),
    ("customer_ssn_value", "NATIONAL_IDENTIFIER", "customer_key"),
    ("installation_address_value", "ADDRESS", "installation_address_key"),
)


def _metadata(tags) -> dict[str, dict[str, str]]:
    out = {}
    for column, category, mask in tags:
        entry = {
            "personal_data_category": category,
            "personal_data_state": "RAW" if mask else "PSEUDONYMIZED",
        }
        if mask:
            entry["mask_column"] = mask
        out[column] = entry
    return out


COLUMN_METADATA = {
    "fa_pd_customer": _metadata(_CUSTOMER_TAGS),
    "fa_pd_service_address": _metadata(_SERVICE_TAGS),
}


def with_column_metadata(df: DataFrame, annotations: dict[str, dict[str, str]]) -> DataFrame:
    """Attach tags and mask bindings as StructField metadata; parquet keeps them."""
    return df.select(
        [
            F.col(c).alias(c, metadata=annotations[c]) if c in annotations else F.col(c)
            for c in df.columns
        ]
    )
