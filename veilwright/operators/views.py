"""Persona-controlled readable views, masked maps and the read matrix."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.config import CASE_USERS, PRIVACY_ADMINS, RESTRICTED_USERS, Persona, PipelineConfig
from veilwright.functions.keys import mask_value, packed, unpacked
from veilwright.operators.policy import case_access, governed_model
from veilwright.sources.tables import literal_relation, union_all

# Readable relations per layer, and the groups that may read them.
_PROTECTED = (PRIVACY_ADMINS, RESTRICTED_USERS)
READ_MATRIX = (
    ("layer1_source", (
        "customer", "customer_deletion_confirmations", "customer_events", "customer_services",
        "invoices",
    ), (PRIVACY_ADMINS,)),
    ("layer1", (
        "stg_customer", "stg_customer_deletion_confirmations", "stg_customer_events",
        "stg_customer_services", "stg_invoices", "customer_deletion_requests",
        "customer_deletion_authorization_history", "customer_deletion_authorizations",
        "quarantine_customer_events", "quarantine_customer_services", "quarantine_invoices",
    ), (PRIVACY_ADMINS,)),
    ("priva_map", ("fa_pd_customer", "fa_pd_service_address"), _PROTECTED),
    ("layer2", (
        "int_customer_protected", "int_customer_events_resolved", "int_customer_services_resolved",
        "int_invoices_resolved",
    ), _PROTECTED),
    ("layer2", ("int_customer_deletion_plan", "int_terminal_deleted_customer_keys"), (PRIVACY_ADMINS,)),
    ("layer3", ("dim_customer", "dim_service", "dim_date", "fct_customer_event", "fct_invoice"), _PROTECTED),
    ("layer3_case", (
        "case_dim_customer", "case_dim_service", "case_fct_customer_event", "case_fct_invoice",
    ), (PRIVACY_ADMINS, CASE_USERS)),
)
GRANT_SCHEMA = "grantee string, table_schema string, table_name string"


def _lookup(dim: DataFrame, mapped: DataFrame, on: list[str], compared: list[str]) -> DataFrame:
    """dim beside mapped where `on` and `compared` agree, exchanged on `on` only.

    The compared columns are tested in a form that is no join key, so the exchange on `on` also serves the join
    with the fact. Nulls never agree.
    """
    other = mapped.select(*[F.col(c).alias(f"_{c}") if c in compared else F.col(c) for c in mapped.columns])
    joined = dim.join(other, on, "inner")
    for c in compared:
        mine, theirs = F.col(c), F.col(f"_{c}")
        same = F.greatest(mine, theirs) == F.least(mine, theirs)
        joined = joined.where(mine.isNotNull() & theirs.isNotNull() & same)
    return joined.drop(*[f"_{c}" for c in compared])


def _readable_customers(dim: DataFrame, mapped: DataFrame) -> DataFrame:
    """Customer members with their readable name and e-mail; one row per customer key."""
    keys = ["customer_key", "full_name_key", "email_key"]
    readable = mapped.select(
        *keys, F.col("full_name_value").alias("full_name"), F.col("email_value").alias("email")
    )
    return _lookup(dim.select(*keys), readable, keys[:1], keys[1:])


def case_dim_customer(dim: DataFrame, mapped: DataFrame, persona: Persona, cfg: PipelineConfig) -> DataFrame:
    keys = ["customer_key", "customer_id_key", "full_name_key", "email_key", "address_key"]
    readable = mapped.select(
        *keys,
        F.col("customer_id_value").alias("customer_id"),
        F.col("full_name_value").alias("full_name"),
        F.col("email_value").alias("email"),
        F.col("address_value").alias("customer_address"),
    )
    joined = dim.select(*keys, "customer_segment", "is_active").join(readable, keys, "inner")
    return governed_model(
        joined, "case_dim_customer", "CASE_VIEW", "customer_key",
        [*keys, "customer_segment", "is_active", "customer_id", "full_name", "email", "customer_address"],
        flag=None, predicate=case_access(persona), erased_key=cfg.erased_member_key,
    )


def case_dim_service(dim: DataFrame, mapped: DataFrame, persona: Persona, cfg: PipelineConfig) -> DataFrame:
    keys = ["customer_key", "service_key", "service_version_key", "installation_address_key"]
    plain = ["service_type", "is_valid", "valid_from", "valid_to"]
    readable = mapped.select(
        *keys,
        F.col("service_id_value").alias("service_id"),
        F.col("installation_address_value").alias("installation_address"),
    )
    joined = dim.select(*keys, *plain).join(readable, keys, "inner")
    return governed_model(
        joined, "case_dim_service", "CASE_VIEW", "service_version_key",
        [*keys, *plain, "service_id", "installation_address"],
        flag=None, predicate=case_access(persona), erased_key=cfg.erased_member_key,
    )


def case_fct_event(fact: DataFrame, dim: DataFrame, mapped: DataFrame, persona: Persona) -> DataFrame:
    """Dimension and map are joined first, so the fact is exchanged once, on the customer key."""
    joined = fact.join(_readable_customers(dim, mapped), "customer_key", "inner")
    return governed_model(
        joined, "case_fct_customer_event", "CASE_VIEW", "event_key",
        [
            "event_key", "customer_key", "full_name_key", "email_key", "event_date_key", "occurred_at",
            "event_type", "measure_value", "measure_unit", "full_name", "email",
        ],
        predicate=case_access(persona),
    )


def case_fct_invoice(
    fact: DataFrame,
    customers: DataFrame,
    services: DataFrame,
    mapped_customers: DataFrame,
    mapped_services: DataFrame,
    persona: Persona,
) -> DataFrame:
    """Four joins, two exchanges of the fact (customer key, then service tuple), one of each lookup; keys travel packed."""
    tuple_keys = ["customer_key", "service_key", "service_version_key"]
    service_keys = [*tuple_keys, "installation_address_key"]
    customer_keys = ["customer_key", "full_name_key", "email_key"]
    readable_services = _lookup(
        packed(services.select(*service_keys), *service_keys),
        packed(mapped_services, *service_keys).select(
            *service_keys,
            F.col("service_id_value").alias("service_id"),
            F.col("installation_address_value").alias("installation_address"),
        ),
        tuple_keys,
        ["installation_address_key"],
    )
    readable_customers = _readable_customers(*(packed(df, *customer_keys) for df in (customers, mapped_customers)))
    joined = packed(fact, *tuple_keys).join(readable_customers, "customer_key", "inner").join(readable_services, tuple_keys, "inner")
    return governed_model(
        unpacked(joined, *service_keys, *customer_keys[1:]), "case_fct_invoice", "CASE_VIEW", "invoice_key",
        [
            "invoice_key", *tuple_keys, "full_name_key", "email_key", "installation_address_key",
            "issue_date_key", "due_date_key", "paid_date_key", "amount", "currency_code", "is_paid",
            "is_due", "full_name", "email", "service_id", "installation_address",
        ],
        predicate=case_access(persona),
    )


def masked_map(mapped: DataFrame, persona: Persona) -> DataFrame:
    """Readable columns replaced by the key column bound to them, unless the persona may read them."""
    columns = []
    for field in mapped.schema.fields:
        key = field.metadata.get("mask_column")
        raw = F.col(field.name)
        if key is not None:
            raw = mask_value(raw, F.col(key), persona).alias(field.name, metadata=field.metadata)
        columns.append(raw)
    return mapped.select(*columns)


def expected_grants(spark: SparkSession) -> DataFrame:
    """The read matrix as rows: who may SELECT what."""
    rows = [
        (group, schema, name)
        for schema, names, groups in READ_MATRIX
        for name in names
        for group in groups
    ]
    return literal_relation(spark, rows, GRANT_SCHEMA)


def matrix_grants(spark: SparkSession) -> DataFrame:
    """The grants that give just the read matrix: SELECT on its relations and USE SCHEMA on their schemas."""
    matrix = expected_grants(spark)
    reads = matrix.select("grantee", F.lit("SELECT").alias("privilege"), "table_schema", "table_name")
    uses = matrix.select("grantee", F.lit("USE SCHEMA").alias("privilege"), "table_schema", F.lit("").alias("table_name"))
    return reads.unionByName(uses.distinct())


def readable_relations(spark: SparkSession, persona: Persona) -> DataFrame:
    """Relations the persona may read through any of its groups."""
    grants = expected_grants(spark)
    return grants.where(F.col("grantee").isin(*sorted(persona.groups) or [""])).select(
        "table_schema", "table_name"
    ).distinct()


def denied_relations(spark: SparkSession, persona: Persona) -> DataFrame:
    """Relations of the read matrix that the persona may not read."""
    return (
        expected_grants(spark)
        .select("table_schema", "table_name")
        .distinct()
        .join(readable_relations(spark, persona), ["table_schema", "table_name"], "left_anti")
    )


def require_readable(persona: Persona, names: Iterable[str]) -> None:
    """Refuse a read before any plan is built."""
    allowed = {
        name
        for _, relations, groups in READ_MATRIX
        for name in relations
        if persona.groups & set(groups)
    }
    denied = sorted(set(names) - allowed)
    if denied:
        raise PermissionError(f"not readable for {sorted(persona.groups)}: {denied}")


def map_resolution_check(mapped: DataFrame, relation: str) -> DataFrame:
    """Rows, rows with every readable column masked, and rows with none masked, from the mask bindings."""
    masked = resolved = F.lit(True)
    bindings = [(f.name, f.metadata["mask_column"]) for f in mapped.schema.fields if "mask_column" in f.metadata]
    for column, key in bindings:
        masked = masked & (F.col(column) == F.col(key))
        resolved = resolved & (F.col(column) != F.col(key))
    return mapped.agg(
        F.count("*").alias("row_count"),
        F.count_if(masked).alias("masked_rows"),
        F.count_if(resolved).alias("resolved_rows"),
    ).select(F.lit(relation).alias("relation"), "row_count", "masked_rows", "resolved_rows")


# Readable columns of each case view and the key column each one resolves.
CASE_COLUMNS = {
    "case_dim_customer": (
        ("customer_id", "customer_id_key"), ("full_name", "full_name_key"), ("email", "email_key"),
        ("customer_address", "address_key"),
    ),
    "case_dim_service": (
        ("service_id", "service_key"), ("installation_address", "installation_address_key"),
    ),
    "case_fct_customer_event": (("full_name", "full_name_key"), ("email", "email_key")),
    "case_fct_invoice": (
        ("full_name", "full_name_key"), ("email", "email_key"), ("service_id", "service_key"),
        ("installation_address", "installation_address_key"),
    ),
}


def case_resolution_checks(case_views: Mapping[str, DataFrame]) -> DataFrame:
    """Per case view: rows, and rows whose readable columns are all resolved."""
    checks = []
    for name, df in case_views.items():
        resolved = F.lit(True)
        for column, key in CASE_COLUMNS[name]:
            resolved = resolved & (F.col(column) != F.col(key))
        checks.append(
            df.agg(F.count("*").alias("row_count"), F.count_if(resolved).alias("resolved_rows")).select(
                F.lit(name).alias("relation"), "row_count", "resolved_rows"
            )
        )
    return union_all(checks)
