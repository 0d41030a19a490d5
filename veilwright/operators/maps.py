"""Current state and the restricted identity maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwright.config import KeyScheme, PipelineConfig
from veilwright.functions import keys as K
from veilwright.functions.text import compose_address, full_name, iso_date
from veilwright.operators.policy import without_deleted
from veilwright.schemas import CONTRACTS


def latest_upserts(stg_customer: DataFrame) -> DataFrame:
    """The newest UPSERT per customer_id, before any other filter.

    ``rank = 1`` sits directly on the window, so each input task keeps only one row per customer
    before the shuffle (WindowGroupLimit): a customer with most of the changes costs nothing extra.
    """
    newest = Window.partitionBy("customer_id").orderBy(
        F.col("source_updated_at").desc(), F.col("customer_change_id").desc()
    )
    return (
        stg_customer.where(F.col("source_operation") == "UPSERT")
        .withColumn("change_rank", F.row_number().over(newest))
        .where(F.col("change_rank") == 1)
        .drop("change_rank")
    )


def readable_customer_values(customers: DataFrame) -> DataFrame:
    return customers.select(
        F.col("customer_pk").cast("string").alias("customer_pk_value"),
        F.col("customer_id").alias("customer_id_value"),
        F.col("customer_ssn").alias("customer_ssn_value"),
        F.col("first_name").alias("first_name_value"),
        F.col("last_name").alias("last_name_value"),
        full_name(F.col("first_name"), F.col("last_name")).alias("full_name_value"),
        F.col("email").alias("email_value"),
        F.col("phone").alias("phone_value"),
        iso_date(F.col("birth_date")).alias("birth_date_value"),
        compose_address(
            F.col("address_line1"),
            F.col("address_line2"),
            F.col("postal_code"),
            F.col("city"),
            F.col("country_code"),
        ).alias("address_value"),
        "customer_segment",
        "is_active",
        "source_updated_at",
    )


def keyed_customer_map(customers: DataFrame, scheme: KeyScheme) -> DataFrame:
    """Readable values beside their ten keys (also the teaching map, with its own scheme)."""
    values = readable_customer_values(customers)
    return values.select(*K.customer_keys(scheme), *[F.col(c) for c in values.columns])


def customer_map(stg_customer: DataFrame, ledger: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Current, active, not deleted customers with readable values and keys.

    The deletion check never changes a rank, so ranking and the active filter run first and the
    ledger is joined to one row per customer.
    """
    current = latest_upserts(stg_customer).where(F.col("is_active"))
    return without_deleted(keyed_customer_map(current, cfg.scheme), ledger, "customer_key")


def installation_address(prefix: str = "installation_"):
    return compose_address(
        F.col(f"{prefix}address_line1"),
        F.col(f"{prefix}address_line2"),
        F.col(f"{prefix}postal_code"),
        F.col(f"{prefix}city"),
        F.col(f"{prefix}country_code"),
    )


def service_map(
    stg_services: DataFrame, ledger: DataFrame, customers: DataFrame, cfg: PipelineConfig
) -> DataFrame:
    """Valid service periods of mapped customers, readable values beside their keys."""
    scheme = cfg.scheme
    usable = stg_services.where(F.col("is_valid") & (F.col("valid_to") >= F.col("valid_from")))
    keyed = usable.select(
        *service_keys(scheme),
        F.col("service_id").alias("service_id_value"),
        F.col("customer_ssn").alias("customer_ssn_value"),
        installation_address().alias("installation_address_value"),
        "service_type",
        "is_valid",
        "valid_from",
        "valid_to",
        "source_updated_at",
    )
    names = [c for c in keyed.columns if c.endswith("_key")]
    deleted, known = (K.packed(df.select("customer_key"), "customer_key") for df in (ledger, customers))
    eligible = without_deleted(K.packed(keyed, *names), deleted, "customer_key")
    mapped = K.unpacked(eligible.join(known, "customer_key", "inner"), *names)
    return mapped.select(CONTRACTS["fa_pd_service_address"].names)


def service_keys(scheme: KeyScheme):
    """The four service keys over staged service columns."""
    return [
        K.ssn_key(F.col("customer_ssn"), scheme).alias("customer_key"),
        K.service_id_key(F.col("service_id"), scheme).alias("service_key"),
        K.service_version_key(F.col("service_id"), F.col("valid_from"), scheme).alias(
            "service_version_key"
        ),
        K.installation_address_key(installation_address(), scheme).alias("installation_address_key"),
    ]


def protect_customer(customers: DataFrame) -> DataFrame:
    """The 13-column allowlist: keys and analytical attributes, no readable value."""
    return customers.select(CONTRACTS["int_customer_protected"].names)


def current_customers(stg_customer: DataFrame, deleted_ssns: DataFrame) -> DataFrame:
    """Teaching variant: current active customers by raw SSN, deleted identities removed."""
    current = latest_upserts(stg_customer).where(F.col("is_active"))
    return without_deleted(current, deleted_ssns, "customer_ssn", ledger_key="customer_ssn")


def suppressed_identifiers(ledger: DataFrame, requests: DataFrame, stg_customer: DataFrame) -> DataFrame:
    """Every SSN behind the ledger, rebuilt from requests and history without the key function."""
    admitted = (
        ledger.select(F.explode(F.array("deletion_request_id", "initial_deletion_request_id")).alias("deletion_request_id"))
        .distinct()
    )
    customers = (
        requests.join(admitted, "deletion_request_id", "left_semi").select("customer_id").distinct()
    )
    identities = (
        stg_customer.where(F.col("customer_ssn").isNotNull()).select("customer_id", "customer_ssn").distinct()
    )
    return (
        identities.join(customers, "customer_id", "left_semi")
        .select(F.replace(F.trim("customer_ssn"), F.lit("-"), F.lit("")).alias("normalized_ssn"))
        .distinct()
    )
