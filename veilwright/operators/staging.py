"""Typed staging of the five extracts: one projection each, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.config import PipelineConfig
from veilwright.functions.text import blank_to_null


def _id(name: str) -> Column:
    return F.trim(F.col(name)).alias(name)


def _text(name: str) -> Column:
    return blank_to_null(F.trim(F.col(name))).alias(name)


def _code(name: str) -> Column:
    return F.upper(F.trim(F.col(name))).alias(name)


def _optional_code(name: str) -> Column:
    return blank_to_null(F.upper(F.trim(F.col(name)))).alias(name)


def _typed(name: str, kind: str) -> Column:
    return F.col(name).cast(kind).alias(name)


def _optional(name: str, kind: str) -> Column:
    return blank_to_null(F.trim(F.col(name))).cast(kind).alias(name)


def stage_customer(df: DataFrame) -> DataFrame:
    return df.select(
        _id("customer_change_id"),
        _typed("customer_pk", "bigint"),
        _id("customer_id"),
        _id("customer_ssn"),
        _text("first_name"),
        _text("last_name"),
        _text("email"),
        _text("phone"),
        _optional("birth_date", "date"),
        _text("address_line1"),
        _text("address_line2"),
        _text("city"),
        _text("postal_code"),
        _optional_code("country_code"),
        _text("customer_segment"),
        _typed("is_active", "boolean"),
        _code("source_operation"),
        _typed("source_updated_at", "timestamp"),
    )


def stage_events(df: DataFrame) -> DataFrame:
    return df.select(
        _id("event_id"),
        _id("customer_ssn"),
        _code("event_type"),
        _typed("occurred_at", "timestamp"),
        _typed("measure_value", "decimal(18,2)"),
        _code("measure_unit"),
        _typed("source_updated_at", "timestamp"),
    )


def stage_services(df: DataFrame) -> DataFrame:
    return df.select(
        _id("service_id"),
        _id("customer_ssn"),
        _code("service_type"),
        _text("installation_address_line1"),
        _text("installation_address_line2"),
        _text("installation_city"),
        _text("installation_postal_code"),
        _optional_code("installation_country_code"),
        _typed("is_valid", "boolean"),
        _typed("valid_from", "date"),
        _typed("valid_to", "date"),
        _typed("source_updated_at", "timestamp"),
    )


def stage_invoices(df: DataFrame) -> DataFrame:
    return df.select(
        _id("invoice_id"),
        _id("customer_ssn"),
        _id("service_id"),
        _typed("amount", "decimal(18,2)"),
        _code("currency_code"),
        _typed("issued_date", "date"),
        _typed("due_date", "date"),
        _typed("is_paid", "boolean"),
        _optional("paid_at", "date"),
        _typed("is_due", "boolean"),
        _typed("source_updated_at", "timestamp"),
    )


def stage_decisions(df: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Decision revisions recorded up to the cutoff; undated ones stay and are classified later."""
    cutoff = F.lit(cfg.decision_as_of).cast("timestamp")
    recorded = F.col("recorded_at")
    return df.select(
        _id("decision_revision_id"),
        _id("deletion_request_id"),
        _code("decision_status"),
        _optional_code("deletion_mode"),
        _optional_code("deletion_policy_version"),
        _optional("recorded_at", "timestamp"),
        _optional("decided_at", "timestamp"),
        _text("decided_by_role"),
        _text("decision_reason"),
        _typed("legal_hold", "boolean"),
    ).where(recorded.isNull() | (recorded <= cutoff))


def stage_decisions_teaching(df: DataFrame) -> DataFrame:
    """Teaching variant: no cutoff, and empty mode or policy text is not turned into null."""
    return df.select(
        _id("decision_revision_id"),
        _id("deletion_request_id"),
        _code("decision_status"),
        _code("deletion_mode"),
        _code("deletion_policy_version"),
        _optional("recorded_at", "timestamp"),
        _optional("decided_at", "timestamp"),
        _text("decided_by_role"),
        _text("decision_reason"),
        _typed("legal_hold", "boolean"),
    )
