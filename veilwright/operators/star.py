"""Dimensions and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwright.config import PipelineConfig
from veilwright.functions.text import date_key
from veilwright.operators.policy import governed_model
from veilwright.schemas import CONTRACTS


def erased_member(spark: SparkSession, schema: T.StructType, cfg: PipelineConfig) -> DataFrame:
    """The one special row of a dimension: sentinel keys, ERASED_SUBJECT label, fixed past dates."""
    columns = []
    for field in schema.fields:
        if field.name.endswith("_key"):
            value = cfg.erased()
        elif field.dataType == T.BooleanType():
            value = F.lit(False)
        elif field.dataType == T.StringType():
            value = F.lit("ERASED_SUBJECT")
        else:
            value = F.lit("1900-01-01 00:00:00").cast("timestamp")
        columns.append(value.cast(field.dataType).alias(field.name))
    return spark.range(1).select(*columns)


def _with_erased_member(df: DataFrame, name: str, cfg: PipelineConfig) -> DataFrame:
    schema = CONTRACTS[name]
    return df.select(schema.names).unionByName(erased_member(df.sparkSession, schema, cfg))


def dim_customer(protected: DataFrame, cfg: PipelineConfig) -> DataFrame:
    return _with_erased_member(protected, "dim_customer", cfg)


def dim_service(services: DataFrame, cfg: PipelineConfig) -> DataFrame:
    return _with_erased_member(services, "dim_service", cfg)


def dim_date(spark: SparkSession, cfg: PipelineConfig) -> DataFrame:
    """One row per day of the configured range; day 1 of the week is Sunday."""
    bounds = spark.range(1).select(
        F.explode(
            F.sequence(F.lit(cfg.date_start).cast("date"), F.lit(cfg.date_end).cast("date"))
        ).alias("date_day")
    )
    day = F.col("date_day")
    return bounds.select(
        date_key(day).alias("date_key"),
        "date_day",
        F.year(day).alias("calendar_year"),
        F.quarter(day).alias("calendar_quarter"),
        F.month(day).alias("month_number"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.dayofmonth(day).alias("day_of_month"),
        F.dayofweek(day).alias("day_of_week"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.weekofyear(day).alias("iso_week_number"),
        F.dayofweek(day).isin(1, 7).alias("is_weekend"),
    )


def fct_event(events: DataFrame) -> DataFrame:
    return (
        events.withColumnRenamed("event_id", "event_key")
        .withColumn("event_date_key", date_key(F.col("occurred_at")))
        .select(CONTRACTS["fct_customer_event"].names)
    )


def fct_invoice(invoices: DataFrame, ledger: DataFrame) -> DataFrame:
    """Calendar keys, then the leak guard: no row with a ledger key gets through."""
    projected = (
        invoices.withColumnRenamed("invoice_id", "invoice_key")
        .withColumn("issue_date_key", date_key(F.col("issued_date")))
        .withColumn("due_date_key", date_key(F.col("due_date")))
        .withColumn("paid_date_key", date_key(F.col("paid_at")))
    )
    return governed_model(
        projected,
        "fct_invoice",
        "FACT",
        "invoice_key",
        CONTRACTS["fct_invoice"].names,
        ledger,
        special_columns=["customer_key", "service_key", "service_version_key"],
        policy_applied=True,
    )
