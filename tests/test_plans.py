"""Plan shapes that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

import fixture_rows as fx
from test_goldens import staged
from veilwright.config import CASE_USERS, Persona
from veilwright.operators import maps, resolve, staging
from veilwright.plans.relations import Relations


@pytest.fixture(scope="module")
def r(spark, cfg):
    return staged(spark, fx.extracts(spark), cfg)


@pytest.fixture(scope="module")
def lazy(spark, cfg, tmp_path_factory):
    """Relations composed in one plan over parquet extracts."""
    folder = tmp_path_factory.mktemp("extracts")
    extracts = {}
    for name, df in fx.extracts(spark).items():
        df.write.parquet(f"{folder}/{name}")
        extracts[name] = spark.read.parquet(f"{folder}/{name}")
    return Relations(spark, extracts, cfg)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def all_relations(r):
    names = (
        "customer_deletion_authorizations", "int_customer_deletion_plan", "int_terminal_deleted_customer_keys",
        "fa_pd_customer", "fa_pd_service_address", "int_customer_event_resolution", "int_customer_service_resolution",
        "int_invoice_resolution", "quarantine_invoices", "dim_customer", "dim_service", "fct_customer_event", "fct_invoice",
    )
    return {n: getattr(r, n) for n in names} | r.case_views(Persona.of(CASE_USERS))


def test_no_python_no_cross_join_no_unpartitioned_window(lazy):
    for name, df in all_relations(lazy).items():
        plan = physical(df)
        for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
            assert bad not in plan, (name, bad)


def test_rank_is_limited_before_the_shuffle(lazy):
    plan = physical(maps.latest_upserts(lazy.stg_customer))
    assert plan.count("WindowGroupLimit") == 2
    exchange = plan.index("Exchange hashpartitioning(customer_id")
    assert plan.index("WindowGroupLimit") < exchange < plan.rindex("WindowGroupLimit")


def test_scans_read_only_needed_columns(lazy):
    keys = physical(lazy.int_customer_events_keyed.select("event_id", "customer_key"))
    assert re.search(r"ReadSchema: struct<event_id:string,customer_ssn:string>", keys)
    requests = physical(lazy.customer_deletion_requests)
    assert "first_name" not in requests and "email" not in requests


def test_staged_keys_are_not_hashed_again(r):
    """Joins read keyed relations that were written before: no plan behind them makes a key."""
    for df in (r.fct_invoice, r.int_customer_event_resolution, r.int_customer_service_resolution, r.int_invoice_resolution):
        assert "sha2" not in physical(df)
    resolved = resolve.resolve_invoices(
        r.int_invoices_keyed, r.int_customer_services_keyed, r.int_customer_services_resolved, r.ledger, r.fa_pd_customer, r.cfg
    )
    assert "sha2" not in physical(resolved)


def test_settings_leave_the_optimizer_alone(spark):
    assert spark.conf.get("spark.sql.constraintPropagation.enabled") == "true"


def test_each_lookup_of_the_invoice_view_is_exchanged_once(r, skew_settings):
    plan = _exchange_outputs(r.case_fct_invoice(Persona.of(CASE_USERS)))
    assert len(plan) == 6


def test_invoices_are_exchanged_once_when_the_ledger_and_map_are_small(r):
    df = resolve.resolve_invoices(
        r.int_invoices_keyed, r.int_customer_services_keyed, r.int_customer_services_resolved, r.ledger,
        r.fa_pd_customer, r.cfg,
    )
    assert sum("amount" in line for line in _exchange_outputs(df)) <= 1


def _exchange_outputs(df):
    """Output columns of every exchange, one text per exchange."""
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)", text)


def test_partition_audit_needs_one_exchange(r):
    from veilwright.operators import audits as A

    df = A.audit_partition(
        A.expected_occurrences(r.int_invoices_keyed, r.ledger, "invoice_id"),
        [r.int_invoices_resolved, r.quarantine_invoices],
        "invoice_id",
    )
    assert len(_exchange_outputs(df)) == 1


def test_pepper_is_redacted(lazy):
    text = lazy.fa_pd_customer._jdf.queryExecution().explainString(
        lazy.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended")
    )
    assert "sha2" in text and "fixture-pepper" not in text


@pytest.fixture
def skew_settings(spark):
    changed = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _skewed_invoices(spark, hot_customer):
    hot = F.col("id") % 3 == 0
    customer = F.when(hot, "c0").otherwise(F.concat(F.lit("c"), F.col("id") % 5000))
    return spark.range(0, 150000, 1, 8).select(
        F.format_string("i%09d", "id").alias("invoice_id"),
        (customer if hot_customer else F.concat(F.lit("c"), F.col("id"))).alias("customer_key"),
        F.when(hot, "s0").otherwise(F.concat(F.lit("s"), F.col("id") % 5000)).alias("service_key"),
        F.lit("2026-01-02").cast("date").alias("issued_date"),
        F.lit(None).cast("string").alias("deletion_mode"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )


@pytest.mark.parametrize("hot_customer", [True, False])
def test_hot_service_is_split(spark, skew_settings, hot_customer):
    """A third of the invoices on one service: for one customer and day, or over many customers."""
    services = spark.range(0, 5000, 1, 4).select(
        F.concat(F.lit("c"), F.col("id")).alias("customer_key"),
        F.concat(F.lit("s"), F.col("id")).alias("service_key"),
        F.concat(F.lit("v"), F.col("id")).alias("service_version_key"),
        F.lit(True).alias("is_valid"),
        F.lit("2025-01-01").cast("date").alias("valid_from"),
        F.lit("2027-01-01").cast("date").alias("valid_to"),
        F.lit(None).cast("string").alias("deletion_mode"),
    )
    stats = resolve.with_service_stats(_skewed_invoices(spark, hot_customer), services, services)
    out = stats.groupBy("service_period_count").agg(F.count("*").alias("n"), F.count("payload").alias("p"))
    assert [tuple(x) for x in out.collect()] == [(1, 150000, 150000)]
    assert "skew=true" in physical(out)


def test_hot_customer_is_split_in_fact_joins(spark, cfg, skew_settings):
    events = _skewed_invoices(spark, True).select(
        F.col("invoice_id").alias("event_id"), "customer_key", F.lit("USAGE").alias("event_type"),
        F.lit(None).cast("timestamp").alias("occurred_at"), F.lit(1).cast("decimal(18,2)").alias("measure_value"),
        F.col("payload").alias("measure_unit"), F.lit(None).cast("timestamp").alias("source_updated_at"),
    )
    keys = spark.range(0, 5000, 1, 4).select(F.concat(F.lit("c"), F.col("id")).alias("customer_key"))
    ledger = spark.range(6000, 6100).select(
        F.concat(F.lit("c"), F.col("id")).alias("customer_key"), F.lit("SPECIAL_DELETION").alias("deletion_mode")
    )
    out = resolve.resolve_events(events, ledger, keys, cfg).groupBy("resolution_status").agg(F.count("measure_unit").alias("n"))
    assert [tuple(x) for x in out.collect()] == [("ACCEPTED", 150000)]
    assert "skew=true" in physical(out)


def test_staging_adds_no_exchange(lazy):
    for df in (lazy.stg_customer, lazy.stg_invoices, lazy.int_invoices_keyed, lazy.int_customer_services_keyed):
        assert "Exchange" not in physical(df)
    assert staging.stage_events(lazy.extracts["customer_events"]).schema == lazy.stg_customer_events.schema


def test_erased_rows_are_spread_over_the_leak_guard(spark, skew_settings):
    """A third of the rows erased, all with one key: the guard's exchange deals them evenly."""
    from veilwright.operators import policy

    erased = F.col("id") % 3 == 0
    rows = spark.range(0, 60000, 1, 8).select(
        F.col("id").alias("row_id"),
        F.when(erased, policy.DEFAULT_ERASED_KEY).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("customer_key"),
        erased.alias("is_erased_customer"),
    )
    ledger = spark.range(1, 60000, 2).select(F.concat(F.lit("k"), F.col("id")).alias("customer_key"), F.lit("x").alias("deletion_mode"))
    out = policy.governed_model(
        rows, "fact", "FACT", "row_id", ["row_id", "customer_key", "is_erased_customer"], ledger,
        special_columns="customer_key", policy_applied=True,
    )
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40000 and out.where("is_erased_customer").count() == 20000
    assert max(sizes) < 2 * 40000 / 16
