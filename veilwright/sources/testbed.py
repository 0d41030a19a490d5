"""Deterministic source extracts derived from the TPC-H-like test tables.

Every customer, order and event becomes extract rows by arithmetic on its own key, with the edge
cases the pipeline has to handle. All columns are strings, as in a real extract. SSNs leave room
for 100 million customers.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.config import PipelineConfig
from veilwright.session import scratch_path
from veilwright.sources.extracts import read_extract

TESTBED = PipelineConfig(
    pepper="testbed-pepper-not-secret",
    as_of_date="1999-01-01",
    date_start="1995-01-01",
    date_end="2001-12-31",
    run_ts="2026-03-01 00:00:00",
)
# A first run that sees only the early decisions, and a second run that sees all of them.
EARLY_CUTOFF = "2026-02-20 00:00:00"
SECOND_RUN_TS = "2026-03-02 00:00:00"

_CURRENT, _UNKNOWN, _HISTORICAL = 100_000_000, 300_000_000, 600_000_000


def _text(value) -> Column:
    return F.lit(value) if isinstance(value, str) else value.cast("string")


def _cat(*parts) -> Column:
    return F.concat(*[_text(p) for p in parts])


def _every(key: Column, n: int) -> Column:
    return (key % n) == 0


def _padded(key: Column, width: int = 10) -> Column:
    return F.lpad(key.cast("string"), width, "0")


def _ssn(key: Column, base: int) -> Column:
    """Nine digits, dashed for even keys, with stray spaces for every seventh."""
    digits = (key + base).cast("string")
    dashed = _cat(digits.substr(1, 3), "-", digits.substr(4, 2), "-", digits.substr(6, 4))
    written = F.when(_every(key, 2), dashed).otherwise(digits)
    return F.when(_every(key, 7), _cat(" ", written, " ")).otherwise(written)


def _read(spark: SparkSession, sf_dir: str, table: str, parts: int | None = None) -> DataFrame:
    """A source table; with parts, dealt evenly: the few columns that a builder reads, not the rows it makes of them.

    Files that are read in as many splits are not dealt again.
    """
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return rows if parts is None or rows.rdd.getNumPartitions() >= parts else rows.repartition(parts)


def _variants(choices: list[tuple[str, Column | None]]) -> Column:
    """One row per variant that applies; None means always."""
    entries = [F.lit(v) if test is None else F.when(test, F.lit(v)) for v, test in choices]
    return F.explode(F.array_compact(F.array(*entries)))


def customer_feed(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """U1 for all; U2 newer; D1 a deletion; U3 a return after it."""
    k = F.col("c_custkey")
    rows = _read(spark, sf_dir, "customer", parts).withColumn(
        "v",
        _variants([("U1", None), ("U2", _every(k, 10)), ("D1", _every(k, 17)), ("U3", _every(k, 51))]),
    )
    v = F.col("v")
    gone = v == "D1"

    def kept(value: Column, blank: Column | None = None) -> Column:
        empty = gone if blank is None else gone | blank
        return F.when(empty, "").otherwise(value)

    first_seen = _cat("2026-01-", F.lpad((1 + k % 20).cast("string"), 2, "0"), "T09:00:00")
    changed = (
        F.when(v == "U1", first_seen)
        .when((v == "U2") & _every(k, 30), first_seen)
        .when(v == "U2", "2026-01-25T09:00:00")
        .when(v == "D1", _cat("2026-02-1", k % 10, "T12:00:00"))
        .otherwise("2026-02-24T12:00:00")
    )
    city_missing = _every(k, 29) | _every(k, 19)
    return rows.select(
        _cat(F.when(_every(k, 5), " ").otherwise(""), "CCHG-", _padded(k), "-", v).alias("customer_change_id"),
        k.cast("string").alias("customer_pk"),
        _cat("CUST-", _padded(k)).alias("customer_id"),
        F.when((v == "U1") & _every(k, 50), _ssn(k, _HISTORICAL)).otherwise(_ssn(k, _CURRENT)).alias("customer_ssn"),
        kept(_cat("  ", F.col("c_name"))).alias("first_name"),
        kept(F.col("c_mktsegment"), _every(k, 11)).alias("last_name"),
        kept(_cat(" User", k, "@Example.Invalid"), _every(k, 13)).alias("email"),
        kept(
            _cat("+358 (", F.lpad((k % 1000).cast("string"), 3, "0"), ") ", F.lpad((k % 10000).cast("string"), 4, "0")),
            _every(k, 23),
        ).alias("phone"),
        kept(F.date_add(F.lit("1950-01-01").cast("date"), (k % 20000).cast("int")).cast("string")).alias("birth_date"),
        kept(_cat(k, " Demo  Street"), _every(k, 29)).alias("address_line1"),
        kept(F.when(_every(k, 3), "Rear").otherwise("")).alias("address_line2"),
        kept(_cat(" City ", F.col("c_nationkey")), city_missing).alias("city"),
        kept(F.lpad((k % 100000).cast("string"), 5, "0"), _every(k, 29)).alias("postal_code"),
        kept(F.lit(" fi"), _every(k, 58)).alias("country_code"),
        kept(F.when(v == "U2", "UPGRADED").otherwise(F.col("c_mktsegment"))).alias("customer_segment"),
        F.when(gone | (F.col("c_acctbal") < 0) | ((v == "U2") & _every(k, 70)), "False")
        .otherwise("True")
        .alias("is_active"),
        F.when(gone, "delete").when(_every(k, 2), "UPSERT").otherwise(" upsert ").alias("source_operation"),
        changed.alias("source_updated_at"),
    )


def decisions(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Decision revisions for nine of every ten deletion requests; some get a second revision."""
    k = F.col("c_custkey")
    case = F.floor(k / 17) % 10
    rows = (
        _read(spark, sf_dir, "customer", parts)
        .where(_every(k, 17) & (case != 6))
        .select(k.alias("k"), case.cast("int").alias("m"))
        .withColumn("r", _variants([("1", None), ("2", F.col("m").isin(1, 8, 9))]))
    )
    k, m, r = F.col("k"), F.col("m"), F.col("r")
    first = r == "1"
    recorded = F.when(first, "2026-02-16T08:00:00").otherwise("2026-02-25T08:00:00")
    return rows.select(
        _cat("DEC-", _padded(k), "-", r).alias("decision_revision_id"),
        _cat("CCHG-", _padded(k), "-D1 ").alias("deletion_request_id"),
        F.when(first & (m == 4), " rejected")
        .when(first & (m == 7), "pending")
        .when(~first & (m == 1), "REJECTED")
        .otherwise("confirmed")
        .alias("decision_status"),
        F.when((first & m.isin(4, 7)) | (~first & (m == 1)), "")
        .when((first & (m == 1)) | (~first & (m == 8)), "FULL_GOVERNED_OUTPUT_DELETION")
        .otherwise("special_deletion")
        .alias("deletion_mode"),
        F.when((m == 5) & _every(k, 2), "customer_deletion_v0")
        .otherwise("CUSTOMER_DELETION_V1")
        .alias("deletion_policy_version"),
        F.when((m == 5) & ~_every(k, 2), "").otherwise(recorded).alias("recorded_at"),
        recorded.alias("decided_at"),
        F.when((m == 5) & _every(k, 3), "").otherwise("privacy_admin").alias("decided_by_role"),
        F.lit("VERIFIED_SOURCE_DELETION").alias("decision_reason"),
        F.when(m == 2, "True").when(m == 3, F.lit(None)).otherwise("False").alias("legal_hold"),
    )


def customer_events(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    e, user, ts = F.col("event_id"), F.col("user_id"), F.col("ts")
    return _read(spark, sf_dir, "events", parts).select(
        _cat("EVT-", _padded(e, 12)).alias("event_id"),
        F.when(_every(e, 50), _ssn(user, _UNKNOWN)).otherwise(_ssn(user, _CURRENT)).alias("customer_ssn"),
        _cat(F.col("event_type"), " ").alias("event_type"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("occurred_at"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("measure_value"),
        F.when(F.col("event_type").isin("view", "click"), "gb ").otherwise("minutes").alias("measure_unit"),
        _cat(F.date_format(ts, "yyyy-MM-dd"), "T23:00:00").alias("source_updated_at"),
    )


def customer_services(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """A for most; B a second service; O a second, overlapping period of A; X an unknown owner's."""
    k = F.col("c_custkey")
    rows = _read(spark, sf_dir, "customer", parts).withColumn(
        "v",
        _variants([("A", ~_every(k, 43)), ("B", _every(k, 3)), ("O", _every(k, 41)), ("X", _every(k, 53))]),
    )
    v = F.col("v")
    service_id = _cat("SVC-", _padded(k), "-", F.when(v == "O", "A").otherwise(v))
    no_address = _every(k, 59)

    def kept(value: Column) -> Column:
        return F.when(no_address, "").otherwise(value)

    return rows.select(
        F.when(_every(k, 2), service_id).otherwise(F.lower(service_id)).alias("service_id"),
        F.when(v == "X", _ssn(k, _UNKNOWN)).otherwise(_ssn(k, _CURRENT)).alias("customer_ssn"),
        F.when(v == "B", " mobile").otherwise("internet").alias("service_type"),
        kept(_cat(k + 200, " Socket Lane")).alias("installation_address_line1"),
        kept(F.when(v == "B", "Rear").otherwise("")).alias("installation_address_line2"),
        kept(_cat("City ", F.col("c_nationkey"))).alias("installation_city"),
        kept(F.lpad((k % 100000).cast("string"), 5, "0")).alias("installation_postal_code"),
        kept(F.lit("fi")).alias("installation_country_code"),
        F.when((v == "A") & _every(k, 31), "False").otherwise("True").alias("is_valid"),
        F.when(v == "O", F.lit("1996-01-01"))
        .otherwise(F.date_add(F.lit("1994-06-01").cast("date"), (k % 200).cast("int")).cast("string"))
        .alias("valid_from"),
        F.when((v == "A") & _every(k, 37), "1993-12-31")
        .when((v == "A") & _every(k, 47), "1998-06-30")
        .otherwise("2003-12-31")
        .alias("valid_to"),
        F.lit("2026-02-01T10:00:00").alias("source_updated_at"),
    )


def invoices(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    issued = F.col("o_orderdate").cast("date")
    owner = F.when(_every(o, 23), k + 1).otherwise(k)
    letter = F.when(_every(owner, 3) & (o % 2 == 1), "B").otherwise("A")
    status = F.col("o_orderstatus")
    paid = status == "F"

    def day(offset: int) -> Column:
        return F.date_add(issued, offset).cast("string")

    return _read(spark, sf_dir, "orders", parts).select(
        _cat("INV-", _padded(o, 12)).alias("invoice_id"),
        F.when(_every(o, 41), _ssn(k, _UNKNOWN))
        .when(_every(o, 13) & _every(k, 50), _ssn(k, _HISTORICAL))
        .otherwise(_ssn(k, _CURRENT))
        .alias("customer_ssn"),
        F.when(_every(o, 61), _cat("SVC-NONE-", o))
        .otherwise(_cat("SVC-", _padded(owner), "-", letter))
        .alias("service_id"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"),
        F.lit(" eur").alias("currency_code"),
        issued.cast("string").alias("issued_date"),
        F.when(_every(o, 29), day(-5)).otherwise(day(30)).alias("due_date"),
        F.when(_every(o, 97), F.lit(None)).when(paid, "True").otherwise("False").alias("is_paid"),
        F.when(paid & _every(o, 19), "")
        .when(paid & _every(o, 37), day(-3))
        .when(paid, day(10))
        .when(_every(o, 31), day(5))
        .otherwise("")
        .alias("paid_at"),
        F.when(status == "O", "True").otherwise("False").alias("is_due"),
        F.lit("2026-02-28T18:00:00").alias("source_updated_at"),
    )


_BUILDERS = {
    "customer": customer_feed,
    "customer_deletion_confirmations": decisions,
    "customer_events": customer_events,
    "customer_services": customer_services,
    "invoices": invoices,
}
_TABLES = ("customer", "events", "orders")
_landed: dict[tuple[str, str, int, str], str] = {}


def input_version(spark: SparkSession, sf_dir: str) -> int:
    """A number that changes with the files of the source tables; reads names, sizes and times only."""
    files = spark.read.format("binaryFile").load([f"{sf_dir}/{t}.parquet" for t in _TABLES])
    return files.agg(F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()[0] or 0


def synth_extracts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: build(spark, sf_dir) for name, build in _BUILDERS.items()}


class LandedExtracts(Mapping):
    """The same extracts written as parquet files to the shared folder, each on first use.

    The pipeline then starts from files with string columns, as it would from real extracts.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark = spark
        self._sf_dir = sf_dir.rstrip("/")
        self.version = input_version(spark, self._sf_dir)

    def __getitem__(self, name: str) -> DataFrame:
        key = (self._spark.sparkContext.applicationId, self._sf_dir, self.version, name)
        if key not in _landed:
            path = scratch_path(self._spark, f"extract-{name}")
            # Dealt evenly where the source's files have fewer splits.
            rows = _BUILDERS[name](self._spark, self._sf_dir, self._spark.sparkContext.defaultParallelism)
            rows.write.option("compression", "zstd").parquet(path)
            _landed[key] = path
        return read_extract(self._spark, name, _landed[key])

    def __iter__(self):
        return iter(_BUILDERS)

    def __len__(self) -> int:
        return len(_BUILDERS)
