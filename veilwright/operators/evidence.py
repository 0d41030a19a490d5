"""Append-only evidence: hashed row archives, execution events, verification and recovery."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwright.config import FULL, PipelineConfig
from veilwright.operators.audits import differing_ranges
from veilwright.operators.controls import LEDGER
from veilwright.schemas import CONTRACTS, CONTROL_KEYS
from veilwright.sources.tables import AtomicLog, literal_relation, union_all

HISTORY_SCHEMA = (
    "source_relation string, payload_hash string, payload string, archived_at timestamp, "
    "invocation_id string"
)
HISTORY_COLUMNS = ("source_relation", "payload_hash", "payload", "archived_at", "invocation_id")
#: As stored: with a row's key as JSON and its deletion mode, for controls.
STORED_SCHEMA = f"{HISTORY_SCHEMA}, record_key string, record_mode string"
STORED_COLUMNS = (*HISTORY_COLUMNS, "record_key", "record_mode")
EVENT_SCHEMA = (
    "execution_id string, target_relation string, plan_digest string, status string, "
    "recorded_at timestamp, invocation_id string"
)
# Fixed values.
STATUSES = ("PENDING", "COMPLETED", "FAILED", "VERIFIED")
WORKFLOW = "__workflow__"
NO_DIGEST = "0" * 64
EVIDENCE_RELATIONS = ("control_history", "execution_events")

# Full precision, so a restored timestamp equals the archived one.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class EvidenceError(RuntimeError):
    """Durable evidence contradicts the requested operation."""


def check_execution_id(value: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,128}", value):
        raise ValueError(f"invalid execution id: {value!r}")
    return value


class EvidenceStore:
    """The two append-only tables, kept apart from the analytical tables."""

    def __init__(self, spark: SparkSession, root: str, table_root: str):
        if root.rstrip("/").lower() == table_root.rstrip("/").lower():
            raise ValueError("evidence must not share a folder with analytical tables")
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, name: str) -> str:
        if name not in EVIDENCE_RELATIONS:
            raise ValueError(f"unknown evidence relation: {name!r}")
        return f"{self.root}/{name}"

    def bootstrap(self) -> None:
        """Create both tables empty where they do not exist yet."""
        for name, schema in zip(EVIDENCE_RELATIONS, (HISTORY_SCHEMA, EVENT_SCHEMA)):
            empty = literal_relation(self.spark, [], STORED_SCHEMA if name == "control_history" else schema)
            folder = "source_relation=none/batch=bootstrap" if name == "control_history" else "batch=bootstrap"
            if name == "control_history":
                empty = empty.drop("source_relation")
            empty.write.mode("ignore").parquet(f"{self._path(name)}/{folder}")

    def _segment_log(self, relation: str) -> AtomicLog:
        return AtomicLog(self.spark, f"{self._path('control_history')}/source_relation={relation}/_segments")

    def _listed(self, relation: str) -> tuple[list[str], list[str]]:
        """Folders of a relation that hold its history: segments, and the batches that none of them has taken in."""
        root = f"{self._path('control_history')}/source_relation={relation}"
        found = self._segment_log(relation).last()[1]
        covered = set(found.get("covered", []))
        batches = [b for b in _folders(self.spark, root) if b.startswith("batch=") and b not in covered]
        return [f"{root}/{s}" for s in found.get("segments", [])], [f"{root}/{b}" for b in sorted(batches)]

    def _rows(self, segments: Sequence[str], batches: Sequence[str]) -> DataFrame:
        """Rows of segments (with the bucket of their hash) and of batches (bucket null)."""
        root = self._path("control_history")
        reader = self.spark.read.option("basePath", root)
        columns = [*STORED_COLUMNS, "bucket"]
        frames = []
        if batches:
            rows = reader.schema(f"{STORED_SCHEMA}, batch string").parquet(*batches)
            frames.append(rows.withColumn("bucket", F.lit(None).cast("string")).select(columns))
        if segments:
            frames.append(reader.schema(f"{STORED_SCHEMA}, segment string, bucket string").parquet(*segments).select(columns))
        return union_all(frames) if frames else literal_relation(self.spark, [], f"{STORED_SCHEMA}, bucket string")

    def history(self, relation: str | None = None, keyed: bool = False) -> DataFrame:
        """Archived rows. They are filed by relation: with one given, no other folder is listed or read.

        keyed: with record_key and record_mode, with which the guards need no payload.
        """
        if relation is not None:
            names = [relation]
        else:
            found = _folders(self.spark, self._path("control_history"))
            names = sorted(n.removeprefix("source_relation=") for n in found if n.startswith("source_relation="))
        listed = [self._listed(n) for n in names]
        rows = self._rows([s for x, _ in listed for s in x], [b for _, x in listed for b in x])
        return rows.select(*(STORED_COLUMNS if keyed else HISTORY_COLUMNS))

    def holding(self, relation: str, hashes: DataFrame) -> DataFrame:
        """The archived rows of a relation whose payload_hash is among the given ones.

        Of segments only the buckets of these hashes are opened: their numbers, 256 at most, are found first.
        """
        segments, batches = self._listed(relation)
        wanted = hashes.select("payload_hash").distinct()
        rows = self._rows([], batches)
        if segments:
            buckets = [r.bucket for r in wanted.select(_bucket().alias("bucket")).distinct().collect()]
            rows = rows.unionByName(self._rows(segments, []).where(F.col("bucket").isin(buckets)))
        return rows.join(wanted, "payload_hash", "left_semi").select(*HISTORY_COLUMNS)

    def compact(self, relation: str, least: int = 8) -> bool:
        """Takes a relation's batches, if there are at least so many, into one segment, sorted by hash in 256 buckets.

        The segment counts from the moment its entry in the relation's list is created; what it took in stays where it is. It is listed
        only if its rows are those of its batches. Of two compactions at once one is listed; a reader sees the old list or the new.
        """
        _, batches = self._listed(relation)
        if len(batches) < least:
            return False
        root = f"{self._path('control_history')}/source_relation={relation}"
        name, rows = f"segment={uuid.uuid4().hex}", self._rows([], batches).drop("bucket")
        sorted_rows = rows.drop("source_relation").withColumn("bucket", _bucket()).repartition("bucket").sortWithinPartitions("bucket", "payload_hash")
        sorted_rows.write.partitionBy("bucket").option("parquet.bloom.filter.enabled#payload_hash", "true").parquet(f"{root}/{name}")
        if not differing_ranges(rows, self._rows([f"{root}/{name}"], []).drop("bucket")).isEmpty():
            raise EvidenceError(f"{relation}: a compacted segment differs from its batches")
        log, taken = self._segment_log(relation), [b.rpartition("/")[2] for b in batches]
        while True:
            sequence, found = log.last()
            covered = found.get("covered", [])
            if set(covered) & set(taken):
                return False
            if log.create(sequence + 1, {"segments": [*found.get("segments", []), name], "covered": [*covered, *taken]}):
                return True

    def archived_controls(self) -> dict:
        """The control versions up to which all rows are known to be archived."""
        return AtomicLog(self.spark, f"{self.root}/_archived").last()[1]

    def mark_archived(self, controls: dict) -> None:
        """Called when all rows of these control versions are archived. If another run was faster, its mark stands."""
        log = AtomicLog(self.spark, f"{self.root}/_archived")
        sequence, found = log.last()
        if found != controls:
            log.create(sequence + 1, controls)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENT_SCHEMA).parquet(f"{self._path('execution_events')}/batch=*")

    def append(self, df: DataFrame, name: str, batch: str, relation: str | None = None) -> None:
        """Every append is a new folder; nothing is ever replaced. History is filed by relation."""
        path = self._path(name)
        if name == "control_history":
            if relation is None:
                raise ValueError("history is appended for one relation at a time")
            df, path = _keyed(_of(df, relation), relation).drop("source_relation"), f"{path}/source_relation={relation}"
        df.write.mode("errorifexists").parquet(f"{path}/batch={batch}-{uuid.uuid4().hex}")


def _folders(spark: SparkSession, path: str) -> list[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(target) if f.isDirectory()] if fs.exists(target) else []


def _bucket() -> Column:
    return F.substring("payload_hash", 1, 2)


def _keyed(history: DataFrame, name: str) -> DataFrame:
    """Archived rows with record_key and record_mode, null for what is no durable control."""
    keys = CONTROL_KEYS.get(name)
    if keys is None:
        return history.withColumns({c: F.lit(None).cast("string") for c in ("record_key", "record_mode")})
    fields = [*keys, *(["deletion_mode"] if "deletion_mode" not in keys else [])]
    record = F.from_json("payload", ", ".join(f"{f} string" for f in fields))
    parsed = history.withColumn("_record", record)
    return parsed.withColumns(
        {"record_key": F.to_json(F.array(*(F.col(f"_record.{k}") for k in keys))), "record_mode": F.col("_record.deletion_mode")}
    ).drop("_record")


# ---- archive ----------------------------------------------------------------------------------

def row_payload(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]), _JSON)


def payloads(df: DataFrame) -> DataFrame:
    """Distinct rows as JSON with their hash."""
    rows = df.select(row_payload(df).alias("payload"))
    return rows.select(F.sha2("payload", 256).alias("payload_hash"), "payload").dropDuplicates(["payload_hash"])


def _of(history: DataFrame, name: str) -> DataFrame:
    return history.where(F.col("source_relation") == name)


def archive(df: DataFrame, name: str, history: DataFrame, cfg: PipelineConfig, invocation_id: str) -> DataFrame:
    """Rows not archived before; replaying a run adds nothing."""
    known = _of(history, name).select("payload_hash")
    return payloads(df).join(known, "payload_hash", "left_anti").select(
        F.lit(name).alias("source_relation"),
        "payload_hash",
        "payload",
        cfg.run_timestamp().alias("archived_at"),
        F.lit(invocation_id).alias("invocation_id"),
    )


def _archived_fields(history: DataFrame, name: str, fields: Sequence[str]) -> DataFrame:
    """Fields of the archived rows as text, from one parse of each payload, with the row's hash."""
    parsed = F.from_json("payload", ", ".join(f"{f} string" for f in fields))
    return _of(history, name).select(parsed.alias("record"), "payload_hash").select("record.*", "payload_hash")


def archive_conflicts(df: DataFrame, name: str, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key was archived with other content: recorded revisions never change."""
    current = df.select(
        *[F.col(k).cast("string").alias(k) for k in keys],
        F.sha2(row_payload(df), 256).alias("current_hash"),
    )
    archived = _archived_fields(history, name, keys)
    return current.join(archived, list(keys), "inner").where(F.col("payload_hash") != F.col("current_hash"))


def missing_or_downgraded(current: DataFrame, name: str, history: DataFrame) -> DataFrame:
    """Archived control keys that are gone, or that lost a FULL mode; of keyed history no payload is read."""
    keys = list(CONTROL_KEYS[name])
    if "record_key" in history.columns:
        archived = _of(history, name).groupBy("record_key").agg(F.bool_or(F.col("record_mode") == FULL).alias("was_full"))
        full = (F.col("deletion_mode") == FULL) if name == LEDGER else F.lit(True)
        present = current.select(F.to_json(F.array(*(F.col(k).cast("string") for k in keys))).alias("record_key"), full.alias("is_full"))
        joined = archived.join(present, "record_key", "left")
        lost = F.col("is_full").isNull() | (F.col("was_full") & ~F.col("is_full"))
        parsed = F.from_json("record_key", "array<string>")
        return joined.where(lost).select(*(F.element_at(parsed, i + 1).alias(k) for i, k in enumerate(keys)))
    if name != LEDGER:
        present = current.select(*[F.col(k).cast("string").alias(k) for k in keys])
        return _archived_fields(history, name, keys).select(*keys).join(present, keys, "left_anti")
    # A FULL archive needs a FULL row; any other archive needs just the row.
    archived = _archived_fields(history, name, [*keys, "deletion_mode"]).select(
        *keys, F.col("deletion_mode").alias("archived_mode")
    )
    strength = current.select("customer_key", (F.col("deletion_mode") == FULL).alias("now_full"))
    joined = archived.join(strength, "customer_key", "left")
    lost = F.col("now_full").isNull() | ((F.col("archived_mode") == FULL) & ~F.col("now_full"))
    return joined.where(lost).select(*keys)


def guard_control(current: DataFrame | None, name: str, history: DataFrame) -> None:
    """Refuse to continue on a missing, truncated or downgraded control."""
    if current is None:
        if not _of(history, name).isEmpty():
            raise EvidenceError(
                f"{name} is missing but durable evidence exists; restore it instead of rebuilding"
            )
        return
    if not missing_or_downgraded(current, name, history).isEmpty():
        raise EvidenceError(f"{name}: archived keys are missing or downgraded; stop for recovery")


def restore_control(
    history: DataFrame, name: str, existing: DataFrame | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """A missing control rebuilt from evidence: FULL first, then the newest archive of each key."""
    if name not in CONTROL_KEYS:
        raise ValueError("only durable request, plan and terminal controls can be restored")
    if existing is not None:
        raise EvidenceError(f"{name}: recovery refuses to overwrite an existing relation")
    evidence = _of(history, name)
    if evidence.isEmpty():
        raise EvidenceError(f"{name}: recovery requires archived evidence")
    return decode_latest(evidence, name, schema or CONTRACTS[name])


def decode_latest(evidence: DataFrame, name: str, schema: T.StructType) -> DataFrame:
    keys = list(CONTROL_KEYS[name])
    decoded = evidence.select(
        F.from_json("payload", schema, _JSON).alias("record"), "archived_at", "invocation_id", "payload_hash"
    )
    order = [F.desc("archived_at"), F.desc("invocation_id"), F.desc("payload_hash")]
    if name == LEDGER:
        order.insert(0, F.desc(F.col("record.deletion_mode") == FULL))
    best = Window.partitionBy(*[F.col(f"record.{k}") for k in keys]).orderBy(*order)
    return (
        decoded.withColumn("recovery_rank", F.row_number().over(best))
        .where(F.col("recovery_rank") == 1)
        .select("record.*")
    )


# ---- digests, events, verification ------------------------------------------------------------

def plan_digest(plan: DataFrame) -> DataFrame:
    """One order-independent digest per target, as a hash tree.

    Equal rows collapse to one entry with its count. Entries meet in up to 16 million leaves by
    hash prefix, then in two levels of at most 4096 children, so no list grows with the plan.
    """
    entry = F.concat("row_hash", F.lit("x"), F.col("count").cast("string"))
    rows = (
        plan.select("target_relation", F.sha2(row_payload(plan), 256).alias("row_hash"))
        .groupBy("target_relation", "row_hash")
        .count()
        .select("target_relation", F.substring("row_hash", 1, 6).alias("prefix"), entry.alias("entry"))
    )

    def fold(level: DataFrame, width: int) -> DataFrame:
        listed = F.sort_array(F.collect_list("entry"))
        folded = level.groupBy("target_relation", "prefix").agg(
            F.sha2(F.concat_ws("", listed), 256).alias("digest")
        )
        return folded.select(
            "target_relation",
            F.substring("prefix", 1, width).alias("prefix") if width else F.lit("").alias("prefix"),
            F.concat("prefix", "digest").alias("entry"),
            "digest",
        )

    leaves = fold(rows, 3)
    branches = fold(leaves, 0)
    return fold(branches, 0).select("target_relation", F.col("digest").alias("plan_digest"))


def append_events(
    digests: DataFrame,
    status: str,
    execution_id: str,
    recorded_at: Column,
    invocation_id: str,
    targets: Iterable[str] | None = None,
) -> DataFrame:
    """Execution events to append: one per target, or for the named targets only."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}; received: {status!r}")
    rows = digests if targets is None else digests.where(F.col("target_relation").isin(*targets))
    return rows.select(
        F.lit(check_execution_id(execution_id)).alias("execution_id"),
        "target_relation",
        "plan_digest",
        F.lit(status).alias("status"),
        recorded_at.alias("recorded_at"),
        F.lit(invocation_id).alias("invocation_id"),
    )


def failure_event(spark: SparkSession, execution_id: str, recorded_at: Column, invocation_id: str) -> DataFrame:
    """The workflow failed as a whole: a reserved target and an all-zero digest."""
    workflow = spark.range(1).select(
        F.lit(WORKFLOW).alias("target_relation"), F.lit(NO_DIGEST).alias("plan_digest")
    )
    return append_events(workflow, "FAILED", execution_id, recorded_at, invocation_id)


def incomplete_targets(digests: DataFrame, events: DataFrame, execution_id: str) -> DataFrame:
    """Targets whose latest event in this execution is not COMPLETED or VERIFIED for this plan."""
    newest = Window.partitionBy("target_relation").orderBy(F.desc("recorded_at"), F.desc("invocation_id"))
    latest = (
        events.where(F.col("execution_id") == execution_id)
        .withColumn("event_rank", F.row_number().over(newest))
        .where(F.col("event_rank") == 1)
        .where(F.col("status").isin("COMPLETED", "VERIFIED"))
        .select("target_relation", "plan_digest")
    )
    return digests.join(latest, ["target_relation", "plan_digest"], "left_anti")


def verify_execution(
    digests: DataFrame,
    events: DataFrame,
    required: Iterable[str],
    passed: Iterable[str],
    failed: Iterable[str],
    execution_id: str,
    recorded_at: Column,
    invocation_id: str,
) -> DataFrame | None:
    """VERIFIED events, only if every required audit passed and every target is complete.

    A failed audit gives a workflow failure event. Missing audits give no event at all.
    """
    if list(failed):
        return failure_event(digests.sparkSession, execution_id, recorded_at, invocation_id)
    if set(required) - set(passed):
        return None
    if not incomplete_targets(digests, events, execution_id).isEmpty():
        raise EvidenceError("cannot verify: not all current plan targets completed in this execution")
    return append_events(digests, "VERIFIED", execution_id, recorded_at, invocation_id)
