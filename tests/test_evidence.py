import re

import pytest
from pyspark.sql import functions as F

from test_controls import plan_rows
from veilwright.operators import controls as C
from veilwright.operators import evidence as E
from veilwright.schemas import CONTRACTS
from veilwright.sources.tables import literal_relation

SPECIAL, FULL = "SPECIAL_DELETION", "FULL_GOVERNED_OUTPUT_DELETION"
REQUESTS = "customer_deletion_requests"


@pytest.fixture
def store(spark, tmp_path):
    store = E.EvidenceStore(spark, str(tmp_path / "evidence"), str(tmp_path / "tables"))
    store.bootstrap()
    return store


@pytest.fixture
def requests(spark):
    return spark.sql(
        "select 'request-1' deletion_request_id, 'c-1' customer_id, '900-00-0001' customer_ssn, "
        "timestamp'2026-01-01 10:11:12.345678' source_deleted_at, timestamp'2026-01-02 00:00:00' detected_at, "
        "'DETECTED' detection_status"
    )


def now(text="2026-03-01 00:00:00"):
    return F.lit(text).cast("timestamp")


def test_archive_replay_restore_and_refusals(spark, cfg, store, requests):
    for run in ("run-1", "run-2"):
        store.append(E.archive(requests, REQUESTS, store.history(), cfg, run), "control_history", run, REQUESTS)
    assert store.history().count() == store.history(REQUESTS).count() == 1
    assert store.history(C.LEDGER).isEmpty() and store.history().columns == list(E.HISTORY_COLUMNS)
    E.guard_control(requests, REQUESTS, store.history(REQUESTS))
    with pytest.raises(E.EvidenceError):
        E.guard_control(None, REQUESTS, store.history())
    with pytest.raises(E.EvidenceError):
        E.guard_control(requests.where("false"), REQUESTS, store.history())
    restored = E.restore_control(store.history(), REQUESTS)
    assert [tuple(r) for r in restored.collect()] == [tuple(r) for r in requests.collect()]
    with pytest.raises(E.EvidenceError):
        E.restore_control(store.history(), REQUESTS, existing=requests)
    with pytest.raises(E.EvidenceError):
        E.restore_control(store.history(), C.PLAN)
    with pytest.raises(ValueError):
        E.restore_control(store.history(), "dim_customer")
    with pytest.raises(ValueError):
        store.append(E.archive(requests, REQUESTS, store.history(), cfg, "x"), "control_history", "x")


def test_nothing_archived_is_no_reason_to_refuse(store):
    E.guard_control(None, C.LEDGER, store.history())


def test_recorded_revision_must_not_change(spark, cfg, store):
    first = literal_relation(spark, [("r1", "x"), ("r2", "y")], "decision_revision_id string, reason string")
    store.append(E.archive(first, "decisions", store.history(), cfg, "a"), "control_history", "a", "decisions")
    assert E.archive_conflicts(first, "decisions", store.history(), ["decision_revision_id"]).isEmpty()
    edited = first.withColumn("reason", F.when(F.col("reason") == "x", "z").otherwise(F.col("reason")))
    found = E.archive_conflicts(edited, "decisions", store.history(), ["decision_revision_id"]).collect()
    assert [r.decision_revision_id for r in found] == ["r1"]


def ledgers(spark, cfg):
    special = [("D1", "R", "k", SPECIAL, "2026-01-01 00:00:00"), ("D3", "R", "m", SPECIAL, "2026-01-01 00:00:00")]
    full = special + [("D2", "R", "k", FULL, "2026-01-02 00:00:00")]
    return [C.merged_ledger(plan_rows(spark, cfg, rows), None, cfg) for rows in (special, full)]


def test_ledger_guard_and_restore_prefer_full(spark, cfg, store):
    special, full = ledgers(spark, cfg)
    for name, df in (("a", full), ("b", special)):
        store.append(E.archive(df, C.LEDGER, store.history(), cfg, name), "control_history", name, C.LEDGER)
    history = store.history()
    E.guard_control(full, C.LEDGER, history)
    assert [r.customer_key for r in E.missing_or_downgraded(special, C.LEDGER, history).collect()] == ["k"]
    assert {r.customer_key for r in E.missing_or_downgraded(special.where("false"), C.LEDGER, history).collect()} == {"k", "m"}
    restored = E.restore_control(history, C.LEDGER)
    assert restored.schema.names == CONTRACTS[C.LEDGER].names
    assert {r.customer_key: r.deletion_mode for r in restored.collect()} == {"k": FULL, "m": SPECIAL}
    assert sorted(map(str, restored.collect())) == sorted(map(str, full.collect()))


def test_digest_ignores_order_but_not_content(spark, cfg):
    plan = plan_rows(spark, cfg, [(f"D{n}", "R", f"k{n}", SPECIAL, "2026-01-01 00:00:00") for n in range(40)])

    def digests(df):
        return {r.target_relation: r.plan_digest for r in E.plan_digest(df).collect()}

    base = digests(plan)
    assert len(base) == 17 and len(set(base.values())) == 17
    assert digests(plan.orderBy(F.desc("customer_key")).repartition(7)) == base
    extra = plan.unionByName(plan.where("customer_key = 'k3' and target_relation = 'fct_invoice'"))
    changed = {t for t, d in digests(extra).items() if d != base[t]}
    assert changed == {"fct_invoice"}
    assert all(d != base[t] for t, d in digests(plan.where("customer_key != 'k7'")).items())


def test_execution_events_and_verification(spark, cfg, store):
    plan = plan_rows(spark, cfg, [("D1", "R", "k", SPECIAL, "2026-01-01 00:00:00")])
    digests = E.plan_digest(plan)
    required = ["one", "two"]

    def record(status, at, targets=None, execution="e1"):
        store.append(E.append_events(digests, status, execution, now(at), "run", targets), "execution_events", f"{execution}-{status}")

    def verify(passed, failed=(), execution="e1"):
        return E.verify_execution(digests, store.events(), required, passed, failed, execution, now(), "run")

    record("PENDING", "2026-03-01 00:00:01")
    assert verify(["one"]) is None
    with pytest.raises(E.EvidenceError):
        verify(required)
    record("COMPLETED", "2026-03-01 00:00:02")
    out = verify(required)
    assert out.count() == 17 and {r.status for r in out.collect()} == {"VERIFIED"}
    with pytest.raises(E.EvidenceError):
        verify(required, execution="e2")
    record("FAILED", "2026-03-01 00:00:03", ["dim_customer"])
    open_targets = E.incomplete_targets(digests, store.events(), "e1").collect()
    assert [r.target_relation for r in open_targets] == ["dim_customer"]
    moved = E.plan_digest(plan.withColumn("authorized_at", now()))
    assert E.incomplete_targets(moved, store.events(), "e1").count() == 17
    failure = verify(["one"], ["two"]).collect()
    assert [(r.target_relation, r.status, r.plan_digest) for r in failure] == [("__workflow__", "FAILED", "0" * 64)]
    with pytest.raises(ValueError):
        record("DONE", "2026-03-01 00:00:04")


def test_names_and_ids(spark, tmp_path):
    with pytest.raises(ValueError):
        E.EvidenceStore(spark, str(tmp_path), f"{tmp_path}/")
    store = E.EvidenceStore(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    with pytest.raises(ValueError):
        store.append(spark.range(1), "dim_customer", "x")
    for bad in ("", "a b", "x" * 129, "a/b"):
        with pytest.raises(ValueError):
            E.check_execution_id(bad)


def archived(spark, store, cfg, first, last):
    rows = spark.range(first, last).selectExpr(
        "concat('request-', id) deletion_request_id", "'c' customer_id", "'900-00-0001' customer_ssn",
        "timestamp'2026-01-01 10:11:12' source_deleted_at", "timestamp'2026-01-02 00:00:00' detected_at", "'DETECTED' detection_status",
    )
    held = store.holding(REQUESTS, E.payloads(rows))
    fresh = E.archive(rows, REQUESTS, held, cfg, f"run-{first}")
    store.append(fresh, "control_history", f"run-{first}", REQUESTS)
    return rows


def test_compacted_evidence_is_the_same_evidence(spark, cfg, store):
    for k in range(6):
        archived(spark, store, cfg, 20 * k, 20 * k + 30)  # each run archives ten rows of the one before again
    before = sorted(map(tuple, store.history().collect()))
    assert len(before) == 130
    assert not store.compact(REQUESTS, least=7) and store.compact(REQUESTS, least=6)
    assert not store.compact(REQUESTS, least=1)
    segments, batches = store._listed(REQUESTS)
    assert len(segments) == 1 and not batches
    assert sorted(map(tuple, store.history(REQUESTS).collect())) == sorted(map(tuple, store.history().collect())) == before
    rows = archived(spark, store, cfg, 100, 140)  # after compaction: ten are new
    assert store.history(REQUESTS).count() == 140 and len(store._listed(REQUESTS)[1]) == 1
    everything = spark.range(140).selectExpr("concat('request-', id) deletion_request_id")
    for history in (store.history(REQUESTS), store.history(REQUESTS, keyed=True)):
        assert E.missing_or_downgraded(everything, REQUESTS, history).isEmpty()
        lost = E.missing_or_downgraded(everything.where("deletion_request_id <> 'request-7'"), REQUESTS, history)
        assert [tuple(r) for r in lost.collect()] == [("request-7",)]
    assert E.restore_control(store.history(), REQUESTS).count() == 140 and rows.count() == 40


def test_few_hashes_open_few_buckets(spark, cfg, store):
    rows = archived(spark, store, cfg, 0, 3000)
    archived(spark, store, cfg, 3000, 3001)
    assert store.compact(REQUESTS, least=2)
    found = store.holding(REQUESTS, E.payloads(rows.limit(3)))
    assert found.count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    opened = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(([^)]*)\)", plan)
    assert opened and len(opened[1].split(",")) <= 3


def test_guards_read_no_payload(spark, cfg, store):
    archived(spark, store, cfg, 0, 10)
    store.compact(REQUESTS, least=1)
    current = spark.range(10).selectExpr("concat('request-', id) deletion_request_id")
    lost = E.missing_or_downgraded(current, REQUESTS, store.history(REQUESTS, keyed=True))
    assert lost.isEmpty()
    plan = lost._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert scans and all("record_key" in columns and "payload" not in columns for columns in scans), scans


def test_of_two_compactions_one_is_listed(spark, cfg, store, monkeypatch):
    for k in range(3):
        archived(spark, store, cfg, 10 * k, 10 * k + 10)
    seen, real = [], E.differing_ranges

    def slow(a, b):
        if not seen:
            seen.append(1)
            assert store.compact(REQUESTS, least=3)
        return real(a, b)

    monkeypatch.setattr(E, "differing_ranges", slow)
    assert not store.compact(REQUESTS, least=3)
    assert len(store._listed(REQUESTS)[0]) == 1 and store.history(REQUESTS).count() == 30
