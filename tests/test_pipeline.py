from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import fixture_rows as fx
from expected import Expected
from veilwright.operators import audits as A
from veilwright.operators import evidence as E
from veilwright.operators import views as V
from veilwright.operators.controls import LEDGER, PLAN
from veilwright.plans import pipeline as P
from veilwright.plans.relations import REBUILT
from veilwright.sources.extracts import read_extracts
from veilwright.sources.tables import Conflict, ContractError, TableStore, enforce_contract
from veilwright.schemas import CONTRACTS, CONTROL_KEYS, EXTRACT_COLUMNS


EARLY, FINAL = Expected(fx.EARLY_CUTOFF).counts(), Expected().counts()


@pytest.fixture
def roots(tmp_path):
    return str(tmp_path / "tables"), str(tmp_path / "evidence")


def csv_extracts(spark, folder, **changed):
    for name, df in fx.extracts(spark, **changed).items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    return read_extracts(spark, str(folder))


def run(spark, extracts, roots, cfg, execution):
    return P.run_pipeline(spark, extracts, *roots, cfg, execution, grants=V.matrix_grants(spark))


def test_two_runs_escalation_and_replay(spark, cfg, roots, tmp_path):
    extracts = csv_extracts(spark, tmp_path / "in")
    assert all(set(t for _, t in df.dtypes) == {"string"} for df in extracts.values())
    early = replace(cfg, decision_as_of=fx.EARLY_CUTOFF)
    first = run(spark, extracts, roots, early, "first")
    assert first.verified and set(first.audits.values()) == {0}
    store, evidence = TableStore(spark, roots[0]), E.EvidenceStore(spark, roots[1], roots[0])
    assert store.read("fct_invoice").count() == EARLY["fct_invoice"]
    assert {r.deletion_mode for r in store.read(LEDGER).collect()} == {fx.SPECIAL}

    second = run(spark, extracts, roots, replace(cfg, run_ts="2026-03-02 00:00:00"), "second")
    assert second.verified and store.read("fct_invoice").count() == FINAL["fct_invoice"]
    ledger = store.read(LEDGER).collect()
    assert sorted((r.deletion_mode, str(r.mode_escalated_at)[:10]) for r in ledger) == [
        (fx.FULL, "2026-03-02"), (fx.FULL, "2026-03-02"), (fx.SPECIAL, "None"),
    ]
    archived, plan_rows = evidence.history().count(), store.read(PLAN).count()
    controls = {name: store.snapshot().relations[name] for name in CONTROL_KEYS}
    assert len(controls[LEDGER].versions) == 2 or controls[LEDGER].versions[0][0].endswith(".base")
    run(spark, extracts, roots, replace(cfg, run_ts="2026-03-03 00:00:00"), "third")
    assert evidence.history().count() == archived and store.read(PLAN).count() == plan_rows
    assert sorted(map(str, store.read(LEDGER).collect())) == sorted(map(str, ledger))
    # Nothing new was decided: no control row was written.
    assert {name: store.snapshot().relations[name] for name in CONTROL_KEYS} == controls
    events = evidence.events().where("execution_id = 'second'").groupBy("status").count().collect()
    assert {r.status: r["count"] for r in events} == {"PENDING": 17, "COMPLETED": 17, "VERIFIED": 17}


def test_failed_build_keeps_controls_and_old_outputs(spark, cfg, roots):
    good = fx.extracts(spark)
    run(spark, good, roots, replace(cfg, decision_as_of=fx.EARLY_CUTOFF), "first")
    duplicated = fx.extracts(spark, customer_events=fx.events() + fx.events()[:1])
    with pytest.raises(E.EvidenceError, match="event_partition"):
        run(spark, duplicated, roots, cfg, "second")
    store, evidence = TableStore(spark, roots[0]), E.EvidenceStore(spark, roots[1], roots[0])
    assert store.read("fct_invoice").count() == EARLY["fct_invoice"]
    assert store.read(LEDGER).where(f"deletion_mode = '{fx.FULL}'").count() == 2
    failed = evidence.events().where("status = 'FAILED'").collect()
    assert [(r.execution_id, r.target_relation) for r in failed] == [("second", "__workflow__")]
    assert run(spark, good, roots, cfg, "third").verified and store.read("fct_invoice").count() == FINAL["fct_invoice"]


class Lost(Exception):
    """The driver is gone: nothing after this runs."""


@pytest.mark.parametrize(
    "point,before",
    [("switch:0", False), (f"append:{LEDGER}", True), ("append:execution_events:2", False), ("switch:1", True)],
)
def test_a_lost_driver_is_followed_by_a_plain_rerun(spark, cfg, roots, monkeypatch, point, before):
    """The second build dies before or after one of its writes; a third ends as if it had not."""
    extracts = fx.extracts(spark)
    run(spark, extracts, roots, replace(cfg, decision_as_of=fx.EARLY_CUTOFF), "first")
    store, evidence = TableStore(spark, roots[0]), E.EvidenceStore(spark, roots[1], roots[0])
    old = store.current_versions()["fct_invoice"]
    kind, _, rest = point.partition(":")
    owner, name = {
        "write": (TableStore, "write_version"), "switch": (TableStore, "switch"), "append": (E.EvidenceStore, "append"),
    }[kind]
    original, seen, lost = getattr(owner, name), [], []

    def here(args):
        if kind == "write":
            return args[1] == rest
        if kind == "append" and not rest.startswith("execution_events"):
            return args[3:] == (rest,)
        if kind == "append" and args[1] != "execution_events":
            return False
        seen.append(1)
        return len(seen) - 1 == int(rest.rpartition(":")[2])

    def dying(self, *args):
        if lost:
            raise Lost
        if not here(args):
            return original(self, *args)
        if not before:
            original(self, *args)
        lost.append(1)
        raise Lost

    later = replace(cfg, run_ts="2026-03-02 00:00:00")
    with monkeypatch.context() as patch:
        patch.setattr(owner, name, dying)
        if owner is not E.EvidenceStore:
            append = E.EvidenceStore.append
            patch.setattr(E.EvidenceStore, "append", lambda self, *a: (_ for _ in ()).throw(Lost()) if lost else append(self, *a))
        with pytest.raises(Lost):
            run(spark, extracts, roots, later, "second")
    if point != "switch:1" or before:
        # Outputs of the lost run are not visible, whatever it had recorded.
        assert store.current_versions()["fct_invoice"] == old
    assert run(spark, extracts, roots, later, "third").verified
    assert store.read("fct_invoice").count() == FINAL["fct_invoice"]
    assert sorted(r.deletion_mode for r in store.read(LEDGER).collect()) == [fx.FULL, fx.FULL, fx.SPECIAL]
    for name in ("customer_deletion_requests", PLAN, LEDGER):
        E.guard_control(store.read(name), name, evidence.history(name))
    visible = store.current_versions()["fct_invoice"]
    assert not evidence.events().where(f"status = 'VERIFIED' and invocation_id = '{visible}'").isEmpty()


def test_missing_audits_never_switch_outputs(spark, cfg, roots, monkeypatch):
    monkeypatch.setattr(P, "REQUIRED_AUDITS", (*P.REQUIRED_AUDITS, "one_more"))
    with pytest.raises(E.EvidenceError, match="one_more"):
        run(spark, fx.extracts(spark), roots, cfg, "first")
    assert TableStore(spark, roots[0]).read("fct_invoice") is None


def test_lost_controls_and_changed_revisions_stop_the_build(spark, cfg, roots, tmp_path):
    extracts = fx.extracts(spark)
    run(spark, extracts, roots, cfg, "first")
    fresh = (str(tmp_path / "other"), roots[1])
    with pytest.raises(E.EvidenceError, match="missing"):
        run(spark, extracts, fresh, cfg, "second")
    edited = fx.decisions()
    edited[0]["decision_reason"] = "SOMETHING_ELSE"
    with pytest.raises(E.EvidenceError, match="revision changed"):
        run(spark, fx.extracts(spark, customer_deletion_confirmations=edited), roots, cfg, "third")
    store = TableStore(spark, fresh[0])
    history = E.EvidenceStore(spark, roots[1], fresh[0]).history()
    for name in ("customer_deletion_requests", PLAN, LEDGER):
        store.publish(E.restore_control(history, name), name, "restored", CONTRACTS[name])
    assert run(spark, extracts, fresh, cfg, "fourth").verified
    with pytest.raises(ValueError):
        run(spark, extracts, roots, cfg, "bad id")


def test_contract_drift_is_refused(spark):
    df = spark.createDataFrame([], CONTRACTS["dim_date"])
    assert enforce_contract(df, CONTRACTS["dim_date"]) is df
    for drift in (df.drop("is_weekend"), df.withColumn("x", df.date_key), df.withColumn("date_key", df.date_key.cast("bigint"))):
        with pytest.raises(ContractError):
            enforce_contract(drift, CONTRACTS["dim_date"])


def test_csv_with_a_changed_header_is_refused(spark, tmp_path):
    columns = list(EXTRACT_COLUMNS["customer_events"])
    wrong = spark.createDataFrame([tuple("x" for _ in columns)], ["other", *columns[1:]])
    wrong.coalesce(1).write.option("header", True).csv(str(tmp_path / "customer_events.csv"))
    from veilwright.sources.extracts import read_extract

    with pytest.raises(Exception, match="header"):
        read_extract(spark, "customer_events", str(tmp_path / "customer_events.csv")).collect()


def test_access_audits_join_the_gate_with_grants(spark, cfg, roots, tmp_path):
    extra = spark.sql("SELECT 'everyone' AS grantee, 'SELECT' AS privilege, 'layer1' AS table_schema, 'stg_customer' AS table_name")
    grants = V.matrix_grants(spark)
    with pytest.raises(E.EvidenceError, match="ambient_grants"):
        P.run_pipeline(spark, fx.extracts(spark), *roots, cfg, "first", grants=grants.unionByName(extra))
    result = P.run_pipeline(spark, fx.extracts(spark), *roots, cfg, "second", grants=grants)
    assert set(result.audits) == {*P.REQUIRED_AUDITS, *P.ACCESS_AUDITS} and set(result.audits.values()) == {0}
    store = TableStore(spark, roots[0])
    assert store.current_versions()[P.GRANTS] == store.current_versions()["fct_invoice"]
    assert store.read(P.GRANTS).count() == grants.count()


def test_no_verification_without_grants(spark, cfg, roots):
    result = P.run_pipeline(spark, fx.extracts(spark), *roots, cfg, "first")
    assert not result.verified and set(result.audits) == set(P.REQUIRED_AUDITS) and set(result.audits.values()) == {0}
    store, evidence = TableStore(spark, roots[0]), E.EvidenceStore(spark, roots[1], roots[0])
    assert store.read("fct_invoice") is None and store.read(LEDGER).count() == 3
    assert evidence.events().where("status in ('VERIFIED', 'FAILED')").isEmpty()


@pytest.mark.parametrize("at", [0, 1])
def test_of_two_interleaved_builds_one_fails_cleanly(spark, cfg, roots, monkeypatch, at):
    """Another build runs from start to end before the first one's switch of controls (0) or of outputs (1)."""
    extracts, switch, seen = fx.extracts(spark), TableStore.switch, []

    def interrupted(self, *args):
        seen.append(1)
        if len(seen) == at + 1:
            assert run(spark, extracts, roots, cfg, "inner").verified
        return switch(self, *args)

    with monkeypatch.context() as patch:
        patch.setattr(TableStore, "switch", interrupted)
        with pytest.raises(Conflict, match="switched by another build"):
            run(spark, extracts, roots, cfg, "outer")
    store, evidence = TableStore(spark, roots[0]), E.EvidenceStore(spark, roots[1], roots[0])
    visible = store.current_versions()["fct_invoice"]
    status = {(r.execution_id, r.status) for r in evidence.events().select("execution_id", "status").distinct().collect()}
    assert ("inner", "VERIFIED") in status and ("outer", "FAILED") in status
    assert {r.invocation_id for r in evidence.events().where("execution_id = 'inner'").collect()} == {visible}
    assert run(spark, extracts, roots, cfg, "after").verified


def test_a_null_in_a_required_column_refuses_the_switch(spark, cfg, roots):
    rows = fx.events()
    rows[0]["measure_unit"] = None
    with pytest.raises(ContractError, match="measure_unit is null in 1 rows"):
        run(spark, fx.extracts(spark, customer_events=rows), roots, cfg, "first")
    assert TableStore(spark, roots[0]).read("fct_customer_event") is None


def test_changed_only_equals_the_full_rebuild(spark, cfg, roots, tmp_path):
    """A build over late rows, changed rows and late decisions, once from what changed and once in full."""
    late = fx.extracts(spark)
    known = {
        "customer_events": late["customer_events"].where("pmod(crc32(event_id), 3) > 0"),
        "customer_services": late["customer_services"].where("pmod(crc32(service_id), 4) > 0"),
        "invoices": late["invoices"].where("pmod(crc32(invoice_id), 3) > 0").withColumn(
            "amount", F.when(F.expr("pmod(crc32(invoice_id), 5) = 0"), F.lit("1.00")).otherwise(F.col("amount"))
        ),
    }
    run(spark, {**late, **known}, roots, replace(cfg, decision_as_of=fx.EARLY_CUTOFF), "first")
    after = replace(cfg, run_ts="2026-03-02 00:00:00")
    store = TableStore(spark, roots[0])
    names = (*REBUILT[3:], "quarantine_customer_events", "quarantine_customer_services", "quarantine_invoices", "fct_invoice")
    changed = P.run_pipeline(spark, late, *roots, after, "second", grants=V.matrix_grants(spark), changed_only=True)
    found = {name: store.read(name) for name in names}
    assert changed.verified and list((tmp_path / "tables" / "_affected_invoices").iterdir())
    run(spark, late, roots, after, "full")
    for name in names:
        assert A.audit_same_bag(found[name], store.read(name).select(found[name].columns)).isEmpty(), name
