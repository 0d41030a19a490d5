import itertools
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import fixture_rows as fx
from veilwright.operators import audits as A
from veilwright.operators import controls as C
from veilwright.operators import maps, staging
from veilwright.schemas import CONTRACTS
from veilwright.sources.tables import ContractError, literal_relation, merge_by_key

COMPLETE = "decision_revision_id string, deletion_request_id string, customer_key string, deletion_mode string, deletion_policy_version string, authorization_recorded_at timestamp, authorized_at timestamp"


def staged_decisions(spark, rows, cfg):
    return staging.stage_decisions(fx.as_extract(spark, "customer_deletion_confirmations", rows), cfg)


def requests(spark, cfg):
    return C.detect_requests(staging.stage_customer(fx.extracts(spark)["customer"]), None, cfg)


FAILING = {
    "no hold": {"legal_hold": None},
    "no mode": {"deletion_mode": None},
    "empty mode": {"deletion_mode": "  "},
    "unknown mode": {"deletion_mode": "PURGE"},
    "no policy": {"deletion_policy_version": None},
    "old policy": {"deletion_policy_version": "CUSTOMER_DELETION_V0"},
    "no recorded_at": {"recorded_at": None},
    "no decided_at": {"decided_at": None},
    "no role": {"decided_by_role": ""},
    "no reason": {"decision_reason": " "},
    "rejected without hold": {"decision_status": "REJECTED", "legal_hold": None},
}


def test_incomplete_decisions_fail_closed(spark, cfg):
    rows = [fx.decision(n, fx.request_of(fx.MASKED), fx.SPECIAL, "2026-02-21T08:00:00") | c for n, c in FAILING.items()]
    got = C.authorization_history(requests(spark, cfg), staged_decisions(spark, rows, cfg), cfg).collect()
    assert len(got) == len(rows) and {r.authorization_status for r in got} == {"INVALID"}


def test_status_order(spark, cfg):
    cases = {
        "held": ({"legal_hold": "True", "decision_status": "REJECTED"}, "HELD"),
        "rejected": ({"decision_status": "rejected"}, "REJECTED"),
        "pending": ({"decision_status": "pending"}, "PENDING"),
        "other": ({"decision_status": "WHATEVER"}, "PENDING"),
        "good": ({"decision_status": " confirmed "}, "AUTHORIZED"),
    }
    rows = [fx.decision(n, fx.request_of(fx.MASKED), "special_deletion", "2026-02-21T08:00:00") | c for n, (c, _) in cases.items()]
    history = C.authorization_history(requests(spark, cfg), staged_decisions(spark, rows, cfg), cfg)
    assert {r.decision_revision_id: r.authorization_status for r in history.collect()} == {
        n: status for n, (_, status) in cases.items()
    }
    # The teaching classifier treats an unknown status as INVALID and looks at the latest revision only.
    raw = staging.stage_decisions_teaching(fx.as_extract(spark, "customer_deletion_confirmations", [rows[3]]))
    got = C.latest_authorization(requests(spark, cfg), raw, cfg).where("decision_revision_id is not null").collect()
    assert [r.authorization_status for r in got] == ["INVALID"]


def test_cutoff_keeps_undated_revisions(spark, cfg):
    rows = [fx.decision("a", "r", fx.FULL, "2026-02-21T08:00:00"), fx.decision("b", "r", fx.FULL, None)]
    cut = replace(cfg, decision_as_of="2026-02-21 07:59:59")
    assert [r.decision_revision_id for r in staged_decisions(spark, rows, cut).collect()] == ["b"]
    assert staged_decisions(spark, rows, replace(cfg, decision_as_of="2026-02-21 08:00:00")).count() == 2


def test_requests_are_detected_once(spark, cfg):
    first = requests(spark, cfg)
    stg = staging.stage_customer(fx.extracts(spark)["customer"])
    again = C.detect_requests(stg, first.where(F.col("deletion_request_id") != fx.request_of(fx.MASKED)), replace(cfg, run_ts="2026-04-01 00:00:00"))
    seen = {r.deletion_request_id: str(r.detected_at)[:7] for r in again.collect()}
    asked = [fx.request_of(n) for n in (fx.UNDECIDED, fx.MASKED, fx.GONE, fx.HELD, fx.REFUSED)]
    assert seen == {r: "2026-04" if r == fx.request_of(fx.MASKED) else "2026-03" for r in asked}
    # An empty replay source loses nothing.
    assert C.detect_requests(stg.where("false"), first, cfg).count() == 5


def plan_rows(spark, cfg, revisions):
    """Full plans for (revision, request, key, mode, recorded) tuples."""
    keys = literal_relation(
        spark,
        [(rev, req, key, mode, "CUSTOMER_DELETION_V1", rec, rec) for rev, req, key, mode, rec in revisions],
        "decision_revision_id string, deletion_request_id string, customer_key string, deletion_mode string, "
        "deletion_policy_version string, r string, d string",
    ).select(
        "decision_revision_id", "deletion_request_id", "customer_key", "deletion_mode", "deletion_policy_version",
        F.col("r").cast("timestamp").alias("authorization_recorded_at"), F.col("d").cast("timestamp").alias("authorized_at"),
    )
    return C._with_targets(keys, C.TARGETS).select(CONTRACTS[C.PLAN].names)


def test_revision_precedence(spark, cfg):
    plan = plan_rows(spark, cfg, [
        ("V1", "R", "k", fx.SPECIAL, "2026-01-01 00:00:00"), ("V2", "R", "k", fx.SPECIAL, "2026-01-02 00:00:00"),
        ("T1", "R", "tie", fx.SPECIAL, "2026-01-01 00:00:00"), ("T2", "R", "tie", fx.SPECIAL, "2026-01-01 00:00:00"),
        ("F1", "R", "full", fx.FULL, "2026-01-01 00:00:00"), ("F2", "R", "full", fx.SPECIAL, "2026-01-09 00:00:00"),
    ])
    ranked = {r.customer_key: r for r in C.rank_plans(C.complete_plans(plan)).collect()}
    assert (ranked["k"].decision_revision_id, ranked["k"].initial_decision_revision_id) == ("V2", "V1")
    assert (ranked["tie"].decision_revision_id, ranked["tie"].initial_decision_revision_id) == ("T2", "T1")
    assert (ranked["full"].decision_revision_id, ranked["full"].initial_decision_revision_id) == ("F1", "F1")


def test_gate_refuses_incomplete_wrong_and_repeated_plans(spark, cfg):
    full = plan_rows(spark, cfg, [(k, "R", k, fx.SPECIAL, "2026-01-01 00:00:00") for k in "abcde"])
    missing = (F.col("customer_key") == "b") & (F.col("target_relation") == "dim_customer")
    plan = full.where(~missing)
    plan = plan.unionByName(plan)
    plan = plan.withColumn(
        "planned_action",
        F.when((F.col("customer_key") == "c") & (F.col("target_relation") == "fct_invoice"), "DELETE_CURRENT_ROWS")
        .otherwise(F.col("planned_action")),
    ).withColumn("plan_status", F.when(F.col("customer_key") == "d", "PENDING").otherwise(F.col("plan_status")))
    plan = plan.withColumn("deletion_mode", F.when(F.col("customer_key") == "e", "UNKNOWN").otherwise(F.col("deletion_mode")))
    assert [r.customer_key for r in C.complete_plans(plan).collect()] == ["a"]
    # A larger registry makes the old plan incomplete.
    more = [*C.TARGETS, C.Target("layer3", "fct_extra", "FACT")]
    assert C.complete_plans(full, more).isEmpty()


def test_teaching_gate(spark, cfg):
    scenarios = [
        ("special", "900000001", fx.SPECIAL, "complete"), ("full", "900000001", fx.FULL, "complete"),
        ("missing", "900000002", fx.FULL, "missing"), ("wrong", "900000003", fx.SPECIAL, "wrong"),
        ("pending", "900000004", fx.SPECIAL, "pending"), ("unknown", "900000005", "UNKNOWN_MODE", "complete"),
        ("special_only", "900000006", fx.SPECIAL, "complete"), ("incomplete", "900000006", fx.FULL, "missing"),
        ("first", "900000007", fx.FULL, "first"), ("second", "900000007", fx.FULL, "second"),
    ]
    rows = []
    for request, ssn, mode, scenario in scenarios:
        for layer, relation, _, full, special in C.target_rows(C.TEACHING_TARGETS):
            if scenario == "missing" and relation == "dim_customer":
                continue
            if (scenario == "first" and layer != "layer1") or (scenario == "second" and layer == "layer1"):
                continue
            action = full if mode == fx.FULL else special
            if scenario == "wrong" and relation == "int_invoices_resolved":
                action = "DELETE_CURRENT_ROWS"
            status = "PENDING" if scenario == "pending" else "AUTHORIZED"
            rows += [(request, ssn, mode, layer, relation, action, status)] * 2
    plan = literal_relation(
        spark, rows,
        "deletion_request_id string, customer_ssn string, deletion_mode string, target_layer string, "
        "target_relation string, planned_action string, plan_status string",
    )
    expected = literal_relation(
        spark, [("900000001", fx.FULL), ("900000006", fx.SPECIAL)], "customer_ssn string, deletion_mode string"
    )
    assert A.audit_same_bag(C.effective_modes(plan), expected).isEmpty()


def test_ledger_is_monotonic_in_any_order(spark, cfg):
    """Whatever order revisions arrive in, the final evidence is the same and nothing is downgraded."""
    revisions = [
        ("D1", "R1", "k", fx.SPECIAL, "2026-01-01 00:00:00"),
        ("D2", "R1", "k", fx.FULL, "2026-01-02 00:00:00"),
        ("D3", "R2", "k", fx.SPECIAL, "2026-01-03 00:00:00"),
    ]
    for order in itertools.permutations(revisions):
        ledger, seen = None, []
        for step, revision in enumerate(order):
            seen.append(revision)
            run = replace(cfg, run_ts=f"2026-03-0{step + 1} 00:00:00")
            ledger = C.merged_ledger(plan_rows(spark, cfg, seen), ledger, run)
        row = ledger.collect()
        assert len(row) == 1 and row[0].deletion_mode == fx.FULL and row[0].decision_revision_id == "D2"
        assert str(row[0].suppression_recorded_at) == "2026-03-01 00:00:00"
        assert row[0].initial_decision_revision_id == order[0][0]
        came_first = order[0][0] == "D2"
        assert (row[0].mode_escalated_at is None) == came_first


def test_merge_keeps_absent_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, merge_by_key(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(ContractError):
        merge_by_key(old, new.withColumnRenamed("v", "w"), ["id"])


def test_targets(spark):
    assert C.target_registry(spark).count() == 17
    with pytest.raises(ValueError):
        C.target_rows([C.TARGETS[0], C.TARGETS[0]])
    with pytest.raises(ValueError):
        C.Target("layer1", "x", "CASE_VIEW", "TABLE").row()
    with pytest.raises(ValueError):
        C.Target("layer1", "x", "NOPE").row()


def test_latest_upsert_does_not_fall_back(spark, cfg):
    rows = [
        fx.change(1, 1, "UPSERT", "2026-01-01T00:00:00") | {"customer_change_id": "a"},
        fx.change(1, 1, "UPSERT", "2026-01-02T00:00:00", active=False) | {"customer_change_id": "b"},
        fx.change(2, 1, "UPSERT", "2026-01-01T00:00:00") | {"customer_change_id": "c"},
        fx.change(2, 1, "UPSERT", "2026-01-01T00:00:00") | {"customer_change_id": "d"},
    ]
    stg = staging.stage_customer(fx.as_extract(spark, "customer", rows))
    assert sorted(r.customer_change_id for r in maps.latest_upserts(stg).collect()) == ["b", "d"]
    nobody = spark.createDataFrame([], "customer_key string, deletion_mode string")
    assert [r.customer_id_value for r in maps.customer_map(stg, nobody, cfg).collect()] == [fx.person(2)]
