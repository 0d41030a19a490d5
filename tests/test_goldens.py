"""Every row of the fixture population against its outcome in plain Python, in three control states."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import fixture_rows as fx
from expected import ERASED, Expected
from veilwright.config import CASE_USERS, Persona
from veilwright.functions import keys as K
from veilwright.operators import audits as A
from veilwright.operators import controls
from veilwright.plans.pipeline import OUTPUT_TABLES, required_audits
from veilwright.plans.relations import Relations
from veilwright.session import scratch_path


def staged(spark, extracts, cfg, state=None):
    def stage(name, df):
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return Relations(spark, extracts, cfg, state, stage)


@pytest.fixture(scope="module")
def final(spark, cfg):
    return staged(spark, fx.extracts(spark), cfg)


@pytest.fixture(scope="module")
def want():
    return Expected()


def key_of(spark, cfg, number):
    return spark.range(1).select(K.ssn_key(F.lit(number), cfg.scheme).alias("k")).first().k


def reasons(df, *key):
    return {(r[0] if len(key) == 1 else tuple(map(str, r[:-1]))): r[-1] for r in df.select(*key, "quarantine_reason").collect()}


def test_population_covers_every_outcome(want):
    """The two map-entry reasons cannot arise in a whole build; test_resolve.py has them."""
    assert set(want.status.values()) == {"PENDING", "AUTHORIZED", "HELD", "REJECTED"}
    assert set(want.events.values()) == {"ACCEPTED", "ERASED", "GONE", "CUSTOMER_NOT_FOUND"}
    assert len(set(want.rejects(want.services).values())) == 3 and "DELETED" in want.services.values()
    assert len(set(want.rejects(want.invoices).values())) == 10 and "SUPPRESSED" in want.invoices.values()


def test_controls(final, want):
    latest = {r.deletion_request_id: r for r in final.customer_deletion_authorizations.collect()}
    assert {k: r.authorization_status for k, r in latest.items()} == want.status
    undecided = latest[fx.request_of(fx.UNDECIDED)]
    assert undecided.deletion_policy_version == "CUSTOMER_DELETION_V1" and undecided.decision_revision_id is None
    plan = final.int_customer_deletion_plan
    assert plan.count() == want.plan_rows * len(controls.TARGETS)
    rows = {(r.deletion_mode, r.planned_action): r.targets for r in A.plan_metrics(plan).collect()}
    registry = controls.target_rows()
    for mode, column in ((fx.FULL, 3), (fx.SPECIAL, 4)):
        actions = [t[column] for t in registry]
        assert {a: n for (m, a), n in rows.items() if m == mode} == {a: actions.count(a) for a in set(actions)}


def test_ledger(spark, cfg, final, want):
    rows = {r.customer_key: r for r in final.ledger.collect()}
    assert {k: r.deletion_mode for k, r in rows.items()} == {key_of(spark, cfg, n): m for n, m in want.ledger.items()}
    for number, modes in want.modes.items():
        row = rows[key_of(spark, cfg, number)]
        assert row.initial_deletion_mode == modes[0]
        assert (row.mode_escalated_at is not None) == (modes[0] != want.ledger[number])
    masked = rows[key_of(spark, cfg, fx.ssn(fx.MASKED))]
    assert (masked.initial_decision_revision_id, masked.decision_revision_id) == ("rev-a", "rev-b")
    assert str(masked.authorization_recorded_at) == "2025-07-19 10:15:00"


def test_row_counts(final, want):
    assert {n: getattr(final, n).count() for n in OUTPUT_TABLES} == want.counts()


def test_every_event_service_and_invoice(final, want):
    assert reasons(final.quarantine_customer_events, "event_id") == want.rejects(want.events)
    assert reasons(final.quarantine_customer_services, "service_id", "valid_from") == want.rejects(want.services)
    assert reasons(final.quarantine_invoices, "invoice_id") == want.rejects(want.invoices)
    for table, key, outcomes in (
        ("int_customer_events_resolved", "event_id", want.events),
        ("int_invoices_resolved", "invoice_id", want.invoices),
    ):
        rows = {r[key]: r for r in getattr(final, table).collect()}
        assert set(rows) == set(want.kept(outcomes))
        for name, row in rows.items():
            assert row.is_erased_customer == (outcomes[name] == "ERASED") == (row.customer_key == ERASED)


def test_erased_rows_lose_their_keys(final):
    row = final.fct_invoice.where(f"invoice_key = 'bill-{fx.MASKED}'").first()
    assert (row.customer_key, row.service_key, row.service_version_key) == (ERASED,) * 3
    event = final.fct_customer_event.where(f"event_key = 'ev-{fx.MASKED}-0-0'").first()
    assert event.customer_key == ERASED and event.event_date_key == 20250622


def test_versions_follow_the_issue_date(final):
    rows = {r.invoice_key: r.service_version_key for r in final.fct_invoice.collect()}
    assert rows["bill-first-version"] != rows["bill-second-version"]


def test_due_flag_beside_the_sources_own(final):
    rows = {r.invoice_id: (r.is_due, r.source_is_due) for r in final.int_invoices_resolved.collect()}
    assert rows["bill-1"] == (True, False) and rows["bill-long-overdue"] == (True, True) and rows["bill-1-paid"] == (False, False)
    assert A.audit_due(final.int_invoices_resolved, final.cfg).isEmpty()


def test_required_audits_pass(final):
    for name, df in required_audits(final, Persona.of(CASE_USERS)).items():
        assert df.isEmpty(), name


def test_walkthrough_states(spark, cfg):
    """Three runs over durable controls: nothing decided, one SPECIAL, the rest with the escalation."""
    state = {}
    for cutoff in ("2025-06-01 00:00:00", fx.EARLY_CUTOFF, "9999-12-31 23:59:59"):
        want = Expected(cutoff)
        r = staged(spark, fx.extracts(spark), replace(cfg, decision_as_of=cutoff, run_ts=None), state)
        plan = r.int_customer_deletion_plan
        assert plan.count() == want.plan_rows * len(controls.TARGETS)
        assert plan.select("decision_revision_id", "customer_key").distinct().count() == want.plan_rows
        assert sorted(x.deletion_mode for x in r.ledger.collect()) == sorted(want.ledger.values())
        names = ("dim_customer", "dim_service", "fct_customer_event", "fct_invoice")
        assert {n: getattr(r, n).count() for n in names} == {n: want.counts()[n] for n in names}
        state = {n: getattr(r, n) for n in ("customer_deletion_requests", controls.PLAN, controls.LEDGER)}
    escalated = [row.customer_key for row in r.ledger.collect() if row.mode_escalated_at is not None]
    assert sorted(escalated) == sorted(key_of(spark, cfg, n) for n in fx.numbers_of(fx.GONE))


@pytest.mark.parametrize("n", [fx.UNDECIDED, fx.HELD, fx.REFUSED])
def test_requests_without_authorization_change_nothing(spark, cfg, final, n):
    key = key_of(spark, cfg, fx.ssn(n))
    for name in ("fa_pd_customer", "int_customer_protected", "dim_customer", "int_customer_services_resolved"):
        assert getattr(final, name).where(F.col("customer_key") == key).count() == 1
    assert final.int_customer_deletion_plan.where(F.col("deletion_request_id") == fx.request_of(n)).isEmpty()


def test_late_customer_is_recovered_by_the_next_build(spark, cfg):
    more = fx.customers() + [fx.change(fx.STRANGER, 1, "UPSERT", "2025-08-26T09:00:00")]
    later, want = staged(spark, fx.extracts(spark, customer=more), cfg), Expected(customers=more)
    assert reasons(later.quarantine_customer_events, "event_id") == want.rejects(want.events)
    assert later.int_invoices_resolved.count() == len(want.kept(want.invoices))
    assert f"bill-{fx.STRANGER}" in want.kept(want.invoices)
