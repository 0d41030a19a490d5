"""What single queries build, write and exchange, over their own few source rows."""

from datetime import date, datetime, timedelta

import pytest

import fixture_rows as fx
from test_goldens import staged
from test_lookups import join_key_types
from test_resolve import INVOICE, LEDGER, SERVICE, invoice, service
from veilwright.config import CASE_USERS, Persona
from veilwright.operators import audits as A
from veilwright.operators import incremental as I
from veilwright.operators import resolve as R
from veilwright.plans.catalog import QUERIES, Run
from veilwright.sources.tables import literal_relation


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A few customers, orders and events, every seventeenth customer deleted."""
    at = str(tmp_path_factory.mktemp("tables"))
    people = [(k, f"Customer#{k}", k % 25, 10.0 + k, "BUILDING") for k in range(120)]
    orders = [(o, o % 120, "FO"[o % 2], 10.0 + o, datetime(1996, 1, 1) + timedelta(o), "1") for o in range(400)]
    events = [(e, datetime(2024, 1, 1) + timedelta(hours=e), e % 120, ("click", "view", "error")[e % 3], 1.0 + e, "{}") for e in range(300)]
    for name, rows, schema in (
        ("customer", people, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        ("orders", orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        ("events", events, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"),
    ):
        literal_relation(spark, rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


def test_broken_pending_audit_builds_only_its_two_outputs(spark, folder):
    run = Run(spark, folder)
    found = QUERIES["audit_pending_untouched_broken"](run).collect()
    assert {r.relation for r in found} == {"fct_customer_event", "fa_pd_customer"}
    built = {n for n in vars(run.up) if n.startswith(("int_invoice", "fct_", "quarantine_", "int_customer_service", "int_customer_event"))}
    assert built == {"int_customer_events_keyed"}


def test_absence_audit_writes_neither_fact_nor_keyed_rows(spark, folder):
    run = Run(spark, folder)
    found = QUERIES["audit_deleted_absent"](run).collect()
    assert found and {r.relation for r in found} == {"int_invoices_keyed"}
    deleted = {r.customer_key for r in run.up.ledger.collect()}
    keyed = run.up.int_invoices_keyed.groupBy("customer_key").count().collect()
    assert {(r.customer_key, r.row_count) for r in found} == {(r.customer_key, r["count"]) for r in keyed if r.customer_key in deleted}
    for name in ("fct_invoice", "int_invoices_keyed", "int_customer_events_keyed"):
        assert not any(f"/{name}-" in f for f in getattr(run.up, name).inputFiles()), name


def test_absence_audit_keeps_keys_of_any_form(spark):
    keys = [None, "", "-99999", "v1:" + "0a" * 32, "v1:" + "0A" * 32]
    rows = literal_relation(spark, [(k,) for k in keys * 2], "customer_key string")
    ledger = literal_relation(spark, [(k,) for k in keys], "customer_key string")
    out = A.audit_deleted_absent({"a": rows}, ledger)
    assert sorted((r.customer_key, r.row_count) for r in out.collect()) == sorted((k, 2) for k in keys[1:])
    assert join_key_types(out) == {"binary"}


def test_invoice_view_joins_packed_keys(spark, cfg):
    r = staged(spark, fx.extracts(spark), cfg)
    view = r.case_fct_invoice(Persona.of(CASE_USERS))
    assert join_key_types(view) == {"binary"}
    key = "^v1:[0-9a-f]{64}$"
    rows = view.where(" and ".join(f"{c} rlike '{key}'" for c in view.columns if c.endswith("_key") and "date" not in c and c != "invoice_key"))
    assert rows.count() == view.count() > 0


def test_services_and_their_map_join_packed_keys(spark, cfg):
    r = staged(spark, fx.extracts(spark), cfg)
    out = R.resolve_services(r.int_customer_services_keyed, r.ledger, r.fa_pd_customer, r.fa_pd_service_address)
    assert join_key_types(out) == {"binary"}


def test_rebuild_writes_affected_rows_once_and_carries_over_the_rest(spark, cfg, tmp_path):
    """Four invoices: one changed, one of a changed service, one gone, one as it was."""

    def versions(before, after, schema):
        return I.Versions(literal_relation(spark, before, schema), literal_relation(spark, after, schema))

    c, s, t = (f"v1:{d * 64}" for d in "abc")
    before = [invoice("i1", c, s), invoice("i2", c, t), invoice("i3", c, s), invoice("i4", c, s)]
    after = [invoice("i1", c, s, paid=True, paid_at=date(2026, 1, 12)), invoice("i2", c, t), invoice("i4", c, s)]
    periods = [service(c, s, f"v1:{'1' * 64}"), service(c, t, f"v1:{'2' * 64}")]
    moved = [periods[0], service(c, t, f"v1:{'3' * 64}")]
    invoices, services = versions(before, after, INVOICE), versions(periods, moved, SERVICE)
    accepted = I.Versions(services.before.drop("service_id"), services.after.drop("service_id"))
    ledger, known = versions([], [], LEDGER), versions([(c,)], [(c,)], "customer_key string")
    written = {}

    def stage(name, df):
        df.write.parquet(f"{tmp_path}/{name}")
        written[name] = spark.read.parquet(f"{tmp_path}/{name}")
        return written[name]

    previous = R.resolve_invoices(invoices.before, services.before, accepted.before, ledger.before, known.before, cfg)
    rebuilt = I.rebuild_invoices(invoices, services, accepted, ledger, known, previous, cfg, stage)
    full = R.resolve_invoices(invoices.after, services.after, accepted.after, ledger.after, known.after, cfg)
    assert sorted(map(str, rebuilt.collect())) == sorted(map(str, full.collect()))
    assert sorted(r.invoice_id for r in written["_affected_invoices"].collect()) == ["i1", "i2", "i3"]
    rows = {r.invoice_id: (r.customer_key, r.service_key) for r in written["_affected_invoice_rows"].collect()}
    assert rows == {"i1": (c, s), "i2": (c, t)}
