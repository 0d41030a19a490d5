"""Service statistics looked up for a pair and its changes, not for every invoice day."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from test_resolve import D, INVOICE, LEDGER, SERVICE, invoice, one_pair, service
from veilwright.config import SPECIAL
from veilwright.operators import resolve as R
from veilwright.sources.tables import literal_relation


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mapped_statistics_read_the_invoices_once(spark, tmp_path):
    """Their days were a second read and three more exchanges of them before."""
    invoices, _, resolved = one_pair(spark, 20)
    invoices.write.parquet(f"{tmp_path}/invoices")
    invoices = spark.read.parquet(f"{tmp_path}/invoices")
    assert physical(R.mapped_service_stats(invoices, resolved)).count("FileScan parquet") == 1


def test_lookups_do_not_grow_with_invoice_days(spark):
    """One period and an invoice on each of many days: two changes in one row."""
    ledger = literal_relation(spark, [], LEDGER)
    periods = R.annotate_services(literal_relation(spark, [service(start=D, end=D + timedelta(50))], SERVICE), ledger)
    invoices = literal_relation(spark, [invoice(f"i{k}", issued=D + timedelta(k)) for k in range(-10, 90)], INVOICE)
    asked = R.annotate_invoices(invoices, ledger).selectExpr(
        "service_key", "customer_key", "cast(null as date) as issued_date", "cast(null as string) as deletion_mode"
    )
    pair = ["service_key", "customer_key"]
    rows = R._lookups(asked, R._source_periods(periods, pair), pair, True).collect()
    assert [(r.low, r.high, [c.day for c in r.changes]) for r in rows] == [(None, None, [D, D + timedelta(51)])]


def test_days_find_their_block(spark):
    """More changes than a row takes: days before, between and after them, on their ends, and none at all."""
    invoices, services, resolved = one_pair(spark, 100, length=0)
    ledger = literal_relation(spark, [], LEDGER)
    days = [None, date(1, 1, 1), date(9999, 12, 31), *(D + timedelta(k) for k in range(-2, 103))]
    invoices = R.annotate_invoices(literal_relation(spark, [invoice(f"i{n}", issued=d) for n, d in enumerate(days)], INVOICE), ledger)
    got = {r.issued_date: r for r in R.with_service_stats(invoices, services, resolved).collect()}
    assert len(got) == len(days)
    for d in days:
        k = (d - D).days if d else -1
        version = f"v{k:06}" if 0 <= k < 100 else None
        r = got[d]
        assert (r.source_service_version_key, r.mapped_service_version_key) == (version, version)
        assert (r.customer_service_period_count, r.valid_service_period_count) == (100, 100)
        assert r.effective_service_period_count == r.mapped_service_period_count == (version is not None)


def test_customers_are_found_for_rows_without_a_pair_and_repeat_with_the_map(spark):
    """Null keys, services that the customer does not have, both views, and a customer that is twice in the map."""
    ledger = literal_relation(spark, [("c2", SPECIAL)], LEDGER)
    rows = [("i1", "c1", "s1"), ("i2", "c1", None), ("i3", None, "s1"), ("i4", "c1", "s2"), ("i5", "c2", "s2"), ("i6", "c3", "s1"), ("i7", "c4", "s9")]
    invoices = R.annotate_invoices(literal_relation(spark, [invoice(*r) for r in rows], INVOICE), ledger)
    services = R.annotate_services(
        literal_relation(spark, [service("c1", "s1", "v1"), service("c2", "s2", "v2"), service("c3", None, "v3"), service(None, "s1", "v4")], SERVICE),
        ledger,
    )
    customers = literal_relation(spark, [("c1",), ("c3",), ("c3",), (None,)], "customer_key string")
    out = R.with_service_stats(invoices, services, customers=customers)
    got = sorted((r.invoice_id, r.customer_found, r.service_period_count, r.customer_service_period_count) for r in out.collect())
    assert got == [
        ("i1", True, 2, 1), ("i2", True, 0, 0), ("i3", False, 0, 0), ("i4", True, 0, 0), ("i5", False, 1, 1),
        ("i6", True, 2, 0), ("i6", True, 2, 0), ("i7", False, 0, 0),
    ]
    assert out.where(F.col("source_service_version_key").isNotNull()).count() == 2


def join_key_types(df):
    """Types of the keys of every equi-join."""
    found, nodes = set(), [df._jdf.queryExecution().sparkPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in node.nodeName() and hasattr(node, "leftKeys"):
            found |= {node.leftKeys().apply(i).dataType().typeName() for i in range(node.leftKeys().size())}
    return found


def test_mapped_statistics_join_packed_keys(spark):
    invoices = literal_relation(spark, [(*invoice("i1"), None)], f"{INVOICE}, deletion_mode string")
    found = join_key_types(R.mapped_service_stats(invoices, literal_relation(spark, [service()], SERVICE)))
    assert "binary" in found and "string" not in found
