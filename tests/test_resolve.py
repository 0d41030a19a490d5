import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from veilwright.operators import incremental as I
from veilwright.operators import resolve as R
from veilwright.sources.tables import literal_relation

SPECIAL, FULL = "SPECIAL_DELETION", "FULL_GOVERNED_OUTPUT_DELETION"
INVOICE = (
    "invoice_id string, customer_key string, service_key string, amount decimal(18,2), currency_code string, "
    "issued_date date, due_date date, is_paid boolean, paid_at date, source_is_due boolean, source_updated_at timestamp"
)
SERVICE = (
    "service_id string, customer_key string, service_key string, service_version_key string, "
    "installation_address_key string, service_type string, is_valid boolean, valid_from date, valid_to date, "
    "source_updated_at timestamp"
)
RESOLVED = SERVICE.replace("service_id string, ", "")
EVENT = (
    "event_id string, customer_key string, event_type string, occurred_at timestamp, measure_value decimal(18,2), "
    "measure_unit string, source_updated_at timestamp"
)
LEDGER = "customer_key string, deletion_mode string"
D = date(2026, 1, 10)


def invoice(i, customer="c1", service="s1", issued=D, due=None, paid=False, paid_at=None):
    return (i, customer, service, None, "EUR", issued, due or D + timedelta(30), paid, paid_at, False, None)


def service(customer="c1", key="s1", version="v1", valid=True, start=date(2025, 1, 1), end=date(2027, 1, 1), address="a1"):
    return (key, customer, key, version, address, "INTERNET", valid, start, end, None)


def resolve(spark, cfg, invoices, services, resolved=None, ledger=(), customers=("c1",)):
    keyed = literal_relation(spark, services, SERVICE)
    out = R.resolve_invoices(
        literal_relation(spark, invoices, INVOICE),
        keyed,
        keyed.drop("service_id") if resolved is None else literal_relation(spark, resolved, RESOLVED),
        literal_relation(spark, ledger, LEDGER),
        literal_relation(spark, [(c,) for c in customers], "customer_key string"),
        cfg,
    )
    return {r.invoice_id: r for r in out.collect()}


def test_every_reason_in_order(spark, cfg):
    other_day = date(2030, 1, 1)
    services = [
        service(),
        service("c2", "s2", "v2"),
        service("c1", "s3", "v3", valid=False),
        service("c1", "s4", "v4a"),
        service("c1", "s4", "v4b", start=date(2025, 6, 1)),
        service("c1", "s5", "v5"),
        service("c1", "s6", "v6"),
        service("c1", "s7", "v7", start=date(2026, 2, 1), end=date(2025, 2, 1)),
    ]
    mapped = [s[1:] for s in services if s[2] in ("s1", "s4", "s6")] + [service("c1", "s6", "v6b")[1:]]
    got = resolve(
        spark, cfg,
        [
            invoice("no customer", "nobody"), invoice("no service", service="none"), invoice("mismatch", service="s2"),
            invoice("invalid", service="s3"), invoice("reversed", service="s7"), invoice("other day", issued=other_day),
            invoice("ambiguous", service="s4"), invoice("unmapped", service="s5"), invoice("twice mapped", service="s6"),
            invoice("dates", due=D - timedelta(1)), invoice("missing", paid=True),
            invoice("unexpected", paid_at=D + timedelta(1)), invoice("early", paid=True, paid_at=D - timedelta(1)),
            invoice("fine", paid=True, paid_at=D), invoice("unknown paid", paid=None, paid_at=D),
            invoice("unknown due", due=D) [:6] + (None,) + invoice("x")[7:],
        ],
        services, mapped,
    )
    assert {k: v.resolution_status for k, v in got.items()} == {
        "no customer": "CUSTOMER_NOT_FOUND",
        "no service": "SERVICE_NOT_FOUND",
        "mismatch": "CUSTOMER_SERVICE_MISMATCH",
        "invalid": "SERVICE_INVALID",
        "reversed": "SERVICE_INVALID",
        "other day": "SERVICE_NOT_VALID_ON_ISSUE_DATE",
        "ambiguous": "SERVICE_VERSION_AMBIGUOUS",
        "unmapped": "SERVICE_MAP_ENTRY_NOT_FOUND",
        "twice mapped": "SERVICE_VERSION_AMBIGUOUS",
        "dates": "INVALID_INVOICE_DATE_RANGE",
        "missing": "PAYMENT_DATE_MISSING",
        "unexpected": "PAYMENT_DATE_UNEXPECTED",
        "early": "PAYMENT_BEFORE_ISSUE_DATE",
        "fine": "ACCEPTED",
        "unknown paid": "ACCEPTED",
        "unknown due": "ACCEPTED",
    }


def test_erased_invoices(spark, cfg):
    ledger = [("special", SPECIAL), ("full", FULL)]
    services = [service("special"), service("full", "s2"), service("c1", "s3", "v3"), service("special", "s4", valid=False)]
    got = resolve(
        spark, cfg,
        [
            invoice("special", "special"), invoice("full", "full", "s2"), invoice("plain", "c1", "s3"),
            invoice("hidden", "c1", "s1"), invoice("late", "special", due=D - timedelta(9)), invoice("bad", "special", "s4"),
        ],
        services, [s[1:] for s in services[2:3]], ledger,
    )
    assert "full" not in got
    keys = lambda r: (r.customer_key, r.service_key, r.resolved_service_version_key)
    assert keys(got["special"]) == ("-99999",) * 3 and got["special"].resolution_status == "ACCEPTED"
    assert keys(got["plain"]) == ("c1", "s3", "v3") and not got["plain"].is_erased_customer
    # A deleted customer's service is invisible to others; erasure does not repair bad data.
    assert got["hidden"].resolution_status == "SERVICE_NOT_FOUND"
    assert got["late"].resolution_status == "INVALID_INVOICE_DATE_RANGE" and got["late"].is_erased_customer
    assert got["bad"].resolution_status == "SERVICE_INVALID" and got["bad"].is_erased_customer


def test_erased_events(spark, cfg):
    rows = [(k, k, "USAGE", None, None, "GB", None) for k in ("special", "full", "c1", "nobody")]
    out = R.resolve_events(
        literal_relation(spark, rows, EVENT),
        literal_relation(spark, [("special", SPECIAL), ("full", FULL)], LEDGER),
        literal_relation(spark, [("c1",)], "customer_key string"),
        cfg,
    )
    got = {r.event_id: (r.customer_key, r.resolution_status, r.is_erased_customer) for r in out.collect()}
    assert got == {
        "special": ("-99999", "ACCEPTED", True),
        "c1": ("c1", "ACCEPTED", False),
        "nobody": ("nobody", "CUSTOMER_NOT_FOUND", False),
    }


def test_service_reasons_and_late_arrival(spark, cfg):
    rows = [
        service("c1", "s1", "v1"), service("c1", "s2", "v2", valid=False),
        service("c1", "s3", "v3", start=date(2027, 1, 1), end=date(2026, 1, 1)),
        service("c1", "s4", "v4", address=None), service("gone", "s5", "v5"),
    ]
    keyed = literal_relation(spark, rows, SERVICE)
    ledger = literal_relation(spark, [("gone", SPECIAL)], LEDGER)

    def statuses(customers, mapped):
        out = R.resolve_services(
            keyed, ledger, literal_relation(spark, customers, "customer_key string"), literal_relation(spark, mapped, RESOLVED)
        )
        return {r.service_key: r.resolution_status for r in out.collect()}

    before = statuses([], [])
    assert set(before.values()) == {"CUSTOMER_NOT_FOUND"} and len(before) == 4
    assert statuses([("c1",)], [r[1:] for r in rows]) == {
        "s1": "ACCEPTED", "s2": "INVALID_VALIDITY_FLAG", "s3": "INVALID_VALIDITY_PERIOD", "s4": "PRIVA_MAP_ENTRY_NOT_FOUND",
    }


def _brute_force(invoices, services, mapped):
    out = {}
    for i, customer, key, issued, mode in invoices:
        same = [s for s in services if s[1] == key and (mode or not s[6])]
        own = [s for s in same if s[0] == customer]
        ok = [s for s in own if s[3] and s[4] and s[5] and s[5] >= s[4]]
        hit = [s for s in ok if issued and s[4] <= issued <= s[5]]
        in_map = [m for m in mapped if m[0] == customer and m[1] == key and issued and m[3] <= issued <= m[4]]
        out[i] = (
            len(same), len(own), len(ok), len(hit), max((s[2] for s in hit), default=None),
            len(in_map), max((m[2] for m in in_map), default=None),
        )
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_statistics_match_brute_force_under_skew(spark, seed):
    """Random periods, with one customer, service and pair holding a third of all rows."""
    rng = random.Random(seed)
    start = date(2025, 1, 1)

    def day():
        return start + timedelta(rng.randrange(60))

    modes = {f"c{n}": (SPECIAL if n == 2 else None) for n in range(5)}

    def pick(prefix):
        return f"{prefix}0" if rng.random() < 0.34 else f"{prefix}{rng.randrange(5)}"

    services = []
    for n in range(400):
        customer, key = ("c0", "s0") if rng.random() < 0.34 else (pick("c"), pick("s"))
        bounds = (None, day()) if n % 50 == 0 else (day(), day())
        services.append((customer, key, f"v{rng.randrange(40)}", rng.random() < 0.8, *bounds, modes[customer]))
    mapped = [
        (c, k, v, f, t) for c, k, v, valid, f, t, mode in services if valid and f and t and t >= f and not mode and rng.random() < 0.5
    ]
    invoices = []
    for n in range(600):
        customer, key = ("c0", "s0") if rng.random() < 0.34 else (pick("c"), f"s{rng.randrange(7)}")
        issued = None if n % 60 == 0 else day()
        invoices.append((f"i{n}", customer, key, issued, modes[customer]))
    inv = literal_relation(spark, invoices, "invoice_id string, customer_key string, service_key string, issued_date date, deletion_mode string")
    svc = literal_relation(
        spark, services,
        "customer_key string, service_key string, service_version_key string, is_valid boolean, valid_from date, "
        "valid_to date, deletion_mode string",
    )
    acc = literal_relation(spark, mapped, "customer_key string, service_key string, service_version_key string, valid_from date, valid_to date")
    got = R.with_service_stats(inv, svc, acc).collect()
    assert len(got) == len(invoices)
    names = (
        "service_period_count", "customer_service_period_count", "valid_service_period_count",
        "effective_service_period_count", "source_service_version_key", "mapped_service_period_count",
        "mapped_service_version_key",
    )
    assert {r.invoice_id: tuple(r[n] for n in names) for r in got} == _brute_force(invoices, services, mapped)


def test_due_flag_is_inclusive_and_null_safe(spark, cfg):
    rows = [("a", False, date(2026, 3, 1)), ("b", False, date(2026, 3, 2)), ("c", True, date(2026, 1, 1)), ("d", None, date(2026, 1, 1))]
    df = R.with_due_flag(literal_relation(spark, rows, "id string, is_paid boolean, due_date date"), cfg)
    assert {r.id: r.is_due for r in df.collect()} == {"a": True, "b": False, "c": False, "d": None}
    assert df.where(F.col("is_due").isNull()).count() == 1


def one_pair(spark, n, length=400):
    """A pair with an invoice on each of n days and a period starting on each of them."""
    days = [D + timedelta(i) for i in range(n)]
    invoices = literal_relation(spark, [invoice(f"i{k}", issued=d) for k, d in enumerate(days)], INVOICE)
    periods = [service(version=f"v{k:06}", start=d, end=d + timedelta(length)) for k, d in enumerate(days)]
    ledger = literal_relation(spark, [], LEDGER)
    services = literal_relation(spark, periods, SERVICE)
    return R.annotate_invoices(invoices, ledger), R.annotate_services(services, ledger), services


def test_one_pair_with_many_overlapping_periods(spark):
    invoices, services, resolved = one_pair(spark, 700)
    rows = R.with_service_stats(invoices, services, resolved).collect()
    for r in rows:
        k = int(r.invoice_id[1:])
        assert r.effective_service_period_count == r.mapped_service_period_count == min(k, 400) + 1
        assert r.source_service_version_key == r.mapped_service_version_key == f"v{k:06}"


def test_periods_that_follow_each_other_are_swept_only(spark):
    """Without overlaps no day is unclear: gaps, one-day periods, a shorter one that has ended, and a far end."""
    periods = [
        service(version="a", start=D, end=D + timedelta(9)),
        service(version="b", start=D + timedelta(10), end=D + timedelta(10)),
        service(version="c", start=D + timedelta(20), end=date(9999, 12, 31)),
    ]
    invoices = [invoice(f"i{k}", issued=D + timedelta(k)) for k in range(-2, 40)]
    ledger = literal_relation(spark, [], LEDGER)
    inv = R.annotate_invoices(literal_relation(spark, invoices, INVOICE), ledger)
    services = literal_relation(spark, periods, SERVICE)
    pair = ["service_key", "customer_key"]
    svc = R.annotate_services(services, ledger)
    assert R._day_stats(R._sweep(inv, R._source_periods(svc, pair), pair), pair).where("unclear").isEmpty()
    got = {int(r.invoice_id[1:]): r.source_service_version_key for r in R.with_service_stats(inv, svc, services).collect()}
    assert got == {k: "a" if 0 <= k < 10 else "b" if k == 10 else "c" if k >= 20 else None for k in range(-2, 40)}
    # A short period inside a long one: the days after it are found by their periods.
    inner = literal_relation(spark, [*periods[:1], service(version="z", start=D + timedelta(2), end=D + timedelta(3))], SERVICE)
    svc = R.annotate_services(inner, ledger)
    got = {int(r.invoice_id[1:]): r.source_service_version_key for r in R.with_service_stats(inv, svc, inner).collect()}
    assert got == {k: "z" if k in (2, 3) else "a" if 0 <= k < 10 else None for k in range(-2, 40)}


def test_work_of_one_pair_is_linear_in_its_days(spark):
    """Twice the days give about twice the pieces and twice the day-to-piece meetings."""
    work = []
    for n in (600, 1200):
        invoices, services, _ = one_pair(spark, n)
        pair = ["service_key", "customer_key"]
        periods = R._source_periods(services, pair)
        swept = R._sweep(invoices, periods, pair)
        assert swept.count() == n
        days = R._day_stats(swept, pair).where("unclear")
        assert n - 2 <= days.count() <= n
        pieces = R._pieces(days, periods, pair).withColumnRenamed("_month", "month")
        months = days.groupBy(F.trunc("issued_date", "MM").alias("month")).agg(F.count("*").alias("d"))
        met = pieces.groupBy("month").agg(F.count("*").alias("p")).join(months, "month").agg(F.sum(F.col("d") * F.col("p")))
        work.append((pieces.count(), met.first()[0]))
    assert work[1][0] < 2.5 * work[0][0] and work[1][1] < 2.5 * work[0][1]
    assert work[1][0] < 70 * 1200 / 30 * 2


def _versions(spark, before, after, schema):
    return I.Versions(literal_relation(spark, before, schema), literal_relation(spark, after, schema))


def test_changed_keys_are_those_with_other_rows(spark):
    rows = [("a", 1), ("a", 1), ("b", 2), ("c", None), (None, 4), ("same", 7), ("same", 8)]
    now = [("a", 1), ("b", 3), ("c", 0), (None, 5), ("same", 8), ("same", 7), ("new", 1)]
    found = _versions(spark, rows, now, "k string, v int").changed("k").collect()
    assert sorted(str(r.k) for r in found) == ["None", "a", "b", "c", "new"]
    assert _versions(spark, rows, rows[::-1], "k string, v int").changed("k").isEmpty()
    assert _versions(spark, [], [], "k string, v int").changed("k").isEmpty()


def test_rebuilt_invoices_follow_customers_services_and_ledger(spark, cfg):
    """Random versions of every input, with null keys and repeated ids: as resolved in full."""
    rnd = random.Random(3)
    customers = ["c1", "c2", "c3", "c4", None]
    keys = ["s1", "s2", "s3", "s4", None]

    def version():
        return (
            [invoice(f"i{rnd.randrange(40)}" if n else None, rnd.choice(customers), rnd.choice(keys)) for n in range(60)],
            [service(rnd.choice(customers), rnd.choice(keys), f"v{n}", rnd.random() < 0.9) for n in range(8)],
            [(c, rnd.choice([SPECIAL, FULL])) for c in customers[:4] if rnd.random() < 0.4],
            [(c,) for c in customers[:4] if rnd.random() < 0.8],
        )

    first, second = version(), version()
    # Most rows stay as they were, so that some outcomes are carried over.
    second = (first[0][:50] + second[0][:5], first[1][:7] + second[1][:1], second[2], first[3][1:])
    schemas = (INVOICE, SERVICE, LEDGER, "customer_key string")
    invoices, services, ledger, known = (_versions(spark, a, b, s) for a, b, s in zip(first, second, schemas))
    accepted = I.Versions(*(df.drop("service_id").where("is_valid") for df in (services.before, services.after)))

    def full(side):
        parts = (getattr(v, side) for v in (invoices, services, accepted, ledger, known))
        return R.resolve_invoices(*parts, cfg)

    rebuilt = I.rebuild_invoices(invoices, services, accepted, ledger, known, full("before"), cfg)
    expected = full("after")
    assert sorted(map(str, rebuilt.select(expected.columns).collect())) == sorted(map(str, expected.collect()))


def test_quarantine_on_raw_identifiers_keeps_staged_rows(spark, cfg):
    """Every staged row of a rejected id, also of a repeated one, with its own identifiers; no erased and no accepted ones."""
    staged = literal_relation(
        spark,
        [("i1", "111111111", "s1", None, "EUR", D, D, False, None, True, None),
         ("i1", "222222222", "s2", None, "EUR", D, D, False, None, False, None),
         ("i2", "333333333", "s3", None, "EUR", D, D, False, None, False, None),
         ("i3", "444444444", "s4", None, "EUR", D, D, False, None, False, None)],
        "invoice_id string, customer_ssn string, service_id string, amount decimal(18,2), currency_code string, issued_date date, "
        "due_date date, is_paid boolean, paid_at date, is_due boolean, source_updated_at timestamp",
    )
    outcome = literal_relation(
        spark,
        [("i1", "111111111", "s1", "SERVICE_NOT_FOUND", False), ("i2", "333333333", "s3", R.ACCEPTED, False),
         ("i3", "-99999", "-99999", "SERVICE_NOT_FOUND", True)],
        "invoice_id string, customer_ssn string, service_id string, resolution_status string, is_erased_customer boolean",
    )
    out = R.quarantine_invoices_raw(staged, outcome, cfg).collect()
    assert sorted((r.invoice_id, r.customer_ssn, r.service_id, r.source_is_due, r.quarantine_reason) for r in out) == [
        ("i1", "111111111", "s1", True, "SERVICE_NOT_FOUND"), ("i1", "222222222", "s2", False, "SERVICE_NOT_FOUND"),
    ]


def test_packed_keys_come_back_and_stay_apart(spark):
    digits = "0123456789abcdef" * 4
    keys = [None, "", "c1", f"v1:{digits}", f"v2:{digits}", f":{digits}", f"v1:{digits.upper()}", f"v1:{digits}\n", digits, f"é:{digits}", "-99999"]
    rows = literal_relation(spark, [(i, k) for i, k in enumerate(keys)], "i int, k string")
    packed = R._packed(rows, "k")
    assert {r.i: r.k for r in R._unpacked(packed, "k").collect()} == dict(enumerate(keys))
    assert packed.where("k is not null").distinct().count() == len(keys) - 1
    assert packed.where("i = 3").first().k == bytearray(b"\x01" + bytes.fromhex(digits) + b"v1:")
