import random
from collections import Counter

from pyspark.sql import functions as F

from veilwright.operators import audits as A
from veilwright.sources.tables import literal_relation


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_column_rules(spark):
    df = literal_relation(spark, [(1, "a"), (1, None), (2, "c"), (None, None)], "id int, v string")
    assert rows(A.audit_not_null(df, ["id", "v"])) == [("id", 1), ("v", 2)]
    assert rows(A.audit_unique(df, ["id"])) == [(1, 2)]
    assert A.audit_unique(df.where("id is not null"), ["id", "v"]).isEmpty()
    assert rows(A.audit_accepted(df, "v", ["a"])) == [("c", 1)]
    parent = literal_relation(spark, [(1,)], "pid int")
    assert rows(A.audit_fk(df, "id", parent, "pid")) == [(2,)]
    assert A.audit_fk(df, "id", parent, "pid", F.col("v") != "c").isEmpty()


def test_set_and_bag_differences(spark):
    a = literal_relation(spark, [(1, None), (1, None), (2, "x")], "id int, v string")
    b = literal_relation(spark, [(1, None), (3, "y"), (3, "y")], "id int, v string")
    assert rows(A.audit_same_rows(a, b)) == [("MISSING", 2, "x"), ("UNEXPECTED", 3, "y")]
    assert sorted(map(tuple, A.audit_same_bag(a, b).select("difference_type", "id", "surplus_rows").collect())) == [
        ("MISSING", 1, 1), ("MISSING", 2, 1), ("UNEXPECTED", 3, 2),
    ]
    assert A.audit_same_rows(a, a).isEmpty() and A.audit_same_bag(a, a).isEmpty()


def test_differences_against_brute_force(spark):
    pick = random.Random(9)
    values = [None, 0, 1, 2]
    for changed in (0, 1, 40):
        left = [(pick.choice(values), pick.choice([None, "x", ""]), pick.choice(values)) for _ in range(300)]
        right = list(left)
        for _ in range(changed):
            right[pick.randrange(300)] = (pick.choice(values), pick.choice([None, "x", "y"]), pick.choice(values))
        pick.shuffle(right)
        a, b = (literal_relation(spark, r, "i int, s string, j int") for r in (left, right))
        surplus = Counter(left)
        surplus.subtract(Counter(right))
        found = {tuple(r)[1:4]: (r.difference_type, r.surplus_rows) for r in A.audit_same_bag(a, b).collect()}
        assert found == {r: ("MISSING" if n > 0 else "UNEXPECTED", abs(n)) for r, n in surplus.items() if n}
        assert Counter(map(tuple, A.audit_same_rows(a, b).collect())) == Counter(
            [("MISSING", *r) for r in set(left) - set(right)] + [("UNEXPECTED", *r) for r in set(right) - set(left)]
        )


def test_nulls_in_other_columns_are_other_rows(spark):
    a = literal_relation(spark, [(None, 5), (7, None)], "i int, j int")
    b = literal_relation(spark, [(5, None), (None, 7)], "i int, j int")
    assert A.audit_same_bag(a, b).count() == 4 and A.audit_same_rows(a, b).count() == 4


def test_equal_sides_shuffle_digests_only(spark, tmp_path):
    wide = spark.range(20_000).selectExpr("id", "cast(id % 7 as string) AS s", "repeat('x', 200) AS w")
    for name, n in (("a", 5), ("b", 3)):
        wide.repartition(n).write.parquet(str(tmp_path / name))
    wide.withColumn("s", F.when(F.col("id") == 77, "other").otherwise(F.col("s"))).write.parquet(str(tmp_path / "c"))
    a, b, c = (spark.read.parquet(str(tmp_path / name)) for name in "abc")
    for audit in (A.audit_same_rows, A.audit_same_bag, lambda x, y: A.audit_projection(x, y, "id")):
        for other, differs in ((b, False), (c, True)):
            found = audit(a, other)
            assert bool(found.collect()) == differs
            plan = found._jdf.queryExecution().executedPlan().toString()
            final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
            # Rows are exchanged by their values (or key) only where some ranges differ.
            assert ("Exchange hashpartitioning(id" in final) == differs


def test_bag_difference_of_very_many_copies_is_one_row(spark):
    many = spark.range(3).selectExpr("id % 1 AS k")
    found = A.audit_same_bag(many, many.where("false"))
    assert rows(found) == [("MISSING", 0, 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "sequence" not in plan and "Generate" not in plan


def test_partition(spark):
    expected = literal_relation(spark, [("a", 1), ("b", 1), ("c", 0), ("d", 1)], "k string, expected_occurrence_count int")
    one = literal_relation(spark, [("a",), ("b",), ("x",)], "k string")
    two = literal_relation(spark, [("b",), ("c",)], "k string")
    assert sorted(r.record_key for r in A.audit_partition(expected, [one, two], "k").collect()) == ["b", "c", "d", "x"]
    good = literal_relation(spark, [("a",), ("d",)], "k string")
    assert A.audit_partition(expected, [good, one.where("k = 'b'")], "k").isEmpty()


def test_tuples_and_projection(spark):
    child = literal_relation(spark, [("a", 5), ("a", 15), ("b", 5), (None, 5)], "k string, day int")
    parent = literal_relation(spark, [("a", 0, 10)], "k string, lo int, hi int")
    inside = F.col("child.day").between(F.col("parent.lo"), F.col("parent.hi"))
    assert A.audit_tuple(child, parent, ["k"], inside).count() == 3
    left = literal_relation(spark, [(1, "a", None), (2, "b", "x"), (3, "c", "z")], "id int, v string, w string")
    right = literal_relation(spark, [(1, "a", None), (2, "b", "y"), (4, "d", "q")], "id int, v string, w string")
    assert rows(A.audit_projection(left, right, "id")) == [(2,), (3,), (4,)]


def test_counts_and_metrics(spark):
    a, b = spark.range(3), spark.range(4)
    assert rows(A.audit_row_bounds({"a": a, "b": b}, 4, 10)) == [("a", 3)]
    assert rows(A.audit_counts({"ok": (b, a, 1), "off": (a, b, 0)})) == [("off", 3, 4)]
    expected = literal_relation(spark, [("rows", 3), ("gone", 1)], "metric string, value bigint")
    actual = A.metrics(spark, {"rows": (a, F.count("*")), "new": (b, F.max("id"))})
    assert sorted(r.metric for r in A.audit_metrics(actual, expected).collect()) == ["gone", "new"]


def test_payment(spark):
    df = literal_relation(
        spark,
        [("ok", 10, 20, 15, True), ("open", 10, 20, None, False), ("range", 10, 5, None, False), ("missing", 10, 20, None, True),
         ("unexpected", 10, 20, 15, False), ("early", 10, 20, 5, True), ("unknown", 10, 20, 15, None)],
        "invoice_key string, issue_date_key int, due_date_key int, paid_date_key int, is_paid boolean",
    )
    assert [r[0] for r in rows(A.audit_payment(df))] == ["early", "missing", "range", "unexpected"]


def test_key_contract_and_summary(spark, cfg):
    df = literal_relation(spark, [(" A@x.invalid ",), (None,), ("",), ("straße",)], "v string")
    contract = A.audit_key_contract(df, "v", cfg)
    assert contract.collect() == []
    summary = A.summarize({"keys": contract, "some": df})
    assert rows(summary) == [("keys", "pass", 0), ("some", "fail", 4)]
    assert summary.columns == ["audit", "status", "findings"]
