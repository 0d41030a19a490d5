import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from veilwright.sources import tables
from veilwright.sources.tables import (
    Checks,
    Conflict,
    ContractError,
    Snapshot,
    TableStore,
    literal_relation,
    merge_by_key,
    publish_view,
)


def test_publish_replaces_whole_tables_and_keeps_old_versions(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    assert store.read("t") is None
    store.publish(literal_relation(spark, [(1, "a"), (2, "b")], "id int, v string"), "t", "first")
    store.publish(literal_relation(spark, [(3, "c")], "id int, v string"), "t", "second")
    assert [tuple(r) for r in store.read("t").collect()] == [(3, "c")]
    assert spark.read.parquet(store.version_path("t", "first")).count() == 2
    # A version that was written but not switched stays invisible.
    store.write_version(literal_relation(spark, [], "id int, v string"), "t", "third")
    assert store.current_versions() == {"t": "second"}


def test_views_are_evaluated_when_read(spark):
    from pyspark.sql import functions as F

    failing = spark.range(3).withColumn("v", F.when(F.col("id") == 2, F.raise_error(F.lit("evaluated"))).cast("string"))
    assert publish_view(failing, "some_view") is failing
    assert spark.table("some_view").where("id < 2").count() == 2
    with pytest.raises(Exception, match="evaluated"):
        spark.table("some_view").collect()


def test_merge_updates_inserts_and_keeps(spark):
    old = literal_relation(spark, [(1, "a"), (2, "b")], "id int, v string")
    new = literal_relation(spark, [(2, "B"), (3, "C")], "id int, v string")
    assert sorted(map(tuple, merge_by_key(old, new, ["id"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    with pytest.raises(ContractError):
        merge_by_key(old, new.withColumnRenamed("v", "w"), ["id"])


def test_switches_at_the_same_time_lose_none(spark, tmp_path):
    stores = [TableStore(spark, str(tmp_path)) for _ in range(6)]
    with ThreadPoolExecutor(6) as pool:
        found = list(pool.map(lambda i: stores[i % 6].switch([f"t{i}", "shared"], f"v{i}"), range(24)))
    assert sorted(s.sequence for s in found) == list(range(1, 25))
    last = max(found, key=lambda s: s.sequence)
    assert stores[0].snapshot() == last
    assert {n for n in last.relations} == {"shared", *(f"t{i}" for i in range(24))}
    assert all(last.relations[f"t{i}"].tip == f"v{i}" for i in range(24))


def test_a_switch_on_a_stale_state_is_refused(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    began = store.switch(["a", "b"], "first")
    store.switch(["c"], "other")
    assert store.switch(["a"], "second", began, ["a", "b"]).sequence == 3
    with pytest.raises(Conflict, match="since entry 1: a"):
        store.switch(["b"], "third", began, ["a", "b"])
    assert store.current_versions() == {"a": "second", "b": "first", "c": "other"}


def test_entries_are_created_once_by_rename_too(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path))
    monkeypatch.setattr(tables, "LINKED", ())
    assert store.log.create(1, {"relations": {}}) and not store.log.create(1, {"other": 1})
    assert store.snapshot() == Snapshot(1, {})
    assert [p.name for p in (tmp_path / "_manifest").iterdir() if not p.name.startswith(".")] == ["000000000001.json"]


def test_changes_merge_on_read_and_compact(spark, tmp_path):
    store, schema, pick = TableStore(spark, str(tmp_path)), "k int, part string, v int", random.Random(3)
    expected, sizes = {}, []
    for run in range(14):
        rows = {(pick.randint(0, 400), p): pick.randint(0, 9) for p in "ab" for _ in range(300 if run == 0 else 12)}
        expected.update(rows)
        changes = literal_relation(spark, [(*k, v) for k, v in rows.items()], schema)
        merged, written, parts = store.write_changes(changes, "t", f"v{run}", ("k", "part"), store.snapshot())
        store.switch({"t": parts}, f"v{run}")
        sizes.append(len(parts.versions))
        assert written.count() == len(rows)
        for found in (merged, store.read("t")):
            got = found.collect()
            assert {(r.k, r.part): r.v for r in got} == expected and len(got) == len(expected)
    assert max(sizes) > 3 and 1 in sizes[1:]
    before = store.snapshot()
    nothing = literal_relation(spark, [], schema)
    merged, written, parts = store.write_changes(nothing, "t", "none", ("k", "part"), before)
    assert parts == before.relations["t"] and merged.count() == len(expected) and written.isEmpty()


def test_rows_are_checked_as_they_are_written(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    checks = Checks(("id",), {"v": ("a", "b")}, {"positive": "id > 0"})
    good = literal_relation(spark, [(1, "a"), (2, None)], "id int, v string")
    store.publish(good, "t", "first", checks=checks)
    bad = literal_relation(spark, [(1, "c"), (None, "c"), (0, "a"), (None, None)], "id int, v string")
    with pytest.raises(ContractError, match="id is null in 2 rows; v is not one of a, b in 2 rows; not positive in 1 rows"):
        store.publish(bad, "t", "second", checks=checks)
    assert store.current_versions() == {"t": "first"}
    store.publish(literal_relation(spark, [], "id int, v string"), "t", "empty", checks=checks)
    assert store.read("t").isEmpty()
