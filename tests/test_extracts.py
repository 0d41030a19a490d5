import random
from collections import Counter

import pytest

from veilwright.schemas import EXTRACT_COLUMNS, extract_schema
from veilwright.sources.csv_ranges import after_line
from veilwright.sources.extracts import read_extract

NAME = "customer_events"
COLUMNS = list(EXTRACT_COLUMNS[NAME])
GOOD = ",".join(f"v{i}" for i in range(len(COLUMNS)))


def write(folder, *records, header=",".join(COLUMNS)):
    path = folder / f"{NAME}.csv"
    path.write_text("\n".join([header, *records]) + "\n")
    return str(path)


def test_good_records(spark, tmp_path):
    quoted = ",".join(['"with, comma"', *[f"v{i}" for i in range(1, len(COLUMNS))]])
    rows = read_extract(spark, NAME, write(tmp_path, GOOD, quoted)).collect()
    assert [tuple(r)[0] for r in rows] == ["v0", "with, comma"]


@pytest.mark.parametrize("record", [GOOD + ",more", "one,two", '"v0\nx"' + GOOD[2:]], ids=["long", "short", "line break"])
def test_malformed_records_fail(spark, tmp_path, record):
    path = write(tmp_path, GOOD, record)
    with pytest.raises(Exception, match="MALFORMED"):
        read_extract(spark, NAME, path).collect()
    with pytest.raises(Exception, match="MALFORMED"):
        read_extract(spark, NAME, path).select(COLUMNS[0]).collect()


def test_quoted_line_breaks_on_demand(spark, tmp_path):
    record = '"v0\nx"' + GOOD[2:]
    rows = read_extract(spark, NAME, write(tmp_path, GOOD, record), multi_line=True).collect()
    assert [tuple(r)[0] for r in rows] == ["v0", "v0\nx"]


def test_wrong_header_fails(spark, tmp_path):
    path = write(tmp_path, GOOD, header=",".join(reversed(COLUMNS)))
    with pytest.raises(Exception, match="header"):
        read_extract(spark, NAME, path).collect()


def spark_reads(spark, path):
    """The same by Spark's reader of whole files, one task each."""
    options = {"header": True, "enforceSchema": False, "mode": "FAILFAST", "columnPruning": False, "multiLine": True}
    return spark.read.schema(extract_schema(NAME)).options(**options).csv(str(path))


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "257", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_ranges_give_what_whole_files_give(spark, tmp_path, small_ranges, line_end):
    pick = random.Random(len(line_end))
    folder = tmp_path / f"{NAME}.csv"
    folder.mkdir()
    pieces = ["a", "b c", ",", "\n", "\n\n", "\\\"", "\\\\", "é😀", "x" * 30, "' ", "\\n", "z, \n y" * 9]

    def field():
        if pick.random() < 0.5:
            return pick.choice(["", "v", "12 3", "in\"side", "back\\slash", "ü" * 20])
        text = "".join(pick.choice(pieces) for _ in range(pick.randint(0, 5)))
        return f'"{text.replace(chr(10), line_end)}"'

    for k in range(5):
        rows = [",".join(field() for _ in COLUMNS[1:]) for _ in range(40)]
        rows = [f"{k}-{i},{r}" for i, r in enumerate(rows)]
        (folder / f"part-{k}.csv").write_bytes((line_end.join([",".join(COLUMNS), *rows]) + line_end * (k % 2)).encode())
    (folder / "empty.csv").write_bytes(b"")
    (folder / "header.csv").write_bytes((",".join(COLUMNS) + line_end).encode())
    found = read_extract(spark, NAME, str(folder), multi_line=True)
    assert found.rdd.getNumPartitions() > 20 or len(found.inputFiles()) == 7
    expected = Counter(map(tuple, spark_reads(spark, folder).collect()))
    assert Counter(map(tuple, found.collect())) == expected and sum(expected.values()) == 200


def test_one_record_over_many_ranges(spark, tmp_path, small_ranges):
    long = "\n".join(f"line {i}, and more" for i in range(200))
    path = write(tmp_path, GOOD, f'"{long}"{GOOD[2:]}', GOOD, f'"{long}"{GOOD[2:]}')
    rows = read_extract(spark, NAME, path, multi_line=True).collect()
    assert sorted(tuple(r)[0] for r in rows) == sorted([long, long, "v0", "v0"])


def test_malformed_records_fail_in_ranges_too(spark, tmp_path, small_ranges):
    for record in (GOOD + ",more", "one,two", '"never closed,' + GOOD):
        with pytest.raises(Exception, match="MALFORMED|Malformed"):
            read_extract(spark, NAME, write(tmp_path, GOOD, record), multi_line=True).collect()
    for header in (",".join(reversed(COLUMNS)), "one,two"):
        with pytest.raises(Exception, match="header|MALFORMED"):
            read_extract(spark, NAME, write(tmp_path, GOOD, header=header), multi_line=True).collect()


def test_quotes_of_a_line():
    for line, outside, inside in [
        ("a,b", False, True), ('"a', True, False), ('a"b', False, False), ('x,"y', True, False), ('"a\\"', True, False), ('"a\\\\"', False, False),
        ('a","b', True, True), ('","', False, True), ('"a","b"', False, False), ("", False, True),
    ]:
        assert (after_line(line, False), after_line(line, True)) == (outside, inside), line
    assert after_line('"a""', False, escape='"') and not after_line('"a"""', False, escape='"')
