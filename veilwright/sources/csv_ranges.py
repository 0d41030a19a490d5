"""CSV files with quoted line breaks, read by many tasks: what a byte range begins with is found from quotes alone."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = "file string, start long, place long, part string, text string"


def after_line(line: str, inside: bool, quote: str = '"', escape: str = "\\", delimiter: str = ",") -> bool:
    """Whether a quoted field is open after a line, from whether one was before it."""
    if quote not in line:
        return inside
    at, size = 0, len(line)
    while True:
        if not inside:
            if not line.startswith(quote, at):  # an unquoted field, in which a quote means nothing
                at = line.find(delimiter, at) + 1
                if not at:
                    return False
                continue
            inside, at = True, at + 1
        while at < size:  # to the closing quote
            c = line[at]
            if c == escape and at + 1 < size and line[at + 1] in (quote, escape):
                at += 2
            elif c == quote:
                break
            else:
                at += 1
        if at >= size:
            return True
        at = line.find(delimiter, at + 1) + 1
        inside = False
        if not at:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a path with the file and the byte range that they were read from, in their order within a range."""
    found = spark.read.option("lineSep", "\n").text(path)
    return found.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[tuple, list[str], pa.RecordBatch]]:
    """Stretches of lines of one range: its file and start, the lines, and their rows."""
    for batch in batches:
        keys = list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()))
        values = batch.column(column).to_pylist()
        first = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[first]:
                yield keys[first], values[first:i], batch.slice(first, i - first)
                first = i


def _states(lines: DataFrame, quote: str, escape: str, delimiter: str) -> DataFrame:
    """(file, start, inside): the ranges that begin inside a quoted field.

    Every range is gone through once for both beginnings; what it ends with is then, for each, outside, inside, or unknown until
    the one before is known. Running from the last range that ends alike for both gives each beginning: of a file, one small row a
    range is sorted.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends = None, [False, True]

        def given() -> pa.RecordBatch:
            row = {"file": [key[0]], "start": [key[1]], "from_outside": [ends[0]], "from_inside": [ends[1]]}
            return pa.record_batch({k: pa.array(v, pa.int64() if k == "start" else None) for k, v in row.items()})

        for here, values, rows in _runs(batches, "value"):
            if here != key:
                if key is not None:
                    yield given()
                key, ends = here, [False, True]
            for i in pc.indices_nonzero(pc.match_substring(rows.column("value"), quote)).to_pylist():
                ends = [after_line(values[i], e, quote, escape, delimiter) for e in ends]
        if key is not None:
            yield given()

    found = lines.mapInArrow(scan, "file string, start long, from_outside boolean, from_inside boolean")
    # A range that ends alike for both beginnings settles the state; one that ends with the other swaps it; others leave it.
    found = found.withColumns(
        {
            "settled": F.expr("if(from_outside = from_inside, from_outside, null)"),
            "swaps": F.expr("if(from_outside and not from_inside, 1, 0)"),
        }
    )
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = found.withColumn("so_far", F.sum("swaps").over(upto))
    placed = counted.withColumns(
        {
            "last": F.last(F.when(F.col("settled").isNotNull(), F.struct("settled", "so_far")), ignorenulls=True).over(earlier),
            "before": F.coalesce(F.max("so_far").over(earlier), F.lit(0)),
        }
    )
    inside = F.expr("coalesce(last.settled, false) <> ((before - coalesce(last.so_far, 0)) % 2 = 1)")
    return placed.select("file", "start", inside.alias("inside")).where("inside")


def _parts(lines: DataFrame, quote: str, escape: str, delimiter: str) -> DataFrame:
    """PARTS of records: a whole `record`, or what a range has of one that others share: its `end`, `middle` or `begin`.

    A file whose first line ends with \\r\\n has one more part, `crlf`.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, place, inside, part, held, crlf = None, 0, False, "record", [], False
        out: list[tuple] = []

        def give() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            out.clear()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "start", "place", "part", "text"])

        def close(last: bool) -> None:
            """Files what is held: at the end of a record, or at the end of its range.

            The last record of a file may lack a line end: then the one before it tells what the file's are.
            """
            nonlocal place, part, held, crlf
            if held:
                kind, text = ({"record": "begin", "end": "middle"}[part] if last else part), "\n".join(held)
                crlf = crlf or text.endswith("\r")
                out.append((*key, place, kind, text.replace("\r\n", "\n") if crlf and kind == "record" else text))
                place += 1
            held, part = [], "record"

        for here, values, rows in _runs(batches, "value"):
            if here != key:
                if key is not None:
                    close(True)
                key, place, inside, crlf = here, 0, rows.column("inside")[0].as_py(), False
                part = "end" if inside else "record"
                if not key[1] and values[0].endswith("\r"):
                    out.append((*key, -1, "crlf", ""))
            for line in values:
                inside = after_line(line, inside, quote, escape, delimiter)
                if inside or held or part == "end":
                    held.append(line)
                    if not inside:
                        close(False)
                else:
                    crlf = line.endswith("\r")
                    out.append((*key, place, "record", line))
                    place += 1
            yield give()
        if key is not None:
            close(True)
            yield give()

    return lines.mapInArrow(cut, PARTS)


def records(spark: SparkSession, path: str, quote: str = '"', escape: str = "\\", delimiter: str = ",") -> DataFrame:
    """(file, is_header, text): the records of all files of a path, without empty ones, line breaks inside quotes kept.

    Files are read in Spark's byte ranges, twice: once for the quotes, once for the records. Records inside a range come straight
    from it; the few that ranges share are put together by file. A file whose last quoted field is never closed gives what is there
    as its last record, which the parser then refuses.
    """
    lines = _lines(spark, path)
    # One small row for each range that begins inside quotes, at most one for each 128 MB of input by default.
    states = F.broadcast(_states(lines, quote, escape, delimiter))
    marked = lines.join(states, ["file", "start"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    parts = _parts(marked, quote, escape, delimiter)
    whole = parts.where("part = 'record'").select("file", ((F.col("start") == 0) & (F.col("place") == 0)).alias("is_header"), "text")
    begun = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared = parts.where("part not in ('record', 'crlf')").withColumn("number", F.sum(F.expr("if(part = 'begin', 1, 0)")).over(begun))
    pieces = F.array_sort(F.collect_list(F.struct("start", "place", "text", "part")))
    joined = shared.groupBy("file", "number").agg(pieces.alias("p"))
    first = F.element_at("p", 1)
    joined = joined.select(
        "file",
        ((first["start"] == 0) & (first["place"] == 0)).alias("is_header"),
        F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"),
    )
    ends = parts.where("part = 'crlf'").select("file", F.lit(True).alias("crlf"))
    text = F.when(F.col("crlf"), F.replace("text", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text")).alias("text")
    joined = joined.join(ends, "file", "left").select("file", "is_header", text)
    found = whole.unionByName(joined).withColumn("text", F.regexp_replace("text", "\r$", ""))
    return found.where("text <> ''")


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType, quote: str = '"', escape: str = "\\", delimiter: str = ",") -> DataFrame:
    """A CSV path with headers whose quoted fields may hold line breaks, read by as many tasks as its size calls for.

    In a file whose lines end with \\r\\n, line breaks inside quotes become \\n, as Spark's own reader has it. Records are parsed by Spark, as strictly as by read_extract: one of another length fails, and so does a file whose header does not
    name the schema's columns in order. Empty files have no rows.
    """
    found = records(spark, path, quote, escape, delimiter)
    options = {"mode": "FAILFAST", "quote": quote, "escape": escape, "sep": delimiter}
    strings = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(schema))])
    row = F.from_csv("text", strings.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    parsed = found.select("file", "is_header", row.alias("row"))
    named = F.array(*(F.col(f"row.c{i}") for i in range(len(schema))))
    wrong = F.raise_error(F.concat(F.lit("CSV header does not conform to the schema: "), F.array_join(named, ", ", "null"), F.lit(" in "), F.col("file")))
    right = named == F.array(*map(F.lit, schema.names))
    kept = parsed.where(~F.when(F.col("is_header") & ~F.coalesce(right, F.lit(False)), wrong.cast("boolean")).otherwise(F.col("is_header")))
    return kept.select(*(F.col(f"row.c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)))
