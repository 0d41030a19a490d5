"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwright.session import scratch_path

#: Words everywhere: runs of anything but these six ASCII characters, which are just those that
#: bytes.split() splits at.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Texts are handled in pieces of a batch of about this many bytes, so memory does not follow
#: the length of the texts in a batch. A single text is never cut.
PIECE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have in any spelling."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in taken:
        name = f"__{stem}_{uuid.uuid4().hex[:8]}"
    return name


def col(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string); a null text is the empty text, other columns are left out."""
    return df.select(
        col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text")
    )


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut into runs of rows of about PIECE_BYTES, with the column's values as UTF-8."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary())
        sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            held += int(size)
            if held >= PIECE_BYTES or i + 1 == len(sizes):
                yield batch.slice(start, i + 1 - start), texts.slice(start, i + 1 - start).to_pylist()
                start, held = i + 1, 0


def positions(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """df, staged, with its 0-based `position` in the given order, without a global window.

    Rows are range-partitioned and sorted; a row's position is its partition's offset, from a table
    with one row a partition, plus its place there.
    """
    placed = staged(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_place", 33))
        .withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))),
        name,
    )
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(offsets, "_part").withColumn("position", F.col("_offset") + F.col("_place")).drop("_part", "_place", "_offset")
    )
