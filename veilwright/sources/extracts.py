"""Source extracts: all-string relations, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilwright.schemas import EXTRACT_COLUMNS, extract_schema
from veilwright.sources.csv_ranges import read_quoted_csv


def read_extract(spark: SparkSession, name: str, path: str, multi_line: bool = False) -> DataFrame:
    """Read one extract from CSV (with header) or parquet; every column is a string.

    A CSV record with too many or too few fields, or a broken quote, fails the read: nothing is cut, padded or
    skipped. Quoted line breaks need ``multi_line``; a file is then read in ranges too (csv_ranges), twice.
    """
    schema = extract_schema(name)
    if multi_line and path.rstrip("/").endswith(".csv"):
        return read_quoted_csv(spark, path, schema)
    if path.rstrip("/").endswith(".csv"):
        return (
            spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", False)
            .option("mode", "FAILFAST")
            # Without pruning the parser sees, and counts, all fields whatever columns are asked for.
            .option("columnPruning", False)
            .csv(path)
        )
    source = spark.read.parquet(path)
    return source.select([source[c].cast("string").alias(c) for c in schema.names])


def read_extracts(
    spark: SparkSession, folder: str, suffix: str = ".csv", multi_line: bool = False
) -> dict[str, DataFrame]:
    """All five extracts from one folder."""
    return {name: read_extract(spark, name, f"{folder}/{name}{suffix}", multi_line) for name in EXTRACT_COLUMNS}
