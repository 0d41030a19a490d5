"""URL rules and lists behind a blocked Bloom filter, all in DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from veilwright.llm.common import col

#: Blocks of 64 bits. The filter is a table of at most this many rows, whatever the list's size;
#: a fuller filter only lets more false hits through to the exact join.
BLOCKS = 1 << 17
BITS_PER_KEY = 4

RULE_SCHEMA = StructType([StructField(c, StringType()) for c in ("host", "path", "verdict")])


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without '://'."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    safe = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(safe, pattern, 1), upper, lower), F.regexp_extract(safe, pattern, 2)


def _block(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BLOCKS))


def _bits(key: Column) -> Column:
    """The key's bits inside its block: BITS_PER_KEY positions from a second hash."""
    second = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    places = [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(BITS_PER_KEY)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", one, p) for p in places])


def bloom_filter(keys: DataFrame) -> DataFrame:
    """(block, mask) over the column `key`: at most BLOCKS rows of two longs."""
    return keys.select(_block(F.col("key")).alias("block"), _bits(F.col("key")).alias("bits")).groupBy("block").agg(
        F.bit_or("bits").alias("mask")
    )


def url_filter(
    pages: DataFrame,
    rules: DataFrame,
    listed: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Verdict on every page: (id, host, path, rule, verdict).

    rules: (host, path, verdict), fitting the host, its subdomains, and paths that start with the
    rule's; the longest wins, block before allow among equals. listed: column `url` of canonical
    URLs (host + path) to be blocked where no rule fits. Each page's canonical URL and its
    (host suffix, path prefix) keys of the shapes that occur among the rules go through a blocked
    Bloom filter of both lists (a broadcast table of at most BLOCKS rows); hits are settled by an
    exact hash join, so false positives change nothing. The keys are made once per distinct
    (host, path), so a hot URL is judged once.

    Null url or none with '://': empty host and path, no rule, allow. Repeated rows and ids: a row
    each. Empty lists: everything allowed. The result has only the named columns, so other columns of pages never
    clash. Only the distinct (labels of host, length of path) shapes of the rules reach the driver.
    """
    host, path = split_url(col(url_col))
    judged = pages.select(col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rules = rules.where("host is not null and verdict is not null").select(
        "host", F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    shapes = (
        rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"))
        .distinct()
        .collect()
    )
    entries = rules.select(F.concat("host", "path").alias("key"), F.lit(True).alias("is_rule"), "verdict").unionByName(
        listed.select(F.col("url").alias("key"), F.lit(False).alias("is_rule"), F.lit("block").alias("verdict"))
    )
    entries = entries.where("key is not null").distinct()
    prefixes = [
        F.when(
            F.length("path") >= s.chars,
            F.concat(F.substring_index("host", ".", -s.labels), F.substring("path", 1, s.chars)),
        )
        for s in shapes
    ]
    keys = F.array_distinct(F.array(F.concat("host", "path"), *prefixes))
    candidates = (
        judged.where("host <> '' or path <> ''")
        .select("host", "path")
        .distinct()
        .select("host", "path", F.explode(keys).alias("key"))
        .where("key is not null")
        .withColumn("block", _block(F.col("key")))
        .withColumn("bits", _bits(F.col("key")))
    )
    possible = candidates.join(F.broadcast(bloom_filter(entries)), "block").where("(mask & bits) = bits")
    exact = possible.select("host", "path", "key").join(entries, "key")
    # A listed URL must be the whole canonical URL; a rule may be any of the keys.
    exact = exact.where("is_rule or key = concat(host, path)")
    best = exact.groupBy("host", "path").agg(
        F.max(
            F.when(F.col("is_rule"), F.struct(F.length("key").alias("n"), F.col("verdict").alias("verdict"), "key"))
        ).alias("best"),
        F.bool_or(~F.col("is_rule")).alias("is_listed"),
    )
    return judged.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.key").alias("rule"),
        F.coalesce("best.verdict", F.when(F.col("is_listed"), F.lit("block")), F.lit("allow")).alias("verdict"),
    )


def spam_listed(pages: DataFrame, terms: tuple[str, ...], url_col: str = "url") -> DataFrame:
    """Canonical URLs of pages on a host of which a label has one of the terms between hyphens or ends."""
    host, path = split_url(col(url_col))
    pattern = rf"(^|[.-])({'|'.join(terms)})([.-]|$)"
    return pages.select(host.alias("host"), path.alias("path")).where(F.col("host").rlike(pattern)).select(
        F.concat("host", "path").alias("url")
    ).distinct()
