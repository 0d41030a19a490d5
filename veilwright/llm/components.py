"""Connected components of a link table, as rounds of star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import staged


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v), root the smallest node it can reach.

    Alternates large-star and small-star: each round points every node's larger neighbours, then
    its smaller ones, at the smallest. Minima are taken by a partial aggregation and joined back, so a node
    with very many links is never gathered. Each round's table replaces the last; only a row count and a
    checksum reach the driver. Nulls and self-links are left out; an empty table gives no rows.
    """
    edges = staged(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "links",
    )
    state = _state(edges)
    while state[0]:
        # Large star: neighbours larger than u point at the smallest of u and its neighbours.
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .where("u <> v")
            .distinct()
        )
        large = staged(large, "large-star")
        # Small star: u and its smaller neighbours point at the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))
            .where("u <> v")
            .distinct()
        )
        edges = staged(small, "small-star")
        last, state = state, _state(edges)
        if state == last:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
