"""Mixing sources to target weights by Pareto order sampling, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.llm.common import col, new_name, positions, staged

#: Classes of log odds in which running sums are taken: at most 1/4096 of a source's documents
#: share one, and a source has at most about 75,000. Sources that are taken whole have none.
CLASSES_PER_UNIT = 1024


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sources (source, source_size) with `target`: `share` of all words, dealt by weight.

    Weights repeat over the sources in code point order, null last. A target stops at `most` times its source's size
    and the excess goes to the others by weight, until none is above: target = min(most * size,
    level * weight). Each round of resharing is one aggregation of which three sums reach the driver.
    """
    placed = positions(sources, F.col("source").asc_nulls_last(), name="sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("position", F.lit(len(weights))) + 1).cast("int"))
    placed = placed.withColumn("weight", weight.cast("double")).drop("position")
    wanted = share * (placed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > most * F.col("source_size")
        row = placed.agg(
            F.sum(over.cast("long")).alias("full"),
            F.sum(F.when(over, most * F.col("source_size")).otherwise(0.0)).alias("held"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row.open or row.full == full:
            break
        full, level = row.full, (wanted - row.held) / row.open
    return placed.withColumn("target", F.least(most * F.col("source_size"), F.lit(level) * F.col("weight"))).drop("weight")


def _row_key(seed: int, row_id: Column, source: Column, text: Column) -> Column:
    # The source with its length, and the text last: no two rows that differ join to one string.
    place = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.octet_length(source).cast("string"), F.lit(":"), source))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(row_id.cast("string"), F.lit("")), place, text))


def _units(keyed: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row for all rows equal in id, source and text: their number n, and how often each is taken.

    That is `copies` times, and once more for `some` of them. keyed: row_key, source and size of every row.
    """
    units = staged(keyed.groupBy("row_key", "source", "size").agg(F.count("*").alias("n")), "units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    named = staged(
        targets(sources, weights, share, most)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("p", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0)),
        "targets",
    )
    placed = units.join(named, units.source.eqNullSafe(named.source)).drop(named.source)
    # Nothing is sampled of a source that is taken whole: no order, no running sums.
    certain = placed.where(~(F.col("p") > 0)).withColumn("some", F.lit(0).cast("long"))
    # Random odds over inclusion odds, the random number from the row itself.
    u = (F.conv(F.substring("row_key", 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    ranked = placed.where("p > 0").withColumn("odds", (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    # Running words in rank order: classes of odds first, then the few documents within a class.
    limit = F.greatest(F.lit(1e-300), F.least(F.lit(1e300), F.col("odds")))
    ranked = ranked.withColumn("class", F.floor(F.log(limit) * CLASSES_PER_UNIT))
    size = F.col("size") * F.col("n")
    earlier = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = (
        ranked.groupBy("source", "class")
        .agg(F.sum(size).alias("words"))
        .select(
            F.col("source").alias("_source"),
            F.col("class").alias("_class"),
            F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"),
        )
    )
    ranked = ranked.join(
        classes, F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class"))
    ).drop("_source", "_class")
    within = Window.partitionBy("source", "class").orderBy("odds", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("start") + F.coalesce(F.sum(size).over(within), F.lit(0))
    # Row k = 0, 1, ... of equal ones is taken if begin + k * size + size / 2 <= rest, so the first `some` are.
    last = F.floor((F.col("rest") - begin - F.col("size") / 2.0) / F.col("size"))
    none_or_all = F.when(begin <= F.col("rest"), F.col("n")).otherwise(0)
    some = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("n"), last + 1))).otherwise(none_or_all)
    columns = ("row_key", "n", "source_size", "target", F.col("whole").alias("copies"), F.col("some").cast("long").alias("some"))
    return staged(ranked.withColumn("some", some).select(*columns).unionByName(certain.select(*columns)), "decided")


def _decided(keyed: DataFrame, units: DataFrame, key: str, copies: str, *more: str) -> DataFrame:
    """keyed with `copies` and more columns of its units. A large unit is one of a skewed join, never one row's to expand."""
    some, n = new_name(keyed, "some"), new_name(keyed, "n")
    named = units.select(F.col("row_key").alias(key), F.col("copies").cast("int").alias(copies), F.col("some").alias(some), F.col("n").alias(n), *more)
    joined = keyed.join(named, key)
    split = (F.col(some) > 0) & (F.col(some) < F.col(n))
    # Most often no unit is split; of each source at most one is, where its sample ends.
    if units.where("some > 0 and some < n").isEmpty():
        return joined.withColumn(copies, F.col(copies) + (F.col(some) > 0).cast("int")).drop(some, n)
    place, part, before, within = (new_name(keyed, c) for c in ("place", "part", "before", "within"))
    numbered = keyed.join(named.where(split), key).withColumn(place, F.monotonically_increasing_id())
    numbered = staged(numbered.withColumn(part, F.shiftright(place, 33)), "split-units")
    sums = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = numbered.groupBy(key, part).agg(F.count("*").alias(before))
    parts = parts.withColumn(before, F.coalesce(F.sum(before).over(sums), F.lit(0)))
    numbered = numbered.withColumn(within, F.row_number().over(Window.partitionBy(key, part).orderBy(place)))
    taken = (F.col(before) + F.col(within) <= F.col(some)).cast("int")
    numbered = numbered.join(parts, [key, part]).withColumn(copies, F.col(copies) + taken).drop(place, part, before, within, some, n)
    rest = joined.where(~split).withColumn(copies, F.col(copies) + (F.col(some) > 0).cast("int")).drop(some, n)
    return rest.unionByName(numbered)


def source_mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    A source whose target is r times its size takes every document floor(r) times for certain; the
    rest, a share p of the source, is a Pareto order sample: documents are ranked by random odds u / (1 - u) over
    inclusion odds p / (1 - p) and taken from the smallest on until their words are nearest to
    the rest, so a source misses its target by at most half a document. Rows equal in id, source and text follow each other
    in that order and are decided singly. u comes from a hash of seed, id, source and text, so
    reruns agree. most must be a whole number for the limit on copies to be exact.

    Null or empty text: size 0, taken 0. Null source: a source of its own, last. Null doc_id: a row
    like any other. Empty table: no rows; other columns are ignored.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    row_id, source = col(id_col).cast("long"), col(source_col).cast("string")
    keyed = docs.select(
        row_id.alias("doc_id"),
        source.alias("source"),
        words(text).alias("size"),
        _row_key(seed, row_id, source, text).alias("row_key"),
    )
    keyed = staged(keyed, "mixed-rows")
    decided = _decided(keyed.drop("source"), _units(keyed, weights, share, most), "row_key", "copies", "source_size", "target")
    return decided.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """docs as mixed by source_mix: a row as often as it is taken, all columns kept.

    A document without words has no copies that count; it stays out unless its source takes whole copies.
    """
    key, copies = new_name(docs, "row_key"), new_name(docs, "copies")
    text, source = F.coalesce(col(text_col), F.lit("")), col(source_col).cast("string")
    row_key = _row_key(seed, col(id_col).cast("long"), source, text)
    rows = docs.select(source.alias("source"), words(text).alias("size"), row_key.alias("row_key"))
    units = _units(rows, weights, share, most).where("copies > 0 or some > 0")
    return (
        _decided(docs.withColumn(key, row_key), units, key, copies)
        .where(F.col(copies) > 0)
        .withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies))))
        .drop(key, copies)
    )
