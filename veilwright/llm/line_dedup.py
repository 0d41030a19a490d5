"""Duplicate and near-duplicate lines by a deletion neighbourhood, in DataFrame and SQL functions only.

The edit unit is the word: a line is a sequence of words, and near means at most one word inserted, deleted
or replaced. In lines of MIN_WORDS words or more this covers a changed character inside a word, which is a replaced
word, but not one that joins or splits words. By character edits (an option) one character inserted, deleted or
replaced, spaces included, is near too, in lines of any number of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.llm.common import col, new_name, positions, staged

#: Lines of fewer words are not compared by words: one edit must leave four fifths of a line.
MIN_WORDS = 5

#: Lines of fewer characters are not compared by characters, for the same share.
MIN_CHARS = 5

#: Size of the bit table that thins out rows before an exact join: 2048 rows of 4096 bytes,
#: whatever the data's size. A fuller table only lets more rows through to that join.
FILTER_BITS = 1 << 26

ORDER = ("no_id", "id", "text_key", "line_no")


def _key(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(FILTER_BITS)) + 1


def _thinned(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose `key` (long) is not in `wanted`; none that is in it is lost."""
    place, zero = _key(F.col(key)), F.lit(0).cast("long")
    # Never null, and said so: else a not-null filter would be pushed down that makes the key once more.
    names = {"_bucket": F.coalesce(F.bitmap_bucket_number(place), zero), "_at": F.coalesce(F.bitmap_bit_position(place), zero)}
    bits = wanted.select(*(c.alias(n) for n, c in names.items()))
    bits = bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return (
        rows.withColumns(names)
        .join(F.broadcast(bits), "_bucket")
        .where(F.call_function("shiftright", byte, (F.col("_at") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
        .drop("_bucket", "_at", "_bits")
    )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    """The columns that name a document: rows equal in id and text are one document."""
    row_id, text = col(id_col).cast("long"), F.coalesce(col(text_col), F.lit(""))
    return {"no_id": row_id.isNull(), "id": F.coalesce(row_id, F.lit(0)), "text_key": F.xxhash64(text)}


#: White space of a line beside the plain space.
SPACES = "\t\x0b\x0c\r"


def _joined(line: Column) -> Column:
    """The line's words with single spaces between: byte searches, and a pattern only for runs of spaces."""
    for c in SPACES:
        line = F.replace(line, F.lit(c), F.lit(" "))
    return F.trim(F.when(F.contains(line, F.lit("  ")), F.regexp_replace(line, " +", " ")).otherwise(line))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" " + SPACES)) == ""


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line that has a word: its place, its words joined by single spaces, and two hashes."""
    text = F.coalesce(col(text_col), F.lit(""))
    names = [c.alias(n) for n, c in _texts(docs, id_col, text_col).items()]
    # The text's hash is taken below the explosion, once a text. Neither words nor parts are filtered on (an inner
    # explode would ask for parts of some size), so that none is made twice for a pushed filter.
    split = docs.select(*names, F.split(text, "\n", -1).alias("parts"))
    lines = split.select(*ORDER[:-1], F.posexplode_outer("parts").alias("line_no", "line")).where(~_blank(F.col("line")))
    return lines.select(*ORDER, _joined(F.col("line")).alias("words")).withColumns(
        {"h1": F.xxhash64("words"), "h2": F.xxhash64(F.lit(1), "words"), "n": _count("words")}
    )


def _count(words: str) -> Column:
    return F.expr(f"octet_length({words}) - octet_length(replace({words}, ' ', '')) + 1")


def _halves(min_words: int) -> dict[str, Column]:
    """Four keys of a line, of which two lines within one edit share one; null for short lines.

    Such lines have m and m or m - 1 words, m - 1 of them unchanged around the edit, so on one side
    of it at least m div 2 words agree. A line is the longer one for m = its words n, the shorter one for n + 1.
    """
    keys = {}
    for more in (0, 1):
        half = f"cast((n + {more}) div 2 as int)"
        for end, sign in (("start", ""), ("end", "-")):
            part = F.expr(f"substring_index(words, ' ', {sign}({half}))")
            keys[f"{end}_{more}"] = F.when(F.col("n") >= min_words, F.xxhash64(F.lit(end), F.col("n") + more, part))
    return keys


def _spelled(rows: DataFrame) -> DataFrame:
    """rows with characters as the words of `words`, n to match; the plain space is written as a tab."""
    spelled = F.rtrim(F.regexp_replace(F.translate("words", " ", "\t"), "(?s)(.)", "$1 "))
    return rows.withColumn("words", spelled).withColumn("n", _count("words"))


def _sides(min_words: int) -> dict[str, Column]:
    """Two keys of a line, of which two lines with one character replaced share one; null for short lines."""
    size, half = F.length("words"), F.expr("length(words) div 2").cast("int")
    parts = {"start": F.substring("words", F.lit(1), half), "end": F.expr("right(words, cast(length(words) div 2 as int))")}
    return {f"{e}_chars": F.when(F.col("n") >= min_words, F.xxhash64(F.lit(e), size, c)) for e, c in parts.items()}


def _lines(occurrences: DataFrame, keys: dict[str, Column], name: str) -> DataFrame:
    """The distinct lines by two hashes, with further keys and the place (ORDER) of the first."""
    lines = occurrences.withColumns(keys).groupBy("h1", "h2", *keys).agg(F.min(F.struct(*ORDER)).alias("first"))
    return staged(lines.select("h1", *keys, "first.*"), name)


def _candidates(occurrences: DataFrame, lines: DataFrame, halves: list[str], counted: bool = False) -> DataFrame:
    """(position, n, words, early, late): the distinct lines that share a half with another, by first occurrence.

    late: the shared half is at the start, so the edit is behind it; early: it is at the end.
    counted: only halves that lines with different numbers of words share.
    """
    parts = lines.select(
        "h1",
        (F.col("n") if counted else F.lit(0)).alias("words"),
        F.explode(F.array(*[F.struct(F.col(c).alias("half"), F.lit("start" in c).alias("late")) for c in halves])).alias("p"),
    )
    parts = parts.select("h1", "words", "p.*").where("half is not null")
    several = F.min("words") < F.max("words") if counted else F.count("*") > 1
    shared = staged(parts.groupBy("half").agg(several.alias("several")).where("several").select("half"), "shared-halves")
    chosen = staged(
        _thinned(parts, "half", shared)
        .join(shared, "half")
        .groupBy("h1")
        .agg(F.bool_or("late").alias("late"), F.bool_or(~F.col("late")).alias("early")),
        "candidate-lines",
    )
    # An inner join with distinct keys: a semi join would be moved in front of the thinning.
    texts = _thinned(occurrences, "h1", chosen).join(chosen, "h1")
    first = F.min(F.struct(*ORDER)).alias("first")
    texts = texts.groupBy("h1", "h2", "n", "early", "late", "words").agg(first)
    texts = staged(texts.select("first.*", "n", "early", "late", "words"), "candidate-texts")
    return positions(texts, *map(F.col, ORDER), name="candidate-order")


def _variants(candidates: DataFrame) -> DataFrame:
    """(key, kind, position): every line with a hole at each place (kind 0), without each word (1), and whole (2).

    Places are those on the side of the shared half where the edit must be.
    A sequence's hash is the xor of hashes of its words in their places, so all variants of a
    line follow from running xors over its words, however long it is.
    """
    words = candidates.select("position", "n", "early", "late", F.posexplode(F.split("words", " ")).alias("at", "word"))
    words = words.withColumns({"here": F.xxhash64("word", "at"), "moved": F.xxhash64("word", F.col("at") - 1)})
    line = Window.partitionBy("position")
    so_far = line.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = words.select(
        "position",
        "n",
        "at",
        F.expr("(late and at >= n div 2) or (early and at < n - n div 2)").alias("wanted"),
        "here",
        F.bit_xor("here").over(line).alias("all"),
        F.bit_xor("here").over(so_far).alias("begun"),
        F.bit_xor("moved").over(line).alias("all_moved"),
        F.bit_xor("moved").over(so_far).alias("begun_moved"),
    )
    # Without a word: the words before it in their places, those after it one place to the left.
    hole = F.when(F.col("wanted"), F.xxhash64(F.lit("hole"), "n", "at", F.expr("all ^ here")))
    moved = F.xxhash64(F.lit("sequence"), F.col("n") - 1, F.expr("begun ^ here ^ all_moved ^ begun_moved"))
    less = F.when(F.col("wanted"), moved)
    whole = F.when(F.col("at") == 0, F.xxhash64(F.lit("sequence"), "n", "all"))
    kinds = [F.struct(k.alias("key"), F.lit(i).alias("kind")) for i, k in enumerate((hole, less, whole))]
    return words.select("position", F.explode(F.array(*kinds)).alias("v")).select("v.*", "position").where("key is not null")


def _agreeing(a: Column, b: Column) -> Column:
    """How many elements two arrays share from the start."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs == 0, F.least(F.size(a), F.size(b))).otherwise(differs - 1)


def _near(candidates: DataFrame) -> DataFrame:
    """Places (ORDER) of the candidates that have an earlier one within one edit."""
    variants = _variants(candidates)

    def least(kind: int) -> Column:
        return F.min(F.when(F.col("kind") == kind, F.col("position")))

    # All lines of a hole are near each other; of a sequence, the whole line and those with a word more.
    groups = variants.groupBy("key").agg(
        least(0).alias("hole"),
        F.max(F.when(F.col("kind") == 0, F.col("position"))).alias("last"),
        least(1).alias("longer"),
        least(2).alias("whole"),
    )
    groups = staged(groups.where("hole < last or (longer is not null and whole is not null)").drop("last"), "variant-groups")
    partner = F.expr("case kind when 0 then hole when 1 then whole else longer end")
    pairs = (
        _thinned(variants, "key", groups)
        .join(groups, "key")
        .withColumn("partner", partner)
        .where("partner < position")
        .select("position", "partner")
        .distinct()
    )
    words = candidates.select("position", F.split("words", " ").alias("b"))
    other = candidates.select(F.col("position").alias("partner"), F.split("words", " ").alias("a"))
    verified = pairs.join(words, "position").join(other, "partner")
    longer = F.greatest(F.size("a"), F.size("b"))
    agree = _agreeing(F.col("a"), F.col("b")) + _agreeing(F.reverse("a"), F.reverse("b"))
    verified = verified.where((F.abs(F.size("a") - F.size("b")) <= 1) & (agree >= longer - 1))
    return candidates.join(verified.select("position").distinct(), "position", "left_semi").select(*ORDER)


def _respaced(occurrences: DataFrame, lines: DataFrame) -> DataFrame:
    """Places (ORDER) of the lines that have an earlier one with one space more or less.

    Such lines are equal without spaces (`bare`, null for lines that are not compared). There a line is the set of its
    words' ends, with the xor of their hashes; a line with a space less is that set without one end.
    """
    shared = lines.where("bare is not null").groupBy("bare").agg(F.count("*").alias("lines"))
    shared = staged(shared.where("lines > 1").select("bare"), "shared-bare")
    chosen = staged(_thinned(lines, "bare", shared).join(shared, "bare").select("h1", "bare").distinct(), "respaced-lines")
    texts = _thinned(occurrences, "h1", chosen).join(chosen, "h1")
    texts = texts.groupBy("h1", "h2", "bare", "words").agg(F.min(F.struct(*ORDER)).alias("position"))
    texts = staged(texts.select("position", "bare", "words"), "respaced-texts")

    line = Window.partitionBy("position")
    so_far = line.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = texts.select("position", "bare", F.posexplode(F.split("words", " ")).alias("at", "word"))
    ends = ends.withColumn("here", F.xxhash64(F.sum(F.length("word")).over(so_far)))
    ends = ends.select("position", "bare", "at", "here", F.bit_xor("here").over(line).alias("all"))
    whole = F.when(F.col("at") == 0, F.xxhash64("bare", "all"))
    less = F.xxhash64("bare", F.expr("all ^ here"))
    kinds = [F.struct(k.alias("key"), F.lit(i).alias("kind")) for i, k in enumerate((less, whole))]
    variants = ends.select("position", F.explode(F.array(*kinds)).alias("v")).select("v.*", "position").where("key is not null")
    groups = variants.groupBy("key").agg(
        F.min(F.when(F.col("kind") == 0, F.col("position"))).alias("longer"),
        F.min(F.when(F.col("kind") == 1, F.col("position"))).alias("whole"),
    )
    groups = staged(groups.where("longer is not null and whole is not null"), "respaced-groups")
    pairs = (
        variants.join(groups, "key")
        .withColumn("partner", F.expr("if(kind = 0, whole, longer)"))
        .where("partner < position")
        .select("position", "partner")
        .distinct()
    )
    words = texts.select("position", F.col("words").alias("b"))
    other = texts.select(F.col("position").alias("partner"), F.col("words").alias("a"))
    verified = pairs.join(words, "position").join(other, "partner").where(F.levenshtein("a", "b", 1) == 1)
    return verified.select("position").distinct().select("position.*")


def line_dedup(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    drop_emptied: bool = False,
    counts: tuple[str, str] | None = None,
    char_edits: bool = False,
) -> DataFrame:
    """docs with repeated lines taken out of the text; all other columns as they are.

    Lines are compared by their words (white space between them does not count). Of equal lines in
    all documents the earliest by (id, place) stays. A line of min_words words or more goes too if an earlier line,
    whether that one stays or not, is within one inserted, deleted or replaced word of it. Shorter lines are
    only compared whole, unless char_edits: then a line of MIN_CHARS characters or more, however many words it has,
    also goes if an earlier such line is within one inserted, deleted or replaced character of it (white space is one
    space). Lines without a word stay. drop_emptied leaves out documents that lose their last word by this; counts names
    two further columns for the lines with a word and for those taken out.

    The deletion neighbourhood (all variants of a line with a hole or a word less, as hashed keys) is made for
    lines that share a half with another one, which every near pair does. Equal variants meet in
    an aggregation, never in pairs; the pairs it points out are verified word by word. Exact lines are told apart by
    128 bits of hash, texts are moved once.

    Null or empty text: unchanged (null stays null). Null id: after all others. Rows equal in id
    and text are one document and keep the same lines; equal ids with different text are ordered by a hash of it.
    Very long lines and texts: in full. Empty table: no rows.
    """
    occurrences = _occurrences(docs, id_col, text_col)
    halves = _halves(min_words)
    more, sides = {}, _sides(min_words)
    if char_edits:
        bare = F.xxhash64(F.replace("words", F.lit(" "), F.lit("")))
        more = {"n": F.col("n"), "bare": F.when(F.col("n") >= min_words, bare), **sides}
    lines = _lines(occurrences, {**halves, **more}, "lines")
    near = _near(_candidates(occurrences, lines, list(halves)))
    if char_edits:
        # One edit changes the number of words by one at most. Both lines short enough: by characters throughout. Else
        # both have min_words words: a character within a word is a word's edit, left are spaces put in, out or replaced.
        short = _spelled(occurrences.where(F.col("n") <= min_words))
        short = short.withColumns({"h1": F.xxhash64("words"), "h2": F.xxhash64(F.lit(1), "words")})
        spelled = _halves(MIN_CHARS)
        by_chars = _near(_candidates(short, _lines(short, spelled, "spelled-lines"), list(spelled)))
        replaced = _near(_spelled(_candidates(occurrences, lines, list(sides), counted=True)))
        near = near.unionByName(by_chars).unionByName(replaced).unionByName(_respaced(occurrences, lines)).distinct()
    marks = lines.select(*ORDER, F.lit(False).alias("near")).unionByName(near.withColumn("near", F.lit(True)))
    lists = marks.groupBy(*ORDER[:-1]).agg(
        F.collect_list(F.when(~F.col("near"), F.col("line_no"))).alias("first"),
        F.collect_list(F.when(F.col("near"), F.col("line_no"))).alias("near"),
    )
    keys = {n: new_name(docs, n) for n in ORDER[:-1]}
    kept, total, left, old = (new_name(docs, n) for n in ("kept", "lines", "left", "old"))
    lists = lists.select(*(F.col(n).alias(k) for n, k in keys.items()), F.array_except("first", "near").alias(kept))
    named = docs.withColumns({keys[n]: c for n, c in _texts(docs, id_col, text_col).items()})
    joined = named.join(lists, list(keys.values()), "left").withColumn(
        kept, F.coalesce(F.col(kept), F.array().cast("array<int>"))
    )
    text = F.coalesce(col(text_col), F.lit(""))

    def rebuilt(parts: Column) -> Column:
        blank = F.filter(
            F.sequence(F.lit(0), F.size(parts) - 1),
            lambda i: _blank(F.get(parts, i)),
        )
        places = F.sort_array(F.concat(blank, F.col(kept)))
        return F.struct(
            (F.size(parts) - F.size(blank)).alias("lines"),
            F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n").alias("text"),
        )

    # The split text is bound once, as the only element of an array, and used by place from there.
    made = F.element_at(F.transform(F.array(F.split(text, "\n", -1)), rebuilt), 1)
    joined = joined.withColumn(old, made).withColumns(
        {total: F.col(old)["lines"], left: F.size(F.col(kept)), text_col: F.when(col(text_col).isNotNull(), F.col(old)["text"])}
    )
    if drop_emptied:
        joined = joined.where((F.col(total) == 0) | (F.col(left) > 0))
    if counts:
        joined = joined.withColumns({counts[0]: F.col(total).cast("long"), counts[1]: (F.col(total) - F.col(left)).cast("long")})
    return joined.drop(*keys.values(), kept, total, left, old)
