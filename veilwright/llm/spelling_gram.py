"""Spelling variants: words one edit apart, found by Gram matrices of letter counts, and their usual forms."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import pieces, staged, texts_of

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent as the word.
FORM_RATIO = 5
#: One run of a text in so many loses a letter.
EVERY = 199

#: Letters of runs, beside which all is a boundary.
LETTERS = "a-zA-ZÀ-ÿ"
#: Distinct counted words a task holds before it hands them on; says where sums are made, not what they are.
HELD_WORDS = 200_000
#: Words of a block in one matrix, at most about so many, and fewer of more than LONG letters; larger blocks are cut by a hash
#: of the word.
CHUNK = 2_048
LONG = 16
#: Letter classes (code point modulo this) by whose counts the words of a length are cut into blocks.
CLASSES = 4
#: Letters share this many columns of a matrix (code point modulo this), which only shortens distances.
COLUMNS = 32

_LOWER = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
BLOCK = ["size", *(f"class{i}" for i in range(CLASSES - 1))]


def altered(counts: Counter, doc_id: int | None, every: int = EVERY) -> Iterator[tuple[str, int]]:
    """The runs of one document with their counts, some with one letter deleted by crc32 of `<doc_id>:<run>`."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in counts.items():
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, n) over all whole texts, of words of at least `least_length` letters and `least_count` occurrences.

    Tasks add up what they have read before anything is shuffled.
    """
    # Deleting a letter never lengthens a run, so shorter runs give no word.
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def given(held: Counter) -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch, found in pieces(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), found):
                # lower() of bytes changes A-Z only
                for word, n in altered(Counter(runs.findall(text.lower().decode())), doc_id):
                    if len(word) >= least_length:
                        held[word] += n
            if len(held) > HELD_WORDS:
                yield given(held)
                held.clear()
        yield given(held)

    counted = texts_of(docs, id_col, text_col).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _blocked(words: DataFrame) -> DataFrame:
    """words with the columns of BLOCK: length, and how many letters of each class but the last."""
    classes = ["".join(c for c in _LOWER if ord(c) % CLASSES == i) for i in range(CLASSES - 1)]
    size = F.length("word")
    return words.withColumns({"size": size} | {f"class{i}": size - F.length(F.translate("word", c, "")) for i, c in enumerate(classes)})


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs of blocks (x's and y's columns, chunks) that can hold words one edit apart, each once.

    A replaced letter leaves all class counts, or moves one from a class to another; an inserted one adds one to a class
    and to the length. The last class has no column: its count follows from the length.
    """
    moves = [(0,) * (CLASSES + 1)]
    for i in range(CLASSES):
        moves.append((1, *(int(k == i) for k in range(CLASSES))))
        moves += [(0, *(int(k == i) - int(k == j) for k in range(CLASSES))) for j in range(i)]
    names = [f"m_{c}" for c in BLOCK]
    steps = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, m))) for m in moves))
    x = blocks.select(*(F.col(c).alias(f"x_{c}") for c in BLOCK), F.col("chunks").alias("x_chunks"), F.explode(steps).alias("step"))
    x = x.select("*", *((F.col(f"x_{c}") + F.col(f"step.m_{c}")).alias(f"y_{c}") for c in BLOCK)).drop("step")
    y = blocks.select(*(F.col(c).alias(f"y_{c}") for c in BLOCK), F.col("chunks").alias("y_chunks"))
    return x.join(y, [f"y_{c}" for c in BLOCK])


def _chunk_pairs(blocks: DataFrame) -> DataFrame:
    """(pair, side, block, chunk): the sides 0 and 1 of every pair of chunks; a chunk with itself has side 2 only."""
    same = F.lit(True)
    for c in BLOCK:
        same = same & (F.col(f"x_{c}") == F.col(f"y_{c}"))
    pairs = _block_pairs(blocks).withColumn("same", same)
    pairs = pairs.withColumn("x_chunk", F.explode(F.sequence(F.lit(0), F.col("x_chunks") - 1)))
    first = F.when(F.col("same"), F.col("x_chunk")).otherwise(0)
    pairs = pairs.withColumn("y_chunk", F.explode(F.sequence(first, F.col("y_chunks") - 1)))
    # Staged, so that a pair keeps its number if a task is run again.
    pairs = staged(pairs.withColumn("pair", F.monotonically_increasing_id()), "spelling-pairs")

    def side(k: int, end: str) -> DataFrame:
        return pairs.select(
            "pair", F.lit(k).alias("side"), *(F.col(f"{end}_{c}").alias(c) for c in BLOCK), F.col(f"{end}_chunk").alias("chunk"),
            alone.alias("alone"),
        )

    alone = F.col("same") & (F.col("x_chunk") == F.col("y_chunk"))
    x = side(0, "x").withColumn("side", F.when(F.col("alone"), 2).otherwise(0))
    return x.union(side(1, "y").where("not alone")).drop("alone")


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points padded with 0, lengths, and letter counts by column of the words."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.array(words, dtype=f"U{int(sizes.max())}").view(np.uint32).reshape(len(words), -1).astype(np.int32)
    rows = np.repeat(np.arange(len(words)), sizes)
    flat = rows * COLUMNS + codes[codes > 0] % COLUMNS
    counts = np.bincount(flat, minlength=len(words) * COLUMNS).reshape(len(words), COLUMNS)
    return codes, sizes, counts.astype(np.float32)


def one_edit(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether rows of code points, padded with 0, differ by exactly one replaced or (b longer by one) inserted letter."""
    width = max(a.shape[1], b.shape[1] - 1)
    a = np.pad(a, ((0, 0), (0, width - a.shape[1])))
    b = np.pad(b, ((0, 0), (0, width + 1 - b.shape[1])))
    at_start, shifted = a == b[:, :width], a == b[:, 1:]
    replaced = (a_size == b_size) & ((~at_start).sum(axis=1) == 1)
    # Inserted: from the first difference on, all of a stands one place later in b.
    before = np.logical_and.accumulate(at_start, axis=1)
    inserted = (b_size == a_size + 1) & (before | shifted).all(axis=1)
    return replaced | inserted


def near_in(left: list[str], right: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of words one edit apart: of left and right, or within left (i < j). The left are not longer."""
    a, a_size, x = _letters(left)
    b, b_size, y = (a, a_size, x) if right is None else _letters(right)
    # |x - y|^2 = |x|^2 + |y|^2 - 2 xy; small whole numbers, exact in single precision
    far = x @ y.T
    far *= -2
    far += (x * x).sum(axis=1)[:, None]
    far += (y * y).sum(axis=1)[None, :]
    i, j = np.nonzero(far <= 2)
    if right is None:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        part = slice(k, k + (1 << 16))
        keep[part] = one_edit(a[i[part]], b[j[part]], a_size[i[part]], b_size[j[part]])
    return i[keep], j[keep]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every pair of distinct words one edit apart, once in each direction.

    Blocks of words of one length and one count of letters by class meet themselves and their neighbours as matrix products of
    at most about CHUNK x CHUNK words. A word goes to as many products as its block has neighbours (21 at most), times
    their chunks; no pair leaves a product unless it is near.
    """
    blocked = _blocked(words)
    room = F.greatest(F.lit(1.0), F.col("size") / LONG) / CHUNK
    sizes = blocked.groupBy(*BLOCK).agg(F.ceil(F.count("*") * room).cast("int").alias("chunks"))
    sizes = staged(sizes, "spelling-blocks")
    placed = blocked.join(sizes, BLOCK).withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")).drop("chunks")
    sides = _chunk_pairs(sizes)
    rows = placed.join(sides, [*BLOCK, "chunk"]).select("pair", "side", "word", "n")

    def found(sides: list[tuple[list[str], list[int]]]) -> pa.RecordBatch | None:
        (left, left_n), (right, right_n), (alone, alone_n) = sides
        if alone:
            left, left_n, right, right_n = alone, alone_n, alone, alone_n
        if not left or not right:
            return None
        i, j = near_in(left, None if alone else right)
        return pa.record_batch(
            {
                "word": pa.array(left, pa.string()).take(pa.array(i)), "n": pa.array(left_n, pa.int64()).take(pa.array(i)),
                "near": pa.array(right, pa.string()).take(pa.array(j)), "near_n": pa.array(right_n, pa.int64()).take(pa.array(j)),
            }
        )

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, [([], []) for _ in range(3)]
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("pair", "side", "word", "n"))
            for pair, side, word, n in zip(*columns):
                if pair != last:
                    if last is not None and (out := found(held)):
                        yield out
                    last, held = pair, [([], []) for _ in range(3)]
                held[side][0].append(word)
                held[side][1].append(n)
        if last is not None and (out := found(held)):
            yield out

    once = rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(products, "word string, n long, near string, near_n long")
    once = staged(once, "spelling-near")
    return once.union(once.select("near", "near_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to.

    A form is at least FORM_RATIO times as frequent as its word, so a chain is as short as a logarithm of the largest
    count, and each round halves what is left of it.
    """
    links = staged(forms.select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        links = staged(
            links.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")),
            "spelling-roots",
        )
        if links.where("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")


def spelling_variants(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least least_length letters and least_count occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z lower-cased; a run of a document for which EVERY divides
    crc32 of `<doc_id>:<run>` loses the letter at crc32 modulo its length. n_near: how many other words are one inserted,
    deleted or replaced letter away. form: the most frequent of these (ties: first in code-point order), if at least
    FORM_RATIO times as frequent, with its count form_n; else both are null. root: where following forms ends.

    Null doc_id: the empty string in the hash. Null or empty text: no words. Repeated rows and doc_ids: each counts.
    Very long texts and runs: in full. Empty table, or no word often enough: no rows. Other columns are ignored.
    """
    words = staged(word_counts(docs, least_length, least_count, id_col, text_col), "spelling-words")
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form"))).alias("best")
    )
    best = best.select("word", "n_near", F.col("best.form").alias("near"), (-F.col("best.rank")).alias("near_n"))
    often = F.col("near_n") >= FORM_RATIO * F.col("n")
    judged = staged(
        words.join(best, "word", "left").select(
            "word", F.when(often, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(often, F.col("near_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
