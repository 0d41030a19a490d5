"""Randomised edit embedding: shared random walks turn edit distance into Hamming distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwright.llm.common import staged, texts_of

SEED = 3
#: Characters are hashed into this many classes; the last one stands for the end of a text.
CLASSES = 64
END = CLASSES - 1
#: Hex digits sampled from every octave [2^k - 1, 2^(k+1) - 1) of the walk's steps.
SAMPLES = 32
BLOCK = 4096
#: Texts walk together in runs of about this many characters.
RUN_CHARS = 20_000_000


def _random(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence((SEED, *key))))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    return _random(0).integers(0, END, 1 << 16, dtype=np.uint8)


@lru_cache(maxsize=64)
def _moves(block: int) -> np.ndarray:
    """Per step of the block and class: does the walk go on to the next character."""
    moves = _random(1, block).integers(0, 2, (BLOCK, CLASSES), dtype=np.uint8)
    moves[:, END] = 0
    return moves


@lru_cache(maxsize=64)
def _octave(k: int) -> tuple[np.ndarray, np.ndarray]:
    """The octave's sampled steps, ascending, and for each a digit per class."""
    first, size = (1 << k) - 1, 1 << k
    draw = _random(2, k)
    steps = np.arange(size) if size <= SAMPLES else np.sort(draw.choice(size, SAMPLES, replace=False, shuffle=False))
    return first + steps, draw.integers(0, 16, (len(steps), CLASSES), dtype=np.uint8)


def _octaves(steps: int) -> int:
    """How many octaves a walk of so many steps enters."""
    return int(steps).bit_length() if steps else 0


@lru_cache(maxsize=64)
def _samples(octaves: int) -> tuple[np.ndarray, np.ndarray]:
    """All sampled steps of the first octaves and the weight of each: the steps it stands for."""
    parts = [_octave(k)[0] for k in range(octaves)]
    weights = [np.full(len(p), (1 << k) / len(p)) for k, p in enumerate(parts)]
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.concatenate([np.zeros(0), *weights])


def codes(text: str) -> np.ndarray:
    """The classes of a text's code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _classes()[points & 0xFFFF]


def walk(texts: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """For each text (classes): the number of steps of its walk and the digits sampled on the way.

    At step j all walks share one random bit for each class: a walk at a character of that class
    emits it and moves on or stays. Walks meet again soon after an edit, so few edits change few of
    the emitted characters. All texts walk at once; those at their end drop out.
    """
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.full(int(sizes.sum()) + n, END, np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    for t, s in zip(texts, starts):
        flat[s : s + len(t)] = t
    steps = np.zeros(n, np.int64)
    digits: list[list[np.ndarray]] = [[] for _ in range(n)]
    active = np.flatnonzero(sizes)
    at = starts[active]
    here = flat[at]
    step, k = 0, 0
    while len(active):
        sampled, table = _octave(k)
        octave_end = (2 << k) - 1
        taken = np.zeros((len(sampled), len(active)), np.uint8)
        members = active  # columns of taken
        column = np.arange(len(active))
        row = 0
        while step < octave_end and len(active):
            moves = _moves(step // BLOCK)
            # Ended walks are looked for only now and then; an ended walk stays where it is.
            stop = min(octave_end, step + 64, (step // BLOCK + 1) * BLOCK)
            begin = at.copy()
            for j in range(step, stop):
                if row < len(sampled) and sampled[row] == j:
                    taken[row, column] = table[row].take(here)
                    row += 1
                at += moves[j % BLOCK].take(here)
                flat.take(at, out=here, mode="clip")
            ended = here == END
            if ended.any():
                # These few walk the last steps again, to find the step at which each has ended.
                again = begin[ended]
                seen = flat[again]
                count = np.zeros(len(again), np.int64)
                for j in range(step, stop):
                    count += seen != END
                    again += moves[j % BLOCK].take(seen)
                    seen = flat[again]
                steps[active[ended]] = step + count
                keep = ~ended
                active, at, here, column = active[keep], at[keep], here[keep], column[keep]
            step = stop
        for c, m in enumerate(members.tolist()):
            digits[m].append(taken[:, c])
        k += 1
    out = []
    for i in range(n):
        count = int(np.searchsorted(_samples(_octaves(steps[i]))[0], steps[i]))
        flat_digits = np.concatenate([np.zeros(0, np.uint8), *digits[i]])[:count]
        out.append((int(steps[i]), flat_digits))
    return out


def written(steps: int, digits: np.ndarray) -> str:
    """A fingerprint: steps in hex, a colon, a hex digit a sample."""
    return f"{steps:x}:" + (digits + np.where(digits < 10, 48, 87)).astype(np.uint8).tobytes().decode()


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    steps, _, digits = fingerprint.partition(":")
    raw = np.frombuffer(digits.encode(), np.uint8)
    return int(steps, 16), (raw - np.where(raw < 58, 48, 87)).astype(np.uint8)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated share of steps, up to the longer walk's end, at which both walks emit the same."""
    longest = max(a[0], b[0])
    if not longest:
        return 1.0
    sampled, weights = _samples(_octaves(longest))
    count = int(np.searchsorted(sampled, longest))
    shared = min(len(a[1]), len(b[1]))
    same = weights[:shared][a[1][:shared] == b[1][:shared]].sum()
    return float(same / weights[:count].sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text, row by row.

    Null or empty text: the fingerprint "0:". Equal texts have equal fingerprints. Null or repeated doc_ids: a row
    each. Empty table: no rows. Other columns are ignored. Memory follows the longest text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _runs(batches):
            prints = [written(*w) for w in walk([codes(t) for t in texts])]
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(prints)],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids.append(i)
            texts.append(t)
            held += len(t)
            if held >= RUN_CHARS:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _edited(text: str, after: str) -> str:
    """text with its last quarter of code points replaced by as many (or all) from the start of `after`."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _compare(ids: list, texts: list[str]) -> dict[str, list]:
    """Result columns for all texts but the last, each compared with the one after it."""
    edited = [_edited(t, u) for t, u in zip(texts, texts[1:])]
    walks = walk([codes(t) for t in [*texts, *edited]])
    own, other = walks[: len(texts)], walks[len(texts) :]
    return {
        "doc_id": ids[:-1],
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": [written(*w) for w in own[:-1]],
        "edited_fingerprint": [written(*w) for w in other],
        "near_edited": [likeness(a, b) for a, b in zip(own, other)],
        "near_next": [likeness(a, b) for a, b in zip(own, own[1:])],
    }


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited text and that of the next document.

    The next document follows in doc_id order (null first; equal ids by two hashes of the text);
    after the last comes the first. Rows are range-partitioned and sorted on id, hashes and a row number, so a hot id is
    spread, and so are equal rows; a task reads its rows in order and keeps one text back. The first and last text of each
    partition are joined to their neighbours afterwards: two rows a partition.

    Null text: empty. Empty text: edited text empty too, likeness 1 to another empty one, else 0. A
    single row is its own next. Repeated rows: a row each. Empty table: no rows. Other columns are ignored.
    """
    keys = {"text_key": F.xxhash64("text"), "text_key2": F.xxhash64(F.lit(1), "text"), "row": F.monotonically_increasing_id()}
    order = [F.col("doc_id").asc_nulls_first(), *keys]
    placed = (
        texts_of(docs, id_col, text_col)
        .withColumns(keys)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop(*keys)
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows(edge: str, columns: dict[str, list], texts: list) -> pa.RecordBatch:
            n = len(texts)
            blank = dict.fromkeys(NAMES, [None] * n) | columns | {"edge": [edge] * n, "part": [part] * n, "text": texts}
            return pa.RecordBatch.from_pydict(blank, schema=schema)

        schema = pa.schema(
            [
                *((n, t) for n, t in zip(NAMES, [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2)),
                ("edge", pa.string()),
                ("part", pa.int64()),
                ("text", pa.string()),
            ]
        )
        kept: tuple[list, list[str]] = ([], [])
        for ids, texts in _runs(batches):
            if not kept[0]:
                yield rows("first", {"doc_id": ids[:1]}, texts[:1])
            ids, texts = kept[0] + ids, kept[1] + texts
            if len(ids) > 1:
                yield rows("", _compare(ids, texts), [None] * (len(ids) - 1))
            kept = (ids[-1:], texts[-1:])
        if kept[0]:
            yield rows("last", {"doc_id": kept[0]}, kept[1])

    found = staged(placed.mapInArrow(run, f"{RESULT}, edge string, part long, text string"), "edit-embedding")
    first, last = found.where("edge = 'first'"), found.where("edge = 'last'")
    # One row a partition: which partition comes next.
    parts = first.select("part")
    after = F.lead("part").over(Window.orderBy("part"))
    least = F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = parts.select("part", F.coalesce(after, least).alias("next_part"))
    ends = last.select("doc_id", "text", "part").join(following, "part")
    ends = ends.join(first.select(F.col("part").alias("next_part"), F.col("text").alias("next_text")), "next_part")

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, u in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text"))):
                row = _compare([i, None], [t, u])
                yield pa.RecordBatch.from_pydict(row | {"doc_id": pa.array([i], pa.int64())})

    return found.where("edge = ''").select(*NAMES).unionByName(
        ends.select("doc_id", "text", "next_text").mapInArrow(close, RESULT)
    )


def near_pairs(docs: DataFrame, least: float = 0.8, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (fingerprint_a, fingerprint_b, likeness) of different fingerprints that are at least `least` alike.

    Bit-sampled banding: each fingerprint is cut into bands of `width` digits in its last two octaves and in the
    next one (empty there); fingerprints that agree on a band in its place are candidates, and every
    candidate pair is verified on all digits. Documents share a fingerprint's row, so copies never pair up.
    """

    def bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys = [], []
            for text in batch.column("fingerprint").to_pylist():
                steps, _, digits = text.partition(":")
                octaves = _octaves(int(steps, 16))
                low = len(_samples(max(0, octaves - 2))[0])
                for at in range(low, len(digits), width):
                    prints.append(text)
                    keys.append(f"{at}:{digits[at : at + width]}")
            yield pa.record_batch([pa.array(prints, pa.string()), pa.array(keys, pa.string())], names=["fingerprint", "band"])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("fingerprint_a", "fingerprint_b"))
            value = [likeness(read(x), read(y)) for x, y in zip(a, b)]
            out = pa.record_batch([pa.array(a), pa.array(b), pa.array(value)], names=["fingerprint_a", "fingerprint_b", "likeness"])
            yield out.filter(pa.compute.greater_equal(out.column("likeness"), least))

    prints = staged(fingerprints(docs, id_col, text_col).select("fingerprint").distinct(), "prints")
    banded = staged(prints.mapInArrow(bands, "fingerprint string, band string"), "bands")
    right = banded.withColumnRenamed("fingerprint", "other")
    pairs = (
        banded.join(right, "band")
        .where("fingerprint < other")
        .select(F.col("fingerprint").alias("fingerprint_a"), F.col("other").alias("fingerprint_b"))
        .distinct()
    )
    return pairs.mapInArrow(verify, "fingerprint_a string, fingerprint_b string, likeness double")
