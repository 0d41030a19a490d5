"""Repetition inside a document from a suffix array over its words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from veilwright.llm.common import col, new_name, pieces, texts_of

MIN_WORDS = 50
#: Maximal repeats of at least this many words count.
MIN_REPEAT = 8
#: A document goes if such repeats cover more than this share of its word characters ...
MAX_COVERED = 0.3
#: ... or if one of them is longer than this many words.
MAX_LONGEST = 100

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
#: Texts are split into words in slices of about this many bytes.
SLICE = 1 << 20
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Words compared at once when common prefixes are measured.
WINDOW = 1 << 20


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _split(text: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + SLICE)
        end = len(text) if cut is None else cut.start()
        yield text[at:end].split()
        at = end


class Words:
    """The words of several texts as one array of ids, each text's ids its own."""

    def __init__(self, texts: list[bytes]):
        ids = _Ids()
        found, counts = [np.zeros(0, np.int32)], []
        for text in texts:
            slices = [np.fromiter(map(ids.__getitem__, words), np.int32, len(words)) for words in _split(text)]
            counts.append(sum(map(len, slices)))
            found += slices
        word = np.concatenate(found)
        del found
        self.counts = np.array(counts, np.int64)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        # Code points of a word: its bytes that do not continue one.
        chars = np.fromiter((len(w) if w.isascii() else len(w.decode()) for w in ids), np.int32, len(ids))
        self.chars = chars[word]
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), self.counts)
        self.end = self.ends.astype(np.int32)[self.text]
        self.first = self.text.astype(np.int64) * max(1, len(ids)) + word


def _dense(keys: np.ndarray) -> np.ndarray:
    """Rank of the first of equal keys in sorted order."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    heads = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    ranks = np.empty(len(keys), np.int32)
    ranks[order] = np.repeat(heads, np.diff(np.r_[heads, len(s)]))
    return ranks


def repeated_windows(words: Words, width: int = 3) -> np.ndarray:
    """Per word: is it in a window of width words that its text has twice or more."""
    n = len(words.first)
    covered = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(np.arange(n) + width <= words.end)
    if len(at):
        key = words.first[at]
        for k in range(1, width):
            _, key = np.unique(key, return_inverse=True)
            key = key * (n * len(words.counts) + 1) + words.first[at + k] if n < 1 << 20 else _pair(key, words.first[at + k])
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        found = at[count[inverse] > 1]
        np.add.at(covered, found, 1)
        np.add.at(covered, found + width, -1)
    return np.cumsum(covered)[:n] > 0


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, b = np.unique(b, return_inverse=True)
    return a * (len(b) + 1) + b


def _suffix_array(words: Words) -> np.ndarray:
    """Word positions in the order of their suffixes, each up to the end of its text.

    Prefix doubling sorts the suffixes of all texts at once: a suffix whose first k words are its own is settled, the
    others are sorted again by their first 2k.
    """
    n = len(words.first)
    rank, k = _dense(words.first), 1
    open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1).astype(np.int32)
    while len(open_):
        after = open_ + np.int32(k)
        key = np.where(after < words.end[open_], rank[np.minimum(after, n - 1)] + 1, 0)
        del after
        key = rank[open_].astype(np.int64) * (n + 1) + key
        order = np.argsort(key, kind="stable")
        place, key = open_[order], key[order]
        del order
        fresh = np.r_[True, key[1:] != key[:-1]]
        del key
        old = rank[place]
        index = np.arange(len(place), dtype=np.int32)
        start = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], index, 0))
        rank[place] = old + np.maximum.accumulate(np.where(fresh, index, 0)) - start
        del old, start, index
        k = min(2 * k, n)
        counts = np.diff(np.r_[np.flatnonzero(fresh), len(place)])
        open_ = place[np.repeat(counts, counts) > 1]
    order = np.empty(n, np.int32)
    order[rank] = np.arange(n, dtype=np.int32)
    return order


def _common(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from a[i] and from b[i] on are equal. first: ids ending with one of its own."""
    out = np.zeros(len(a), np.int32)
    open_, width = np.arange(len(a)), 1
    last = len(first) - 1
    while len(open_):
        still = []
        # Windows grow twofold, so a pair costs about twice its common prefix; all windows of a step fit WINDOW words.
        span = min(width, WINDOW)
        rows = max(1, WINDOW // span)
        for at in range(0, len(open_), rows):
            pairs = open_[at : at + rows]
            steps = np.arange(span)
            x = first[np.minimum((a[pairs] + out[pairs])[:, None] + steps, last)]
            y = first[np.minimum((b[pairs] + out[pairs])[:, None] + steps, last)]
            unlike = x != y
            ends = unlike.any(axis=1)
            out[pairs] += np.where(ends, unlike.argmax(axis=1), span).astype(np.int32)
            still.append(pairs[~ends])
        open_ = np.concatenate(still)
        width *= 2
    return out


def longest_repeats(words: Words, least: int) -> np.ndarray:
    """Per word position: the longest prefix, in words, that its text has at another place too.

    Common prefixes of neighbours in the suffix array, in memory linear in the words. In text order, where the words before
    a suffix and before its neighbour are equal, the common prefix is one less than that of the suffix before; only where they
    differ is it counted out, and those prefixes add up to n log n words at most. Lengths below `least` are given as 0.
    """
    n = len(words.first)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    order = _suffix_array(words)
    # The neighbour before, and whether the pair follows from the one of the position before.
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    text, first = words.text, np.r_[words.first, -1]
    here = np.arange(1, n, dtype=np.int32)
    there = before[1:]
    inside = (there > 0) & (text[here] == text[here - 1]) & (text[there] == text[there - 1])
    follows = np.r_[False, inside & (first[here - 1] == first[there - 1])]
    del here, there, inside
    at = np.flatnonzero(~follows & (before >= 0) & (first[:-1] == first[before]))
    common = np.zeros(n, np.int32)
    common[at] = _common(first, at, before[at].astype(np.int64))
    del before
    source = np.maximum.accumulate(np.where(follows, 0, np.arange(n, dtype=np.int32)))
    common = common[source] - (np.arange(n, dtype=np.int32) - source)
    del source, follows
    common[common < least] = 0
    pairs = common[order]
    longest[order] = np.maximum(pairs, np.r_[pairs[1:], np.int32(0)])
    return longest


def measure(texts: list[bytes], least: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The counts of every text and what its maximal repeats of at least `least` words cover."""
    words = Words(texts)
    n, m = len(words.first), len(texts)

    def per_text(values: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(values, dtype=np.int64)]
        return (total[words.ends] - total[words.starts]).astype(np.int64)

    longest = longest_repeats(words, least)
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(longest)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + longest[at], -1)
    covered = np.cumsum(edges)[:n] > 0
    top = np.zeros(m, np.int64)
    np.maximum.at(top, words.text, longest)
    lines = [[line for line in t.split(b"\n") if line.strip()] for t in texts]
    return {
        "n_words": words.counts,
        "word_chars": per_text(words.chars),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": per_text(repeated_windows(words)),
        "covered_chars": per_text(words.chars * covered),
        "longest_repeat": top,
    }


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_chars long, longest_repeat long"
)


def _verdicts(texts: list[bytes], least: int, most_covered: float, most_longest: int) -> dict[str, np.ndarray]:
    m = measure(texts, least)
    m["base_failed"] = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    repetitive = (m["covered_chars"] > most_covered * m["word_chars"]) | (m["longest_repeat"] > most_longest)
    m["kept"] = ~m["base_failed"] & ~repetitive
    return m


def quality_rules(
    docs: DataFrame,
    least: int = MIN_REPEAT,
    most_covered: float = MAX_COVERED,
    most_longest: int = MAX_LONGEST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Counts and verdict of every document, from its whole text.

    A suffix array over the words of each text gives, by its longest-common-prefix intervals, the
    maximal repeated substrings of at least `least` words. The union of their spans (overlaps included) may cover at most
    `most_covered` of the word characters, and none may exceed `most_longest` words. base_failed: under 50
    words, or over half of them in 3-word windows that occur twice or more.

    Null or empty text: all counts 0, base_failed. Null or repeated doc_ids and repeated rows: a row each. Very
    long texts: in full, memory in proportion to the longest text. Empty table: no rows. Other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            m = _verdicts(texts, least, most_covered, most_longest)
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(m[c]) for c in names[1:])], names=names)

    return texts_of(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def quality_filter(
    docs: DataFrame,
    least: int = MIN_REPEAT,
    most_covered: float = MAX_COVERED,
    most_longest: int = MAX_LONGEST,
    text_col: str = "text",
) -> DataFrame:
    """docs without the rows that quality_rules rejects, all columns kept; nothing is shuffled."""
    @arrow_udf("boolean")
    def keeps(texts: pa.Array) -> pa.Array:
        batch = pa.record_batch({"text": texts})
        parts = [_verdicts(t, least, most_covered, most_longest)["kept"] for _, t in pieces([batch])]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

    flag = new_name(docs, "kept")
    return docs.withColumn(flag, keeps(F.coalesce(col(text_col), F.lit("")))).where(F.col(flag)).drop(flag)
