"""Token counts of byte-level BPE without shuffling a single pre-token."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import pieces, texts_of

#: The pre-token pattern of byte-level BPE files that ask for it (use_regex). Fixed value.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LATIN_PRETOKEN = r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"

#: White space and printable ASCII, Latin, Greek, Cyrillic, punctuation, currency, arrows and mathematics, kana,
#: unified ideographs, Hangul syllables, full-width forms, common emoji.
SETTLED = (
    r"\t-\r -~\xa0-\u0233\u0391-\u03a1\u03a3-\u03c9\u0400-\u0481\u2010-\u2027\u2030-\u205e\u20a0-\u20b5"
    r"\u2190-\u22ff\u3001-\u3003\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001f5ff"
)

#: Frequent pre-tokens come from about this many documents; they only decide what is looked up
#: first, never a result. Broadcast: at most TABLE_ENTRIES strings of at most TABLE_CHARS.
SAMPLE_DOCUMENTS = 2_000
TABLE_ENTRIES = 1 << 15
TABLE_CHARS = 32

#: A worker's cache of the other pre-tokens starts afresh beyond this size.
CACHE_ENTRIES = 500_000

_workers: dict[str, _Counter] = {}


class _Counter:
    """One worker's tokenizer, frequent lengths and cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pre = spec.get("pre_tokenizer") or {}
        special = [t["content"] for t in spec.get("added_tokens", [])]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
        #: Only this kind of file is a sum over pre-tokens; any other is encoded text by text.
        self.by_pretoken = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and spec.get("normalizer") is None
            and plain
        )
        self.find = regex.compile(PRETOKEN).findall
        # Texts with an added token, or with characters beyond these long-settled blocks, go to the
        # library whole: Unicode versions may differ on the class of the others.
        self.whole = regex.compile("|".join([*map(regex.escape, special), f"[^{SETTLED}]"])).search
        # The same pattern for texts of printable ASCII and Latin-1 letters only, which the quicker
        # library splits alike.
        self.special = special
        self.not_latin = re.compile(r"[^\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]").search
        self.find_latin = re.compile(LATIN_PRETOKEN).findall
        self.cache: dict[str, int] = {}

    def whole_lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pretokens(self, text: str) -> list[str] | None:
        """The text's pre-tokens, or None if the library has to see the whole text."""
        if not self.by_pretoken:
            return None
        if not self.not_latin(text) and not any(s in text for s in self.special):
            return self.find_latin(text)
        return None if self.whole(text) else self.find(text)

    def lengths(self, texts: list[str], frequent: dict[str, int]) -> list[int]:
        known, cache = frequent.get, self.cache
        totals, missed, aside = [0] * len(texts), {}, []
        for i, text in enumerate(texts):
            found = self.pretokens(text)
            if found is None:
                aside.append(i)
                continue
            first = list(map(known, found))
            if None in first:
                missed[i] = [p for p, n in zip(found, first) if n is None]
                first = filter(None, first)
            totals[i] = sum(first)
        # One call of the library for all that no tier knows.
        fresh = {p for ps in missed.values() for p in ps if p not in cache}
        if len(cache) + len(fresh) > CACHE_ENTRIES:
            cache.clear()
            fresh = {p for ps in missed.values() for p in ps}
        fresh = list(fresh)
        cache.update(zip(fresh, self.whole_lengths(fresh)))
        for i, ps in missed.items():
            totals[i] += sum(map(cache.__getitem__, ps))
        for i, n in zip(aside, self.whole_lengths([texts[i] for i in aside])):
            totals[i] = n
        return totals


def _counter(path: str) -> _Counter:
    if path not in _workers:
        _workers[path] = _Counter(path)
    return _workers[path]


def frequent_pretokens(texts: DataFrame, tokenizer_path: str) -> dict[str, int]:
    """Lengths of the pre-tokens that a bounded sample of documents repeats, at most TABLE_ENTRIES."""
    total = texts.count()
    if not total:
        return {}
    share = min(1.0, SAMPLE_DOCUMENTS / total)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = _counter(tokenizer_path), Counter()
        if counter.by_pretoken:
            for _, found in pieces(batches):
                for text in found:
                    seen.update(counter.pretokens(text.decode()) or ())
                if len(seen) > 4 * TABLE_ENTRIES:
                    seen = Counter(dict(seen.most_common(2 * TABLE_ENTRIES)))
        top = [(p, n) for p, n in seen.most_common(TABLE_ENTRIES) if n > 1 and len(p) <= TABLE_CHARS]
        yield pa.record_batch(
            {"pretoken": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
        )

    rows = (
        texts.select("text")
        .sample(share, seed=7)
        # The scan keeps its tasks; only the sampled texts are gathered.
        .repartition(8)
        .mapInArrow(partial, "pretoken string, n long")
        .groupBy("pretoken")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "pretoken")
        .limit(TABLE_ENTRIES)
        .collect()
    )
    names = [r.pretoken for r in rows]
    return dict(zip(names, _counter(tokenizer_path).whole_lengths(names))) if names else {}


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, as the library counts them.

    tokenizer_path must exist on every executor. Two tiers, both on the map side: a broadcast table of the lengths of
    frequent pre-tokens (bounded in entries and characters), then the worker's cache, whose misses
    the library encodes. A text that has an added token's string, and any tokenizer that is not a
    plain sum over pre-tokens, is encoded whole by the library.

    Null or empty text: 0 bytes, 0 tokens, not over. Null or repeated doc_ids: a row each. Very
    long texts are counted whole. Other columns are ignored. Empty table: no rows.
    """
    texts = texts_of(docs, id_col, text_col)
    shared = texts.sparkSession.sparkContext.broadcast(frequent_pretokens(texts, tokenizer_path))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, frequent = _counter(tokenizer_path), shared.value
        for batch, found in pieces(batches):
            n_tokens = counter.lengths([t.decode() for t in found], frequent)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array([len(t) for t in found], pa.int64()),
                    "n_tokens": pa.array(n_tokens, pa.int64()),
                    "over_limit": pa.array([n > limit for n in n_tokens], pa.bool_()),
                }
            )

    return texts.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
