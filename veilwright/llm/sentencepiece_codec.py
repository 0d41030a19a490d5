"""SentencePiece models encoded and decoded by the tokenizers library."""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilwright.llm.common import pieces, texts_of

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2

#: Texts go to the backend in batches of about this many characters.
BATCH_CHARS = 250_000
#: Threads of the backend in each worker, unless RAYON_NUM_THREADS says otherwise.
THREADS = 2
#: What a text is cut into before it is encoded, where no piece goes on with a marker after another character.
UNITS = re.compile(" *[^ ]+| +")
#: Texts that are a unit with one marker; so many are encoded in one row.
WORDLIKE = re.compile(f"[^ {MARK}]+")
WORDS_A_ROW = 64
#: Units whose ids a worker remembers, each of at most so many characters; beyond it starts anew.
MOST_UNITS = 1 << 18
LONGEST_UNIT = 32


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: varints as int, the others as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} in a model file")
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What a SentencePiece model file says, as far as encoding and decoding need it."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marker: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
                model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
            elif number == 2:
                spec = dict(_fields(value))
                model.model_type = spec.get(3, UNIGRAM)
                model.byte_fallback = bool(spec.get(35, 0))
                model.suffix_marker = bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(_fields(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix, model.remove_extra, model.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if model.model_type not in (UNIGRAM, BPE) or model.suffix_marker or not model.escape:
            raise ValueError("only unigram and BPE models with an escaped prefix marker are handled")
        return model

    @property
    def splits_at_marks(self) -> bool:
        """No piece goes on with a marker after another character, so texts can be cut before markers."""
        return all(MARK not in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))

    @property
    def splits_at_units(self) -> bool:
        """A text's ids are those of its units in a row: every unit has a marker, and nothing unknown runs on through it."""
        known = self.byte_fallback or any(p == MARK and kind == NORMAL for p, _, kind in self.pieces)
        return self.splits_at_marks and not self.charsmap and known and (self.dummy_prefix or not self.remove_extra)


def _merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first."""
    known = {p for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    ranked = sorted((-score, i, p) for i, (p, score, kind) in enumerate(model.pieces) if p in known and kind == NORMAL)
    return [(p[:k], p[k:]) for _, _, p in ranked for k in range(1, len(p)) if p[:k] in known and p[k:] in known]


def backend(model: Model):
    """A tokenizers.Tokenizer with the model's normaliser, marker, scores or merges, and byte fallback."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unk = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.model_type == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk, model.byte_fallback)
    else:
        core = models.BPE(
            {p: i for i, (p, _, _) in enumerate(model.pieces)},
            _merges(model),
            unk_token=None if unk is None else model.pieces[unk][0],
            fuse_unk=True,
            cache_capacity=0,
            byte_fallback=model.byte_fallback,
        )
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    steps += [normalizers.Prepend(" ")] if model.dummy_prefix else []
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if model.splits_at_marks:
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    ends = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends]
    )
    return tokenizer


class Codec:
    """One worker's backend for a model, checked against the sentencepiece library as it goes.

    Neither library joins pieces across units (a word and the spaces before it), so each distinct unit is encoded by both, once a
    worker while it is remembered, and a text's ids are its units' ids in a row. Texts with a marker of their own, and models that
    normalise characters or whose pieces span units, have whole texts encoded and compared. Where the two differ, sentencepiece's ids
    of that text stand.
    """

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = Model.parse(data)
        self.tokenizer = backend(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.disagreed = 0
        self.by_unit = self.model.splits_at_units
        self.units: dict[str, bytes] = {}
        self.differing: set[str] = set()
        self.marked = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.in_rows = self.by_unit and self.model.dummy_prefix and any(p == MARK for p, _, kind in self.model.pieces if kind == NORMAL)
        self.byte_of = [int(p[1:-1], 16) if kind == BYTE else None for p, _, kind in self.model.pieces]
        self.plain = [
            b" \xe2\x81\x87 "
            if kind == UNKNOWN
            else b""
            if kind == CONTROL
            else bytes([b])
            if b is not None
            else p.replace(MARK, " ").encode()
            for (p, _, kind), b in zip(self.model.pieces, self.byte_of)
        ]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        return self.encode_checked(texts)[:2]

    def encode_checked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As encode, and for each text whether the backend agreed."""
        ids, counts, agreed, start, held = [np.zeros(0, np.int32)], [], [], 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= BATCH_CHARS or i + 1 == len(texts):
                # The backend's objects are many times a text's size: only plain ids outlive a batch.
                found, same = self._batch(texts[start : i + 1])
                ids += found
                counts += map(len, found)
                agreed += same
                start, held = i + 1, 0
        return np.concatenate(ids), np.array(counts, np.int64), np.array(agreed, bool)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """The backend's ids of each text. Words are encoded many in a row, and told apart by the marker before each."""
        words = [i for i, t in enumerate(texts) if WORDLIKE.fullmatch(t)] if self.in_rows else []
        rows = [words[k : k + WORDS_A_ROW] for k in range(0, len(words), WORDS_A_ROW)]
        apart = sorted(set(range(len(texts))).difference(words))
        out: list[list[int]] = [[]] * len(texts)
        for row, e in zip(rows, self._encoded([" ".join([texts[i] for i in row]) for row in rows])):
            ids = e.ids
            starts = np.flatnonzero(self.marked[ids]).tolist()
            if len(starts) != len(row):
                apart += row
                continue
            for i, start, end in zip(row, starts, [*starts[1:], len(ids)]):
                out[i] = ids[start:end]
        for i, e in zip(apart, self._encoded([texts[i] for i in apart])):
            out[i] = e.ids
        return out

    def _encoded(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _batch(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        split = [self._units(t) if self.by_unit and MARK not in t else None for t in texts]
        fresh = self._learn(set().union(*filter(None, split)))
        whole = [t for t, units in zip(texts, split) if units is None]
        compared = zip(self._ids(whole), self.reference.encode(whole, num_threads=1)) if whole else iter(())
        ids, same = [], []
        for text, units in zip(texts, split):
            if units is None:
                own, wanted = next(compared)
                agreed = own == wanted
            else:
                agreed = not self.differing or self.differing.isdisjoint(units)
                wanted = None if agreed else self.reference.encode(text)
            if units is not None and agreed:
                ids.append(np.frombuffer(b"".join(map(self.units.__getitem__, units)), np.int32))
            else:
                ids.append(np.array(wanted, np.int32))
            self.disagreed += not agreed
            same.append(agreed)
        self._forget(fresh)
        return ids, same

    def _units(self, text: str) -> list[str]:
        """The text's units in order, as texts of their own that give the same pieces; a lone space at the end is an empty one."""
        if self.model.remove_extra:
            return [u for u in text.split(" ") if u]
        if not self.model.dummy_prefix:
            return UNITS.findall(text)
        # The prefix that a unit loses here comes back when it is encoded.
        found = text.split(" ") if text else []
        return [u[1:] for u in UNITS.findall(" " + text)] if "" in found else found

    def _learn(self, units: set[str]) -> list[str]:
        """Encodes the units not yet known with both libraries, and returns them."""
        fresh = list(units.difference(self.units))
        # There is no prefix before an empty text: a lone space is encoded behind a word.
        shown = [u or "a " for u in fresh]
        for u, own, wanted in zip(fresh, self._ids(shown), self.reference.encode(shown, num_threads=1)):
            if own != wanted:
                self.differing.add(u)
            self.units[u] = array("i", own if u else own[len(self._ids(["a"])[0]) :]).tobytes()
        return fresh

    def _forget(self, fresh: list[str]) -> None:
        if len(self.units) > MOST_UNITS:
            self.units.clear()
            self.differing.clear()
            return
        for u in fresh:
            if len(u) > LONGEST_UNIT:
                del self.units[u]
                self.differing.discard(u)

    def decode(self, ids: list[int]) -> str:
        """The text of one list of ids; ids outside the model are an error."""
        text = b"".join(map(self.plain.__getitem__, ids))
        # The marker that encoding put in front; what a byte piece has written is not it.
        if self.model.dummy_prefix and ids and self.byte_of[ids[0]] is None and text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", errors="replace")


_workers: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _workers:
        # The backend's pool starts once a worker; a thread a core of the machine would cost every
        # worker memory for cores it does not have.
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        with open(path, "rb") as f:
            _workers[path] = Codec(f.read())
    return _workers[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip, parity): every whole text encoded, and whether decoding gives it back.

    parity: whether the backend gave the library's ids; where not, the library's stand.

    model_path must exist on every executor; neither begin nor end ids are added. Row by row, nothing is shuffled.

    Null or empty text: no ids, round_trip true. Null or repeated doc_ids and repeated rows: a row
    each. Characters without a piece: bytes if the model falls back to them, else the unknown id and
    round_trip false; so is it where normalising changed the text. Empty table: no rows. Other
    columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch, found in pieces(batches):
            texts = [t.decode() for t in found]
            ids, counts, agreed = c.encode_checked(texts)
            ends = np.r_[0, np.cumsum(counts)]
            same = [c.decode(ids[a:b].tolist()) == t for a, b, t in zip(ends, ends[1:], texts)]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "round_trip": pa.array(same, pa.bool_()),
                    "parity": pa.array(agreed, pa.bool_()),
                }
            )

    return texts_of(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean, parity boolean"
    )


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of lists of ids. A null or empty list gives the empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            texts = [c.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    ids = encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids"))
    return ids.mapInArrow(run, "doc_id long, text string")
