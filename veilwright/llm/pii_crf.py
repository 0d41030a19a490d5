"""Personal data: fixed patterns, and a linear-chain CRF over word shapes for what they miss."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilwright.llm.common import pieces, texts_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
IMPOSSIBLE = -1e9

#: Weak labels come from about this many documents and at most so many runs of words reach the driver.
TRAIN_DOCUMENTS = 20_000
TRAIN_RUNS = 4_000
#: The hand-labelled rows below count this often beside them.
HAND_WEIGHT = 20.0
PENALTY = 0.02
ROUNDS = 200

Span = tuple[int, int, int]  # start, index of kind, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match takes digits to their end, so a later one never starts inside a run of them.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _is_card(digits: str) -> bool:
    return 14 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and not overlapping within a kind, in order."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        # The local part is the run of its characters up to the sign, but not inside the last match.
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if _is_ip(m.group()):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and _is_card(NOT_DIGIT.sub("", m.group())):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


class Placed:
    """Sorted spans, asked for the first that overlaps a range in logarithmic time."""

    def __init__(self, spans: list[Span]):
        self.spans = spans
        self.reach = list(accumulate((end for _, _, end in spans), max))

    def hit(self, start: int, end: int) -> Span | None:
        i = bisect_right(self.reach, start)  # the first span that ends behind start
        return self.spans[i] if i < len(self.spans) and self.spans[i][0] < end else None


# Words and their shapes. A word without a digit or an at sign can only be outside, so the chain falls apart into runs
# of neighbouring marked words, each between two outside words.

MARK = re.compile(r"[0-9@]+|[\[(]at[\])]")
SPACE = re.compile(r"[\x20\x09-\x0D]")
GAP = re.compile(r"[\x20\x09-\x0D]+")
CORE = re.compile(r"^[^\w+(]*(.*?)[^\w)]*$", re.S)
DEFANGED = re.compile(r"[\[(](\.|dot|at)[\])]")


def marked_words(text: str) -> list[tuple[int, int]]:
    """Bounds of the words that have a mark."""
    words, end = [], 0
    for m in MARK.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and text[start - 1] not in " \t\n\r\x0b\x0c":
            start -= 1
        after = SPACE.search(text, m.end())
        end = after.start() if after else len(text)
        words.append((start, end))
    return words


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Marked words that follow each other with nothing but white space between, on one line."""
    out: list[list[tuple[int, int]]] = []
    for word in marked_words(text):
        if out:
            gap = text[out[-1][-1][1] : word[0]]
            if "\n" not in gap and GAP.fullmatch(gap):
                out[-1].append(word)
                continue
        out.append([word])
    return out


def shape(word: str) -> str:
    """Letters as a, runs of digits as d and their number (up to 20), other characters as they are."""
    out = []
    for m in re.finditer(r"([0-9]+)|([^\W\d_]+)|(.)", word[:200], re.S):
        out.append(f"d{min(len(m[1]), 20)}" if m[1] else "a" if m[2] else m[3])
    return "".join(out)


def features(word: str) -> list[str]:
    """Names of what is seen of a word: its shape, and facts about its digits and signs."""
    core = CORE.match(word)[1]
    plain = DEFANGED.sub(lambda m: {"at": "@"}.get(m[1], "."), core)
    digits = NOT_DIGIT.sub("", core)
    letters = any(c.isalpha() for c in core)
    names = ["bias", f"digits={min(len(digits), 20)}", f"letters={letters}", f"start={core[:1] if core[:1] in '+(' else ''}"]
    if not letters:
        names.append(f"shape={shape(core)}")
    if "@" in plain:
        local, _, domain = plain.partition("@")
        names.append(f"at={bool(local)}/{min(domain.count('.'), 2)}/{domain.count('@')}")
    parts = plain.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        names.append(f"quad={_is_ip(plain)}")
    if 14 <= len(digits) <= 19 and not letters:
        names.append(f"luhn={luhn(digits)}")
    return names


#: Hand-labelled rows for what the patterns miss; labels of the marked words in order.
HAND_LABELLED = (
    ("ring +1 (269) 555-3296 4524132264652876 now", "phone phone phone card"),
    ("ring +1 (415) 555-0137 4111111111111111 now", "phone phone phone card"),
    ("pay 4111111111111111 +1 (415) 555-0137 now", "card phone phone phone"),
    ("numbers 4111111111111111 5500005555555559 both", "card card"),
    ("numbers 4111111111111111 27.65.93.188 both", "card ip"),
    ("hosts 10.20.30.40 192.0.2.17 both", "ip ip"),
    ("host 192[.]0[.]2[.]17 is down", "ip"),
    ("host 203(.)0(.)113(.)5 is down", "ip"),
    ("write to info@münchen.example today", "email"),
    ("write to jörg.weiß@straße.example today", "email"),
    ("write to sales[at]example.com today", "email"),
    ("write to mary(at)mail.example.org today", "email"),
    ("ring (269) 555-3296 today", "phone phone"),
    ("ring (020) 555-0100 today", "phone phone"),
    ("ring 269-555-3296 today", "phone"),
    ("ring 0044 20 7946 0958 today", "phone phone phone phone"),
    ("mail a.b@mail7.example.com +1 (269) 555-3296 end", "email phone phone phone"),
    ("released under version 2.0. of 2004", "O O"),
    ("section 3.1.4 page 12 of 340", "O O O"),
    ("from 1999-2004 or 12/31/2020", "O O"),
    ("build 1.2.3.400 of 12345678", "O O"),
    ("number 1234567890123456 12 3", "O O O"),
    ("about 1,250,000 in 2019 and 15%", "O O O"),
    ("at 10:30 on 2024-01-02 @ noon", "O O O"),
    ("@someone said 100 things", "O O"),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "O"),
    ("order 555-7713 and 88-1234", "O O"),
    ("1. 2. 3) 4", "O O O O"),
)


def _hand_rows() -> list[tuple[list[str], list[int]]]:
    rows = []
    for text, names in HAND_LABELLED:
        given = iter(names.split())
        for run in runs(text):
            words, labels, last = [], [], ""
            for start, end in run:
                kind = next(given)
                # A phone number may go on over several words; the other kinds are one word each.
                goes_on = kind == "phone" and last == "phone" and not text[start:end].startswith("+")
                words.append(text[start:end])
                labels.append(LABELS.index("O" if kind == "O" else f"{'I' if goes_on else 'B'}-{kind}"))
                last = kind
            rows.append((words, labels))
    return rows


def weak_rows(text: str) -> list[tuple[list[str], list[int]]]:
    """Runs of a text, labelled by the base spans they overlap."""
    if not MARK.search(text):
        return []
    spans = Placed(base_spans(text))
    rows = []
    for run in runs(text):
        words, labels, last = [], [], None
        for start, end in run:
            hit = spans.hit(start, end)
            prefix = "I" if hit is not None and hit is last else "B"
            words.append(text[start:end])
            labels.append(0 if hit is None else LABELS.index(f"{prefix}-{KINDS[hit[1]]}"))
            last = hit
        rows.append((words, labels))
    return rows


@dataclass
class Chain:
    """Weights of a trained chain: per feature and label, and per pair of neighbouring labels."""

    names: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def scores(self, word: str) -> np.ndarray:
        known = [self.names[n] for n in features(word) if n in self.names]
        return self.emit[known].sum(axis=0)


def _allowed() -> np.ndarray:
    """0 where a label may follow another, else IMPOSSIBLE: I-k follows B-k or I-k only."""
    move = np.zeros((len(LABELS), len(LABELS)))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            move[:, j] = [0 if a[1:] == b[1:] else IMPOSSIBLE for a in LABELS]
    return move


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(rows: list[tuple[list[str], list[int], float]]) -> Chain:
    """The chain's weights by gradient ascent (Adam) on the penalised log-likelihood of all rows.

    Rows of one length run through forward and backward passes together. A run stands between two outside words.
    """
    seen = [[features(w) for w in words] for words, _, _ in rows]
    names = {n: i for i, n in enumerate(sorted({n for run in seen for f in run for n in f}))}
    allowed, size = _allowed(), len(LABELS)
    groups: dict[int, list[int]] = {}
    for i, (words, _, _) in enumerate(rows):
        groups.setdefault(len(words), []).append(i)
    data = []
    for length, members in sorted(groups.items()):
        x = np.zeros((len(members), length, len(names)), np.float32)
        for a, i in enumerate(members):
            for t, found in enumerate(seen[i]):
                x[a, t, [names[n] for n in found]] = 1
        y = np.array([rows[i][1] for i in members])
        data.append((x, y, np.array([rows[i][2] for i in members])))
    total = sum(w.sum() for _, _, w in data)
    weights = [np.zeros((len(names), size)), np.zeros((size, size))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, ROUNDS + 1):
        emit, move = weights[0], weights[1] + allowed
        grads = [-PENALTY * w for w in weights]
        for x, y, weight in data:
            n, length, _ = x.shape
            e = x @ emit
            ahead = np.empty((n, length, size))
            back = np.empty((n, length, size))
            ahead[:, 0] = e[:, 0] + move[0]
            for t in range(1, length):
                ahead[:, t] = e[:, t] + _logsum(ahead[:, t - 1, :, None] + move, 1)
            back[:, -1] = move[:, 0]
            for t in range(length - 2, -1, -1):
                back[:, t] = _logsum(move + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            norm = _logsum(ahead[:, -1] + move[:, 0], 1)
            share = weight / total
            one = np.eye(size)[y]
            expect = np.exp(ahead + back - norm[:, None, None])
            grads[0] += np.einsum("ntf,ntl->fl", x, (one - expect) * share[:, None, None])
            pair = np.zeros((size, size))
            for t in range(1, length):
                both = np.exp(ahead[:, t - 1, :, None] + move + (e[:, t] + back[:, t])[:, None, :] - norm[:, None, None])
                pair += np.einsum("nab,n->ab", np.einsum("na,nb->nab", one[:, t - 1], one[:, t]) - both, share)
            pair[0] += ((one[:, 0] - expect[:, 0]) * share[:, None]).sum(axis=0)
            pair[:, 0] += ((one[:, -1] - expect[:, -1]) * share[:, None]).sum(axis=0)
            grads[1] += pair
        for k in range(2):
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
            rate = 0.1 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            weights[k] = weights[k] + rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return Chain(names, weights[0], weights[1] + allowed)


def viterbi(chain: Chain, batch: list[list[str]]) -> list[list[int]]:
    """The best labels of every run; all runs of a batch go step by step together, the longest first."""
    size = len(LABELS)
    lengths = np.array([len(r) for r in batch])
    order = np.argsort(-lengths, kind="stable")
    scores: dict[str, np.ndarray] = {}
    for run in batch:
        for word in run:
            if word not in scores:
                scores[word] = chain.scores(word)
    out: list[list[int]] = [[] for _ in batch]
    if not len(batch):
        return out
    best = np.array([scores[batch[i][0]] for i in order]) + chain.move[0]
    from_: list[np.ndarray] = []
    for t in range(1, int(lengths.max())):
        live = int((lengths > t).sum())
        step = best[:live, :, None] + chain.move
        from_.append(step.argmax(axis=1))
        best[:live] = step.max(axis=1) + np.array([scores[batch[i][t]] for i in order[:live]])
    last = (best + chain.move[:, 0]).argmax(axis=1)
    for a, i in enumerate(order):
        path = [int(last[a])]
        for t in range(lengths[i] - 1, 0, -1):
            path.append(int(from_[t - 1][a, path[-1]]))
        out[i] = path[::-1]
    return out


def _plausible(kind: str, text: str) -> bool:
    digits = NOT_DIGIT.sub("", text)
    plain = DEFANGED.sub(lambda m: {"at": "@"}.get(m[1], "."), text)
    if kind == "email":
        local, _, domain = plain.partition("@")
        return bool(local) and "." in domain.strip(".") and "@" not in domain
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", plain)) and _is_ip(plain)
    if kind == "card":
        return _is_card(digits)
    return 10 <= len(digits) <= 15


def _trimmed(kind: str, text: str, start: int, end: int) -> tuple[int, int]:
    """The span without punctuation at its ends."""
    opening = {"phone": "+("}.get(kind, "")
    while start < end and not (text[start].isalnum() or text[start] in opening):
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    return start, end


def added_spans(chain: Chain, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans that the chain finds beside the base ones, never overlapping them."""
    where, batch, placed = [], [], [Placed(b) for b in base]
    for i, text in enumerate(texts):
        if MARK.search(text):
            for run in runs(text):
                # A run that the base spans cover word by word has nothing to add.
                if not all(placed[i].hit(b, e) for b, e in run):
                    where.append((i, run))
                    batch.append([text[b:e] for b, e in run])
    out: list[list[Span]] = [[] for _ in texts]
    for (i, run), labels in zip(where, viterbi(chain, batch)):
        text, at = texts[i], 0
        while at < len(run):
            name = LABELS[labels[at]]
            stop = at + 1
            if name[0] == "B":
                kind = name[2:]
                while stop < len(run) and LABELS[labels[stop]] == f"I-{kind}":
                    stop += 1
                start, end = _trimmed(kind, text, run[at][0], run[stop - 1][1])
                if not placed[i].hit(start, end) and _plausible(kind, text[start:end]):
                    out[i].append((start, KINDS.index(kind), end))
            at = stop
    return out


def trained_chain(texts: DataFrame) -> Chain:
    """A chain for these texts (doc_id, text): HAND_LABELLED and weak labels from a bounded sample of them."""
    total = texts.count()

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in pieces(batches):
            rows = [r for t in found for r in weak_rows(t.decode())]
            keys = [hashlib.md5("\x1f".join(w).encode()).hexdigest() for w, _ in rows]
            yield pa.record_batch(
                {
                    "key": pa.array(keys, pa.string()),
                    "words": pa.array([w for w, _ in rows], pa.list_(pa.string())),
                    "labels": pa.array([y for _, y in rows], pa.list_(pa.int32())),
                }
            )

    weak = []
    if total:
        weak = (
            texts.select("text")
            .sample(min(1.0, TRAIN_DOCUMENTS / total), seed=1)
            .mapInArrow(label, "key string, words array<string>, labels array<int>")
            .where("size(words) <= 12")
            .orderBy("key", "labels")
            .limit(TRAIN_RUNS)
            .collect()
        )
    rows = [(w, y, HAND_WEIGHT) for w, y in _hand_rows()]
    return train(rows + [(list(r.words), list(r.labels), 1.0) for r in weak])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every whole text.

    Base spans are those of the fixed patterns; n_* and base_sha256 are about them alone. spans has them and those
    that a linear-chain CRF over word shapes adds: trained here on HAND_LABELLED and on weak labels from a
    bounded sample, sent to the executors as a small table of weights, decoded by Viterbi in
    batches. An added span passes its kind's check (digits, Luhn, octets, a domain) and overlaps no base span. Offsets
    are code points, ends exclusive.

    Null or empty text: no spans. Null or repeated doc_ids and repeated rows: a row each. Very long
    texts: in full, in time linear in their length. Empty table: no rows. Other columns are ignored.
    """
    texts = texts_of(docs, id_col, text_col)
    shared = texts.sparkSession.sparkContext.broadcast(trained_chain(texts))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch, found in pieces(batches):
            decoded = [t.decode() for t in found]
            base = [base_spans(t) for t in decoded]
            added = added_spans(chain, decoded, base)
            counts = np.zeros((len(base), len(KINDS)), np.int64)
            for i, spans in enumerate(base):
                for _, kind, _ in spans:
                    counts[i, kind] += 1
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    **{f"n_{k}": pa.array(counts[:, j]) for j, k in enumerate(KINDS)},
                    "base_sha256": pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]),
                    "spans": pa.array([joined(b + a) for b, a in zip(base, added)]),
                    "n_added": pa.array([len(a) for a in added], pa.int64()),
                }
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return texts.mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")
