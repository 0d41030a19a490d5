"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import pieces, staged, texts_of

#: The classifier is fitted on at most so many labelled documents, those first by a hash of their id.
TRAIN_ROWS = 20_000

#: Insults as whole words, the fixed part of the lexicon.
INSULTS = (
    "arsehole asshole bastard bitch clown coward creep cretin cunt degenerate despicable dickhead dimwit disgusting "
    "dumbass filth fool freak garbage idiot idiotic imbecile jerk liar loser lowlife maggot moron moronic parasite "
    "pathetic pig prick repulsive scum scumbag stupid subhuman trash twat ugly vermin vile worthless wretch "
    "abschaum arschloch depp dummkopf dreckskerl hure idiotin missgeburt scheusal trottel vollidiot wichser "
    "abruti bouffon connard conne crétin débile enculé imbécile ordure pourriture raclure salaud salope "
    "basura cabrón escoria estúpido gilipollas idiota imbécil inútil mierda payaso perdedor"
).split()
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta vous votre usted ustedes "
    "vosotros ti tus"
).split()
#: Characters between a hit and a second-person word that count as near.
NEAR = 40

#: Learned entries: beginnings of words of these lengths, or whole words, that toxic training documents have more often.
PREFIXES = range(3, 9)
MOST_ENTRIES = 2_000
LEAST_DOCUMENTS = 3
LEAST_GAIN = 15.0
LEAST_ODDS = 1.5

LEET = str.maketrans("013457@$!|", "oieastasii")
INSIDE = re.compile(r"[^\W\d_][0-9@$*!|]+[^\W\d_]")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .*_-][^\W\d_]){2,}(?![^\W_])")
RUNS = re.compile(r"[!?]{2,}")
LETTERS = re.compile(r"[^\W\d_]+")
APART = str.maketrans({c: " " for c in "\t\n\r\x0b\x0c!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"})

FEATURES = (
    "insult_density insult_kinds learned_density learned_count learned_top learned_kinds near_second second_density "
    "capitals shouted exclamation question runs symbols inside_density spaced_density hidden_density log_words"
).split()


def _plain(text: str) -> str:
    """Lower case, white space and ASCII punctuation as single places, a space at either end."""
    return f" {text.lower().translate(APART)} "


def entries_of(text: str) -> set[str]:
    """Whole words (with spaces around) and beginnings of words (with a space before) of a text."""
    out = set()
    for word in set(_plain(text).split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in PREFIXES if len(word) >= k)
    return out


@dataclass
class Lexicon:
    """Learned entries with the numbers of toxic and other training documents that have them."""

    counts: dict[str, tuple[int, int]] = field(default_factory=dict)
    toxic: int = 0
    other: int = 0

    def weight(self, entry: str, label: int | None = None) -> float:
        """Log odds of an entry, 0 if too weak; with a label, as if that one document had not been seen."""
        a, b = self.counts[entry]
        n, m = self.toxic, self.other
        if label is not None:
            a, n, b, m = (a - 1, n - 1, b, m) if label else (a, n, b - 1, m - 1)
        return _weight(a, n, b, m)


def _weight(a: int, n: int, b: int, m: int) -> float:
    """Smoothed log odds of a document share a of n against b of m, or 0 if these don't differ enough."""
    if a < LEAST_DOCUMENTS or not n or not m:
        return 0.0
    odds = math.log((a + 0.5) / (n - a + 0.5)) - math.log((b + 0.5) / (m - b + 0.5))
    if odds < LEAST_ODDS:
        return 0.0
    gain = sum(
        x * math.log(x * (n + m) / (rows * hits))
        for x, rows, hits in ((a, n, a + b), (n - a, n, n + m - a - b), (b, m, a + b), (m - b, m, n + m - a - b))
        if x
    )
    return odds if 2 * gain >= LEAST_GAIN else 0.0


class Reader:
    """Dense features of texts; one automaton finds all lexicon entries."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        tags: dict[str, list[tuple[str, str]]] = {}
        for word in INSULTS:
            tags.setdefault(f" {word}", []).append(("insult", word))
        for word in SECOND_PERSON:
            tags.setdefault(f" {word} ", []).append(("second", word))
        for entry in lexicon.counts:
            tags.setdefault(entry, []).append(("learned", entry))
        self.automaton = ahocorasick.Automaton()
        for entry, found in tags.items():
            self.automaton.add_word(entry, (len(entry), found))
        self.automaton.make_automaton()
        self.insults = ahocorasick.Automaton()
        for word in INSULTS:
            self.insults.add_word(f" {word} ", word)
        self.insults.make_automaton()

    def features(self, text: str, label: int | None = None) -> list[float]:
        plain = _plain(text)
        words = len(plain.split())
        n = max(1, words)
        insults, learned, seconds = [], {}, []
        for end, (size, found) in self.automaton.iter(plain):
            start = end - size + 1
            for kind, name in found:
                if kind == "second":
                    seconds.append(start)
                elif kind == "insult":
                    if not plain[end + 1].isalnum():
                        insults.append((start, name))
                elif weight := self.lexicon.weight(name, label):
                    if weight > learned.get(start, (0.0, ""))[0]:
                        learned[start] = (weight, name)
        hits = sorted([s for s, _ in insults] + list(learned))
        near = 0
        if hits and seconds:
            at = np.searchsorted(np.array(seconds), hits)
            padded = np.r_[-(10**9), seconds, 10**9]
            near = int((np.minimum(hits - padded[at], padded[at + 1] - hits) <= NEAR).sum())
        inside = INSIDE.findall(text)
        spaced = SPACED.findall(text)
        hidden = 0
        if inside or spaced:
            bare = f" {INSIDE.sub(lambda m: m.group().translate(LEET), text.lower())} {' '.join(re.sub(r'[ .*_-]', '', s.lower()) for s in spaced)} "
            hidden = max(0, sum(1 for _ in self.insults.iter(_plain(bare))) - len(insults))
        letters = max(1, sum(map(len, LETTERS.findall(text))))
        upper = len(re.findall(r"[A-Z]", text))
        weights = [w for w, _ in learned.values()]
        return [
            len(insults) / n,
            len({w for _, w in insults}),
            sum(weights) / n,
            math.log1p(len(weights)),
            max(weights, default=0.0),
            len({e for _, e in learned.values()}),
            near / n,
            len(seconds) / n,
            upper / letters,
            len(re.findall(r"\b[A-Z]{3,}\b", text)) / n,
            text.count("!") / n,
            text.count("?") / n,
            len(RUNS.findall(text)) / n,
            sum(map(text.count, "#$%&*|<>")) / n,
            len(inside) / n,
            len(spaced) / n,
            hidden / n,
            math.log1p(words),
        ]


@dataclass
class Boosted:
    """Regression trees of one depth on binned features, summed to log odds, and an isotonic curve."""

    edges: list[np.ndarray]
    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, total = self.bins(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(len(leaf).bit_length() - 1):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a thousandth of the uncalibrated one keeps the order within a step."""
        raw = 1 / (1 + np.exp(-self.raw(x)))
        if self.curve is None:
            return raw
        return 0.999 * np.interp(raw, *self.curve) + 0.001 * raw


def boost(
    x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, shrink: float = 1.0, most_bins: int = 32
) -> Boosted:
    """Newton boosting of the logistic loss on histograms of at most most_bins values a feature."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, most_bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    share = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    model = Boosted(edges, float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    binned, width = model.bins(x), most_bins + 1
    total, rows = np.full(len(y), model.start), np.arange(len(y))
    inner = (1 << depth) - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, width, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            best = np.full(nodes, 1e-6)
            for j in range(x.shape[1]):
                place = (node - first) * width + binned[:, j]
                gs = np.bincount(place, g, nodes * width).reshape(nodes, width).cumsum(axis=1)
                hs = np.bincount(place, h, nodes * width).reshape(nodes, width).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + shrink) + (ga - gs) ** 2 / (ha - hs + shrink) - ga**2 / (ha + shrink)
                gain[(hs < 1) | (ha - hs < 1)] = 0
                k = gain.argmax(axis=1)
                value = gain[np.arange(nodes), k]
                better = value > best
                best[better] = value[better]
                feature[first : first + nodes][better] = j
                cut[first : first + nodes][better] = k[better]
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        place = node - inner
        leaf = rate * np.bincount(place, g, inner + 1) / (np.bincount(place, h, inner + 1) + shrink)
        total += leaf[place]
        model.trees.append((feature, cut, leaf))
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising curve nearest to y over score (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of scores
    for s, v in zip(score[order], y[order]):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def fit(x: np.ndarray, y: np.ndarray, folds: int = 5) -> Boosted:
    """Trees on all rows, calibrated on scores of rows that other folds' trees have not seen."""
    model = boost(x, y)
    if len(y) >= 10 * folds and 0 < y.sum() < len(y):
        fold, unseen = np.arange(len(y)) % folds, np.zeros(len(y))
        for k in range(folds):
            part = boost(x[fold != k], y[fold != k])
            unseen[fold == k] = 1 / (1 + np.exp(-part.raw(x[fold == k])))
        model.curve = isotonic(unseen, y)
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5 (a null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _training_texts(texts: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, toxic) of at most `rows` labelled documents that are not held out, one text an id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic")
    one = one.agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    return staged(one.select("doc_id", "least.text", "toxic"), "toxic-training")


def learn_lexicon(training: DataFrame) -> Lexicon:
    """Entries that toxic training documents have more often: each is counted and weighed in Spark, and those that pass
    the test, the MOST_ENTRIES with the largest weights times documents, reach the driver."""
    sizes = {r.toxic: r.n for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    lexicon = Lexicon(toxic=sizes.get(1, 0), other=sizes.get(0, 0))
    if not lexicon.toxic or not lexicon.other:
        return lexicon
    toxic, other = lexicon.toxic, lexicon.other

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch, found in pieces(batches):
            for text, label in zip(found, batch.column("toxic").to_pylist()):
                if label in (0, 1):
                    seen[label].update(entries_of(text.decode()))
        for label in (0, 1):
            n = pa.array(seen[label].values(), pa.int64())
            none = pa.array(np.zeros(len(n), np.int64))
            yield pa.record_batch({"entry": pa.array(seen[label], pa.string()), "a": n if label else none, "b": none if label else n})

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            weights = [_weight(x, toxic, y, other) for x, y in zip(a, b)]
            yield batch.append_column("weight", pa.array(weights, pa.float64())).filter(pa.array([w > 0 for w in weights], pa.bool_()))

    counted = training.select("text", "toxic").mapInArrow(count, "entry string, a long, b long")
    counted = counted.groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= LEAST_DOCUMENTS)
    weighed = counted.mapInArrow(weigh, "entry string, a long, b long, weight double")
    best = weighed.orderBy(F.desc(F.col("weight") * F.col("a")), "entry").limit(MOST_ENTRIES).collect()
    lexicon.counts = {r.entry: (r.a, r.b) for r in best}
    return lexicon


def trained(texts: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Lexicon, Boosted]:
    """Lexicon and trees from the training documents; only their dense features reach the driver.

    A training document's learned features leave out what it has itself added to the lexicon.
    """
    training = _training_texts(texts, labels, rows)
    lexicon = learn_lexicon(training)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch, found in pieces(batches):
            toxic = batch.column("toxic").to_pylist()
            dense = [reader.features(t.decode(), y) for t, y in zip(found, toxic)]
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "dense": pa.array(dense, pa.list_(pa.float64()))}
            )

    dense = training.mapInArrow(read, "doc_id long, toxic int, dense array<double>").collect()
    dense.sort(key=lambda r: (r.doc_id, r.toxic, r.dense))
    x = np.array([r.dense for r in dense]).reshape(len(dense), len(FEATURES))
    return lexicon, fit(x, np.array([float(r.toxic) for r in dense]))


def toxicity(
    docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    labels: (doc_id, toxic 0/1). Documents whose crc32(doc_id as text) mod 5 is 0 are held out of
    training; at most `rows` of the others are used. The score comes from the text alone: densities of fixed and learned
    lexicon entries, second-person words near them, capitals, punctuation and obfuscation rates, through boosted
    trees and an isotonic curve. Model and lexicon are small tables of bounded size.

    Null or empty text: scored by its (zero) features. Null doc_id: held out. Repeated doc_ids and rows: a row each; of
    conflicting labels the larger counts. No labels, or of one kind only: the score is their share. Very long
    texts: in full. Empty table: no rows. Other columns are ignored.
    """
    texts = texts_of(docs, id_col, text_col)
    model = texts.sparkSession.sparkContext.broadcast(trained(texts, labels, rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, boosted = model.value
        reader = Reader(lexicon)
        for batch, found in pieces(batches):
            dense = np.array([reader.features(t.decode()) for t in found]).reshape(len(found), len(FEATURES))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(boosted.score(dense), pa.float64())})

    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
