"""Quality: random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import pieces, staged, texts_of
from veilwright.llm.toxicity_gbt import held_out

#: The network is fitted on at most so many labelled documents, those first by a hash of their id.
TRAIN_ROWS = 20_000

#: Words are runs of letters, of digits, of other signs or of line ends; case stays.
WORDS = re.compile(r"[^\W\d_]+|\d+|\n+|[^\w\s]+|_+")
#: A word's vector is kept at its hash modulo this, so the table has one size for any number of words.
PLACES = 1 << 14
DIMENSIONS = 64
#: Entries of a word's index vector that are not zero, half of them 1 and half -1.
ENTRIES = 4
#: Words on either side that a word's vector adds up.
WINDOW = 2
#: Frequent words weigh COMMON / (COMMON + share) in a document's mean.
COMMON = 1e-3
#: Words a worker remembers; forgotten all at once.
KNOWN_WORDS = 200_000
#: Tokens handled at a time.
TOKENS_AT_ONCE = 1 << 17

#: Mean, deviation, mean product of neighbours by dimension, and the logarithm of the number of words.
FEATURES = 3 * DIMENSIONS + 1
HIDDEN = 48
EPOCHS = 20
ROWS_AT_ONCE = 128
RATE = 3e-3
DECAY = 1e-3
SEED = 11


class Places(dict):
    """Word -> place in the table of vectors. A number counts by its length only."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        kept = "0" * len(word) if word[0].isdigit() else word
        place = self[word] = zlib.crc32(kept.encode()) % PLACES
        return place

    def of(self, text: str) -> np.ndarray:
        """Places of the words of a text, in order."""
        found = WORDS.findall(text)
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def index_columns() -> np.ndarray:
    """(PLACES, ENTRIES): where the index vector of a place is 1 (even columns) or -1 (odd ones), from a fixed seed."""
    pick = np.random.default_rng(SEED)
    return np.argsort(pick.random((PLACES, DIMENSIONS)), axis=1)[:, :ENTRIES].astype(np.int64)


class Contexts:
    """Sums of the index vectors of the words around each word."""

    def __init__(self):
        self.columns = index_columns()
        self.sums = np.zeros(PLACES * DIMENSIONS, np.int64)
        self.counts = np.zeros(PLACES, np.int64)

    def add(self, documents: list[np.ndarray]) -> None:
        """The words of documents, apart from each other."""
        apart = np.full(WINDOW, -1, np.int64)
        flat = np.concatenate([x for tokens in documents for x in (tokens, apart)])
        self.counts += np.bincount(flat[flat >= 0], minlength=PLACES)
        for k in range(0, len(flat), TOKENS_AT_ONCE):
            stretch = flat[k : k + TOKENS_AT_ONCE + WINDOW]
            left, right = [], []
            for step in range(1, WINDOW + 1):
                a = stretch[: min(TOKENS_AT_ONCE, len(stretch) - step)]
                b = stretch[step : step + len(a)]
                both = (a >= 0) & (b >= 0)
                left.append(a[both])
                right.append(b[both])
            word, near = np.concatenate(left + right), np.concatenate(right + left)
            keys = word[:, None] * DIMENSIONS + self.columns[near]
            self.sums += np.bincount(keys[:, 0::2].ravel(), minlength=len(self.sums))
            self.sums -= np.bincount(keys[:, 1::2].ravel(), minlength=len(self.sums))


@dataclass
class Vectors:
    """Unit vectors by place and their weights in a mean."""

    unit: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, sums: np.ndarray, counts: np.ndarray) -> Vectors:
        sums = sums.astype(np.float64)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        share = counts / max(1, counts.sum())
        return cls((sums / np.maximum(size, 1.0)).astype(np.float32), COMMON / (COMMON + share))

    def pooled(self, tokens: np.ndarray) -> np.ndarray:
        """The features of one document, in stretches, so memory does not follow its length."""
        out = np.zeros(FEATURES)
        if not len(tokens):
            return out
        d, total = DIMENSIONS, 0.0
        for k in range(0, len(tokens), TOKENS_AT_ONCE):
            stretch = tokens[k : k + TOKENS_AT_ONCE + 1]
            unit = self.unit[stretch]
            here = unit[:TOKENS_AT_ONCE]
            weight = self.weight[stretch[:TOKENS_AT_ONCE]]
            out[:d] += weight @ here
            out[d : 2 * d] += weight @ (here * here)
            out[2 * d : 3 * d] += np.einsum("ij,ij->j", unit[:-1], unit[1:])
            total += weight.sum()
        out[: 2 * d] /= total
        out[d : 2 * d] = np.sqrt(np.maximum(out[d : 2 * d] - out[:d] ** 2, 0.0))
        out[2 * d : 3 * d] /= max(1, len(tokens) - 1)
        out[-1] = np.log1p(len(tokens))
        return out


def learn_vectors(texts: DataFrame) -> Vectors:
    """Word vectors from all words of all texts.

    Each task adds up a table of PLACES x DIMENSIONS numbers; tables are added by place. The sum, of the same size, reaches the driver.
    """
    names = [f"v{i}" for i in range(DIMENSIONS)]

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, contexts = Places(), Contexts()
        for _, found in pieces(batches):
            contexts.add([places.of(t.decode()) for t in found])
        seen = np.flatnonzero(contexts.counts)
        table = contexts.sums.reshape(PLACES, DIMENSIONS)[seen]
        columns = {"place": pa.array(seen.astype(np.int32)), "n": pa.array(contexts.counts[seen])}
        yield pa.record_batch(columns | {name: pa.array(table[:, i]) for i, name in enumerate(names)})

    schema = "place int, n long, " + ", ".join(f"{name} long" for name in names)
    summed = texts.select("text").mapInArrow(add, schema).groupBy("place").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))
    rows = staged(summed, "quality-vectors").toArrow()
    place = rows["place"].to_numpy()
    sums, counts = np.zeros((PLACES, DIMENSIONS), np.int64), np.zeros(PLACES, np.int64)
    counts[place] = rows["n"].to_numpy()
    for i, name in enumerate(names):
        sums[place, i] = rows[name].to_numpy()
    return Vectors.of(sums, counts)


@dataclass
class Network:
    """Standardised features, a layer of HIDDEN tanh units, one output, divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        inner, bias, outer, level = self.layers
        return np.tanh(np.clip((x - self.mean) / self.scale, -5, 5) @ inner + bias) @ outer + level[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.logits(x) / self.temperature)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the logistic loss; the same rows in the same order give the same network."""
    pick = np.random.default_rng(SEED)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -5, 5)
    layers = [
        pick.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), pick.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1),
    ]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(EPOCHS):
        order = pick.permutation(len(z))
        for k in range(0, len(order), ROWS_AT_ONCE):
            rows = order[k : k + ROWS_AT_ONCE]
            hidden = np.tanh(z[rows] @ layers[0] + layers[1])
            slope = (_logistic(hidden @ layers[2] + layers[3][0]) - y[rows]) / len(rows)
            back = np.outer(slope, layers[2]) * (1 - hidden * hidden)
            slopes = [z[rows].T @ back, back.sum(axis=0), hidden.T @ slope, np.array([slope.sum()])]
            step += 1
            for i, g in enumerate(slopes):
                g = g + DECAY * layers[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, layers)


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """A network on four fifths of the rows, its temperature the one that makes the rest likeliest.

    With no rows, or of one kind only, all scores are (1 + ones) / (2 + rows).
    """
    kinds = len(np.unique(y))
    apart = np.arange(len(y)) % 5 == 4
    if kinds < 2 or len(np.unique(y[~apart])) < 2:
        share = (1 + y.sum()) / (2 + len(y))
        zero = [np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), np.array([np.log(share / (1 - share))])]
        return Network(np.zeros(FEATURES), np.ones(FEATURES), zero)
    network = train(x[~apart], y[~apart])
    if apart.any():
        z = network.logits(x[apart]) * (2 * y[apart] - 1)
        network.temperature = float(min(np.geomspace(0.25, 16, 73), key=lambda t: np.logaddexp(0, -z / t).mean()))
    return network


def _training_rows(texts: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, quality) of at most `rows` labelled documents that are not held out, one text an id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality")
    one = one.agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    return one.select("doc_id", "least.text", "quality")


def learn(texts: DataFrame, labels: DataFrame, vectors: Vectors, rows: int = TRAIN_ROWS) -> Network:
    """The network from the training documents' features, which are all that reaches the driver of them."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch, found in pieces(batches):
            pooled = [vectors.pooled(places.of(t.decode())).tobytes() for t in found]
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "pooled": pa.array(pooled, pa.binary())}
            )

    found = _training_rows(texts, labels, rows).mapInArrow(read, "doc_id long, quality int, pooled binary").toArrow()
    x = np.frombuffer(b"".join(found["pooled"].to_pylist())).reshape(-1, FEATURES)
    order = np.argsort(found["doc_id"].to_numpy())
    return fit(x[order], found["quality"].to_numpy()[order].astype(np.float64))


def quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; predicted is 1 from a score of threshold on.

    labels: (doc_id, quality 0/1). Word vectors are sums of index vectors of the words around, over all texts; a document is their
    mean, deviation and the products of neighbours. Documents whose crc32(doc_id as text) mod 5 is 0 are held out of the fit;
    at most `rows` of the others are used, of which a fifth sets the temperature. Model and vectors have a fixed size.

    Null or empty text, or one without words: scored by its zero features. Null doc_id: held out. Repeated doc_ids and rows: a row each,
    one of them (by hash of the text) in the fit; of conflicting labels the larger counts. No labels, or of one kind: one score
    for all. Very long texts: in full. Empty table: no rows. Other columns are ignored.
    """
    texts = texts_of(docs, id_col, text_col)
    vectors = learn_vectors(texts)
    model = texts.sparkSession.sparkContext.broadcast((vectors, learn(texts, labels, vectors, rows)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = model.value
        places = Places()
        for batch, found in pieces(batches):
            x = np.array([vectors.pooled(places.of(t.decode())) for t in found]).reshape(len(found), FEATURES)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(network.score(x), pa.float64())})

    scored = texts.mapInArrow(run, "doc_id long, score double")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)
