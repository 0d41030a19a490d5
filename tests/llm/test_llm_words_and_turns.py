"""Word vectors, spelling variants and conversation tries against brute force, ties, nulls and hot groups included."""

import random
from collections import Counter

import numpy as np
import pytest

import brute
from veilwright.llm import prefix_trie, quality_vectors, spelling_gram

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"


def trie(spark, rows, **options):
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), **options).collect()
    out = {(r.conv_id, r.depth): tuple(r)[2:] for r in found}
    assert len(out) == len(found)
    return out


@pytest.mark.parametrize("shard_turns", [1, 7, 1000])
def test_trie_against_brute_force(spark, shard_turns):
    pick = random.Random(3)
    rows = []
    for conv_id in range(130):
        for turn in range(pick.choice([1, 1, 2, 3, 5, 9])):
            rows.append((conv_id, turn, pick.choice("ua"), "x " * pick.randint(0, 2)))
    rows += [(400, t, "u", "x " * (t % 3)) for t in range(40)]
    rows += [(401, t, "u", "x " * (t % 3)) for t in range(30)] + [(402, t, "u", "x " * (t % 3)) for t in range(35)]
    assert trie(spark, rows, shard_turns=shard_turns) == brute.prefix_trie(rows)


def test_trie_edges(spark):
    pick = random.Random(4)
    rows = [
        (None, 0, "u", "left out"), (0, None, None, None), (0, 1, "u", "hello there"), (0, 1, "u", "hello there"), (0, 2, "a", "y\x00  "),
        (7, 0, "u", ""), (7, 0, None, "tie"), (7, 0, "u", "tie"), (45, 0, "u", "alone"), (46, None, "", "word " * 60_000),
        (2**62, 0, "u", "hello there"), (2**62 + 1, 0, "a:1", "x"), (2**62 + 2, 0, "a", ":1x"),
    ]
    pick.shuffle(rows)
    got = trie(spark, rows, shard_turns=2)
    assert got == brute.prefix_trie(rows)
    wide = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], TURNS + ", path long, key long, depth long")
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in prefix_trie.prefix_trie(wide).collect()} == got
    assert trie(spark, []) == {} and trie(spark, [(None, 1, "u", "x")]) == {}


def test_trie_of_turnless_conversations(spark):
    rows = [(c, 0, "u", "x") for c in range(1, 20)]  # conversation 0 is not there: most have nothing left
    got = trie(spark, rows)
    assert got == brute.prefix_trie(rows) and got[1, 0][1] == 19


def test_trie_with_a_hot_conversation(spark):
    rows = [(c, t, "u", f"same text {t}") for c in range(3000) for t in range(2)] + [(c, 2, "a", str(c)) for c in range(0, 3000, 7)]
    # Many pieces of one digest, in order.
    assert trie(spark, rows, shard_turns=50) == brute.prefix_trie(rows)


def test_parentheses():
    pick = random.Random(1)
    for blocks in (4, 128):
        old, prefix_trie.BLOCK = prefix_trie.BLOCK, blocks
        try:
            for _ in range(50):
                opens, depth = [True], 1
                while depth:
                    up = pick.random() < (0.52 if len(opens) < 2000 else 0.1)
                    opens.append(up)
                    depth += 1 if up else -1
                tree = prefix_trie.Parentheses(np.array(opens))
                stack, close = [], {}
                for i, up in enumerate(opens):
                    if up:
                        stack.append(i)
                    else:
                        close[stack.pop()] = i
                at = np.flatnonzero(tree.opens)
                found = tree.findclose(at)
                assert found.tolist() == [close[i] for i in at]
                leaves = [sum(opens[k] and not opens[k + 1] for k in range(i, close[i])) for i in at[:20]]
                assert tree.leaves(at, found)[:20].tolist() == leaves
        finally:
            prefix_trie.BLOCK = old


def spelled(spark, docs, **options):
    found = spelling_gram.spelling_variants(spark.createDataFrame(docs, DOCS), **options).collect()
    out = {r.word: tuple(r)[1:] for r in found}
    assert len(out) == len(found)
    return out


@pytest.mark.parametrize("chunk", [2048, 5])
def test_spelling_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(spelling_gram, "CHUNK", chunk)
    pick = random.Random(8)
    vocabulary = ["".join(pick.choice("abé") for _ in range(pick.randint(5, 8))) for _ in range(250)]
    weights = [1 / (1 + i) for i in range(250)]
    docs = [(i, " ".join(pick.choices(vocabulary, weights, k=200))) for i in range(60)]
    docs.append((60, "kkkkkk " * 900 + "kkkkkn " * 110 + "kkkknn " * 16))
    got = spelled(spark, docs)
    assert got == brute.spelling(docs)
    assert got["kkkknn"][:2] == ("kkkkkn", "kkkkkk")


def test_spelling_edges(spark):
    long_run = "q" * 120_000
    docs = [
        (None, "Banana BANANA banana\tbanana-banana bananas"), (None, None), (1, ""), (2, "bananas " * 40 + "bandanas " * 8 + "ÀÉÎõü÷ " * 5),
        (2, "bananas " * 40 + "bandanas " * 8 + "ÀÉÎõü÷ " * 5), (3, f"{long_run} " * 3), (4, f"{long_run} {long_run}r " * 6), (5, "漢字 " * 9 + "x1banana2x"),
        (6, "tietia tietib tietic " * 2), (7, "tietia tietib tietic " * 6), (8, "abcdef abcdfe abcdeg " * 9), (9, "abcdeg " * 200),
    ]
    got = spelled(spark, docs)
    assert got == brute.spelling(docs)
    assert spelled(spark, []) == {} and spelled(spark, [(1, "few words here")]) == {}
    clash = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], DOCS + ", word int, n int, pair int")
    assert {r.word: tuple(r)[1:] for r in spelling_gram.spelling_variants(clash).collect()} == got


def test_spelling_near_in_all_ways():
    words = ["abcdef", "abcdeg", "abcdfe", "fedcba", "bacdef", "bbcdef"]
    longer = ["xabcdef", "abcxdef", "abcdefx", "abcdegh", "aabcdef", "badcfeg"]
    i, j = spelling_gram.near_in(words, longer)
    got = {(words[a], longer[b]) for a, b in zip(i, j)}
    assert got == {(a, b) for a in words for b in longer if any(b[:k] + b[k + 1 :] == a for k in range(7))}
    i, j = spelling_gram.near_in(words, None)
    assert {(words[a], words[b]) for a, b in zip(i, j)} == {("abcdef", "abcdeg"), ("abcdef", "bbcdef"), ("bacdef", "bbcdef")}


def test_word_vectors_against_brute_force(monkeypatch):
    monkeypatch.setattr(quality_vectors, "TOKENS_AT_ONCE", 5)
    pick = random.Random(2)
    texts = [" ".join(pick.choices(["a", "bc", "12", "!!", "\n", "é_x"], k=pick.randint(0, 40))) for _ in range(30)]
    places, contexts = quality_vectors.Places(), quality_vectors.Contexts()
    tokens = [places.of(t) for t in texts]
    contexts.add(tokens[:10])
    contexts.add(tokens[10:])
    columns = quality_vectors.index_columns()
    sums = np.zeros((quality_vectors.PLACES, quality_vectors.DIMENSIONS), np.int64)
    for t in tokens:
        for i, x in enumerate(t):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(t):
                    for k, c in enumerate(columns[t[j]]):
                        sums[x, c] += -1 if k % 2 else 1
    assert (contexts.sums.reshape(sums.shape) == sums).all()
    assert contexts.counts.sum() == sum(map(len, tokens)) and Counter(np.concatenate(tokens).tolist())[places["a"]] == contexts.counts[places["a"]]

    vectors = quality_vectors.Vectors.of(sums, contexts.counts)
    t = tokens[int(np.argmax([len(t) for t in tokens]))]
    in_stretches = vectors.pooled(t)
    monkeypatch.setattr(quality_vectors, "TOKENS_AT_ONCE", 1000)
    assert np.allclose(in_stretches, vectors.pooled(t), atol=1e-5)
    unit, weight = vectors.unit[t].astype(float), vectors.weight[t]
    mean = weight @ unit / weight.sum()
    d = quality_vectors.DIMENSIONS
    assert np.allclose(vectors.pooled(t)[:d], mean, atol=1e-5)
    assert np.allclose(vectors.pooled(t)[2 * d : 3 * d], (unit[:-1] * unit[1:]).mean(axis=0), atol=1e-5)


def test_network_is_calibrated():
    pick = np.random.default_rng(5)
    x = pick.normal(size=(4000, quality_vectors.FEATURES))
    chance = 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1]))
    y = (pick.random(4000) < chance).astype(float)
    network = quality_vectors.fit(x[:3000], y[:3000])
    score, truth = network.score(x[3000:]), y[3000:]
    assert network.temperature > 1  # a network this large is too sure of itself
    assert ((score > 0.5) == truth).mean() > 0.7
    for low in np.arange(0, 1, 0.25):
        here = (score >= low) & (score < low + 0.25)
        assert abs(score[here].mean() - truth[here].mean()) < 0.12


def test_quality_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)] + [(None, None)], DOCS)
    ones = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    none = ones.where("doc_id < 0")
    assert {r.score for r in quality_vectors.quality(docs, none).collect()} == {0.5}
    (score,) = {round(r.score, 9) for r in quality_vectors.quality(docs, ones).collect()}
    assert 0.9 < score < 1
