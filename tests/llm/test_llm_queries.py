"""Registered corpus queries against SQL, libraries and brute force on the smallest tables."""

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest

import brute
import corpus_pipeline
from compare import connect, difference
from veilwright.llm import edit_embedding, pii_crf
from veilwright.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def documents(con):
    return con.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()


def rows(spark, name, sf_dir=SF_DIR):
    found = QUERIES[name](spark, sf_dir).collect()
    out = {r.doc_id: r for r in found}
    assert len(out) == len(found)
    return out


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) is None


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_personal_data(spark, documents):
    got = rows(spark, "op1_pii_crf")
    for doc_id, text, _ in documents:
        spans = brute.base_spans(text)
        row, joined = got[doc_id], pii_crf.joined(spans)
        counts = [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(filter(None, row.spans.split(",")))


def test_quality(spark, documents):
    got = rows(spark, "op2_quality_rules")
    for doc_id, text, _ in documents:
        r = got[doc_id]
        assert brute.repetition(text) == (
            r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_chars, r.longest_repeat,
        )
        assert r.kept == brute.passes(text)


def test_edit_embedding(spark, documents):
    got = rows(spark, "op3_edit_embedding")
    texts = [t for _, t, _ in documents]
    own = edit_embedding.walk([edit_embedding.codes(t) for t in texts])
    for i, (doc_id, text, _) in enumerate(documents):
        after = texts[(i + 1) % len(texts)]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == edit_embedding.written(*own[i])
        assert r.edited_fingerprint == edit_embedding.written(*edit_embedding.walk([edit_embedding.codes(edited)])[0])
        assert r.near_next == pytest.approx(edit_embedding.likeness(own[i], own[(i + 1) % len(texts)]))
        assert 0 <= r.near_next <= 1 and 0.5 < r.near_edited <= 1
    wide = [r.near_edited > r.near_next for r in got.values()]
    assert np.mean(wide) > 0.97


def test_toxicity(spark, con):
    got = rows(spark, "op5_toxicity", "/root/testdata/sf0.1")
    toxic = dict(connect("/root/testdata/sf0.1").execute("SELECT doc_id, toxic FROM labels").fetchall())
    held = [i for i in got if got[i].held_out]
    assert set(held) == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    seen = [(got[i].score, got[i].predicted, toxic[i]) for i in held if i in toxic]
    yes = np.array([s for s, _, t in seen if t])
    no = np.array([s for s, _, t in seen if not t])
    assert np.mean(yes[:, None] > no[None, :]) > 0.98
    assert np.mean([p == t for _, p, t in seen]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_quality_vectors(spark):
    got = rows(spark, "op11_quality_vectors", "/root/testdata/sf0.1")
    good = dict(connect("/root/testdata/sf0.1").execute("SELECT doc_id, quality FROM labels").fetchall())
    held = [i for i in got if got[i].held_out]
    assert set(held) == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    seen = [(got[i].score, got[i].predicted, good[i]) for i in held if i in good]
    yes = np.array([s for s, _, q in seen if q])
    no = np.array([s for s, _, q in seen if not q])
    assert np.mean(yes[:, None] > no[None, :]) > 0.99
    assert np.mean(yes >= 0.3) > 0.99 and np.mean(no < 0.3) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_token_counts(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(spark, "op6_token_counts")
    for doc_id, text, _ in documents:
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert tuple(got[doc_id]) == (doc_id, len(text.encode()), n, n > 1024)


def test_sentencepiece(spark, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = rows(spark, "op9_sentencepiece")
    for doc_id, text, _ in documents:
        assert got[doc_id].ids == library.encode(text) and got[doc_id].n_tokens == len(got[doc_id].ids)
        assert got[doc_id].round_trip


def test_simhash(spark, documents):
    got = rows(spark, "op10_simhash_dedup")
    prints = {i: brute.simhash(t) for i, t, _ in documents}
    roots = brute.hamming_components(prints.values())
    least = {}
    for i in sorted(prints):
        least.setdefault(roots[prints[i]], i)
    for i, p in prints.items():
        assert (got[i].fingerprint, got[i].component_id) == (f"{p:016x}", least[roots[p]])


def test_pipeline(spark, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = [(i, t, s) for i, t, s in documents if brute.passes(t)]
    lines = brute.dedup_lines([(i, t) for i, t, _ in docs])
    docs = [(i, lines[i][0], s) for i, t, s in docs if lines[i][1] > lines[i][2] or not lines[i][1]]
    prints = {i: brute.simhash(t) for i, t, _ in docs}
    roots, first = brute.hamming_components(prints.values()), {}
    for i in sorted(prints):
        first.setdefault(roots[prints[i]], i)
    docs = [(i, t, s) for i, t, s in docs if i in first.values()]
    texts = {i: t for i, t, _ in docs}
    expected = sorted((i, library.encode(texts[i])) for i, _, copies in brute.mix([(i, s, t) for i, t, s in docs]) for _ in range(copies))
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == expected
