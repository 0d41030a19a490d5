"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import brute
import corpus_pipeline
from veilwright.llm import (
    edit_embedding,
    line_dedup,
    pii_crf,
    quality_suffix,
    quality_vectors,
    sentencepiece_codec,
    simhash_dedup,
    source_mix,
    token_counts,
    toxicity_gbt,
    url_filter,
)

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: Names that the operators use inside, beside the documents' own.
CLASHING = (
    "key fp node root side spent depth value text_key h1 h2 words line_no no_id id first near size copies class n "
    "odds p band edge part position _place kept lines left old __key __kept __no_id __id __text_key __copies __row_key "
    "least component_id fingerprint spans score held_out n_tokens ids host path block bits mask is_rule verdict rule a.b"
).split()


def prose(n, seed):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 7))) for _ in range(n))


LONG = prose(30_000, 1)
BASE = [
    (1, prose(80, 2), "en", "a", 0),
    (2, prose(80, 3) + "\n" + prose(60, 4), "en", "a", None),
    (2, prose(80, 3) + "\n" + prose(60, 4), "en", "a", None),
    (2, prose(90, 5), None, None, None),
    (None, prose(70, 6), "de", "b", 5),
    (None, prose(70, 6), "de", "b", 5),
    (None, None, None, None, None),
    (7, None, "en", "c", 0),
    (8, "", "en", "c", 0),
    (9, " \n\t\n ", "en", "", 5),
    (10, LONG, "en", "b", 1),
    (11, LONG, "en", "c", 1),
    (12, "x" * 200_000, "en", "b", 1),
    (13, "Ünïcode ✓ 😀 \u2028 \x00 \x1f <|endoftext|> ▁ write to a@b.co 10.0.0.1", "en", "b", 1),
    (14, "one", "en", "d", 1),
]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(spark, rows=BASE):
    return spark.createDataFrame(rows, DOCUMENTS)


def clashing(spark, rows=BASE):
    schema = T._parse_datatype_string(DOCUMENTS)
    for name in CLASHING:
        schema = schema.add(name, T.IntegerType())
    return spark.createDataFrame([(*r, *range(len(CLASHING))) for r in rows], schema)


def labels(spark, rows=((1, 1, 1), (1, 0, 0), (2, 1, 0), (None, 1, 1), (14, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "pii": lambda s, d: pii_crf.find_pii(d),
    "quality": lambda s, d: quality_suffix.quality_rules(d),
    "embedding": lambda s, d: edit_embedding.edited_neighbours(d),
    "lines": lambda s, d: line_dedup.line_dedup(d, counts=("c1", "c2")).select("doc_id", "text", "c1", "c2"),
    "toxicity": lambda s, d: toxicity_gbt.toxicity(d, labels(s)),
    "tokens": lambda s, d: token_counts.token_counts(d, BPE),
    "mix": lambda s, d: source_mix.source_mix(d),
    "pieces": lambda s, d: sentencepiece_codec.encode(d, PIECES),
    "simhash": lambda s, d: simhash_dedup.simhash_components(d),
    "vectors": lambda s, d: quality_vectors.quality(d, labels(s)),
}


def bag(df):
    return Counter(map(repr, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_and_other_columns(spark, name):
    run = OPERATORS[name]
    found = run(spark, plain(spark)).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in BASE)
    assert bag(run(spark, clashing(spark))) == Counter(map(repr, found))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, plain(spark, [])).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, name, stage):
    for make in (plain, clashing):
        docs = make(spark)
        out = stage(spark, docs, "unused")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        rows = out.collect()
        assert stage(spark, make(spark, []), "unused").collect() == []
        if make is plain:
            bare = Counter(map(repr, rows))
    assert sum(bare.values()) == len(rows)


def test_personal_data_values(spark):
    rows = {(r.doc_id, r.spans): r for r in OPERATORS["pii"](spark, plain(spark)).collect()}
    text = BASE[13][1]
    at, ip = text.index("a@b"), text.index("10.0")
    assert (13, f"email:{at}:{at + 6},ip:{ip}:{ip + 8}") in rows
    assert (8, "") in rows and (None, "") in rows


def test_added_spans(spark):
    text = "Please ring +1 (269) 555-3296 4532015112830366 or mail info@münchen.example, version 2.0. of 2004"
    (row,) = pii_crf.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    found = [(s.split(":")[0], text[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in row.spans.split(",")]
    assert found == [("phone", "+1 (269) 555-3296"), ("card", "4532015112830366"), ("email", "info@münchen.example")]
    assert row.n_added == 3 and row.n_phone + row.n_card + row.n_email == 0


def test_quality_values(spark):
    rows = OPERATORS["quality"](spark, plain(spark)).collect()
    by = {r.doc_id: r for r in rows}
    assert (by[8].n_words, by[8].base_failed, by[8].kept) == (0, True, False)
    assert by[10].n_words == 30_000 and by[10].kept
    assert by[12].word_chars == 200_000


def test_quality_filter_keeps_columns(spark):
    out = quality_suffix.quality_filter(clashing(spark))
    assert out.columns == clashing(spark).columns
    kept = Counter(r.doc_id for r in out.collect())
    assert kept == Counter(r[0] for r in BASE if brute.passes(r[1] or ""))


def test_line_dedup_values(spark):
    same = "this line is in several documents at once"
    rows = [
        (3, f"{same}\n\nown words of number three here\nthis line is in several documents at  once "),
        (1, f"{same}\r\nkept"),
        (2, "this line is in many documents at once\nthis line is in several documents at once today\na b c d\na b c e"),
        (None, "nothing else has no number\nkept"),
        (4, "this line was in many documents at once\ntwo edits away here from all the others"),
        (4, "two edits away here from all the others\nanother text"),
        (5, None),
    ]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), counts=("n", "gone"))
    got = {(r.doc_id, r.text, r.n, r.gone) for r in out.collect()}
    assert {g for g in got if g[0] != 4} == {
        (None, "nothing else has no number", 2, 1),
        (1, f"{same}\r\nkept", 2, 0),
        (2, "a b c d\na b c e", 4, 2),
        (3, "\nown words of number three here", 3, 2),
        (5, None, 0, 0),
    }
    # Equal ids: one of the two texts has the shared line, in the order of a hash of the text. The other one's first line is
    # one edit from a line of document 2 that was taken out itself.
    fours = sorted((g for g in got if g[0] == 4), key=lambda g: g[1])
    assert [g[2] for g in fours] == [2, 2] and sum(g[3] for g in fours) == 2


def test_line_dedup_against_brute_force(spark):
    pick = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "eps"]
    docs = []
    for doc_id in range(40):
        lines = [" ".join(pick.choice(vocabulary) for _ in range(pick.randint(1, 8))) for _ in range(pick.randint(1, 6))]
        docs.append((doc_id, "\n".join(lines)))
    out = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), counts=("n", "gone")).collect()
    assert {r.doc_id: (r.text, r.n, r.gone) for r in out} == brute.dedup_lines(docs)


def test_line_dedup_character_edits(spark):
    rows = [
        (1, "Der eingeä erer.\nAre is anwh reenen.\n漢字仮名交じり文の長い一行です\nthe rapist came home again today\nabcd\nan 😀 x of here"),
        (2, "Der, eingeä erer.\nAre, is anwh  reenen.\n漢字仮名交り文の長い一行です\ntherapist came home again today\nabce\nan 😀 xyof here"),
        (3, "Der, eingeä, erer.\nthe rapist came ho me again today\nthe rapist,came home again today\n漢字だけの別の行です"),
        (4, "therapist came homeagain to day\nAre is anwh renen!"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.gone) for r in line_dedup.line_dedup(docs, counts=("n", "gone"), char_edits=True).collect()}
    assert got == {
        1: (rows[0][1], 0),
        2: ("abce", 5),
        3: ("漢字だけの別の行です", 3),
        4: (rows[3][1], 0),
    }
    stage = dict(corpus_pipeline.STAGES)["line_dedup"](spark, plain(spark, [(i, t, "en", "a", 0) for i, t in rows]), "unused")
    assert {r.doc_id: r.text for r in stage.collect()} == {i: t for i, (t, _) in got.items()}


def test_line_dedup_characters_against_brute_force(spark):
    pick = random.Random(6)

    def near(a, b):
        """One character edit, or one word edit as without characters."""
        x, y = " ".join(a), " ".join(b)
        chars = min(len(x), len(y)) >= 5 and abs(len(x) - len(y)) <= 1 and brute.one_edit(list(x), list(y))
        return chars or (min(len(a), len(b)) >= 5 and abs(len(a) - len(b)) <= 1 and brute.one_edit(a, b))

    docs, seen, expected = [], [], {}
    for doc_id in range(60):
        lines = ["".join(pick.choice("ab  ") for _ in range(pick.randint(1, 18))).strip() or "a" for _ in range(6)]
        docs.append((doc_id, "\n".join(lines)))
        kept = []
        for line in lines:
            w = brute.words(line)
            if not any(w == s or near(w, s) for s in seen):
                kept.append(line)
            if w not in seen:
                seen.append(w)
        expected[doc_id] = "\n".join(kept)
    out = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), char_edits=True).collect()
    assert {r.doc_id: r.text for r in out} == expected


def test_line_dedup_hot_line_and_template(spark):
    rows = [(i, f"the very same line in every document\nitem number {i} of the long list here") for i in range(3000)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), counts=("n", "gone"))
    assert out.where("gone = 2").count() == 2999 and out.where("gone = 0").count() == 1
    assert line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), drop_emptied=True).count() == 1


def test_mix_values(spark):
    rows = OPERATORS["mix"](spark, plain(spark)).collect()
    sizes = Counter()
    for r in BASE:
        sizes[r[3]] += len(brute.words(r[1]))
    targets = brute.fill(sizes)
    found = {(r.source_size, round(r.target, 6)) for r in rows}
    assert found == {(sizes[s], round(t, 6)) for s, t in targets.items()}
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    assert bag(OPERATORS["mix"](spark, plain(spark))) == Counter(map(repr, rows))


def test_mix_is_near_its_targets(spark):
    pick = random.Random(3)
    rows = [(i, " ".join(["w"] * pick.randint(1, 60)), "hot" if i % 3 else f"s{i % 7}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mix.source_mix(docs).toPandas()
    for _, part in got.groupby(["source_size", "target"]):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 30
    copies = source_mix.mixed_documents(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies} == {
        int(i): int(t // s) for i, t, s in zip(got.doc_id, got.taken, got["size"]) if t
    }


def test_mix_tells_rows_apart_whose_parts_join_alike(spark):
    rows = [(None, "b|c d e", "a"), (None, "c d e", "a|b"), (None, "3:a|b c d e", "s"), (1, "b c d", "a"), (None, None, None), (None, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mix.source_mix(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    expected = brute.mix([(i, s, t) for i, t, s in rows])
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == sorted((str(i), n, int(n * k)) for i, n, k in expected)
    copies = source_mix.mixed_documents(docs).groupBy("text", "source").count().collect()
    assert all(r["count"] <= 2 for r in copies)


def test_mix_decides_equal_rows_singly(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "hot") for i in range(400)] + [(7, "all the same words", "hot")] * 600
    rows += [(i, "two words", "low") for i in range(40)] + [(5, "", "hot")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = source_mix.source_mix(docs).collect()
    expected = brute.mix([(i, s, t) for i, t, s in rows])
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((i, n, n * c) for i, n, c in expected)
    assert len({r.taken for r in got if r.doc_id == 7 and r.size == 4}) == 2
    copies = source_mix.mixed_documents(docs).groupBy("doc_id", "text").count().collect()
    wanted = Counter()
    for (i, n, c), (_, t, _) in zip(sorted(expected), sorted(rows, key=lambda r: (r[0], len(r[1].split())))):
        wanted[i, t] += c
    assert {(r.doc_id, r.text): r["count"] for r in copies} == {k: c for k, c in wanted.items() if c}


def test_mix_sorts_no_source_that_is_taken_whole(spark):
    docs = spark.createDataFrame([(i, "some words", f"s{i % 3}") for i in range(90)], "doc_id long, text string, source string")
    keyed = docs.select("source", source_mix.words(F.col("text")).alias("size"), F.md5(F.col("doc_id").cast("string")).alias("row_key"))
    got = source_mix._units(keyed, (1,), 2.0, 2.0).collect()
    assert len(got) == 90 and {(r.copies, r.some) for r in got} == {(2, 0)}


def test_simhash_values(spark):
    rows = OPERATORS["simhash"](spark, plain(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[7] == by[8] == by[9] == {("0" * 16, 7)}
    assert by[10] == by[11] and {c for _, c in by[10]} == {10}
    assert (("0" * 16, 7) in by[None]) and any(c is None for _, c in by[None])
    assert len(by[2]) == 2 and {c for _, c in by[2]} == {2}
    assert by[10] == {(f"{brute.simhash(LONG):016x}", 10)}


def test_simhash_dedup_keeps_one_of_each(spark):
    docs = clashing(spark)
    out = simhash_dedup.simhash_dedup(docs)
    assert out.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    assert set(kept.values()) == {1}
    prints = {(r[0], r[1]): brute.simhash(r[1]) for r in BASE}
    roots = brute.hamming_components(prints.values())
    assert sorted(roots[prints[k]] for k in kept) == sorted(set(roots.values()))
    assert {i for i, _ in kept} == {1, 2, None, 7, 10, 12, 13, 14}


def test_embedding_values(spark):
    docs = [(5, "abcdefgh"), (None, "first of all"), (5, "abcdefgh"), (7, ""), (6, None), (9, "zz")]
    got = edit_embedding.edited_neighbours(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[7][0].fingerprint == "0:" and by[6][0].near_next == 1.0 and by[7][0].near_next == 0.0
    assert by[5][0].fingerprint == by[5][1].fingerprint and max(r.near_next for r in by[5]) == 1.0
    single = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    (row,) = edit_embedding.edited_neighbours(single).collect()
    assert row.near_next == 1.0 and row.edited_fingerprint == edit_embedding.written(
        *edit_embedding.walk([edit_embedding.codes("abca")])[0]
    )


def test_token_and_piece_values(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    counted = {(r.doc_id, r.n_tokens) for r in OPERATORS["tokens"](spark, plain(spark)).collect()}
    assert {(r[0], len(library.encode(r[1] or "", add_special_tokens=False))) for r in BASE} == counted
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = sentencepiece_codec.encode(plain(spark), PIECES)
    for r in found.collect():
        assert any(r.ids == reference.encode(t or "") for i, t, *_ in BASE if i == r.doc_id)
    back = sentencepiece_codec.decode(found, PIECES).collect()
    assert {r.doc_id: r.text for r in back}[13] == BASE[13][1].replace("▁", " ")
    assert all(r.round_trip for r in found.where("doc_id <> 13").collect())


PAGES = [
    (1, "https://a.ORG/x?y#z"),
    (1, "https://a.ORG/x?y#z"),
    (2, "http://example.org/es/1"),
    (3, "http://www.example.org/en/10"),
    (4, "http://www.example.org/en/20"),
    (5, "http://x.com/fr/"),
    (6, "http://x.com/de/1#a"),
    (7, "http://notorg/"),
    (8, "http://org"),
    (9, "https://listed.net/page?x=1"),
    (10, "https://listed.net/page/other"),
    (None, None),
    (11, "no scheme"),
    (12, "http://com"),
    (13, "a?b://c.org/d"),
]


def test_url_values(spark):
    from veilwright.llm.queries import URL_RULES

    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    listed = spark.createDataFrame([("listed.net/page",), ("listed.net/page",), (None,)], "url string")
    pages = spark.createDataFrame([(*p, 0, 0, 0) for p in PAGES], "page_id long, url string, host int, key int, rule int")
    rows = url_filter.url_filter(pages, rules, listed).collect()
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows)
    assert got == Counter(
        [
            (1, "a.org", "/x", "org/", "allow"),
            (1, "a.org", "/x", "org/", "allow"),
            (2, "example.org", "/es/1", "example.org/es/", "block"),
            (3, "www.example.org", "/en/10", "example.org/en/1", "block"),
            (4, "www.example.org", "/en/20", "org/", "allow"),
            (5, "x.com", "/fr/", "com/fr/", "allow"),
            (6, "x.com", "/de/1", "com/de/", "block"),
            (7, "notorg", "/", None, "allow"),
            (8, "org", "", None, "allow"),
            (9, "listed.net", "/page", None, "block"),
            (10, "listed.net", "/page/other", None, "allow"),
            (None, "", "", None, "allow"),
            (11, "", "", None, "allow"),
            (12, "com", "", None, "allow"),
            (13, "c.org", "/d", "org/", "allow"),
        ]
    )
    empty = spark.createDataFrame([], "url string")
    assert url_filter.url_filter(pages, rules.limit(0), empty).where("verdict <> 'allow'").isEmpty()
    assert url_filter.url_filter(pages.limit(0), rules, listed).collect() == []


def test_toxicity_without_two_classes(spark):
    for rows in ((), ((1, 1, 1), (2, 1, 1))):
        out = toxicity_gbt.toxicity(plain(spark), labels(spark, rows)).collect()
        assert len(out) == len(BASE) and all(0 <= r.score <= 1 for r in out)
        assert all(r.held_out for r in out if r.doc_id is None)
