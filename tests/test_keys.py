import hashlib

import pytest
from pyspark.sql import functions as F

from veilwright.config import DEMO_SCHEME, Persona, PipelineConfig
from veilwright.functions import keys as K
from veilwright.functions import text as X


def one(spark, column, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(column(F.col("v"))).first()[0]


def test_known_answers(spark):
    ssn = one(spark, lambda c: K.personal_data_key(c, "customer.ssn", DEMO_SCHEME, "ssn"), "900-00-0001")
    mail = one(spark, lambda c: K.personal_data_key(c, "customer.email", DEMO_SCHEME), " Customer01@example.INVALID ")
    assert ssn == "demo-v1:825c0ec1125ce7f0b50d3ad4013f02ac42d0565d8cc4a202b3a0ab5f1ee0f3c8"
    assert mail == "demo-v1:a84a4bc9c4f38a8e1a06248ed3499d7ce505d09dbc745275d3226d021ef03853"


@pytest.mark.parametrize("value", ["abc", "ä ö", "日本", "a|b=c", "x" * 500])
def test_frame_counts_characters(spark, cfg, value):
    got = one(spark, lambda c: K.framed_hash(c, "customer.id", cfg.scheme), value)
    framed = (
        "purpose_length=28|purpose=gdpr_personal_data_pseudonym|version_length=2|version=v1|"
        f"domain_length=11|domain=customer.id|value_length={len(value)}|value={value}|"
        "pepper_length=14|pepper=fixture-pepper"
    )
    assert got == "v1:" + hashlib.sha256(framed.encode()).hexdigest()


@pytest.mark.parametrize(
    "kind,value,expected",
    [
        ("text", "  Aa \t\n b  ", "aa b"),
        ("text", "\t A  b ", " a b"),
        ("text", "   ", None),
        ("text", None, None),
        ("ssn", " 900-00-0001 ", "900000001"),
        ("ssn", "900000001", "900000001"),
        ("ssn", None, None),
        ("phone", "+358-555-0101", "3585550101"),
        ("phone", "+358 (555) 0101", "3585550101"),
        ("phone", None, None),
        ("date", "1981-02-02", "1981-02-02"),
    ],
)
def test_canonical_forms(spark, kind, value, expected):
    assert one(spark, lambda c: K.canonicalize(c, kind), value) == expected


@pytest.mark.parametrize(
    "kind,value",
    [
        ("ssn", "900A000001"),
        ("ssn", "900letters000001"),
        ("ssn", ""),
        ("ssn", "900-000001"),
        ("phone", "3585550101"),
        ("phone", "+3585550101ext2"),
        ("phone", "3585550101x2"),
        ("phone", "+12345"),
        ("phone", "+1234567890123456"),
    ],
)
def test_bad_identifiers_fail_the_job(spark, kind, value):
    with pytest.raises(Exception, match="Invalid"):
        one(spark, lambda c: K.canonicalize(c, kind), value)


def test_unknown_kind_is_refused(spark):
    with pytest.raises(ValueError):
        K.canonicalize(F.lit("x"), "email")


def test_null_in_null_out_and_domains_differ(spark, cfg):
    df = spark.createDataFrame([(None,), ("same",)], "v string")
    rows = df.select(
        K.personal_data_key(F.col("v"), "customer.email", cfg.scheme).alias("a"),
        K.personal_data_key(F.col("v"), "customer.full_name", cfg.scheme).alias("b"),
    ).collect()
    assert rows[0].a is None and rows[0].b is None
    assert rows[1].a != rows[1].b and rows[1].a.startswith("v1:")


@pytest.mark.parametrize("change", [{"hash_version": "v2"}, {"pepper_name": "pepper_v2"}])
def test_wrapper_refuses_other_versions(change):
    with pytest.raises(ValueError):
        PipelineConfig(pepper="p", **change).scheme


def test_pepper_is_not_in_repr(cfg):
    assert "fixture-pepper" not in repr(cfg) and "fixture-pepper" not in repr(cfg.scheme)


def test_mask(spark):
    df = spark.createDataFrame([("raw", "key")], "r string, k string")
    seen = [
        df.select(K.mask_value(F.col("r"), F.col("k"), Persona.of(g))).first()[0]
        for g in ("restricted_users", "privacy_admins", "case_users")
    ]
    assert seen == ["key", "raw", "raw"]


def test_composed_text(spark):
    df = spark.createDataFrame(
        [("a", None, None, None, "FI"), (None, None, None, None, None), (None, "b", "00001", None, None)],
        "l1 string, l2 string, p string, c string, n string",
    )
    got = [r[0] for r in df.select(X.compose_address(*[F.col(c) for c in df.columns])).collect()]
    assert got == ["a, , FI", None, "b, 00001"]
    names = spark.createDataFrame([("A", None), (None, None), ("A", "B")], "f string, l string")
    assert [r[0] for r in names.select(X.full_name(F.col("f"), F.col("l"))).collect()] == ["A", None, "A B"]
