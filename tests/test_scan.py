import pytest

from veilwright.operators import scan as S
from veilwright.sources.tables import literal_relation


def texts(spark, rows):
    return literal_relation(spark, rows, "id int, text string")


@pytest.mark.parametrize(
    "rule,line",
    [
        ("credential-shaped token", "key = sk-" + "a" * 20),
        ("credential-shaped token", "AKIA" + "A1" * 8),
        ("credential-shaped token", "ghp_" + "x" * 20),
        ("credential-shaped token", "github_pat_" + "x" * 20),
        ("credential-shaped token", "dapi" + "0" * 20),
        ("credential-shaped token", "xoxb-" + "1" * 10),
        ("private key", "-----BEGIN PRIVATE KEY-----"),
        ("private key", "-----BEGIN OPENSSH PRIVATE KEY-----"),
        ("home path", "see /Users/some.one/x"),
        ("workspace host", "https://dbc-a1-b2.databricks.com"),
        ("workspace host", "x.y.gcp.databricks.com"),
        ("workspace host", "adb-12.3.azuredatabricks.net"),
        ("warehouse identifier", "/sql/1.0/warehouses/" + "a0" * 8),
        ("warehouse identifier", "warehouse_id:  " + "a0" * 8),
        ("account identifier", "DATABRICKS_ACCOUNT_ID = 0a0a0a0a-" + "1" * 27),
        ("group identifier", "CASE_USER_GROUP_ID=12345"),
    ],
)
def test_rules_report_location_only(spark, rule, line):
    found = S.scan_sensitive(texts(spark, [(1, f"first\n{line}\nlast"), (2, "nothing here")]), "id", "text")
    assert found.columns == ["rule", "record_id", "line_number"]
    assert [tuple(r) for r in found.collect()] == [(rule, 1, 2)]


@pytest.mark.parametrize("line", ["sk-short", "AKIA123", "BEGIN PUBLIC KEY", "/Users/", "gh_" + "x" * 30, "DATABRICKS_ACCOUNT_ID="])
def test_near_misses(spark, line):
    assert S.scan_sensitive(texts(spark, [(1, line)]), "id", "text").isEmpty()


def test_own_rules_see_single_lines(spark):
    rows = [(1, "first\npassword=x"), (2, "password=x\nlast"), (3, "a\npassword=x\nb"), (4, "no password=x y"), (5, None)]
    found = S.scan_sensitive(texts(spark, rows), "id", "text", {"start": "^password=", "end": "=x$"}).collect()
    assert sorted((r.rule, r.record_id, r.line_number) for r in found) == sorted(
        (rule, i, n) for i, n in ((1, 2), (2, 1), (3, 2)) for rule in ("start", "end")
    )


def test_every_part_has_a_literal():
    for rule, parts in S.RULE_PARTS.items():
        assert all(len(literal) >= 3 and "\n" not in literal for _, literal, _ in parts), rule


def test_emails(spark):
    rows = [
        (1, "a@real.org\nb@example.com and c@mail5.example.com"),
        (2, "x@y.invalid z@a.example q@users.noreply.github.com noreply@github.com"),
        (3, "Someone@EXAMPLE.com, other@github.com, other2@github.com"),
        (4, None),
    ]
    found = sorted((r.record_id, r.line_number) for r in S.scan_emails(texts(spark, rows), "id", "text").collect())
    assert found == [(1, 1), (1, 2), (3, 1)]


def test_paths(spark):
    bad = [
        ".env", "a/.env", "x.env", "b/.env.local", ".databrickscfg", "a/.dbt/profiles.yml", ".config/dbt/x", "logs/a.txt",
        "a/target/b", "credentials-x.json", "a/credentials.json", "token.json", "a/token-cache.json", "x.token", "k.pem",
        "a/b.p12", "id_rsa", "a/id_ed25519", ".user.yml",
    ]
    good = [".env.example", "environment.txt", "id_rsa.pub", "my_credentials.json", "catalogs/x", "tokens.json", "keyring.txt"]
    df = literal_relation(spark, [(p,) for p in bad + good], "path string")
    assert sorted(r.path for r in S.scan_paths(df, "path").collect()) == sorted(bad)
