"""Sensitive-text scan over tables: rule and location only, never the matching text."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Each rule's alternatives as (pattern before, literal text, pattern after).
RULE_PARTS = {
    "workspace host": (
        (r"dbc-[a-zA-Z0-9-]+", ".databricks.com", ""),
        (r"([a-zA-Z0-9-]+\.)+(cloud|gcp)", ".databricks.com", ""),
        (r"adb-[0-9]+\.[0-9]+", ".azuredatabricks.net", ""),
    ),
    "warehouse identifier": (
        ("", "/sql/1.0/warehouses/", "[0-9a-f]{16}"),
        ("", "DATABRICKS_WAREHOUSE_ID", r"\s*=\s*[0-9a-f]{16}"),
        ("", "warehouse_id:", r"\s*[0-9a-f]{16}"),
    ),
    "account identifier": (("", "DATABRICKS_ACCOUNT_ID", r"\s*=\s*[0-9a-f]{8}-[0-9a-f-]{27,}"),),
    "group identifier": (("(PRIVACY_ADMIN|RESTRICTED_USER|CASE_USER)", "_GROUP_ID", r"\s*=\s*[0-9]{5,}"),),
    "home path": (("", "/Users/", "[a-zA-Z0-9_.-]+/"),),
    "credential-shaped token": (
        ("", "dapi", "[a-z0-9]{20,}"),
        ("", "github_pat_", "[A-Za-z0-9_]{20,}"),
        ("", "ghp_", "[A-Za-z0-9]{20,}"),
        ("", "gho_", "[A-Za-z0-9]{20,}"),
        ("", "ghu_", "[A-Za-z0-9]{20,}"),
        ("", "ghs_", "[A-Za-z0-9]{20,}"),
        ("", "ghr_", "[A-Za-z0-9]{20,}"),
        ("", "sk-", "[A-Za-z0-9_-]{20,}"),
        ("", "AKIA", "[0-9A-Z]{16}"),
        ("", "xox", "[baprs]-[A-Za-z0-9-]{10,}"),
    ),
    "private key": (("BEGIN (RSA |EC |OPENSSH )?", "PRIVATE KEY", ""),),
}
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
RESERVED_SUFFIX = r"(^|\.)(invalid|example)$"
RESERVED_DOMAINS = ("example.com", "example.net", "example.org", "users.noreply.github.com")
RESERVED_ADDRESSES = ("noreply@github.com",)
SAFE_PATHS = (".env.example",)
SENSITIVE_PATHS = (
    r"\.env(\..*)?$",
    r"(^|/)\.databrickscfg$",
    r"(^|/)\.databricks/",
    r"(^|/)\.dbt/",
    r"(^|/)\.config/(databricks|dbt)/",
    r"(^|/)\.user\.yml$",
    r"(^|/)(logs|target)/",
    r"^credentials.*\.json$",
    r"/credentials.*\.json$",
    r"(^|/)token(-cache)?\.json$",
    r"\.token$",
    r"\.(pem|key|p8|p12|pfx|jks|keystore)$",
    r"(^|/)id_(dsa|ecdsa|ed25519|rsa)$",
)


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line, numbered from 1; the text never leaves its task."""
    return df.select(
        F.col(id_col).alias("record_id"),
        F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_index", "line"),
    )


def _any(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _present(text: Column, parts: Iterable[tuple[str, str, str]]) -> Column:
    """Whether one of the rule's literals occurs (a byte search); every match contains one."""
    return _any(F.contains(text, F.lit(literal)) for literal in sorted({literal for _, literal, _ in parts}))


def _part_test(line: Column, parts: Iterable[tuple[str, str, str]]) -> Column:
    pattern = "|".join(f"({before}{re.escape(literal)}{after})" for before, literal, after in parts)
    return _present(line, parts) & line.rlike(pattern)


def scan_sensitive(df: DataFrame, id_col: str, text_col: str, rules: dict[str, str] | None = None) -> DataFrame:
    """(rule, record_id, line_number) for every line that matches a rule; null texts have no lines.

    Patterns only ever see single lines, so ``^`` and ``$`` are a line's ends. With the built-in rules, texts
    without any of the literals that their patterns are built from are not split at all. Rules
    that are passed in are plain patterns, of which no literal is known: every text is split.
    """
    text, line = F.col(text_col), F.col("line")
    if rules is None:
        df = df.where(_any(_present(text, parts) for parts in RULE_PARTS.values()))
        tests = {rule: _part_test(line, parts) for rule, parts in RULE_PARTS.items()}
    else:
        tests = {rule: line.rlike(pattern) for rule, pattern in rules.items()}
    hits = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in tests.items()]))
    return _lines(df, id_col, text_col).select(
        F.explode(hits).alias("rule"), "record_id", (F.col("line_index") + 1).alias("line_number")
    )


def scan_emails(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines with an e-mail address outside the reserved domains."""
    lines = _lines(df.where(F.col(text_col).contains("@")), id_col, text_col)
    found = lines.where(F.col("line").contains("@")).select(
        "record_id",
        "line_index",
        F.explode(F.regexp_extract_all("line", F.lit(EMAIL), F.lit(0))).alias("address"),
    )
    address = F.lower("address")
    domain = F.regexp_replace(address, "^.*@", "")
    reserved = domain.rlike(RESERVED_SUFFIX) | domain.isin(*RESERVED_DOMAINS) | address.isin(*RESERVED_ADDRESSES)
    return (
        found.where(~reserved)
        .select(
            F.lit("non-reserved email address").alias("rule"),
            "record_id",
            (F.col("line_index") + 1).alias("line_number"),
        )
        .distinct()
    )


def scan_paths(df: DataFrame, path_col: str) -> DataFrame:
    """Distinct sensitive file paths."""
    path = F.col(path_col)
    sensitive = path.rlike("|".join(f"({p})" for p in SENSITIVE_PATHS)) & ~path.isin(*SAFE_PATHS)
    return df.where(sensitive).select(F.lit("sensitive filename").alias("rule"), path.alias("path")).distinct()
