"""Deletion policy on governed relations.

The ledger has one row per key. Its join carries no broadcast hint: a ledger grows with the
number of erased customers, so Spark decides from its measured size.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.config import SPECIAL, KeyScheme, Persona
from veilwright.functions.keys import personal_data_key
from veilwright.sources.tables import union_all

# Fixed values.
MODEL_TYPES = (
    "FACT", "DIMENSION", "MAPPING", "SERVICE", "QUARANTINE", "IDENTITY", "DEPENDENT", "CASE_VIEW",
)
DEFAULT_ERASED_KEY = "-99999"

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def check_identifier(value, argument: str) -> str:
    if not isinstance(value, str) or not _IDENTIFIER.fullmatch(value):
        raise ValueError(f"{argument}: {value!r} is no plain name")
    return value


def check_columns(columns, argument: str = "columns") -> list[str]:
    if isinstance(columns, str) or not isinstance(columns, Sequence) or not columns:
        raise ValueError(f"{argument}: at least one name is needed")
    for name in columns:
        check_identifier(name, argument)
    if len(set(columns)) != len(columns):
        raise ValueError(f"{argument}: a name occurs twice in {list(columns)}")
    return list(columns)


def check_model_type(model_type: str) -> str:
    kind = str(model_type).upper()
    if kind not in MODEL_TYPES:
        raise ValueError(f"unknown model type {model_type!r}; known: {', '.join(MODEL_TYPES)}")
    return kind


def _as_list(value, argument: str) -> list[str]:
    return check_columns([value] if isinstance(value, str) else value, argument)


def without_deleted(
    df: DataFrame, ledger: DataFrame, key: str | Column, ledger_key: str = "customer_key"
) -> DataFrame:
    """Rows whose key is not in the ledger, in either mode; a null key matches nothing and stays."""
    deleted = ledger.select(F.col(ledger_key).alias("_deleted_key"))
    key_column = F.col(key) if isinstance(key, str) else key
    return df.join(deleted, key_column == F.col("_deleted_key"), "left_anti")


def attach_deletion_mode(
    df: DataFrame,
    ledger: DataFrame,
    key: str | Column,
    columns: Sequence[str],
    mode_column: str = "deletion_mode",
    ledger_key: str = "customer_key",
) -> DataFrame:
    """``columns`` plus the ledger's mode for the row's key, null where the key is not deleted."""
    names = check_columns(columns)
    check_identifier(mode_column, "mode_column")
    modes = ledger.select(F.col(ledger_key).alias("_ledger_key"), F.col("deletion_mode").alias("_ledger_mode"))
    key_column = F.col(key) if isinstance(key, str) else key
    joined = df.join(modes, key_column == F.col("_ledger_key"), "left")
    return joined.select(*names, F.col("_ledger_mode").alias(mode_column))


def apply_policy(
    df: DataFrame,
    columns: Sequence[str],
    behavior: str,
    replacements: Mapping[str, Column] | None = None,
    flag: str | None = None,
    mode_column: str = "deletion_mode",
) -> DataFrame:
    """DELETE drops both modes. REPLACE drops FULL and rewrites SPECIAL rows, marked by ``flag``."""
    names = check_columns(columns)
    check_identifier(mode_column, "mode_column")
    replacements = dict(replacements or {})
    mode = F.col(mode_column)
    kind = str(behavior).upper()
    if kind == "DELETE":
        if replacements or flag is not None:
            raise ValueError("DELETE drops rows, so it replaces and flags none")
        return df.where(mode.isNull()).select(*names)
    if kind != "REPLACE":
        raise ValueError(f"neither DELETE nor REPLACE: {behavior!r}")
    if not replacements or flag is None:
        raise ValueError("REPLACE: what is replaced, and by which flag is it marked?")
    unknown = sorted(set(replacements) - set(names))
    if unknown:
        raise ValueError(f"not projected, so not replaceable: {unknown}")
    if check_identifier(flag, "flag") in names:
        raise ValueError(f"the flag {flag} is projected already")
    special = F.coalesce(mode == SPECIAL, F.lit(False))
    projected = [
        F.when(special, replacements[c]).otherwise(F.col(c)).alias(c) if c in replacements else F.col(c)
        for c in names
    ]
    return df.where(mode.isNull() | (mode == SPECIAL)).select(*projected, special.alias(flag))


def governed_model(
    df: DataFrame,
    name: str,
    model_type: str,
    primary_key: str | Sequence[str],
    columns: Sequence[str],
    ledger: DataFrame | None = None,
    key_column: str | None = "customer_key",
    key_expression: Column | None = None,
    special_columns: str | Sequence[str] | None = None,
    flag: str | None = "is_erased_customer",
    mode_annotated: bool = False,
    policy_applied: bool = False,
    mode_column: str = "deletion_mode",
    predicate: Column | None = None,
    erased_key: str = DEFAULT_ERASED_KEY,
) -> DataFrame:
    """One deletion-governed relation, by model type."""
    check_identifier(name, "name")
    kind = check_model_type(model_type)
    names = check_columns(columns)
    for key in _as_list(primary_key, "primary_key"):
        if key not in names:
            raise ValueError(f"{name}: primary key {key} is not projected")
    if mode_annotated and policy_applied:
        raise ValueError(f"{name}: rows are either annotated or governed already, not both")

    if kind == "CASE_VIEW":
        if policy_applied:
            raise ValueError(f"{name}: only a FACT may be governed already")
        if mode_annotated or special_columns is not None:
            raise ValueError(f"{name}: a CASE_VIEW neither annotates nor replaces")
        if predicate is None:
            raise ValueError(f"{name}: a CASE_VIEW without a predicate would be open to all")
        if flag is None and key_column is None:
            raise ValueError(f"{name}: a CASE_VIEW needs a flag or a key to hide erased rows")
        visible = ~F.col(flag) if flag is not None else F.col(key_column) != erased_key
        return df.where(predicate & visible).select(*names)

    if predicate is not None:
        raise ValueError(f"{name}: only a CASE_VIEW has a predicate")
    if kind != "FACT":
        if policy_applied:
            raise ValueError(f"{name}: only a FACT may be governed already")
        if special_columns is not None:
            raise ValueError(f"{name}: columns are replaced in a FACT only")
        if mode_annotated:
            return apply_policy(df, names, "DELETE", mode_column=mode_column)
        key = key_expression if key_expression is not None else key_column
        if key is None:
            raise ValueError(f"{name}: which key meets the ledger?")
        return without_deleted(df, _need_ledger(ledger, name), key).select(*names)

    replaced = _as_list(special_columns or [], f"{name}: special_columns")
    if key_column not in replaced:
        raise ValueError(f"{name}: a FACT replaces at least its key column")
    if set(replaced) - set(names):
        raise ValueError(f"{name}: replaced, but not projected: {sorted(set(replaced) - set(names))}")
    if flag is None:
        raise ValueError(f"{name}: a FACT marks erased rows by a flag")
    if policy_applied:
        # Leak guard: a row that still carries a ledger key never gets through.
        if flag not in names:
            raise ValueError(f"{name}: a FACT governed already projects its erased flag")
        # The erased member is in no ledger; its rows are dealt over many keys, or they would all
        # meet the ledger in one task.
        key, own = F.col(key_column), [F.col(c) for c in _as_list(primary_key, "primary_key")]
        spread = F.concat(key, F.lit("|"), F.pmod(F.xxhash64(*own), F.lit(4096)).cast("string"))
        key = F.when(key == erased_key, spread).otherwise(key)
        return without_deleted(df, _need_ledger(ledger, name), key).select(*names)
    if not mode_annotated:
        key = key_expression if key_expression is not None else key_column
        df = attach_deletion_mode(df, _need_ledger(ledger, name), key, names, mode_column)
    return apply_policy(
        df, names, "REPLACE", {c: F.lit(erased_key) for c in replaced}, flag, mode_column
    )


def _need_ledger(ledger: DataFrame | None, name: str) -> DataFrame:
    if ledger is None:
        raise ValueError(f"{name}: no ledger given")
    return ledger


def case_access(persona: Persona) -> Column:
    """A literal: without access Catalyst folds the whole view to an empty relation."""
    return F.lit(persona.reads_raw_values)


def contract_violations(
    df: DataFrame,
    model_type: str,
    primary_key: str | Sequence[str],
    key_columns: str | Sequence[str],
    ledger: DataFrame | None = None,
    key_column: str = "customer_key",
    key_domain: str | None = None,
    key_kind: str = "text",
    scheme: KeyScheme | None = None,
    flag: str | None = None,
    erased_key: str = DEFAULT_ERASED_KEY,
) -> DataFrame:
    """One ``failure_reason`` row per broken rule and row of a governed relation."""
    kind = check_model_type(model_type)
    pk = _as_list(primary_key, "primary_key")
    keys = _as_list(key_columns, "key_columns")
    if kind not in ("FACT", "CASE_VIEW") and len(keys) != 1:
        raise ValueError("without replacement there is one customer key column")

    any_null = F.lit(False)
    for c in pk:
        any_null = any_null | F.col(c).isNull()
    erased = [F.col(c).eqNullSafe(F.lit(erased_key)) for c in keys]
    any_erased, all_erased = F.lit(False), F.lit(True)
    for test in erased:
        any_erased, all_erased = any_erased | test, all_erased & test
    rules = {"NULL_PRIMARY_KEY": any_null}
    if kind == "FACT":
        if flag is None:
            raise ValueError("a FACT has an erased flag")
        marked = F.col(flag)
        rules["INVALID_ERASED_MEMBER"] = marked.isNull() | (marked & ~all_erased) | (~marked & any_erased)
    checked = df
    if kind == "CASE_VIEW":
        rules["ERASED_MEMBER_VISIBLE_IN_CASE_VIEW"] = any_erased
    else:
        key = F.col(key_column)
        if key_domain is not None:
            key = personal_data_key(key, key_domain, scheme, key_kind)
        deleted = _need_ledger(ledger, "contract").select(F.col("customer_key").alias("_deleted_key"))
        checked = df.join(deleted, key == F.col("_deleted_key"), "left")
        rules["DELETED_CUSTOMER_VISIBLE"] = F.col("_deleted_key").isNotNull()
    # One pass for all rules on single rows, one for repeated keys.
    broken = F.array_compact(F.array(*[F.when(test, F.lit(reason)) for reason, test in rules.items()]))
    repeated = df.groupBy(*pk).count().where(F.col("count") > 1)
    return union_all(
        [
            checked.select(F.explode(broken).alias("failure_reason")),
            repeated.select(F.lit("DUPLICATE_PRIMARY_KEY").alias("failure_reason")),
        ]
    )
