"""Declarative governed models: a spec is interpreted as a DataFrame.

A spec names its source, joins, filters and columns (plain, SQL expression, or key), and how the
deletion policy applies. Expressions are ordinary Spark SQL fragments.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.config import Persona, PipelineConfig
from veilwright.functions.keys import personal_data_key
from veilwright.operators import star
from veilwright.operators.audits import audit_not_null, audit_unique
from veilwright.operators.controls import Target
from veilwright.operators.policy import case_access, check_columns, check_identifier, check_model_type, governed_model
from veilwright.schemas import with_column_metadata
from veilwright.sources.tables import merge_by_key

# Model kinds per layer, and what a kind is stored as by default.
LAYER_KINDS = {
    "layer1": ("STAGING", "QUARANTINE", "CONTROL"),
    "priva_map": ("MAPPING",),
    "layer2": ("KEYED", "RESOLUTION", "PUBLISHED", "CONTROL"),
    "layer3": ("DIMENSION", "DATE_DIMENSION", "FACT"),
    "layer3_case": ("CASE_VIEW",),
}
DEFAULT_STORAGE = {"STAGING": "view", "KEYED": "ephemeral", "RESOLUTION": "ephemeral", "CASE_VIEW": "view"}
GOVERNED_KINDS = ("QUARANTINE", "MAPPING", "FACT", "CASE_VIEW")
FIXED_TYPES = ("QUARANTINE", "MAPPING", "DIMENSION", "FACT", "CASE_VIEW")


@dataclass(frozen=True)
class KeySpec:
    expression: str
    domain: str
    kind: str = "text"


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    data_type: str | None = None
    expression: str | None = None
    key: KeySpec | None = None
    tests: tuple[str, ...] = ()
    tags: Mapping[str, str] = field(default_factory=dict)
    mask_column: str | None = None


@dataclass(frozen=True)
class JoinSpec:
    relation: str
    alias: str
    on: str | None = None
    how: str = "inner"


@dataclass(frozen=True)
class DeletionSpec:
    model_type: str | None = None
    key_column: str = "customer_key"
    key_expression: str | None = None
    key_domain: str | None = None
    key_kind: str = "text"
    special_columns: tuple[str, ...] | None = None
    flag: str | None = None
    mode_annotated: bool = False
    policy_applied: bool = False
    mode_column: str = "deletion_mode"
    predicate: str | None = None
    register_target: bool = False


@dataclass(frozen=True)
class NamedSpec:
    """A relation of a model's own, under a name that its source and joins may use.

    It reads relations from outside or names given before it. With one_row its columns are
    aggregates over all rows; only such a relation may be cross joined.
    """

    name: str
    source: str
    columns: tuple[ColumnSpec, ...]
    alias: str = "source_rows"
    joins: tuple[JoinSpec, ...] = ()
    where: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    one_row: bool = False


@dataclass(frozen=True)
class ModelSpec:
    layer: str
    kind: str
    name: str
    source: str | None = None
    primary_key: tuple[str, ...] = ()
    columns: tuple[ColumnSpec, ...] = ()
    helper_columns: tuple[ColumnSpec, ...] = ()
    alias: str = "source_rows"
    joins: tuple[JoinSpec, ...] = ()
    where: tuple[str, ...] = ()
    deletion: DeletionSpec | None = None
    erased_member: Mapping[str, str] | None = None
    merge_key: tuple[str, ...] | None = None
    named: tuple[NamedSpec, ...] = ()

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def storage(self) -> str:
        return "incremental" if self.merge_key else DEFAULT_STORAGE.get(self.kind, "table")


def validate(spec: ModelSpec) -> None:
    """Refuse a contradictory spec before any plan is built."""
    if spec.layer not in LAYER_KINDS or spec.kind not in LAYER_KINDS[spec.layer]:
        raise ValueError(f"{spec.name}: layer {spec.layer} holds no {spec.kind}")
    check_identifier(spec.name, "name")
    if spec.kind == "DATE_DIMENSION":
        if spec.source or spec.columns or spec.joins or spec.where or spec.deletion or spec.erased_member:
            raise ValueError(f"{spec.name}: a date dimension has nothing but its range")
        return
    if not spec.source:
        raise ValueError(f"{spec.name}: which relation does it read?")
    names = check_columns(spec.column_names, f"{spec.name}: columns")
    if not spec.primary_key or set(spec.primary_key) - set(names):
        raise ValueError(f"{spec.name}: the primary key is not projected")
    _validate_named(spec)
    for column in spec.columns:
        if column.mask_column and spec.kind != "MAPPING":
            raise ValueError(f"{spec.name}: a mask belongs into a MAPPING")
        if (column.mask_column or column.tags) and spec.storage not in ("table", "incremental"):
            raise ValueError(f"{spec.name}: only stored relations carry tags and masks")
        if column.expression is not None and column.key is not None:
            raise ValueError(f"{spec.name}: {column.name} is given twice, as expression and as key")
    if spec.helper_columns and spec.deletion is None:
        raise ValueError(f"{spec.name}: helper columns without a deletion rule have no use")
    if set(names) & {c.name for c in spec.helper_columns}:
        raise ValueError(f"{spec.name}: a helper column hides a visible one")
    if spec.kind in GOVERNED_KINDS and spec.deletion is None:
        raise ValueError(f"{spec.name}: {spec.kind} needs a deletion rule")
    if spec.erased_member is not None:
        if spec.kind != "DIMENSION":
            raise ValueError(f"{spec.name}: only a DIMENSION has an erased member")
        if set(spec.erased_member) != set(names):
            raise ValueError(f"{spec.name}: the erased member leaves columns open")
    if spec.merge_key is not None and set(spec.merge_key) - set(names):
        raise ValueError(f"{spec.name}: the merge key is not projected")
    if spec.deletion is not None:
        _validate_deletion(spec, spec.deletion, names)


def _validate_named(spec: ModelSpec) -> None:
    seen: set[str] = set()
    single = {p.name for p in spec.named if p.one_row}
    _validate_joins(spec.name, spec.alias, spec.joins, single)
    for part in spec.named:
        check_identifier(part.name, f"{spec.name}: named relation")
        check_columns([c.name for c in part.columns], f"{spec.name}: columns of {part.name}")
        if part.name in seen:
            raise ValueError(f"{spec.name}: two relations are named {part.name}")
        later = {p.name for p in spec.named} - seen
        if {part.source, *(j.relation for j in part.joins)} & later:
            raise ValueError(f"{spec.name}: {part.name} reads a relation that is named only after it")
        _validate_joins(spec.name, part.alias, part.joins, single)
        seen.add(part.name)


def _validate_joins(name: str, alias: str, joins: tuple[JoinSpec, ...], single: set[str]) -> None:
    aliases = [alias, *(j.alias for j in joins)]
    if len(set(aliases)) != len(aliases):
        raise ValueError(f"{name}: each alias can be used once: {aliases}")
    for join in joins:
        if join.how not in ("inner", "left", "cross"):
            raise ValueError(f"{name}: unknown kind of join: {join.how}")
        if (join.how == "cross") != (join.on is None):
            raise ValueError(f"{name}: only a cross join goes without a condition")
        if join.how == "cross" and join.relation not in single:
            raise ValueError(f"{name}: {join.relation} may have many rows; only a one-row relation is cross joined")


def _model_type(spec: ModelSpec) -> str:
    return check_model_type(spec.deletion.model_type or spec.kind)


def _validate_deletion(spec: ModelSpec, deletion: DeletionSpec, names: list[str]) -> None:
    model_type = _model_type(spec)
    if spec.kind in FIXED_TYPES and model_type != spec.kind:
        raise ValueError(f"{spec.name}: its deletion rule is for another kind than {spec.kind}")
    if deletion.key_expression is not None and deletion.key_domain is not None:
        raise ValueError(f"{spec.name}: key expression and key domain exclude each other")
    if deletion.key_column not in names and (model_type != "CASE_VIEW" or deletion.flag is None):
        raise ValueError(f"{spec.name}: {deletion.key_column}, its key, is not projected")
    if model_type == "FACT":
        if not deletion.special_columns or deletion.key_column not in deletion.special_columns:
            raise ValueError(f"{spec.name}: a FACT replaces at least its key")
        if set(deletion.special_columns) - set(names):
            raise ValueError(f"{spec.name}: it replaces columns that it does not project")
        if deletion.flag not in names:
            raise ValueError(f"{spec.name}: a FACT projects its erased flag")
    elif deletion.special_columns is not None:
        raise ValueError(f"{spec.name}: columns are replaced in a FACT only")


def _projected(part: ModelSpec | NamedSpec, column: ColumnSpec, cfg: PipelineConfig) -> Column:
    if column.key is not None:
        value = F.expr(column.key.expression)
        return personal_data_key(value, column.key.domain, cfg.scheme, column.key.kind).alias(column.name)
    if column.expression is not None:
        return F.expr(column.expression).alias(column.name)
    return F.col(f"{part.alias}.{column.name}").alias(column.name)


def _joined(part: ModelSpec | NamedSpec, relations: Mapping[str, DataFrame]) -> DataFrame:
    """Source, joins and filters."""
    rows = relations[part.source].alias(part.alias)
    for join in part.joins:
        other = relations[join.relation].alias(join.alias)
        rows = rows.crossJoin(other) if join.how == "cross" else rows.join(other, F.expr(join.on), join.how)
    for predicate in part.where:
        rows = rows.where(F.expr(predicate))
    return rows


def _named(spec: ModelSpec, relations: Mapping[str, DataFrame], cfg: PipelineConfig) -> dict[str, DataFrame]:
    """The outer relations and the model's own ones, each built from those before it."""
    known = dict(relations)
    for part in spec.named:
        rows = _joined(part, known)
        columns = [_projected(part, c, cfg) for c in part.columns]
        if part.one_row:
            known[part.name] = rows.agg(*columns)
        elif part.group_by:
            keys = [c for c, s in zip(columns, part.columns) if s.name in part.group_by]
            values = [c for c, s in zip(columns, part.columns) if s.name not in part.group_by]
            known[part.name] = rows.groupBy(*keys).agg(*values)
        else:
            known[part.name] = rows.select(*columns)
    return known


def relations_read(spec: ModelSpec) -> set[str]:
    """The outer relations that a spec names, which are all that build_model needs."""
    parts = (spec, *spec.named)
    found = {n for part in parts for n in (part.source, *(j.relation for j in part.joins)) if n is not None}
    return found - {part.name for part in spec.named}


def reads_ledger(spec: ModelSpec) -> bool:
    return spec.deletion is not None and not spec.deletion.mode_annotated and _model_type(spec) != "CASE_VIEW"


def build_model(
    spec: ModelSpec,
    relations: Mapping[str, DataFrame],
    cfg: PipelineConfig,
    ledger: DataFrame | None = None,
    persona: Persona | None = None,
    existing: DataFrame | None = None,
) -> DataFrame:
    """The relation a spec describes."""
    validate(spec)
    if spec.kind == "DATE_DIMENSION":
        return star.dim_date(next(iter(relations.values())).sparkSession, cfg)

    rows = _joined(spec, _named(spec, relations, cfg))

    deletion = spec.deletion
    computed_flag = None
    if deletion is not None and _model_type(spec) == "FACT" and not deletion.policy_applied:
        computed_flag = deletion.flag
    wanted = [c for c in (*spec.columns, *spec.helper_columns) if c.name != computed_flag]
    generated = rows.select(*[_projected(spec, c, cfg) for c in wanted])
    if deletion is not None:
        generated = _governed(spec, deletion, generated, cfg, ledger, persona, computed_flag)
    if spec.erased_member is not None:
        member = generated.sparkSession.range(1).select(
            *[F.expr(spec.erased_member[f.name]).cast(f.dataType).alias(f.name) for f in generated.schema.fields]
        )
        generated = generated.unionByName(member)

    annotations = {
        c.name: {**c.tags, **({"mask_column": c.mask_column} if c.mask_column else {})}
        for c in spec.columns
        if c.tags or c.mask_column
    }
    out = with_column_metadata(generated.select(spec.column_names), annotations)
    if spec.merge_key is not None and existing is not None:
        out = merge_by_key(existing, out, spec.merge_key)
    return out


def _governed(spec, deletion, generated, cfg, ledger, persona, computed_flag) -> DataFrame:
    model_type = _model_type(spec)
    key = None
    if deletion.key_domain is not None:
        key = personal_data_key(F.col(deletion.key_column), deletion.key_domain, cfg.scheme, deletion.key_kind)
    elif deletion.key_expression is not None:
        key = F.expr(deletion.key_expression)
    options = {}
    if model_type == "CASE_VIEW":
        access = F.lit(False) if persona is None else case_access(persona)
        options["predicate"] = access if deletion.predicate is None else access & F.expr(deletion.predicate)
        options["flag"] = deletion.flag
    elif model_type == "FACT":
        options["flag"] = deletion.flag
        options["special_columns"] = list(deletion.special_columns)
    return governed_model(
        generated,
        spec.name,
        model_type,
        list(spec.primary_key),
        [c for c in spec.column_names if c != computed_flag],
        ledger,
        key_column=deletion.key_column,
        key_expression=key,
        mode_annotated=deletion.mode_annotated,
        policy_applied=deletion.policy_applied,
        mode_column=deletion.mode_column,
        erased_key=cfg.erased_member_key,
        **options,
    )


def column_tests(spec: ModelSpec, df: DataFrame) -> dict[str, DataFrame]:
    """The audits a spec asks for: not_null columns together, each unique column on its own."""
    audits = {}
    required = [c.name for c in spec.columns if "not_null" in c.tests]
    if required:
        audits[f"{spec.name}_not_null"] = audit_not_null(df, required)
    for column in spec.columns:
        if "unique" in column.tests:
            audits[f"{spec.name}_{column.name}_unique"] = audit_unique(df, [column.name])
    if spec.primary_key:
        audits[f"{spec.name}_primary_key_unique"] = audit_unique(df, list(spec.primary_key))
    return audits


def register_target(spec: ModelSpec) -> Target:
    """The deletion target of a governed model, to be added to the registry."""
    validate(spec)
    if spec.deletion is None or not spec.deletion.register_target:
        raise ValueError(f"{spec.name}: it does not register as a deletion target")
    return Target(spec.layer, spec.name, _model_type(spec))
