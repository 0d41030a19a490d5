"""Deletion controls: requests, fail-closed decisions, plan, and the monotonic ledger."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwright.config import FULL, MODES, SPECIAL, PipelineConfig
from veilwright.functions.keys import ssn_key
from veilwright.operators.policy import check_identifier, check_model_type
from veilwright.schemas import CONTRACTS, CONTROL_KEYS
from veilwright.sources.tables import literal_relation, merge_by_key

PLAN = "int_customer_deletion_plan"
LEDGER = "int_terminal_deleted_customer_keys"


# ---- requests and decisions -------------------------------------------------------------------

def new_requests(stg_customer: DataFrame, existing: DataFrame | None, cfg: PipelineConfig) -> DataFrame:
    """DELETE changes that are no requests yet."""
    detected = stg_customer.where(F.col("source_operation") == "DELETE").select(
        F.col("customer_change_id").alias("deletion_request_id"),
        "customer_id",
        "customer_ssn",
        F.col("source_updated_at").alias("source_deleted_at"),
        cfg.run_timestamp().alias("detected_at"),
        F.lit("DETECTED").alias("detection_status"),
    )
    if existing is None:
        return detected
    return detected.join(existing.select("deletion_request_id"), "deletion_request_id", "left_anti").select(detected.columns)


def detect_requests(stg_customer: DataFrame, existing: DataFrame | None, cfg: PipelineConfig) -> DataFrame:
    """DELETE changes become requests once; the first ``detected_at`` is kept."""
    fresh = new_requests(stg_customer, existing, cfg)
    return fresh if existing is None else existing.unionByName(fresh)


def _complete_confirmation(policy_version: str) -> Column:
    return (
        (F.col("decision_status") == "CONFIRMED")
        & F.col("deletion_mode").isin(*MODES)
        & (F.col("deletion_policy_version") == policy_version)
        & F.col("recorded_at").isNotNull()
        & F.col("decided_at").isNotNull()
        & F.col("decided_by_role").isNotNull()
        & F.col("decision_reason").isNotNull()
    )


def authorization_history(requests: DataFrame, decisions: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Every revision classified; a missing or unknown hold is checked first and fails closed."""
    hold = F.col("legal_hold")
    status = F.col("decision_status")
    outcome = (
        F.when(hold.isNull(), "INVALID")
        .when(hold, "HELD")
        .when(_complete_confirmation(cfg.policy_version), "AUTHORIZED")
        .when(status == "CONFIRMED", "INVALID")
        .when(status == "REJECTED", "REJECTED")
        .otherwise("PENDING")
    )
    joined = requests.drop("detection_status").join(decisions, "deletion_request_id", "inner")
    return joined.withColumn("authorization_status", outcome).select(
        CONTRACTS["customer_deletion_authorization_history"].names
    )


def _latest_revision(revisions: DataFrame) -> DataFrame:
    newest = Window.partitionBy("deletion_request_id").orderBy(
        F.col("recorded_at").desc(), F.col("decision_revision_id").desc()
    )
    return (
        revisions.withColumn("revision_rank", F.row_number().over(newest))
        .where(F.col("revision_rank") == 1)
        .drop("revision_rank")
    )


def authorizations(requests: DataFrame, history: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Reviewer view: the latest revision per request, PENDING where there is none."""
    decision_columns = [
        "deletion_request_id", "decision_revision_id", "decision_status", "deletion_mode",
        "recorded_at", "decided_at", "decided_by_role", "decision_reason", "legal_hold",
        "deletion_policy_version", "authorization_status",
    ]
    latest = _latest_revision(history.select(*decision_columns))
    undecided = F.col("decision_revision_id").isNull()
    joined = requests.drop("detection_status").join(latest, "deletion_request_id", "left")
    return (
        joined.withColumn("decision_status", F.coalesce("decision_status", F.lit("PENDING")))
        .withColumn(
            "deletion_policy_version",
            F.when(undecided, F.lit(cfg.policy_version)).otherwise(F.col("deletion_policy_version")),
        )
        .withColumn("authorization_status", F.coalesce("authorization_status", F.lit("PENDING")))
        .select(CONTRACTS["customer_deletion_authorizations"].names)
    )


# ---- targets and plan -------------------------------------------------------------------------

@dataclass(frozen=True)
class Target:
    """A governed relation; its two actions follow from its model type."""

    layer: str
    relation: str
    model_type: str
    kind: str | None = None

    def row(self) -> tuple[str, str, str, str, str]:
        check_identifier(self.layer, "layer")
        check_identifier(self.relation, "relation")
        model_type = check_model_type(self.model_type)
        wanted = "VIEW" if model_type == "CASE_VIEW" else "TABLE"
        kind = wanted if self.kind is None else self.kind.upper()
        if kind != wanted:
            raise ValueError(f"{model_type} kind must be {wanted}; received: {self.kind!r}")
        if model_type == "FACT":
            actions = ("DELETE_CURRENT_ROWS", "REASSIGN_TO_ERASED_MEMBER")
        elif model_type == "CASE_VIEW":
            actions = ("EXCLUDE_DELETED_ROWS", "EXCLUDE_ERASED_ROWS")
        else:
            actions = ("DELETE_CURRENT_ROWS", "DELETE_CURRENT_ROWS")
        return (self.layer, self.relation, kind, *actions)


# Fixed values.
TARGETS = (
    Target("layer1", "quarantine_customer_events", "QUARANTINE"),
    Target("layer1", "quarantine_customer_services", "QUARANTINE"),
    Target("layer1", "quarantine_invoices", "QUARANTINE"),
    Target("priva_map", "fa_pd_customer", "MAPPING"),
    Target("priva_map", "fa_pd_service_address", "MAPPING"),
    Target("layer2", "int_customer_protected", "IDENTITY"),
    Target("layer2", "int_customer_events_resolved", "FACT"),
    Target("layer2", "int_customer_services_resolved", "SERVICE"),
    Target("layer2", "int_invoices_resolved", "FACT"),
    Target("layer3", "dim_customer", "DIMENSION"),
    Target("layer3", "dim_service", "DIMENSION"),
    Target("layer3", "fct_customer_event", "FACT"),
    Target("layer3", "fct_invoice", "FACT"),
    Target("layer3_case", "case_dim_customer", "CASE_VIEW"),
    Target("layer3_case", "case_dim_service", "CASE_VIEW"),
    Target("layer3_case", "case_fct_customer_event", "CASE_VIEW"),
    Target("layer3_case", "case_fct_invoice", "CASE_VIEW"),
)

# The teaching variant's six targets.
TEACHING_TARGETS = (
    Target("layer1", "int_current_customers", "IDENTITY"),
    Target("priva_map", "demo_customer_map", "MAPPING"),
    Target("layer2", "int_customer_protected", "IDENTITY"),
    Target("layer2", "int_invoices_resolved", "FACT"),
    Target("layer1", "quarantine_invoices", "QUARANTINE"),
    Target("layer3", "dim_customer", "DIMENSION"),
)

REGISTRY_SCHEMA = (
    "target_layer string, target_relation string, target_kind string, "
    "full_deletion_action string, special_deletion_action string"
)


def target_rows(targets: Sequence[Target] = TARGETS) -> list[tuple[str, str, str, str, str]]:
    if not targets:
        raise ValueError("targets must not be empty")
    names = [t.relation for t in targets]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate deletion target in {names}")
    return [t.row() for t in targets]


def target_registry(spark: SparkSession, targets: Sequence[Target] = TARGETS) -> DataFrame:
    return literal_relation(spark, target_rows(targets), REGISTRY_SCHEMA)


def expand_historical_keys(history: DataFrame, stg_customer: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Authorized revisions x every key the customer ever had.

    The feed is reduced to distinct (customer, SSN) pairs before it meets the revisions, so a
    customer with most of the changes contributes only its few SSNs.
    """
    authorized = (
        history.where(F.col("authorization_status") == "AUTHORIZED")
        .select(
            "customer_id",
            "decision_revision_id",
            "deletion_request_id",
            "deletion_mode",
            "deletion_policy_version",
            F.col("recorded_at").alias("authorization_recorded_at"),
            F.col("decided_at").alias("authorized_at"),
        )
    )
    identities = (
        stg_customer.where(F.col("customer_ssn").isNotNull()).select("customer_id", "customer_ssn").distinct()
    )
    return (
        authorized.join(identities, "customer_id", "inner")
        .select(
            "decision_revision_id",
            "deletion_request_id",
            ssn_key(F.col("customer_ssn"), cfg.scheme).alias("customer_key"),
            "deletion_mode",
            "deletion_policy_version",
            "authorization_recorded_at",
            "authorized_at",
        )
        .distinct()
    )


def _with_targets(keys: DataFrame, targets: Sequence[Target]) -> DataFrame:
    """Each row once per target. The registry is a literal array: no join, no shuffle."""
    entries = [
        F.struct(
            F.lit(layer).alias("target_layer"),
            F.lit(relation).alias("target_relation"),
            F.lit(kind).alias("target_kind"),
            F.lit(full).alias("full_deletion_action"),
            F.lit(special).alias("special_deletion_action"),
        )
        for layer, relation, kind, full, special in target_rows(targets)
    ]
    action = F.when(F.col("deletion_mode") == FULL, F.col("target.full_deletion_action")).when(
        F.col("deletion_mode") == SPECIAL, F.col("target.special_deletion_action")
    )
    return (
        keys.withColumn("target", F.explode(F.array(*entries)))
        .withColumn("target_layer", F.col("target.target_layer"))
        .withColumn("target_relation", F.col("target.target_relation"))
        .withColumn("target_kind", F.col("target.target_kind"))
        .withColumn("planned_action", action)
        .withColumn("plan_status", F.lit("AUTHORIZED"))
        .drop("target")
    )


def plan_changes(
    history: DataFrame,
    stg_customer: DataFrame,
    cfg: PipelineConfig,
    targets: Sequence[Target] = TARGETS,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Planned rows that the existing plan does not have as they are: none where nothing new was decided."""
    keys = expand_historical_keys(history, stg_customer, cfg)
    planned = _with_targets(keys, targets).select(CONTRACTS[PLAN].names)
    if existing is None:
        return planned
    return rows_not_in(planned, existing, CONTROL_KEYS[PLAN])


def rows_not_in(rows: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in existing, or is there with other content."""
    rest = [c for c in rows.columns if c not in keys]
    old = existing.select(*(F.col(c).alias(f"_old_{c}") for c in rows.columns))
    same = F.lit(True)
    for c in keys:
        same = same & (F.col(c) == F.col(f"_old_{c}"))
    for c in rest:
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    return rows.join(old, same, "left_anti")


def deletion_plan(
    history: DataFrame,
    stg_customer: DataFrame,
    cfg: PipelineConfig,
    targets: Sequence[Target] = TARGETS,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Authorized keys x targets with the mode's action, merged over an existing plan."""
    changes = plan_changes(history, stg_customer, cfg, targets, existing)
    return changes if existing is None else merge_by_key(existing, changes, CONTROL_KEYS[PLAN])


def _required_actions(spark: SparkSession, targets: Sequence[Target]) -> DataFrame:
    """Two rows per target (one per mode): its size is fixed by the registry."""
    rows = []
    for number, (layer, relation, kind, full, special) in enumerate(target_rows(targets)):
        rows.append((number, layer, relation, kind, FULL, full))
        rows.append((number, layer, relation, kind, SPECIAL, special))
    return literal_relation(
        spark,
        rows,
        "target_number int, target_layer string, target_relation string, target_kind string, "
        "deletion_mode string, planned_action string",
    )


def complete_plans(plan: DataFrame, targets: Sequence[Target] = TARGETS) -> DataFrame:
    """Plans that cover every target with its exact action.

    Each matched target sets its bit in a mask: a plain hash aggregation that combines map-side and cannot be
    fooled by repeated rows. A registry has at most 63 targets.
    """
    if len(targets) > 63:
        raise ValueError("a registry has at most 63 targets")
    required = F.broadcast(_required_actions(plan.sparkSession, targets))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("target_number"))
    matched = plan.where(F.col("plan_status") == "AUTHORIZED").join(
        required,
        ["target_layer", "target_relation", "target_kind", "deletion_mode", "planned_action"],
        "inner",
    )
    return (
        matched.groupBy(
            "decision_revision_id",
            "deletion_request_id",
            "customer_key",
            "deletion_mode",
            "deletion_policy_version",
        )
        .agg(
            F.min("authorization_recorded_at").alias("authorization_recorded_at"),
            F.min("authorized_at").alias("authorized_at"),
            F.bit_count(F.bit_or(bit)).alias("matched_target_count"),
        )
        .where(F.col("matched_target_count") == len(targets))
    )


# ---- ledger -----------------------------------------------------------------------------------

_EVIDENCE = [
    "decision_revision_id", "deletion_request_id", "deletion_mode", "deletion_policy_version",
    "authorization_recorded_at", "authorized_at",
]


def rank_plans(complete: DataFrame) -> DataFrame:
    """Initial and effective evidence per key, in one aggregation.

    Initial is the oldest recorded plan. Effective puts FULL first, then the newest recorded, then
    the highest revision id. Min and max of an ordered struct combine map-side, so a key with most
    of the plans never becomes one large group.
    """
    oldest = F.min(F.struct("authorization_recorded_at", "decision_revision_id", F.struct(*_EVIDENCE).alias("row")))
    strongest = F.max(
        F.struct(
            (F.col("deletion_mode") == FULL).alias("full"),
            "authorization_recorded_at",
            "decision_revision_id",
            F.struct(*_EVIDENCE).alias("row"),
        )
    )
    ranked = complete.groupBy("customer_key").agg(oldest.alias("initial"), strongest.alias("effective"))
    return ranked.select(
        "customer_key",
        *[F.col(f"effective.row.{c}").alias(c) for c in _EVIDENCE],
        *[F.col(f"initial.row.{c}").alias(f"initial_{c}") for c in _EVIDENCE],
    )


def advance_ledger(candidates: DataFrame, existing: DataFrame | None, cfg: PipelineConfig) -> DataFrame:
    """The ledger rows this run adds or advances.

    A key enters once, may go from SPECIAL to FULL, and may take newer evidence of the same mode.
    It is never downgraded, and its initial evidence and first suppression time never change.
    """
    now = cfg.run_timestamp()
    escalates_at_once = (F.col("initial_deletion_mode") == SPECIAL) & (F.col("deletion_mode") == FULL)
    if existing is None:
        fresh = candidates.withColumn("suppression_recorded_at", now).withColumn(
            "mode_escalated_at", F.when(escalates_at_once, now)
        )
        return fresh.select(CONTRACTS[LEDGER].names)

    kept = [f"initial_{c}" for c in _EVIDENCE] + ["suppression_recorded_at", "mode_escalated_at"]
    compared = ["deletion_mode", "authorization_recorded_at", "decision_revision_id"]
    old = existing.select(
        "customer_key",
        F.lit(True).alias("old_present"),
        *[F.col(c).alias(f"old_{c}") for c in compared + kept],
    )
    joined = candidates.join(old, "customer_key", "left")

    is_new = F.col("old_present").isNull()
    escalates = (F.col("old_deletion_mode") == SPECIAL) & (F.col("deletion_mode") == FULL)
    newer = (F.col("authorization_recorded_at") > F.col("old_authorization_recorded_at")) | (
        (F.col("authorization_recorded_at") == F.col("old_authorization_recorded_at"))
        & (F.col("decision_revision_id") > F.col("old_decision_revision_id"))
    )
    same_mode = F.col("old_deletion_mode") == F.col("deletion_mode")
    accepted = joined.where(is_new | escalates | (same_mode & newer))

    advanced = {f"initial_{c}": F.coalesce(f"old_initial_{c}", f"initial_{c}") for c in _EVIDENCE}
    advanced["suppression_recorded_at"] = F.coalesce(F.col("old_suppression_recorded_at"), now)
    advanced["mode_escalated_at"] = F.when((is_new & escalates_at_once) | escalates, now).otherwise(
        F.col("old_mode_escalated_at")
    )
    return accepted.withColumns(advanced).select(CONTRACTS[LEDGER].names)


def ledger_changes(
    plan: DataFrame,
    existing: DataFrame | None,
    cfg: PipelineConfig,
    targets: Sequence[Target] = TARGETS,
    changed_plan: DataFrame | None = None,
) -> DataFrame:
    """Gate, rank, advance: the ledger rows of this run. With the rows of the plan that changed, only their keys are judged.

    Plan and ledger are switched together, so a key whose plan has not changed has its evidence in the ledger already.
    """
    if existing is not None and changed_plan is not None:
        plan = plan.join(changed_plan.select("customer_key").distinct(), "customer_key", "left_semi")
    return advance_ledger(rank_plans(complete_plans(plan, targets)), existing, cfg)


def merged_ledger(
    plan: DataFrame,
    existing: DataFrame | None,
    cfg: PipelineConfig,
    targets: Sequence[Target] = TARGETS,
    changed_plan: DataFrame | None = None,
) -> DataFrame:
    """The ledger after this run."""
    changes = ledger_changes(plan, existing, cfg, targets, changed_plan)
    return changes if existing is None else merge_by_key(existing, changes, ["customer_key"])


# ---- teaching variant: snapshot controls on raw SSNs ------------------------------------------

def detect_requests_snapshot(stg_customer: DataFrame) -> DataFrame:
    """Requests rebuilt on every run, without a ledger of earlier detections."""
    return stg_customer.where(F.col("source_operation") == "DELETE").select(
        F.col("customer_change_id").alias("deletion_request_id"),
        "customer_id",
        "customer_ssn",
        F.col("source_updated_at").alias("source_deleted_at"),
        F.lit("DETECTED").alias("detection_status"),
    )


def latest_authorization(requests: DataFrame, decisions: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Rank first, then classify only the latest revision; an unknown status is INVALID here."""
    hold = F.col("legal_hold")
    outcome = (
        F.when(F.col("decision_revision_id").isNull(), "PENDING")
        .when(hold.isNull(), "INVALID")
        .when(hold, "HELD")
        .when(_complete_confirmation(cfg.policy_version), "AUTHORIZED")
        .when(F.col("decision_status") == "REJECTED", "REJECTED")
        .otherwise("INVALID")
    )
    joined = requests.join(_latest_revision(decisions), "deletion_request_id", "left")
    return joined.withColumn("authorization_status", outcome).select(
        "deletion_request_id",
        "customer_id",
        "customer_ssn",
        "source_deleted_at",
        "decision_revision_id",
        F.coalesce("decision_status", F.lit("PENDING")).alias("decision_status"),
        "deletion_mode",
        "deletion_policy_version",
        "recorded_at",
        "decided_at",
        "legal_hold",
        "authorization_status",
    )


def snapshot_plan(
    authorized: DataFrame, stg_customer: DataFrame, targets: Sequence[Target] = TEACHING_TARGETS
) -> DataFrame:
    identities = (
        stg_customer.where(F.col("customer_ssn").isNotNull()).select("customer_id", "customer_ssn").distinct()
    )
    keys = (
        authorized.where(F.col("authorization_status") == "AUTHORIZED")
        .select(
            "customer_id",
            "deletion_request_id",
            "deletion_mode",
            "deletion_policy_version",
            F.col("decided_at").alias("authorized_at"),
        )
        .join(identities, "customer_id", "inner")
    )
    return _with_targets(keys, targets).select(
        "deletion_request_id",
        "customer_ssn",
        "deletion_mode",
        "deletion_policy_version",
        "target_layer",
        "target_relation",
        "planned_action",
        "plan_status",
        "authorized_at",
    )


def effective_modes(plan: DataFrame, targets: Sequence[Target] = TEACHING_TARGETS) -> DataFrame:
    """One mode per identity from complete requests; FULL wins over SPECIAL."""
    required = F.broadcast(_required_actions(plan.sparkSession, targets).drop("target_kind"))
    per_request = (
        plan.where((F.col("plan_status") == "AUTHORIZED") & F.col("customer_ssn").isNotNull())
        .join(required, ["target_layer", "target_relation", "deletion_mode", "planned_action"], "inner")
        .groupBy("deletion_request_id", "customer_ssn", "deletion_mode")
        .agg(F.size(F.collect_set("target_number")).alias("matched_target_count"))
        .where(F.col("matched_target_count") == len(targets))
    )
    any_full = F.max(F.col("deletion_mode") == FULL)
    return per_request.groupBy("customer_ssn").agg(
        F.when(any_full, FULL).otherwise(SPECIAL).alias("deletion_mode")
    )
