"""Executable audits: each returns the violating rows, empty means it passed."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.config import FULL, DEMO_SCHEME, Persona, PipelineConfig
from veilwright.functions.keys import canonicalize, framed_hash, packed, personal_data_key, unpacked
from veilwright.operators import controls, maps
from veilwright.operators.policy import attach_deletion_mode
from veilwright.schemas import CONTRACTS
from veilwright.sources.tables import literal_relation, union_all

# Readable names that must not appear in protected layers.
FORBIDDEN_COLUMNS = (
    "customer_ssn", "customer_id", "first_name", "last_name", "full_name", "email", "phone",
    "birth_date", "address", "installation_address",
)
READABLE_STATES = ("RAW", "CONTROLLED_READABLE")


# ---- column rules -----------------------------------------------------------------------------

def audit_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with nulls and how many, all counted in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    listed = counts.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rows")) for c in columns])
        )
    )
    return listed.where(F.col("null_rows") > 0)


def audit_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counted = df.groupBy(*columns).agg(F.count("*").alias("row_count"))
    return counted.where(F.col("row_count") > 1)


def audit_accepted(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values outside the list, with their row counts; null is left to the not-null audit."""
    bad = df.where(~F.col(column).isin(*values))
    return bad.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("row_count"))


def audit_fk(
    child: DataFrame, column: str, parent: DataFrame, parent_column: str, where: Column | None = None
) -> DataFrame:
    """Child values without a parent row. Child values are made distinct before the join."""
    rows = child if where is None else child.where(where)
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    parents = parent.select(F.col(parent_column).alias("value"))
    return values.join(parents, "value", "left_anti")


# ---- comparisons ------------------------------------------------------------------------------

#: Ranges that two relations are digested by before rows are compared: so many small rows a task, and at most so many to broadcast.
DIGEST_RANGES = 4_096


def _hash(columns: Sequence[str], seed: int) -> Column:
    """Of a row's values and of which of them are null, which the values' hash alone passes over."""
    return F.xxhash64(F.lit(seed), F.array(*(F.col(c).isNull() for c in columns)), *(F.col(c) for c in columns))


def _range(by: Sequence[str]) -> Column:
    return F.pmod(_hash(by, 0), F.lit(DIGEST_RANGES)).cast("int")


def _differing(a: DataFrame, b: DataFrame, group: Column) -> DataFrame:
    """Values of ``group`` (an aliased column) for which the two relations are not the same bag of rows.

    The digest of a group is the number of its rows and the sums of the halves of two 64-bit hashes of them, whatever their
    order: b's are taken off a's, and what is left is not zero. Tasks add up their rows before the exchange.
    """
    half = F.lit((1 << 32) - 1)

    def side(df: DataFrame, sign: int) -> DataFrame:
        hashed = df.select(group.alias("_group"), *(_hash(a.columns, i).alias(f"_h{i}") for i in (1, 2)))
        parts = [F.lit(sign).cast("bigint").alias("_n")]
        for i in (1, 2):
            parts.append((sign * F.col(f"_h{i}").bitwiseAND(half)).alias(f"_low{i}"))
            parts.append((sign * F.shiftrightunsigned(f"_h{i}", 32)).alias(f"_high{i}"))
        return hashed.select("_group", *parts)

    both = side(a, 1).unionAll(side(b.select(a.columns), -1))
    names = both.columns[1:]
    left = both.groupBy("_group").agg(*(F.sum(c).alias(c) for c in names))
    return left.where(" or ".join(f"{c} <> 0" for c in names)).select("_group")


def differing_ranges(a: DataFrame, b: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Ranges (of a hash of the ``by`` columns, else of the row) in which the two relations are not the same bag of rows."""
    return _differing(a, b, _range(by or a.columns)).withColumnRenamed("_group", "_range")


def differing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` (null is one) for which the two relations are not the same bag of rows.

    Ranges of keys are compared first; keys are digested only in ranges that differ.
    """
    return _differing(*_where_differing(a, b, [key]), F.col(key)).withColumnRenamed("_group", key)


def _where_differing(a: DataFrame, b: DataFrame, by: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both relations' rows in ranges whose digests differ: none, and none shuffled, where they are equal."""
    ranges = F.broadcast(differing_ranges(a, b, by))
    here = _range(by or a.columns)
    return tuple(df.select(a.columns).join(ranges, here == F.col("_range"), "left_semi") for df in (a, b))


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both relations with their counts on either side, in one aggregation; only of ranges that differ."""
    a, b = _where_differing(a, b)
    both = a.withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(
        b.withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1))
    )
    return both.groupBy(*a.columns).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))


def audit_same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symmetric set difference; MISSING rows are only in ``a``, UNEXPECTED only in ``b``."""
    sides = _sides(a, b).where((F.col("_a") == 0) | (F.col("_b") == 0))
    side = F.when(F.col("_b") == 0, "MISSING").otherwise("UNEXPECTED")
    return sides.select(side.alias("difference_type"), *a.columns)


def audit_same_bag(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symmetric bag difference: each distinct row with its number of surplus copies."""
    surplus = F.col("_a") - F.col("_b")
    side = F.when(surplus > 0, "MISSING").otherwise("UNEXPECTED")
    return _sides(a, b).where(surplus != 0).select(
        side.alias("difference_type"), *a.columns, F.abs(surplus).alias("surplus_rows")
    )


def audit_partition(expected: DataFrame, outputs: Iterable[DataFrame], key: str) -> DataFrame:
    """Keys that do not appear exactly as often over all outputs as expected.

    ``expected`` has the key and ``expected_occurrence_count``. Both sides are tagged, united and
    counted once, instead of a count followed by a full outer join.
    """
    wanted = expected.select(
        F.col(key).alias("record_key"),
        F.col("expected_occurrence_count").cast("bigint").alias("wanted"),
        F.lit(1).alias("source_rows"),
        F.lit(0).alias("found"),
    )
    found = [
        o.select(
            F.col(key).alias("record_key"),
            F.lit(None).cast("bigint").alias("wanted"),
            F.lit(0).alias("source_rows"),
            F.lit(1).alias("found"),
        )
        for o in outputs
    ]
    counted = union_all([wanted, *found]).groupBy("record_key").agg(
        F.max("wanted").alias("expected_occurrence_count"),
        F.sum("source_rows").alias("source_rows"),
        F.sum("found").alias("actual_occurrence_count"),
    )
    broken = (F.col("source_rows") == 0) | (
        F.col("actual_occurrence_count") != F.col("expected_occurrence_count")
    )
    return counted.where(broken).select("record_key", "expected_occurrence_count", "actual_occurrence_count")


def expected_occurrences(keyed: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Each source row once, FULL rows not at all."""
    annotated = attach_deletion_mode(keyed, ledger, "customer_key", [key])
    wanted = F.when(F.col("deletion_mode") == FULL, 0).otherwise(1)
    return annotated.select(key, wanted.alias("expected_occurrence_count"))


def audit_tuple(child: DataFrame, parent: DataFrame, columns: Sequence[str], extra: Column | None = None) -> DataFrame:
    """Child tuples that the parent does not contain; ``extra`` may compare ``child.x`` with ``parent.y``."""
    left, right = child.alias("child"), parent.alias("parent")
    condition = F.lit(True) if extra is None else extra
    for c in columns:
        condition = condition & (F.col(f"child.{c}") == F.col(f"parent.{c}"))
    return left.join(right, condition, "left_anti")


def audit_projection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose rows differ in any column of ``a``, or exist on one side only; only ranges of keys that differ are joined."""
    a, b = _where_differing(a, b, [key])
    columns = [c for c in a.columns if c != key]
    left = a.select(F.col(key), F.struct(*columns).alias("a_row"))
    right = b.select(F.col(key), F.struct(*columns).alias("b_row"))
    return left.join(right, key, "outer").where(~F.col("a_row").eqNullSafe(F.col("b_row"))).select(key)


def audit_schema(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Column names that are missing or unexpected."""
    rows = [(n, "MISSING") for n in names if n not in df.columns]
    rows += [(n, "UNEXPECTED") for n in df.columns if n not in names]
    return literal_relation(df.sparkSession, rows, "column_name string, difference_type string")


def audit_allowlist(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing and unexpected entries of an allowlist, such as grants."""
    sides = _sides(expected.select(*keys), actual.select(*keys))
    return sides.where((F.col("_a") == 0) | (F.col("_b") == 0)).select(
        *keys, (F.col("_a") == 0).alias("is_unexpected"), (F.col("_b") == 0).alias("is_missing")
    )


# ---- deletion rules ---------------------------------------------------------------------------

def audit_deleted_absent(relations: Mapping[str, DataFrame], ledger: DataFrame) -> DataFrame:
    """Ledger keys still visible in any of the relations, with row counts."""
    visible = union_all(
        packed(df.select(F.lit(name).alias("relation"), "customer_key"), "customer_key") for name, df in relations.items()
    )
    counted = visible.groupBy("relation", "customer_key").agg(F.count("*").alias("row_count"))
    deleted = packed(ledger.select("customer_key"), "customer_key")
    return unpacked(counted.join(deleted, "customer_key", "left_semi"), "customer_key").select("relation", "customer_key", "row_count")


def audit_erased_members(
    dim_customer: DataFrame, dim_service: DataFrame, events: DataFrame, invoices: DataFrame, cfg: PipelineConfig
) -> DataFrame:
    """One special member per dimension, and flag and sentinel keys equivalent in both facts."""

    def member(df: DataFrame, label: str, flag: str, name: str) -> DataFrame:
        test = (F.col(label) == "ERASED_SUBJECT") & ~F.col(flag)
        for c in df.columns:
            if c.endswith("_key"):
                test = test & (F.col(c) == cfg.erased())
        counted = df.agg(F.count_if(test).alias("n"))
        return counted.where(F.col("n") != 1).select(F.lit(name).alias("invariant"))

    def equivalence(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        any_plain, any_erased = F.lit(False), F.lit(False)
        for c in keys:
            any_plain = any_plain | (F.col(c) != cfg.erased())
            any_erased = any_erased | (F.col(c) == cfg.erased())
        flag = F.col("is_erased_customer")
        broken = F.count_if((flag & any_plain) | (~flag & any_erased))
        return df.agg(broken.alias("n")).where(F.col("n") > 0).select(F.lit(name).alias("invariant"))

    return union_all(
        [
            member(dim_customer, "customer_segment", "is_active", "dim_customer_special_member"),
            member(dim_service, "service_type", "is_valid", "dim_service_special_member"),
            equivalence(events, ["customer_key"], "event_flag_key_equivalence"),
            equivalence(
                invoices, ["customer_key", "service_key", "service_version_key"], "invoice_flag_key_equivalence"
            ),
        ]
    )


def expected_plan(
    history: DataFrame, stg_customer: DataFrame, cfg: PipelineConfig, targets=controls.TARGETS
) -> DataFrame:
    """The plan written anew from its rule, without the functions that build it.

    Every authorized revision, each number its customer has ever had, each target, with the
    action the target's kind of relation calls for.
    """
    identities = stg_customer.groupBy("customer_id", "customer_ssn").agg(F.count("*").alias("changes"))
    keyed = identities.where("customer_ssn is not null").select(
        "customer_id", personal_data_key(F.col("customer_ssn"), "customer.ssn", cfg.scheme, "ssn").alias("customer_key")
    )
    revisions = history.where("authorization_status = 'AUTHORIZED'").join(keyed, "customer_id")
    placed = []
    for t in targets:
        fact, view = t.model_type.upper() == "FACT", t.model_type.upper() == "CASE_VIEW"
        full = "EXCLUDE_DELETED_ROWS" if view else "DELETE_CURRENT_ROWS"
        special = "EXCLUDE_ERASED_ROWS" if view else "REASSIGN_TO_ERASED_MEMBER" if fact else "DELETE_CURRENT_ROWS"
        fields = {"layer": t.layer, "relation": t.relation, "kind": "VIEW" if view else "TABLE", "full": full, "special": special}
        placed.append(F.struct(*[F.lit(v).alias(k) for k, v in fields.items()]))
    return revisions.withColumn("t", F.explode(F.array(*placed))).select(
        "decision_revision_id",
        "deletion_request_id",
        "customer_key",
        "deletion_mode",
        "deletion_policy_version",
        F.col("t.layer").alias("target_layer"),
        F.col("t.relation").alias("target_relation"),
        F.col("t.kind").alias("target_kind"),
        F.expr(f"if(deletion_mode = '{FULL}', t.full, t.special)").alias("planned_action"),
    )


def audit_plan(
    plan: DataFrame, history: DataFrame, stg_customer: DataFrame, cfg: PipelineConfig, targets=controls.TARGETS
) -> DataFrame:
    """The plan against one written anew from the authorized revisions, both ways."""
    wanted = expected_plan(history, stg_customer, cfg, targets)
    return audit_same_rows(wanted, plan.select(wanted.columns))


def plan_metrics(plan: DataFrame) -> DataFrame:
    """Distinct targets per mode and action."""
    return plan.groupBy("deletion_mode", "planned_action").agg(
        F.size(F.collect_set(F.concat_ws(".", "target_layer", "target_relation"))).alias("targets"),
        F.count("*").alias("plan_rows"),
    )


def ledger_metrics(ledger: DataFrame) -> DataFrame:
    """One row of ledger counts per effective and initial mode."""
    incomplete = (
        F.col("authorized_at").isNull()
        | F.col("suppression_recorded_at").isNull()
        | F.col("deletion_policy_version").isNull()
        | F.col("decision_revision_id").isNull()
        | F.col("initial_decision_revision_id").isNull()
    )
    return ledger.groupBy("deletion_mode", "initial_deletion_mode").agg(
        F.count("*").alias("ledger_keys"),
        F.count_if(F.col("mode_escalated_at").isNotNull()).alias("escalated_keys"),
        F.count_if(incomplete).alias("incomplete_keys"),
        F.count_if(F.col("decision_revision_id") != F.col("initial_decision_revision_id")).alias("advanced_keys"),
    )


def audit_pending_untouched(
    authorizations: DataFrame,
    plan: DataFrame,
    ledger: DataFrame,
    stg_customer: DataFrame,
    cfg: PipelineConfig,
    outputs: Mapping[str, tuple[DataFrame, DataFrame]],
) -> DataFrame:
    """What a request without an authorized revision has nevertheless changed.

    One finding per request that entered plan or ledger, and one per output and customer key of
    such a request whose row counts differ. ``outputs`` gives each output as (rows, the rows there would be without
    any request), both with ``customer_key``; keys that another request has put in the ledger are left out.
    """
    pending = authorizations.where(F.col("authorization_status") != "AUTHORIZED")
    authorized = authorizations.where(F.col("authorization_status") == "AUTHORIZED").select("customer_id")
    admitted = union_all(
        [
            plan.select("deletion_request_id").distinct(),
            ledger.select(F.explode(F.array("deletion_request_id", "initial_deletion_request_id")).alias("deletion_request_id")),
        ]
    )
    entered = pending.where(F.col("authorization_status") == "PENDING").join(admitted, "deletion_request_id", "left_semi")
    keys = (
        stg_customer.where(F.col("customer_ssn").isNotNull())
        .join(pending.select("customer_id"), "customer_id", "left_semi")
        .join(authorized, "customer_id", "left_anti")
        .select(personal_data_key(F.col("customer_ssn"), "customer.ssn", cfg.scheme, "ssn").alias("customer_key"))
        .distinct()
        .join(ledger.select("customer_key"), "customer_key", "left_anti")
    )
    keys = packed(keys, "customer_key")
    sides = [
        packed(df.select("customer_key"), "customer_key").select("customer_key", F.lit(name).alias("relation"), F.lit(1 - i).alias("found"), F.lit(i).alias("wanted"))
        for name, pair in outputs.items()
        for i, df in enumerate(pair)
    ]
    counted = union_all(sides).groupBy("relation", "customer_key").agg(
        F.sum("wanted").alias("expected_rows"), F.sum("found").alias("actual_rows")
    )
    changed = unpacked(counted.where("expected_rows <> actual_rows").join(keys, "customer_key", "left_semi"), "customer_key")
    none = F.lit(None).cast("bigint")
    return entered.select(
        F.lit("plan").alias("relation"), F.col("deletion_request_id").alias("subject"), none.alias("expected_rows"), none.alias("actual_rows")
    ).unionByName(changed.select("relation", F.col("customer_key").alias("subject"), "expected_rows", "actual_rows"))


def control_states(authorizations: DataFrame, ledger: DataFrame, stg_customer: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Each deletion request with its named state and how many of its customer's keys are suppressed."""
    identities = stg_customer.where(F.col("customer_ssn").isNotNull()).select(
        "customer_id", personal_data_key(F.col("customer_ssn"), "customer.ssn", cfg.scheme, "ssn").alias("customer_key")
    ).distinct()
    per_customer = (
        identities.join(ledger.select("customer_key", "deletion_mode", "mode_escalated_at"), "customer_key", "left")
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("keys"),
            F.count("deletion_mode").alias("suppressed_keys"),
            F.count_if(F.col("deletion_mode") == FULL).alias("full_keys"),
            F.count("mode_escalated_at").alias("escalated_keys"),
        )
    )
    status = F.col("authorization_status")
    state = (
        F.when(status != "AUTHORIZED", status)
        .when(F.col("suppressed_keys") < F.col("keys"), "NOT_SUPPRESSED")
        .when(F.col("full_keys") == 0, "SPECIAL")
        .when(F.col("full_keys") < F.col("keys"), "MIXED")
        .when(F.col("escalated_keys") > 0, "ESCALATED_TO_FULL")
        .otherwise("FULL")
    )
    return authorizations.join(per_customer, "customer_id", "left").select(
        "deletion_request_id", state.alias("state"), F.coalesce("suppressed_keys", F.lit(0).cast("bigint")).alias("suppressed_keys")
    )


def audit_control_states(states: DataFrame, expected: DataFrame) -> DataFrame:
    """Requests whose named state is not the expected one; both have (deletion_request_id, state)."""
    wanted = expected.select("deletion_request_id", F.col("state").alias("expected_state"))
    found = states.select("deletion_request_id", F.col("state").alias("actual_state"))
    return wanted.join(found, "deletion_request_id", "outer").where(
        ~F.col("expected_state").eqNullSafe(F.col("actual_state"))
    )


# ---- counts and facts -------------------------------------------------------------------------

def row_counts(relations: Mapping[str, DataFrame]) -> DataFrame:
    return union_all(
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("relation"), "row_count")
        for name, df in relations.items()
    )


def audit_row_bounds(relations: Mapping[str, DataFrame], low: int, high: int) -> DataFrame:
    return row_counts(relations).where(~F.col("row_count").between(low, high))


def audit_counts(pairs: Mapping[str, tuple[DataFrame, DataFrame, int]]) -> DataFrame:
    """Relations whose row count is not the other relation's count plus a fixed number of rows."""
    actual = row_counts({name: a for name, (a, _, _) in pairs.items()})
    expected = union_all(
        b.agg((F.count("*") + extra).alias("expected_count")).select(F.lit(name).alias("relation"), "expected_count")
        for name, (_, b, extra) in pairs.items()
    )
    return actual.join(expected, "relation", "inner").where(F.col("row_count") != F.col("expected_count"))


def audit_due(invoices: DataFrame, cfg: PipelineConfig) -> DataFrame:
    again = ~F.col("is_paid") & (F.col("due_date") <= F.lit(cfg.as_of_date).cast("date"))
    return invoices.where(~F.col("is_due").eqNullSafe(again)).select("invoice_id")


def audit_payment(fact: DataFrame) -> DataFrame:
    """Accepted invoices must be consistent about payment and dates."""
    paid, paid_key = F.col("is_paid"), F.col("paid_date_key")
    broken = (
        (F.col("due_date_key") < F.col("issue_date_key"))
        | (paid & paid_key.isNull())
        | (~paid & paid_key.isNotNull())
        | (paid_key < F.col("issue_date_key"))
    )
    return fact.where(broken).select("invoice_key")


def audit_fact_integrity(
    events: DataFrame, fct_event: DataFrame, invoices: DataFrame, fct_invoice: DataFrame
) -> DataFrame:
    """Keys of fact rows that are missing, unexpected, or differ from the accepted rows in any column."""

    def day(column: str) -> Column:
        return F.expr(f"year({column}) * 10000 + month({column}) * 100 + day({column})").cast("int")

    wanted_events = events.select(
        F.col("event_id").alias("record_key"),
        F.struct("customer_key", "event_type", day("occurred_at").alias("d"), "occurred_at", "measure_value", "measure_unit", "is_erased_customer").alias("row"),
    )
    found_events = fct_event.select(
        F.col("event_key").alias("record_key"),
        F.struct("customer_key", "event_type", F.col("event_date_key").alias("d"), "occurred_at", "measure_value", "measure_unit", "is_erased_customer").alias("row"),
    )
    shared = ["customer_key", "service_key", "service_version_key", "amount", "currency_code", "is_paid", "is_due", "is_erased_customer"]
    wanted_invoices = invoices.select(
        F.col("invoice_id").alias("record_key"),
        F.struct(*shared, day("issued_date").alias("i"), day("due_date").alias("d"), day("paid_at").alias("p")).alias("row"),
    )
    found_invoices = fct_invoice.select(
        F.col("invoice_key").alias("record_key"),
        F.struct(*shared, F.col("issue_date_key").alias("i"), F.col("due_date_key").alias("d"), F.col("paid_date_key").alias("p")).alias("row"),
    )

    def differing(name: str, wanted: DataFrame, found: DataFrame) -> DataFrame:
        return audit_same_rows(wanted, found).select(F.lit(name).alias("relation"), "record_key").distinct()

    return union_all(
        [
            differing("fct_customer_event", wanted_events, found_events),
            differing("fct_invoice", wanted_invoices, found_invoices),
        ]
    )


def audit_map_sources(
    stg_customer: DataFrame,
    stg_services: DataFrame,
    suppressed: DataFrame,
    customer_map: DataFrame,
    service_map: DataFrame,
) -> DataFrame:
    """Readable maps against the trusted source, rebuilt from raw identifiers without the key function.

    ``suppressed`` has the normalized numbers behind the ledger. Per map and kind of difference, the number of rows.
    """

    def normalized(column: str) -> Column:
        return F.replace(F.trim(column), F.lit("-"), F.lit(""))

    numbers = suppressed.select(F.col("normalized_ssn").alias("number"))
    current = maps.latest_upserts(stg_customer).where("is_active").withColumn("number", normalized("customer_ssn"))
    current = current.join(numbers, "number", "left_anti")
    customers = maps.readable_customer_values(current)
    readable = [c for c in customers.columns if c in customer_map.columns and c.endswith("_value")]
    services = (
        stg_services.where("is_valid and valid_to >= valid_from")
        .withColumn("number", normalized("customer_ssn"))
        .join(current.select("number").distinct(), "number", "left_semi")
        .select(
            F.col("service_id").alias("service_id_value"),
            F.col("customer_ssn").alias("customer_ssn_value"),
            maps.installation_address().alias("installation_address_value"),
            "service_type",
            "valid_from",
            "valid_to",
        )
    )
    checks = [
        ("fa_pd_customer", customers.select(readable), customer_map.select(readable)),
        ("fa_pd_service_address", services, service_map.select(services.columns)),
    ]
    return union_all(
        audit_same_bag(wanted, found)
        .groupBy("difference_type")
        .agg(F.sum("surplus_rows").alias("row_count"))
        .select(F.lit(name).alias("relation"), "difference_type", "row_count")
        for name, wanted, found in checks
    )


# ---- access -----------------------------------------------------------------------------------

GRANT_COLUMNS = ["grantee", "table_schema", "table_name"]


def audit_relation_grants(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Granted reads that the matrix does not have, and reads of the matrix that are not granted."""
    return audit_allowlist(expected, actual.where("privilege = 'SELECT'"), GRANT_COLUMNS)


def audit_parent_privileges(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Schema use that a grantee has without a relation to read in it, or lacks although it has one."""
    schemas = ["grantee", "table_schema"]
    return audit_allowlist(expected, actual.where("privilege = 'USE SCHEMA'"), schemas)


def audit_ambient_grants(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Any privilege of a grantee that the matrix does not know, and privileges other than reading and use."""
    known = expected.select("grantee").distinct()
    ambient = actual.join(known, "grantee", "left_anti")
    strong = actual.where(~F.col("privilege").isin("SELECT", "USE SCHEMA")).join(known, "grantee", "left_semi")
    return ambient.unionByName(strong).select("grantee", "privilege", "table_schema", "table_name")


def audit_evidence_access(actual: DataFrame, relations: Sequence[str], keepers: Sequence[str]) -> DataFrame:
    """Privileges on evidence relations for anyone but their keepers."""
    evidence = F.col("table_name").isin(*relations)
    return actual.where(evidence & ~F.col("grantee").isin(*keepers)).select("grantee", "privilege", "table_name")


# ---- schemas and tags -------------------------------------------------------------------------

def schema_rows(spark: SparkSession, relations: Mapping[str, DataFrame]) -> DataFrame:
    """Columns of the relations with their tags, as rows; it grows with columns, not with data."""
    rows = [
        (
            name,
            f.name,
            f.metadata.get("personal_data_category"),
            f.metadata.get("personal_data_state"),
            f.metadata.get("mask_column"),
        )
        for name, df in relations.items()
        for f in df.schema.fields
    ]
    return literal_relation(
        spark,
        rows,
        "table_name string, column_name string, personal_data_category string, "
        "personal_data_state string, mask_column string",
    )


def audit_columns(schemas: DataFrame) -> DataFrame:
    """Readable column names in a protected layer."""
    name = F.col("column_name")
    readable = name.endswith("_value") & (name != "measure_value")
    return schemas.where(readable | name.isin(*FORBIDDEN_COLUMNS)).select("table_name", "column_name")


def audit_column_metadata(
    spark: SparkSession, expected: Mapping[str, Mapping[str, Mapping[str, str]]], schemas: DataFrame
) -> DataFrame:
    """Exact tag and mask inventory, and every RAW column masked."""
    names = ["personal_data_category", "personal_data_state", "mask_column"]
    wanted = literal_relation(
        spark,
        [(t, c, *[tags.get(n) for n in names]) for t, cols in expected.items() for c, tags in cols.items()],
        "table_name string, column_name string, " + ", ".join(f"{n} string" for n in names),
    )
    tagged = schemas.where(F.coalesce(*[F.col(n) for n in names]).isNotNull())
    return audit_same_rows(wanted, tagged)


def audit_unmasked_raw(schemas: DataFrame) -> DataFrame:
    """RAW columns without a mask, and masked columns that are not RAW."""
    raw = F.coalesce(F.col("personal_data_state") == "RAW", F.lit(False))
    return schemas.where(raw != F.col("mask_column").isNotNull()).select("table_name", "column_name")


def audit_no_readable(schemas: DataFrame) -> DataFrame:
    return schemas.where(F.col("personal_data_state").isin(*READABLE_STATES)).select(
        "table_name", "column_name", "personal_data_state"
    )


# ---- keys -------------------------------------------------------------------------------------

def audit_key_contract(df: DataFrame, column: str, cfg: PipelineConfig) -> DataFrame:
    """Key rules checked on every value of a text column; rows that break any rule."""
    value = F.col(column)
    key = personal_data_key(value, "customer.email", cfg.scheme)
    other = personal_data_key(value, "customer.full_name", cfg.scheme)
    spaced = personal_data_key(F.concat(F.lit(" "), F.lower(value), F.lit(" ")), "customer.email", cfg.scheme)
    core = framed_hash(canonicalize(value), "customer.email", cfg.scheme)
    demo = personal_data_key(value, "customer.email", DEMO_SCHEME)
    empty = canonicalize(value).isNull()
    rules = {
        "deterministic": key.eqNullSafe(personal_data_key(value, "customer.email", cfg.scheme)),
        "domain_separated": empty | (key != other),
        "version_separated": empty | (key != demo),
        "null_preserved": ~empty | key.isNull(),
        "version_prefixed": empty | key.startswith("v1:"),
        "canonical_equivalence": key.eqNullSafe(spaced),
        "core_matches_wrapper": key.eqNullSafe(core),
    }
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(rule)) for rule, ok in rules.items()]))
    return df.select(value.alias("value"), F.explode(failed).alias("rule")).groupBy("rule").agg(
        F.count("*").alias("row_count")
    )


def audit_key_format(customers: DataFrame, services: DataFrame, version: str = "v1") -> DataFrame:
    """Counts of badly versioned keys and of keys that collide across domains, per map."""
    key_columns = [c for c in customers.columns if c.endswith("_key")]
    bad = F.lit(False)
    for c in key_columns:
        bad = bad | ~F.col(c).rlike(f"^{version}:[0-9a-f]{{64}}$")
    collide = (
        (F.col("customer_key") == F.col("customer_id_key"))
        | (F.col("customer_key") == F.col("email_key"))
        | (F.col("customer_id_key") == F.col("email_key"))
    )
    bad_service = ~F.col("service_version_key").rlike(f"^{version}:[0-9a-f]{{64}}$")
    return union_all(
        [
            customers.agg(
                F.lit("fa_pd_customer").alias("relation"),
                F.count("*").alias("row_count"),
                F.count_if(bad).alias("invalid_version_count"),
                F.count_if(collide).alias("domain_collision_count"),
            ),
            services.agg(
                F.lit("fa_pd_service_address").alias("relation"),
                F.count("*").alias("row_count"),
                F.count_if(bad_service).alias("invalid_version_count"),
                F.lit(0).cast("bigint").alias("domain_collision_count"),
            ),
        ]
    )


def audit_keys_unpivot(mapped: DataFrame) -> DataFrame:
    """Customers whose non-null keys are not all different, from one unpivot."""
    keys = [c for c in CONTRACTS["int_customer_protected"].names if c.endswith("_key")]
    long = mapped.select(F.col("customer_id_value").alias("id"), *keys).unpivot(["id"], keys, "key_name", "key_value")
    counted = long.where(F.col("key_value").isNotNull()).groupBy("id").agg(
        F.count("*").alias("key_count"), F.size(F.collect_set("key_value")).alias("distinct_keys")
    )
    return counted.where(F.col("key_count") != F.col("distinct_keys"))


# ---- state, personas, summaries ---------------------------------------------------------------

def audit_metrics(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Named counts that differ from their expected values; both have (metric, value)."""
    wanted = expected.select("metric", F.col("value").alias("expected"))
    found = actual.select("metric", F.col("value").alias("actual"))
    return wanted.join(found, "metric", "outer").where(~F.col("expected").eqNullSafe(F.col("actual")))


def metrics(spark: SparkSession, named: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One named aggregate per entry; all entries of one relation are aggregated in one pass."""
    passes: dict[int, tuple[DataFrame, dict[str, Column]]] = {}
    for name, (df, value) in named.items():
        passes.setdefault(id(df), (df, {}))[1][name] = value.cast("bigint")
    out = []
    for df, values in passes.values():
        row = df.agg(*[v.alias(n) for n, v in values.items()])
        pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in values])
        out.append(row.select(F.inline(pairs)))
    return union_all(out)


def control_state(ledger: DataFrame, subjects: DataFrame) -> DataFrame:
    """Ledger modes of named subjects: one row per subject and mode, with its number of keys."""
    return (
        subjects.join(ledger.select("customer_key", "deletion_mode"), "customer_key", "inner")
        .groupBy("customer_id", "deletion_mode")
        .agg(F.count("*").alias("key_count"))
    )


def audit_fail_closed(views: Mapping[str, DataFrame], persona: Persona) -> DataFrame:
    """Case views that show rows to a persona without access."""
    if persona.reads_raw_values:
        return row_counts(views).where(F.lit(False))
    return row_counts(views).where(F.col("row_count") != 0)


def summarize(audits: Mapping[str, DataFrame]) -> DataFrame:
    """Audit name, status and number of findings; never the violating values themselves."""
    counted = union_all(
        df.agg(F.count("*").alias("findings")).select(F.lit(name).alias("audit"), "findings")
        for name, df in audits.items()
    )
    status = F.when(F.col("findings") == 0, "pass").otherwise("fail")
    return counted.select("audit", status.alias("status"), "findings")
