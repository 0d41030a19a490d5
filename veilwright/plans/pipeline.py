"""The governed build: controls and evidence first, then outputs, audits, and verification."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.config import CASE_USERS, PRIVACY_ADMINS, Persona, PipelineConfig
from veilwright.functions import keys as K
from veilwright.operators import audits as A
from veilwright.operators import evidence as E
from veilwright.operators import maps, resolve, views
from veilwright.operators.controls import LEDGER, PLAN, TARGETS
from veilwright.plans.relations import REBUILT, Relations
from veilwright.schemas import CHECKS, CONTRACTS, CONTROL_KEYS
from veilwright.sources.tables import Parts, Snapshot, TableStore

T = TypeVar("T")

CONTROL_TABLES = (
    "customer_deletion_requests",
    "customer_deletion_authorization_history",
    "customer_deletion_authorizations",
    PLAN,
    LEDGER,
)
OUTPUT_TABLES = tuple(name for name in CONTRACTS if name not in CONTROL_TABLES)
#: The grants that a build was judged by, a version of it like its outputs.
GRANTS = "_grants"
#: What a build relies on: none of these may be switched by another build while it runs.
BUILT_TABLES = tuple(dict.fromkeys((*CONTROL_TABLES, *OUTPUT_TABLES, GRANTS, *REBUILT)))
DECISIONS = "stg_customer_deletion_confirmations"

# Relations of one wave depend on earlier waves only, so their jobs run side by side.
CONTROL_WAVES = (
    ("customer_deletion_requests",),
    ("customer_deletion_authorization_history",),
    ("customer_deletion_authorizations", PLAN),
    (LEDGER,),
)
OUTPUT_WAVES = (
    (
        "fa_pd_customer", "int_customer_events_keyed", "int_customer_services_keyed", "int_invoices_keyed",
        "dim_date", "resolution_basis",
    ),
    ("fa_pd_service_address", "int_customer_event_resolution", "int_customer_protected"),
    (
        "int_customer_service_resolution", "int_customer_events_resolved", "quarantine_customer_events",
        "dim_customer",
    ),
    ("int_customer_services_resolved", "quarantine_customer_services", "fct_customer_event"),
    ("int_invoice_resolution", "dim_service"),
    ("int_invoices_resolved", "quarantine_invoices"),
    ("fct_invoice",),
)

# Audits that must pass before any target is recorded as VERIFIED.
REQUIRED_AUDITS = (
    "plan_matches_authorizations",
    "pending_requests_untouched",
    "protected_terminal_deletion",
    "quarantine_terminal_deletion",
    "star_terminal_deletion",
    "case_terminal_deletion",
    "erased_member_invariants",
    "event_partition",
    "service_partition",
    "invoice_partition",
    "fact_integrity",
    "map_sources",
)


# These judge the platform's grants, a relation that is read once and kept with the build.
ACCESS_AUDITS = ("relation_grants", "parent_privileges", "ambient_grants", "evidence_access")


def _side_by_side(spark: SparkSession, work: Iterable[Callable[[], T]]) -> list[T]:
    """Run independent Spark jobs from a few driver threads; the first error is raised."""
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=8) as pool:
        return [f.result() for f in [pool.submit(inherit(w)) for w in work]]


def _build(r: Relations, waves: Iterable[Iterable[str]]) -> None:
    for wave in waves:
        _side_by_side(r.spark, (partial(getattr, r, name) for name in wave))


@dataclass
class RunResult:
    relations: Relations
    audits: dict[str, int]
    verified: bool


def quarantined_keys(r: Relations) -> dict[str, DataFrame]:
    """The quarantine tables with their raw identifiers as keys."""
    names = ("quarantine_customer_events", "quarantine_customer_services", "quarantine_invoices")
    return {name: getattr(r, name).select(_raw_key(r)) for name in names}


#: Outputs with a customer key: their quarantine, and the keyed source rows; without, they come from the current customers.
PENDING_OUTPUTS = {
    "fa_pd_customer": None,
    "int_customer_protected": None,
    "dim_customer": None,
    "dim_service": ("quarantine_customer_services", "int_customer_services_keyed"),
    "fct_customer_event": ("quarantine_customer_events", "int_customer_events_keyed"),
    "fct_invoice": ("quarantine_invoices", "int_invoices_keyed"),
}


def _raw_key(r: Relations):
    return K.ssn_key(F.col("customer_ssn"), r.cfg.scheme).alias("customer_key")


def pending_found(r: Relations, name: str) -> DataFrame:
    """The keys of an output and of what was quarantined on the way to it."""
    found = getattr(r, name).select("customer_key")
    if PENDING_OUTPUTS[name] is None:
        return found
    return found.unionByName(getattr(r, PENDING_OUTPUTS[name][0]).select(_raw_key(r)))


def pending_wanted(r: Relations, name: str) -> DataFrame:
    """The keys that the source of an output gives where no request is authorized."""
    if PENDING_OUTPUTS[name] is None:
        return maps.latest_upserts(r.stg_customer).where("is_active").select(_raw_key(r))
    return getattr(r, PENDING_OUTPUTS[name][1]).select("customer_key")


def pending_outputs(r: Relations) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Each output beside what its source gives where no request is authorized."""
    return {name: (pending_found(r, name), pending_wanted(r, name)) for name in PENDING_OUTPUTS}


def required_audits(r: Relations, persona: Persona) -> dict[str, DataFrame]:
    """The audits behind verification, each returning violating rows."""
    ledger = r.ledger
    case = r.case_views(persona)
    keyed_services = r.int_customer_services_keyed
    resolution = r.int_invoice_resolution
    quarantined_services = resolve.key_services(r.quarantine_customer_services, r.cfg)
    return {
        "plan_matches_authorizations": A.audit_plan(
            r.int_customer_deletion_plan, r.customer_deletion_authorization_history, r.stg_customer, r.cfg, r.targets
        ),
        "pending_requests_untouched": A.audit_pending_untouched(
            r.customer_deletion_authorizations, r.int_customer_deletion_plan, ledger, r.stg_customer, r.cfg,
            pending_outputs(r),
        ),
        "quarantine_terminal_deletion": A.audit_deleted_absent(quarantined_keys(r), ledger),
        "fact_integrity": A.audit_fact_integrity(
            r.int_customer_events_resolved, r.fct_customer_event, r.int_invoices_resolved, r.fct_invoice
        ),
        "map_sources": A.audit_map_sources(
            r.stg_customer,
            r.stg_customer_services,
            maps.suppressed_identifiers(ledger, r.customer_deletion_requests, r.stg_customer),
            r.fa_pd_customer,
            r.fa_pd_service_address,
        ),
        "protected_terminal_deletion": A.audit_deleted_absent(
            {
                name: getattr(r, name)
                for name in (
                    "fa_pd_customer",
                    "fa_pd_service_address",
                    "int_customer_protected",
                    "int_customer_events_resolved",
                    "int_customer_services_resolved",
                    "int_invoices_resolved",
                )
            },
            ledger,
        ),
        "star_terminal_deletion": A.audit_deleted_absent(
            {n: getattr(r, n) for n in ("dim_customer", "dim_service", "fct_customer_event", "fct_invoice")}, ledger
        ),
        "case_terminal_deletion": A.audit_deleted_absent(case, ledger),
        "erased_member_invariants": A.audit_erased_members(
            r.dim_customer, r.dim_service, r.fct_customer_event, r.fct_invoice, r.cfg
        ),
        "event_partition": A.audit_partition(
            A.expected_occurrences(r.int_customer_events_keyed, ledger, "event_id"),
            [r.int_customer_events_resolved, r.quarantine_customer_events],
            "event_id",
        ),
        "service_partition": A.audit_partition(
            keyed_services.join(ledger.select("customer_key"), "customer_key", "left_anti").select(
                "service_version_key", F.lit(1).alias("expected_occurrence_count")
            ),
            [r.int_customer_services_resolved, quarantined_services],
            "service_version_key",
        ),
        "invoice_partition": A.audit_partition(
            A.expected_occurrences(r.int_invoices_keyed, ledger, "invoice_id"),
            [r.int_invoices_resolved, r.quarantine_invoices, resolve.suppressed_invoices(resolution)],
            "invoice_id",
        ),
    }


def access_audits(spark: SparkSession, grants: DataFrame) -> dict[str, DataFrame]:
    """Audits of (grantee, privilege, table_schema, table_name) against the read matrix."""
    expected = views.expected_grants(spark).select(*A.GRANT_COLUMNS)
    return {
        "relation_grants": A.audit_relation_grants(expected, grants),
        "parent_privileges": A.audit_parent_privileges(expected, grants),
        "ambient_grants": A.audit_ambient_grants(expected, grants),
        "evidence_access": A.audit_evidence_access(grants, E.EVIDENCE_RELATIONS, [PRIVACY_ADMINS]),
    }


def run_pipeline(
    spark: SparkSession,
    extracts: Mapping[str, DataFrame],
    table_root: str,
    evidence_root: str,
    cfg: PipelineConfig,
    execution_id: str,
    invocation_id: str | None = None,
    targets=TARGETS,
    grants: DataFrame | None = None,
    changed_only: bool = False,
) -> RunResult:
    """One governed build. Outputs become visible together, and only after every audit passed.

    ``grants`` (grantee, privilege, table_schema, table_name) are kept as a version of the build, which the access audits judge; a
    build without them runs to its end and stays unverified and invisible. Controls are written as changes over those of the
    last entry of the manifest. With ``changed_only``, events, services and invoices are resolved again only where their inputs
    differ from those of the last verified build; leave it out after a change of the rules themselves. If another build switches tables that this one was built on, it fails with Conflict.
    """
    E.check_execution_id(execution_id)
    invocation = E.check_execution_id(invocation_id or uuid.uuid4().hex)
    store = TableStore(spark, table_root)
    evidence = E.EvidenceStore(spark, evidence_root, table_root)
    evidence.bootstrap()
    began = store.snapshot()
    state = {name: df for name in CONTROL_KEYS if (df := store.read(name, began)) is not None}
    parts: dict[str, Parts] = {}
    try:
        for name in CONTROL_KEYS:
            E.guard_control(state.get(name), name, evidence.history(name, keyed=True))

        def stage(name: str, df: DataFrame) -> DataFrame:
            return store.write_version(df, name, invocation, CONTRACTS.get(name), CHECKS.get(name))

        def stage_changes(name: str, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
            merged, written, parts[name] = store.write_changes(
                changes, name, invocation, CONTROL_KEYS[name], began, CONTRACTS[name], CHECKS.get(name)
            )
            return merged, written

        earlier = {name: store.read(name, began) for name in REBUILT} if changed_only else {}
        earlier = {name: df for name, df in earlier.items() if df is not None}
        r = Relations(spark, extracts, cfg, state, stage, targets, stage_changes, earlier)
        built_on = _build_controls(r, store, evidence, invocation, began, parts)
        digests = E.plan_digest(r.int_customer_deletion_plan)
        digests = store.write_version(digests, "_plan_digest", invocation)

        def record(status: str, names=None) -> None:
            events = E.append_events(digests, status, execution_id, F.current_timestamp(), invocation, names)
            evidence.append(events.coalesce(1), "execution_events", f"{invocation}-{status.lower()}")

        record("PENDING")
        _build(r, OUTPUT_WAVES)
        record("COMPLETED")
        required = required_audits(r, Persona.of(CASE_USERS))
        names = (*REQUIRED_AUDITS, *ACCESS_AUDITS)
        if grants is not None:
            judged = store.write_version(grants.select("grantee", "privilege", "table_schema", "table_name"), GRANTS, invocation)
            required.update(access_audits(spark, judged))
        findings = dict(zip(required, _side_by_side(spark, (df.count for df in required.values()))))
        failed = [name for name, count in findings.items() if count]
        outcome = E.verify_execution(
            digests, evidence.events(), names, set(findings) - set(failed), failed,
            execution_id, F.current_timestamp(), invocation,
        )
        if failed:
            raise E.EvidenceError(f"audits failed: {failed}")
        if grants is None and set(names) - set(findings) <= set(ACCESS_AUDITS):
            return RunResult(r, findings, False)
        if outcome is None:
            raise E.EvidenceError(f"audits missing: {sorted(set(names) - set(findings))}")
        store.check(built_on, BUILT_TABLES)
        # Outputs are never visible without their verification; a crash in between leaves the old ones.
        evidence.append(outcome.coalesce(1), "execution_events", f"{invocation}-verified")
        store.switch(dict.fromkeys((*OUTPUT_TABLES, GRANTS, *REBUILT)).keys(), invocation, built_on, BUILT_TABLES)
        return RunResult(r, findings, True)
    except Exception:
        failure = E.failure_event(spark, execution_id, F.current_timestamp(), invocation)
        evidence.append(failure.coalesce(1), "execution_events", f"{invocation}-failed")
        raise


def _control_parts(snapshot: Snapshot) -> dict:
    return {name: [list(v) for v in snapshot.relations[name].versions] for name in CONTROL_KEYS if name in snapshot.relations}


def _build_controls(
    r: Relations, store: TableStore, evidence: E.EvidenceStore, invocation: str, began: Snapshot, parts: dict[str, Parts]
) -> Snapshot:
    """Write and switch the controls, then archive them: later failures never undo a suppression. Returns what is visible then.

    Evidence never runs ahead of the visible controls, so a driver lost at any point is followed
    by a plain rerun: it finds every archived key, and archives what the lost run did not.
    """
    decisions = r.stg_customer_deletion_confirmations
    if not E.archive_conflicts(decisions, DECISIONS, evidence.history(DECISIONS), ["decision_revision_id"]).isEmpty():
        raise E.EvidenceError("a recorded decision revision changed; submit a new revision instead")
    _build(r, CONTROL_WAVES)
    switched = {name: parts.get(name, Parts(((invocation, None),))) for name in CONTROL_TABLES}
    now = store.switch(switched, invocation, began, BUILT_TABLES)
    # Where all rows of the controls that this run began with are archived, its changes are all that is not.
    known = evidence.archived_controls() == _control_parts(began)
    rows = {name: getattr(r, name) for name in CONTROL_TABLES if name != "customer_deletion_authorizations"}
    rows.update({name: r.changes[name] for name in parts if known})

    def archive(name: str, df: DataFrame) -> None:
        held = evidence.holding(name, E.payloads(df))
        fresh = E.archive(df, name, held, r.cfg, invocation)
        if not fresh.isEmpty():
            evidence.append(fresh, "control_history", f"{invocation}-{name}", name)
            evidence.compact(name)

    _side_by_side(r.spark, [partial(archive, name, df) for name, df in {DECISIONS: decisions, **rows}.items()])
    evidence.mark_archived(_control_parts(now))
    return now
