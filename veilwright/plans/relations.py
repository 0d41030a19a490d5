"""All relations of one run, wired in order.

``stage`` decides what happens at each table boundary. By default a relation is composed lazily;
the pipeline passes a function that writes the table and reads it back, which cuts the lineage
with storage every executor can reach and gives the planner exact sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from veilwright.config import Persona, PipelineConfig
from veilwright.operators import controls, incremental, maps, resolve, star, staging, views
from veilwright.operators.incremental import Versions
from veilwright.schemas import COLUMN_METADATA, CONTRACTS, CONTROL_KEYS, with_column_metadata
from veilwright.sources.tables import enforce_contract, merge_by_key

Stage = Callable[[str, DataFrame], DataFrame]
#: From the name and the changes of a durable table to the merged table and the changes as written.
StageChanges = Callable[[str, DataFrame], tuple[DataFrame, DataFrame]]


#: What a build needs of the one before it to resolve changed rows only.
BASIS = "_resolution_basis"
REBUILT = (
    BASIS, "fa_pd_customer", "fa_pd_service_address", "int_customer_events_keyed", "int_customer_services_keyed",
    "int_invoices_keyed", "int_customer_event_resolution", "int_customer_service_resolution", "int_customer_services_resolved",
    "int_invoice_resolution",
)


class Relations:
    def __init__(
        self,
        spark: SparkSession,
        extracts: Mapping[str, DataFrame],
        cfg: PipelineConfig,
        state: Mapping[str, DataFrame] | None = None,
        stage: Stage | None = None,
        targets=controls.TARGETS,
        stage_changes: StageChanges | None = None,
        previous: Mapping[str, DataFrame] | None = None,
    ):
        self.spark = spark
        self.extracts = extracts
        self.cfg = cfg
        self.state = dict(state or {})
        self.targets = targets
        self._stage = stage
        self._stage_changes = stage_changes
        self.changes: dict[str, DataFrame] = {}
        # The REBUILT relations of an earlier build: resolutions start from them.
        self.previous = dict(previous or {})

    def _table(self, name: str, df: DataFrame) -> DataFrame:
        annotations = COLUMN_METADATA.get(name)
        if annotations:
            df = with_column_metadata(df, annotations)
        enforce_contract(df, CONTRACTS[name])
        return df if self._stage is None else self._stage(name, df)

    def _durable(self, name: str, changes: DataFrame) -> DataFrame:
        """A durable control: its earlier rows, and the new and changed ones of this run."""
        enforce_contract(changes, CONTRACTS[name])
        if self._stage_changes is not None:
            merged, self.changes[name] = self._stage_changes(name, changes)
            return merged
        self.changes[name] = changes
        existing = self.state.get(name)
        return self._table(name, changes if existing is None else merge_by_key(existing, changes, CONTROL_KEYS[name]))

    # staging
    @cached_property
    def stg_customer(self) -> DataFrame:
        return staging.stage_customer(self.extracts["customer"])

    @cached_property
    def stg_customer_deletion_confirmations(self) -> DataFrame:
        return staging.stage_decisions(self.extracts["customer_deletion_confirmations"], self.cfg)

    @cached_property
    def stg_customer_events(self) -> DataFrame:
        return staging.stage_events(self.extracts["customer_events"])

    @cached_property
    def stg_customer_services(self) -> DataFrame:
        return staging.stage_services(self.extracts["customer_services"])

    @cached_property
    def stg_invoices(self) -> DataFrame:
        return staging.stage_invoices(self.extracts["invoices"])

    # controls
    @cached_property
    def customer_deletion_requests(self) -> DataFrame:
        name = "customer_deletion_requests"
        return self._durable(name, controls.new_requests(self.stg_customer, self.state.get(name), self.cfg))

    @cached_property
    def customer_deletion_authorization_history(self) -> DataFrame:
        return self._table(
            "customer_deletion_authorization_history",
            controls.authorization_history(
                self.customer_deletion_requests, self.stg_customer_deletion_confirmations, self.cfg
            ),
        )

    @cached_property
    def customer_deletion_authorizations(self) -> DataFrame:
        return self._table(
            "customer_deletion_authorizations",
            controls.authorizations(
                self.customer_deletion_requests, self.customer_deletion_authorization_history, self.cfg
            ),
        )

    @cached_property
    def int_customer_deletion_plan(self) -> DataFrame:
        return self._durable(
            controls.PLAN,
            controls.plan_changes(
                self.customer_deletion_authorization_history,
                self.stg_customer,
                self.cfg,
                self.targets,
                self.state.get(controls.PLAN),
            ),
        )

    @cached_property
    def int_terminal_deleted_customer_keys(self) -> DataFrame:
        plan = self.int_customer_deletion_plan
        return self._durable(
            controls.LEDGER,
            controls.ledger_changes(
                plan, self.state.get(controls.LEDGER), self.cfg, self.targets, self.changes[controls.PLAN]
            ),
        )

    @property
    def ledger(self) -> DataFrame:
        return self.int_terminal_deleted_customer_keys

    # maps
    @cached_property
    def fa_pd_customer(self) -> DataFrame:
        return self._table("fa_pd_customer", maps.customer_map(self.stg_customer, self.ledger, self.cfg))

    @cached_property
    def fa_pd_service_address(self) -> DataFrame:
        return self._table(
            "fa_pd_service_address",
            maps.service_map(self.stg_customer_services, self.ledger, self.fa_pd_customer, self.cfg),
        )

    # keyed rows and resolutions
    def _shared(self, name: str, df: DataFrame) -> DataFrame:
        # Read several times downstream; staging hashes every key and classifies every row once.
        return df if self._stage is None else self._stage(name, df)

    @cached_property
    def int_customer_events_keyed(self) -> DataFrame:
        return self._shared(
            "int_customer_events_keyed", resolve.key_events(self.stg_customer_events, self.cfg)
        )

    @cached_property
    def int_customer_services_keyed(self) -> DataFrame:
        return self._shared(
            "int_customer_services_keyed", resolve.key_services(self.stg_customer_services, self.cfg)
        )

    @cached_property
    def int_invoices_keyed(self) -> DataFrame:
        return self._shared("int_invoices_keyed", resolve.key_invoices(self.stg_invoices, self.cfg))

    @cached_property
    def resolution_basis(self) -> DataFrame:
        return self._shared(BASIS, incremental.basis(self.ledger, self.cfg))

    def _versions(self, name: str) -> Versions:
        return Versions(self.previous[name], self.resolution_basis if name == BASIS else getattr(self, name))

    @property
    def _changed_only(self) -> bool:
        return all(name in self.previous for name in REBUILT)

    @cached_property
    def int_customer_event_resolution(self) -> DataFrame:
        name = "int_customer_event_resolution"
        if self._changed_only:
            inputs = map(self._versions, ("int_customer_events_keyed", BASIS, "fa_pd_customer"))
            return self._shared(name, incremental.rebuild_events(*inputs, self.previous[name], self.cfg, self._shared))
        return self._shared(
            name, resolve.resolve_events(self.int_customer_events_keyed, self.ledger, self.fa_pd_customer, self.cfg)
        )

    @cached_property
    def int_customer_service_resolution(self) -> DataFrame:
        name = "int_customer_service_resolution"
        if self._changed_only:
            inputs = map(self._versions, ("int_customer_services_keyed", BASIS, "fa_pd_customer", "fa_pd_service_address"))
            return self._shared(name, incremental.rebuild_services(*inputs, self.previous[name], self._shared))
        return self._shared(
            name,
            resolve.resolve_services(
                self.int_customer_services_keyed, self.ledger, self.fa_pd_customer, self.fa_pd_service_address
            ),
        )

    @cached_property
    def int_invoice_resolution(self) -> DataFrame:
        name = "int_invoice_resolution"
        if self._changed_only:
            rows = ("int_invoices_keyed", "int_customer_services_keyed", "int_customer_services_resolved")
            inputs = map(self._versions, (*rows, BASIS, "fa_pd_customer"))
            return self._shared(name, incremental.rebuild_invoices(*inputs, self.previous[name], self.cfg, self._shared))
        return self._shared(
            name,
            resolve.resolve_invoices(
                self.int_invoices_keyed,
                self.int_customer_services_keyed,
                self.int_customer_services_resolved,
                self.ledger,
                self.fa_pd_customer,
                self.cfg,
            ),
        )

    # protected tables and quarantine
    @cached_property
    def int_customer_protected(self) -> DataFrame:
        return self._table("int_customer_protected", maps.protect_customer(self.fa_pd_customer))

    @cached_property
    def int_customer_events_resolved(self) -> DataFrame:
        return self._table(
            "int_customer_events_resolved", resolve.accepted_events(self.int_customer_event_resolution)
        )

    @cached_property
    def int_customer_services_resolved(self) -> DataFrame:
        return self._table(
            "int_customer_services_resolved",
            resolve.accepted_services(self.int_customer_service_resolution),
        )

    @cached_property
    def int_invoices_resolved(self) -> DataFrame:
        return self._table(
            "int_invoices_resolved", resolve.accepted_invoices(self.int_invoice_resolution, self.cfg)
        )

    @cached_property
    def quarantine_customer_events(self) -> DataFrame:
        return self._table(
            "quarantine_customer_events",
            resolve.quarantine_events(
                self.stg_customer_events, self.int_customer_event_resolution, self.cfg
            ),
        )

    @cached_property
    def quarantine_customer_services(self) -> DataFrame:
        return self._table(
            "quarantine_customer_services",
            resolve.quarantine_services(
                self.stg_customer_services, self.int_customer_service_resolution, self.cfg
            ),
        )

    @cached_property
    def quarantine_invoices(self) -> DataFrame:
        return self._table(
            "quarantine_invoices",
            resolve.quarantine_invoices(self.stg_invoices, self.int_invoice_resolution, self.cfg),
        )

    # star
    @cached_property
    def dim_customer(self) -> DataFrame:
        return self._table("dim_customer", star.dim_customer(self.int_customer_protected, self.cfg))

    @cached_property
    def dim_service(self) -> DataFrame:
        return self._table("dim_service", star.dim_service(self.int_customer_services_resolved, self.cfg))

    @cached_property
    def dim_date(self) -> DataFrame:
        return self._table("dim_date", star.dim_date(self.spark, self.cfg))

    @cached_property
    def fct_customer_event(self) -> DataFrame:
        return self._table("fct_customer_event", star.fct_event(self.int_customer_events_resolved))

    @cached_property
    def fct_invoice(self) -> DataFrame:
        return self._table("fct_invoice", star.fct_invoice(self.int_invoices_resolved, self.ledger))

    # views
    def case_dim_customer(self, persona: Persona) -> DataFrame:
        return views.case_dim_customer(self.dim_customer, self.fa_pd_customer, persona, self.cfg)

    def case_dim_service(self, persona: Persona) -> DataFrame:
        return views.case_dim_service(self.dim_service, self.fa_pd_service_address, persona, self.cfg)

    def case_fct_customer_event(self, persona: Persona) -> DataFrame:
        return views.case_fct_event(
            self.fct_customer_event, self.dim_customer, self.fa_pd_customer, persona
        )

    def case_fct_invoice(self, persona: Persona) -> DataFrame:
        return views.case_fct_invoice(
            self.fct_invoice,
            self.dim_customer,
            self.dim_service,
            self.fa_pd_customer,
            self.fa_pd_service_address,
            persona,
        )

    def case_views(self, persona: Persona) -> dict[str, DataFrame]:
        return {
            "case_dim_customer": self.case_dim_customer(persona),
            "case_dim_service": self.case_dim_service(persona),
            "case_fct_customer_event": self.case_fct_customer_event(persona),
            "case_fct_invoice": self.case_fct_invoice(persona),
        }
