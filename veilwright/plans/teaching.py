"""The teaching variant: snapshot controls, public demo keys, raw-identifier invoices."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.config import DEMO_SCHEME, PipelineConfig
from veilwright.operators import controls, maps, resolve, staging


class TeachingRelations:
    def __init__(self, extracts: Mapping[str, DataFrame], cfg: PipelineConfig):
        self.extracts = extracts
        self.cfg = cfg

    @cached_property
    def stg_customer(self) -> DataFrame:
        return staging.stage_customer(self.extracts["customer"])

    @cached_property
    def stg_customer_services(self) -> DataFrame:
        return staging.stage_services(self.extracts["customer_services"])

    @cached_property
    def stg_invoices(self) -> DataFrame:
        return staging.stage_invoices(self.extracts["invoices"])

    @cached_property
    def stg_customer_deletion_confirmations(self) -> DataFrame:
        return staging.stage_decisions_teaching(self.extracts["customer_deletion_confirmations"])

    @cached_property
    def int_customer_deletion_requests(self) -> DataFrame:
        return controls.detect_requests_snapshot(self.stg_customer)

    @cached_property
    def int_customer_deletion_authorizations(self) -> DataFrame:
        return controls.latest_authorization(
            self.int_customer_deletion_requests, self.stg_customer_deletion_confirmations, self.cfg
        )

    @cached_property
    def int_customer_deletion_plan(self) -> DataFrame:
        return controls.snapshot_plan(self.int_customer_deletion_authorizations, self.stg_customer)

    @cached_property
    def int_terminal_deleted_customer_ssns(self) -> DataFrame:
        return controls.effective_modes(self.int_customer_deletion_plan)

    @cached_property
    def int_current_customers(self) -> DataFrame:
        return maps.current_customers(self.stg_customer, self.int_terminal_deleted_customer_ssns)

    @cached_property
    def demo_customer_map(self) -> DataFrame:
        return maps.keyed_customer_map(self.int_current_customers, DEMO_SCHEME)

    @cached_property
    def int_customer_protected(self) -> DataFrame:
        return maps.protect_customer(self.demo_customer_map)

    @cached_property
    def dim_customer(self) -> DataFrame:
        """The same 13 columns; this variant has no erased member."""
        return maps.protect_customer(self.int_customer_protected)

    @cached_property
    def int_invoice_resolution(self) -> DataFrame:
        return resolve.resolve_invoices_raw(
            self.stg_invoices,
            self.stg_customer_services,
            self.int_terminal_deleted_customer_ssns,
            self.int_current_customers,
            self.cfg,
        )

    @cached_property
    def int_invoices_resolved(self) -> DataFrame:
        rows = resolve.with_due_flag(resolve.accepted(self.int_invoice_resolution), self.cfg)
        return rows.select(
            "invoice_id", "customer_ssn", "service_id", "amount", "currency_code", "issued_date",
            "due_date", "is_paid", "paid_at", "source_is_due", "is_due", "source_updated_at",
            "is_erased_customer",
        )

    @cached_property
    def quarantine_invoices(self) -> DataFrame:
        return resolve.quarantine_invoices_raw(self.stg_invoices, self.int_invoice_resolution, self.cfg)

    @cached_property
    def key_checks(self) -> DataFrame:
        """Readable value next to its demo key, for the known-answer vectors."""
        return self.demo_customer_map.select(
            F.col("customer_ssn_value"), "customer_key", "email_value", "email_key"
        )
