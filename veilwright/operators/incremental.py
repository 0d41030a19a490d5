"""Change-driven rebuilds: only rows whose inputs changed since the last build are resolved again.

Two versions of an input are compared by digests of key ranges, then by digests of the keys in the ranges that differ, so equal inputs
exchange digests only. Changed customers and services lead to the rows that depend on them; the outcomes of all other
rows are carried over. The result equals that of the full rebuild.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.config import PipelineConfig
from veilwright.functions.keys import packed, unpacked
from veilwright.operators import resolve
from veilwright.operators.audits import differing_keys
from veilwright.sources.tables import union_all


@dataclass(frozen=True)
class Versions:
    """An input as the last build saw it, and as it is now."""

    before: DataFrame
    after: DataFrame

    def select(self, *columns: str) -> Versions:
        return Versions(self.before.select(*columns), self.after.select(*columns))

    def changed(self, key: str) -> DataFrame:
        """Keys (null too) whose rows, as a bag, are not the same in both versions; added and removed ones among them."""
        before, after = self.before, self.after
        return differing_keys(before.select(after.columns), after, key)


def _any(key: str, frames: Iterable[DataFrame]) -> DataFrame:
    return union_all(df.select(key) for df in frames).distinct()


def _matching(df: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    wanted = keys.select(F.col(key).alias("_wanted"))
    return df.join(wanted, F.col(key).eqNullSafe(F.col("_wanted")), how)


def only(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return _matching(df, keys, key, "left_semi")


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return _matching(df, keys, key, "left_anti")


def basis(ledger: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Of ledger and parameters, what outcomes depend on; a build keeps it beside them, because controls move on when a build fails."""
    return ledger.select("customer_key", "deletion_mode", cfg.erased().alias("erased_member_key"))


def changed_customers(ledger: Versions, customers: Versions) -> DataFrame:
    """Customers whose ledger row or whose place in the customer map changed.

    ``ledger`` is customer_key, deletion_mode and what else of a run the outcome of a deleted customer depends on (see ``basis``).
    """
    known = customers.select("customer_key")
    return _any("customer_key", [ledger.changed("customer_key"), known.changed("customer_key")])


def changed_services(services: Versions, resolved: Versions, ledger: Versions) -> DataFrame:
    """Services with a changed period, a changed accepted period, or a customer whose deletion mode changed."""
    governed = only(services.after, ledger.changed("customer_key"), "customer_key")
    return _any("service_key", [services.changed("service_key"), resolved.changed("service_key"), governed])


def affected_rows(rows: Versions, key: str, causes: Mapping[str, DataFrame]) -> DataFrame:
    """Keys of rows that changed themselves, or that depend (by the named column) on a changed key."""
    dependent = [only(rows.after, keys, column) for column, keys in causes.items()]
    return _any(key, [rows.changed(key), *dependent])


def carry_over(previous: DataFrame, fresh: DataFrame, affected: DataFrame, key: str) -> DataFrame:
    """The previous outcomes of all keys that are not affected, and the fresh ones of those that are."""
    return without(previous, affected, key).select(fresh.columns).unionByName(fresh)


Stage = Callable[[str, DataFrame], DataFrame]


def _as_is(name: str, df: DataFrame) -> DataFrame:
    return df


def rebuild_events(
    events: Versions, ledger: Versions, customers: Versions, previous: DataFrame, cfg: PipelineConfig, stage: Stage = _as_is
) -> DataFrame:
    """As resolve_events over all current events; previous is the resolution of the earlier versions.

    ``stage`` may write the affected keys, which are read twice.
    """
    causes = {"customer_key": changed_customers(ledger, customers)}
    affected = stage("_affected_events", affected_rows(events, "event_id", causes))
    rows = only(events.after, affected, "event_id")
    return carry_over(previous, resolve.resolve_events(rows, ledger.after, customers.after, cfg), affected, "event_id")


def rebuild_services(
    services: Versions, ledger: Versions, customers: Versions, mapped: Versions, previous: DataFrame, stage: Stage = _as_is
) -> DataFrame:
    """As resolve_services over all current services."""
    key = "service_version_key"
    columns = (key, "customer_key", "service_key", "installation_address_key")
    causes = {"customer_key": changed_customers(ledger, customers), key: mapped.select(*columns).changed(key)}
    affected = stage("_affected_services", affected_rows(services, key, causes))
    rows = only(services.after, affected, key)
    return carry_over(previous, resolve.resolve_services(rows, ledger.after, customers.after, mapped.after), affected, key)


def rebuild_invoices(
    invoices: Versions,
    services: Versions,
    resolved: Versions,
    ledger: Versions,
    customers: Versions,
    previous: DataFrame,
    cfg: PipelineConfig,
    stage: Stage = _as_is,
) -> DataFrame:
    """As resolve_invoices over all current invoices. Of the services, only those of affected invoices are swept.

    Keys travel packed. ``stage`` may write the affected keys and the affected rows, which are read several times.
    """
    pair = ("customer_key", "service_key")
    current = packed(invoices.after, *pair)
    causes = {
        "customer_key": packed(changed_customers(ledger, customers), "customer_key"),
        "service_key": packed(changed_services(services, resolved, ledger), "service_key"),
    }
    dependent = [only(current, keys, column) for column, keys in causes.items()]
    affected = stage("_affected_invoices", _any("invoice_id", [invoices.changed("invoice_id"), *dependent]))
    rows = stage("_affected_invoice_rows", unpacked(only(current, affected, "invoice_id"), *pair))
    needed = packed(rows.select("service_key").distinct(), "service_key")

    def periods(of: Versions, columns: tuple[str, ...]) -> DataFrame:
        return unpacked(only(packed(of.after, *columns), needed, "service_key"), *columns)

    version = "service_version_key"
    fresh = resolve.resolve_invoices(
        rows, periods(services, (*pair, version)), periods(resolved, (*pair, version)), ledger.after, customers.after, cfg
    )
    keys = (*pair, "resolved_service_version_key")
    carried = unpacked(without(packed(previous, *keys), affected, "invoice_id"), *keys)
    return carried.select(fresh.columns).unionByName(fresh)
