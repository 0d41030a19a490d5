"""Run parameters, passed explicitly to every operator that needs them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SPECIAL = "SPECIAL_DELETION"
FULL = "FULL_GOVERNED_OUTPUT_DELETION"
MODES = (SPECIAL, FULL)

PRIVACY_ADMINS = "privacy_admins"
RESTRICTED_USERS = "restricted_users"
CASE_USERS = "case_users"


@dataclass(frozen=True)
class KeyScheme:
    """A key version together with the pepper it is pinned to."""

    version: str
    pepper: str = field(repr=False)


# Public teaching constant: a known-answer scheme, not a security control.
DEMO_SCHEME = KeyScheme("demo-v1", "public-browser-demo-not-secret")


@dataclass(frozen=True)
class Persona:
    """The caller's group memberships; Apache Spark has no account groups of its own."""

    groups: frozenset[str] = frozenset()

    @classmethod
    def of(cls, *groups: str) -> Persona:
        return cls(frozenset(groups))

    @property
    def reads_raw_values(self) -> bool:
        return bool(self.groups & {PRIVACY_ADMINS, CASE_USERS})


@dataclass(frozen=True)
class PipelineConfig:
    pepper: str = field(repr=False)
    as_of_date: str = "2026-03-01"
    decision_as_of: str = "9999-12-31 23:59:59"
    erased_member_key: str = "-99999"
    policy_version: str = "CUSTOMER_DELETION_V1"
    date_start: str = "2025-01-01"
    date_end: str = "2028-12-31"
    hash_version: str = "v1"
    pepper_name: str = "pepper_v1"
    run_ts: str | None = None

    @property
    def scheme(self) -> KeyScheme:
        """The pinned v1 scheme; any other version or pepper name is refused."""
        if self.hash_version != "v1":
            raise ValueError("v1 keys require hash_version='v1'")
        if self.pepper_name != "pepper_v1":
            raise ValueError("v1 keys require pepper_name='pepper_v1'")
        if not self.pepper:
            raise ValueError("v1 keys require a non-empty pepper")
        return KeyScheme("v1", self.pepper)

    def run_timestamp(self) -> Column:
        """The run's own timestamp: a constant when given, the clock otherwise."""
        if self.run_ts is None:
            return F.current_timestamp()
        return F.lit(self.run_ts).cast("timestamp")

    def erased(self) -> Column:
        return F.lit(self.erased_member_key)
