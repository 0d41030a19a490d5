"""Governed personal-data analytics as plain PySpark DataFrame jobs."""

from veilwright.config import CASE_USERS, PRIVACY_ADMINS, RESTRICTED_USERS, KeyScheme, Persona, PipelineConfig

__all__ = [
    "CASE_USERS",
    "PRIVACY_ADMINS",
    "RESTRICTED_USERS",
    "KeyScheme",
    "Persona",
    "PipelineConfig",
]
