"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # AQE re-plans joins from measured sizes and splits skewed partitions; forcing the split keeps
    # it active even where it costs one more exchange (a customer may own a third of a fact).
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Build sides that turn out small per partition are hashed, so wide facts need no sort.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
}

_local_work_dirs: dict[str, str] = {}


def apply_settings(spark: SparkSession, pepper: str | None = None) -> SparkSession:
    """Apply the runtime settings; with a pepper, also redact it from explain output."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    if pepper:
        # Added to what is redacted already: one session may hold several peppers.
        hidden = spark.conf.get("spark.sql.redaction.string.regex", None)
        known = hidden.split("|") if hidden else []
        if re.escape(pepper) not in known:
            spark.conf.set("spark.sql.redaction.string.regex", "|".join([*known, re.escape(pepper)]))
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    A local folder is used only where that setting is absent and the master is local, as in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_work_dirs:
        _local_work_dirs[app] = tempfile.mkdtemp(prefix="veilwright-")
    return _local_work_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path under the shared folder."""
    return f"{work_dir(spark)}/veilwright/{name}-{uuid.uuid4().hex}"
