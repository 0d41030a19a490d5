"""Headline timings: one JSON line. Three timed runs after one warm-up, median reported.

The full build runs the whole governed pipeline on landed extracts. The single operators read the
tables published upstream of them and are written to the no-op sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from veilwright.plans.catalog import QUERIES, Run  # noqa: E402
from veilwright.operators.views import matrix_grants  # noqa: E402
from veilwright.plans.pipeline import OUTPUT_TABLES, run_pipeline  # noqa: E402
from veilwright.session import apply_settings  # noqa: E402
from veilwright.sources.testbed import TESTBED, LandedExtracts  # noqa: E402

OPERATORS = (
    "stage_customer",
    "key_customer_set",
    "customer_map",
    "service_map",
    "deletion_plan",
    "ledger_first_run",
    "ledger_second_run",
    "resolve_events",
    "resolve_services",
    "source_service_stats",
    "resolve_invoices",
    "quarantine_invoices",
    "fct_invoice",
    "case_fct_invoice",
    "audit_event_partition",
    "audit_invoice_partition",
    "audit_deleted_absent",
    "plan_digest",
    "restore_ledger",
    "teaching_resolve_invoices",
    "scan_sensitive_documents",
    "scan_emails_documents",
)
RUNS = 3


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("governed-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    apply_settings(spark, TESTBED.pepper)

    extracts = LandedExtracts(spark, sf_dir)
    landing = timed(lambda: [extracts[name] for name in extracts])
    run = Run(spark, sf_dir)
    publish = timed(lambda: [getattr(run.up, name) for name in OUTPUT_TABLES])

    def build() -> None:
        root = tempfile.mkdtemp(prefix="governed-bench-")
        result = run_pipeline(spark, extracts, f"{root}/tables", f"{root}/evidence", TESTBED, "bench", grants=matrix_grants(spark))
        assert result.verified

    queries = {}
    build()
    queries["full_governed_build"] = round(statistics.median(timed(build) for _ in range(RUNS)), 3)
    for name in OPERATORS:
        def once() -> None:
            QUERIES[name](run).write.format("noop").mode("overwrite").save()

        once()
        queries[name] = round(statistics.median(timed(once) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "governed_privacy_pipeline_total",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "cpus": int(cpus),
                "setup": {"land_extracts": round(landing, 3), "publish_upstream": round(publish, 3)},
            }
        )
    )


if __name__ == "__main__":
    main()
