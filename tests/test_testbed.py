import os
import shutil

import pytest

from veilwright.plans.catalog import DERIVED, Run
from veilwright.sources.testbed import LandedExtracts, input_version, invoices, synth_extracts

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_changed_tables_are_landed_again(spark, tmp_path):
    folder = str(tmp_path)
    for name in ("customer", "events", "orders"):
        shutil.copy(f"{SF_DIR}/{name}.parquet", folder)
    first = input_version(spark, folder)
    before = LandedExtracts(spark, folder)["customer"].count()
    assert LandedExtracts(spark, folder).version == first
    os.remove(f"{folder}/customer.parquet")
    spark.read.parquet(f"{SF_DIR}/customer.parquet").limit(10).write.parquet(f"{folder}/customer.parquet")
    assert input_version(spark, folder) != first
    assert LandedExtracts(spark, folder)["customer"].count() < before


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_source_rows_are_dealt_before_extracts_are_made_of_them(spark):
    plan = invoices(spark, SF_DIR, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("INV-") < plan.index("Exchange RoundRobinPartitioning(3)")  # plans are printed from the last step
    landed = LandedExtracts(spark, SF_DIR)
    for name, made in synth_extracts(spark, SF_DIR).items():
        assert landed[name].exceptAll(made).isEmpty() and made.exceptAll(landed[name]).isEmpty()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_projections_of_published_tables_are_not_written_again(spark):
    up = Run(spark, SF_DIR).up
    for name in DERIVED:
        files = getattr(up, name).inputFiles()
        assert files and not any(f"/{name}-" in f for f in files), name
