import pytest
from pyspark.sql import functions as F

import fixture_rows as fx
from expected import Expected
from test_goldens import staged
from veilwright.config import CASE_USERS, PRIVACY_ADMINS, RESTRICTED_USERS, Persona
from veilwright.operators import audits as A
from veilwright.operators import views as V
from veilwright.schemas import COLUMN_METADATA

CASE, ADMIN, RESTRICTED = (Persona.of(g) for g in (CASE_USERS, PRIVACY_ADMINS, RESTRICTED_USERS))


@pytest.fixture(scope="module")
def r(spark, cfg):
    return staged(spark, fx.extracts(spark), cfg)


def test_case_views_by_persona(r):
    expected = Expected().case_counts()
    for persona in (CASE, ADMIN):
        assert {n: df.count() for n, df in r.case_views(persona).items()} == expected
    for persona in (RESTRICTED, Persona.of()):
        assert A.audit_fail_closed(r.case_views(persona), persona).isEmpty()


def test_case_views_resolve_readable_values(r):
    for row in V.case_resolution_checks(r.case_views(CASE)).collect():
        assert row.row_count == row.resolved_rows > 0
    row = r.case_fct_invoice(CASE).where("invoice_key = 'bill-1'").first()
    assert (row.full_name, row.service_id) == ("Given-1 Family 1", fx.service_id(1))
    assert row.installation_address == "Wall 1, 80001 Elsewhere, DE"


def test_no_access_folds_to_an_empty_plan(r):
    plan = r.case_fct_invoice(RESTRICTED)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in plan and "Join" not in plan


def test_masks_follow_the_persona_and_survive_parquet(r, tmp_path):
    path, people = str(tmp_path / "map"), len(Expected().map)
    r.fa_pd_customer.write.parquet(path)
    again = r.spark.read.parquet(path)
    for df in (r.fa_pd_customer, again):
        masked = V.map_resolution_check(V.masked_map(df, RESTRICTED), "m").first()
        assert (masked.row_count, masked.masked_rows, masked.resolved_rows) == (people, people, 0)
        raw = V.map_resolution_check(V.masked_map(df, ADMIN), "m").first()
        assert (raw.masked_rows, raw.resolved_rows) == (0, people)
    bound = [f.name for t in ("fa_pd_customer", "fa_pd_service_address") for f in getattr(r, t).schema if "mask_column" in f.metadata]
    assert len(bound) == 13


def test_read_matrix(spark):
    names = {p: {x.table_name for x in V.readable_relations(spark, p).collect()} for p in (CASE, ADMIN, RESTRICTED)}
    assert names[CASE] == {"case_dim_customer", "case_dim_service", "case_fct_customer_event", "case_fct_invoice"}
    assert len(names[ADMIN]) == 33
    assert len(names[RESTRICTED]) == 11 and "fa_pd_customer" in names[RESTRICTED]
    V.require_readable(RESTRICTED, ["dim_customer", "fct_invoice"])
    for persona, denied in ((RESTRICTED, "stg_customer"), (RESTRICTED, "case_dim_customer"), (RESTRICTED, "int_customer_deletion_plan"),
                            (CASE, "fa_pd_customer"), (CASE, "dim_customer"), (CASE, "quarantine_invoices"), (Persona.of(), "dim_date")):
        with pytest.raises(PermissionError):
            V.require_readable(persona, [denied])


def test_grant_reconciliation(spark):
    wanted = V.expected_grants(spark)
    actual = wanted.where("table_name != 'dim_date'").unionByName(
        spark.createDataFrame([("users", "layer2", "int_invoices_resolved")], V.GRANT_SCHEMA)
    )
    found = A.audit_allowlist(wanted, actual, ["grantee", "table_schema", "table_name"]).collect()
    assert sorted((x.grantee, x.is_unexpected, x.is_missing) for x in found) == [
        ("privacy_admins", False, True), ("restricted_users", False, True), ("users", True, False),
    ]


def test_tags_and_columns(spark, r):
    maps = {n: getattr(r, n) for n in COLUMN_METADATA}
    schemas = A.schema_rows(spark, maps)
    assert A.audit_column_metadata(spark, COLUMN_METADATA, schemas).isEmpty()
    assert A.audit_unmasked_raw(schemas).isEmpty()
    untagged = {**maps, "fa_pd_customer": r.fa_pd_customer.withColumn("email_value", F.upper("email_value"))}
    drift = A.audit_column_metadata(spark, COLUMN_METADATA, A.schema_rows(spark, untagged)).collect()
    assert [(x.difference_type, x.column_name) for x in drift] == [("MISSING", "email_value")]
    protected = {n: getattr(r, n) for n in ("int_customer_protected", "int_invoices_resolved", "dim_customer", "fct_customer_event")}
    assert A.audit_columns(A.schema_rows(spark, protected)).isEmpty()
    assert A.audit_no_readable(A.schema_rows(spark, protected)).isEmpty()
    assert A.audit_columns(schemas).count() == 13
    assert A.audit_no_readable(schemas).count() == 13
    assert [x.column_name for x in A.audit_schema(r.int_customer_protected, r.int_customer_protected.columns[1:]).collect()] == ["customer_key"]
