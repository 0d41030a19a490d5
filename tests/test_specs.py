from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from veilwright.config import CASE_USERS, RESTRICTED_USERS, Persona
from veilwright.operators import controls as C
from veilwright.operators import specs as S
from veilwright.plans import catalog
from veilwright.sources.tables import literal_relation

SPECIAL, FULL = "SPECIAL_DELETION", "FULL_GOVERNED_OUTPUT_DELETION"
KEY = S.KeySpec("customer_ssn", "customer.ssn", "ssn")


@pytest.fixture(scope="module")
def relations(spark):
    orders = literal_relation(
        spark, [("o1", "900-00-0001", 5), ("o2", "900-00-0002", 6), ("o3", "900-00-0003", 7)],
        "order_id string, customer_ssn string, amount int",
    )
    return {"orders": orders, "status": literal_relation(spark, [("o1", "ACCEPTED"), ("o2", "BAD")], "order_id string, status string")}


@pytest.fixture(scope="module")
def ledger(spark, cfg, relations):
    keyed = relations["orders"].select(
        S.personal_data_key(F.col("customer_ssn"), "customer.ssn", cfg.scheme, "ssn").alias("customer_key"), "order_id"
    )
    mode = F.when(F.col("order_id") == "o2", SPECIAL).when(F.col("order_id") == "o3", FULL)
    return keyed.select("customer_key", mode.alias("deletion_mode")).where("deletion_mode is not null")


def spec(layer, kind, columns, **options):
    return S.ModelSpec(layer, kind, "example", "orders", (columns[0].name,), tuple(columns), **options)


ORDER = S.ColumnSpec("order_id", tests=("not_null", "unique"))
CUSTOMER = S.ColumnSpec("customer_key", key=KEY)
FACT = spec(
    "layer3", "FACT", [ORDER, CUSTOMER, S.ColumnSpec("is_erased_customer")],
    deletion=S.DeletionSpec(special_columns=("customer_key",), flag="is_erased_customer", register_target=True),
)


def test_plain_expression_key_join_and_filter(relations, cfg):
    columns = [S.ColumnSpec("order_id"), S.ColumnSpec("double", expression="source_rows.amount * 2"), S.ColumnSpec("status", expression="s.status")]
    joined = spec("layer1", "STAGING", columns, joins=(S.JoinSpec("status", "s", "source_rows.order_id = s.order_id", "left"),), where=("amount > 5",))
    assert sorted(map(tuple, S.build_model(joined, relations, cfg).collect())) == [("o2", 12, "BAD"), ("o3", 14, None)]
    with pytest.raises(ValueError, match="one-row"):
        S.validate(spec("layer1", "STAGING", columns, joins=(S.JoinSpec("status", "s", how="cross"),)))
    single = S.NamedSpec("single", "status", (S.ColumnSpec("status", expression="max(source_rows.status)"),), one_row=True)
    crossed = spec("layer1", "STAGING", columns, joins=(S.JoinSpec("single", "s", how="cross"),), named=(single,))
    assert S.build_model(crossed, relations, cfg).count() == 3


def test_named_relations(relations, cfg):
    mine = S.NamedSpec("mine", "orders", (S.ColumnSpec("order_id"), S.ColumnSpec("amount")), where=("amount > 5",))
    total = S.NamedSpec("total", "mine", (S.ColumnSpec("one", expression="1"), S.ColumnSpec("n", expression="count(*)")), group_by=("one",))
    columns = [S.ColumnSpec("order_id", expression="m.order_id"), S.ColumnSpec("n", expression="t.n")]
    model = S.ModelSpec(
        "layer1", "STAGING", "example", "mine", ("order_id",), tuple(columns), alias="m",
        joins=(S.JoinSpec("total", "t", "t.one = 1"),), named=(mine, total),
    )
    assert sorted(map(tuple, S.build_model(model, relations, cfg).collect())) == [("o2", 2), ("o3", 2)]
    with pytest.raises(ValueError, match="only after"):
        S.validate(replace(model, named=(total, mine)))
    with pytest.raises(ValueError, match="two relations"):
        S.validate(replace(model, named=(mine, mine)))


def test_governed_kinds(spark, relations, cfg, ledger):
    fact = S.build_model(FACT, relations, cfg, ledger)
    assert {r.order_id: r.is_erased_customer for r in fact.collect()} == {"o1": False, "o2": True}
    dimension = spec(
        "layer3", "DIMENSION", [CUSTOMER, S.ColumnSpec("amount")], deletion=S.DeletionSpec(),
        erased_member={"customer_key": "'-99999'", "amount": "0"},
    )
    assert sorted(r.amount for r in S.build_model(dimension, relations, cfg, ledger).collect()) == [0, 5]
    quarantine = spec(
        "layer1", "QUARANTINE", [ORDER, S.ColumnSpec("customer_ssn")],
        deletion=S.DeletionSpec(key_column="customer_ssn", key_domain="customer.ssn", key_kind="ssn"),
    )
    assert [r.order_id for r in S.build_model(quarantine, relations, cfg, ledger).collect()] == ["o1"]
    view = S.ModelSpec(
        "layer3_case", "CASE_VIEW", "case_example", "fact", ("order_id",), tuple(S.ColumnSpec(c) for c in fact.columns),
        deletion=S.DeletionSpec(flag="is_erased_customer"),
    )
    seen = {g: S.build_model(view, {"fact": fact}, cfg, persona=Persona.of(g)).count() for g in (CASE_USERS, RESTRICTED_USERS)}
    assert seen == {CASE_USERS: 1, RESTRICTED_USERS: 0}
    assert S.build_model(view, {"fact": fact}, cfg).isEmpty()


def test_mapping_tags_tests_and_target(relations, cfg, ledger):
    mapping = spec(
        "priva_map", "MAPPING",
        [S.ColumnSpec("order_key", key=S.KeySpec("order_id", "order.id")), CUSTOMER,
         S.ColumnSpec("order_value", expression="order_id", tags={"personal_data_state": "RAW"}, mask_column="order_key")],
        deletion=S.DeletionSpec(register_target=True),
    )
    df = S.build_model(mapping, relations, cfg, ledger)
    assert df.schema["order_value"].metadata == {"personal_data_state": "RAW", "mask_column": "order_key"}
    assert S.register_target(mapping) == C.Target("priva_map", "example", "MAPPING")
    assert S.register_target(FACT).row()[3:] == ("DELETE_CURRENT_ROWS", "REASSIGN_TO_ERASED_MEMBER")
    audits = S.column_tests(FACT, S.build_model(FACT, relations, cfg, ledger))
    assert set(audits) == {"example_not_null", "example_order_id_unique", "example_primary_key_unique"}
    assert all(a.isEmpty() for a in audits.values())


def test_incremental_and_calendar(relations, cfg):
    control = spec("layer1", "CONTROL", [ORDER, S.ColumnSpec("amount")], merge_key=("order_id",))
    old = S.build_model(control, {"orders": relations["orders"].withColumn("amount", F.lit(1))}, cfg)
    merged = S.build_model(control, {"orders": relations["orders"].where("order_id = 'o1'")}, cfg, existing=old)
    assert sorted(map(tuple, merged.collect())) == [("o1", 5), ("o2", 1), ("o3", 1)]
    calendar = S.ModelSpec("layer3", "DATE_DIMENSION", "dim_date")
    assert S.build_model(calendar, relations, cfg).count() == 1461


@pytest.mark.parametrize(
    "broken",
    [
        replace(FACT, layer="layer1"),
        replace(FACT, kind="STAGING"),
        replace(FACT, name="bad name"),
        replace(FACT, source=None),
        replace(FACT, primary_key=("absent",)),
        replace(FACT, columns=(ORDER, ORDER)),
        replace(FACT, deletion=None),
        replace(FACT, joins=(S.JoinSpec("status", "source_rows", "true"),)),
        replace(FACT, joins=(S.JoinSpec("status", "s"),)),
        replace(FACT, joins=(S.JoinSpec("status", "s", "true", "outer"),)),
        replace(FACT, helper_columns=(ORDER,)),
        replace(FACT, erased_member={"order_id": "1"}),
        replace(FACT, merge_key=("absent",)),
        replace(FACT, deletion=replace(FACT.deletion, special_columns=None)),
        replace(FACT, deletion=replace(FACT.deletion, special_columns=("order_id",))),
        replace(FACT, deletion=replace(FACT.deletion, flag="absent")),
        replace(FACT, deletion=replace(FACT.deletion, key_domain="a", key_expression="b")),
        replace(FACT, deletion=replace(FACT.deletion, model_type="SERVICE")),
        replace(FACT, columns=(*FACT.columns, S.ColumnSpec("m", mask_column="order_id"))),
        spec("layer1", "STAGING", [ORDER], helper_columns=(S.ColumnSpec("h"),)),
        spec("layer1", "STAGING", [S.ColumnSpec("order_id", tags={"a": "b"})]),
        S.ModelSpec("layer3", "DATE_DIMENSION", "dim_date", "orders"),
    ],
)
def test_contradictory_specs_are_refused(broken):
    with pytest.raises(ValueError):
        S.validate(broken)


def test_a_model_asks_for_nothing_that_it_does_not_read(monkeypatch):
    """Relations left out of a spec are not built: the stand-in has none of them."""
    assert S.relations_read(catalog.MODEL_NAMED) == {"stg_invoices", "int_customer_protected"}
    assert [S.reads_ledger(m) for m in (catalog.MODEL_NAMED, catalog.MODEL_CASE_VIEW, catalog.MODEL_FACT)] == [False, False, True]
    monkeypatch.setattr(S, "build_model", lambda spec, relations, cfg, ledger, **options: (relations, ledger))
    run = SimpleNamespace(up=SimpleNamespace(fct_customer_event="f", fa_pd_customer="m"), lazy=SimpleNamespace())
    assert catalog._modelled(run, catalog.MODEL_CASE_VIEW) == ({"fct_customer_event": "f", "fa_pd_customer": "m"}, None)
