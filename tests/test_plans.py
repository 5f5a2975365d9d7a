import pytest

from weftline.plans import drift, graph
from weftline.plans.build import PlanError, build_plan, preflight, validate_config
from weftline.plans.model import Check, Column, ForeignKey, Schema, Table, schema_hash
from weftline.plans.semantic import analyze, bounds, coverage
from weftline.plans.shop import shop_schema
from weftline.sources import catalog


def test_graph_of_the_shop():
    g = graph.build(shop_schema())
    assert g.levels[0] == ("users", "products", "tags") and g.order.index("order_items") > g.order.index("orders")
    assert ("users",) in g.cycles
    assert {(e.kind, e.via) for e in g.edges} >= {("many-to-many", "product_tags"), ("self-referential", None), ("one-to-many", None)}


def test_cycles_are_found_and_raise():
    a = Table("a", (Column("id", "uuid", primary=True), Column("b_id", "uuid")), ("id",), (ForeignKey(("b_id",), "b", ("id",)),))
    b = Table("b", (Column("id", "uuid", primary=True), Column("a_id", "uuid")), ("id",), (ForeignKey(("a_id",), "a", ("id",)),))
    g = graph.build(Schema.of(a, b))
    assert g.order == () and set(g.cycles[0]) == {"a", "b"}
    with pytest.raises(PlanError, match="cycle"):
        build_plan(Schema.of(a, b))


def test_semantics():
    found = {(m.table, m.column): m.meaning for m in analyze(shop_schema())}
    assert found["users", "email"] == "email" and found["products", "price"] == "currency" and found["order_items", "quantity"] == "bounded-integer"
    assert coverage(analyze(shop_schema())) > 0.8
    t = Table("t", (Column("n", "integer"), Column("k")), (), (), (), (Check("a", "n > 0 AND n <= 5"), Check("b", "k IN ('x', 'y')")))
    assert bounds(t, "n") == {"min": 1, "max": 5} and bounds(t, "k") == {"values": ["x", "y"]}


def test_plan_issues_are_collected():
    bad = {"tables": {"users": {"columns": {"nope": "uuid", "email": "boolean"}, "parent": "x"}, "ghost": {}}}
    assert len(validate_config(bad, shop_schema())) == 4
    with pytest.raises(PlanError) as e:
        build_plan(Schema.of(Table("t", (Column("blob", "binary"),))))
    assert "blob" in str(e.value)


def test_preflight():
    schema = Schema.of(Table("t", (Column("id", "integer", primary=True), Column("c", "integer", unique=True)), ("id",)))
    plan = build_plan(schema, {"tables": {"t": {"count": 100, "columns": {"c": {"kind": "uniformInt", "min": 0, "max": 50}}}}})
    assert [f.level for f in preflight(plan)] == ["warning"]


def test_drift(spark, tmp_path):
    old = shop_schema()
    users = old.tables["users"]
    new = Schema({**old.tables, "users": Table("users", users.columns[1:], users.primary_key)})
    plan = build_plan(old)
    drift.write_lock(str(tmp_path / "a" / "lock.json"), drift.make_lock(plan, {}, {}))
    lock = drift.read_lock(str(tmp_path / "a" / "lock.json"))
    assert drift.read_lock(str(tmp_path / "none")) is None
    assert drift.check_drift(spark, lock, old).reason == "unchanged"
    found = drift.check_drift(spark, lock, new)
    assert not found.proceed and "- users.id: column removed" in drift.describe(found.changes)
    assert drift.check_drift(spark, drift.acknowledge(lock, new), new).proceed
    assert Schema.from_dict(old.as_dict()) == old and schema_hash(Schema.from_dict(old.as_dict())) == schema_hash(old)
    constraints = drift.diff_constraints(drift.constraints_frame(spark, old), drift.constraints_frame(spark, new)).collect()
    assert {(r["kind"], r["change"]) for r in constraints} == {("foreign key", "removed")}


def test_native_types():
    cases = {"int4": "integer", "numeric(10,2)": "float", "tinyint(1)": "boolean", "timestamp with time zone": "timestamp", "text[]": "array", "jsonb": "json", "made_up": "string", "enum('a','b''c')": "enum"}
    assert {k: catalog.logical_type(k) for k in cases} == cases
    assert catalog.enum_values("enum('a','b''c')") == ("a", "b'c")


def test_sqlite(tmp_path):
    import sqlite3

    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.executescript("CREATE TABLE p (id INTEGER PRIMARY KEY, name TEXT UNIQUE); CREATE TABLE c (id INTEGER PRIMARY KEY, p_id INT NOT NULL REFERENCES p(id) ON DELETE CASCADE, n INT CONSTRAINT pos CHECK (n > (0)));")
    s = catalog.introspect("sqlite", path)
    assert s.tables["c"].foreign_keys == (ForeignKey(("p_id",), "p", ("id",), "CASCADE"),)
    assert s.tables["c"].checks == (Check("pos", "n > (0)"),) and s.tables["p"].column("name").unique and not s.tables["c"].column("p_id").nullable


def test_documents(spark):
    rows = ['{"_id": {"$oid": "a"}, "n": 1, "items": [{"q": 2}], "tags": ["x"]}', '{"_id": {"$oid": "b"}, "n": 1.5}']
    found = catalog.from_documents({"d": spark.createDataFrame([(r,) for r in rows], "value string")}).tables["d"]
    assert {(c.name, c.type, c.nullable) for c in found.columns} == {("_id", "uuid", False), ("n", "float", False), ("items[].q", "integer", True), ("tags", "array", True)}


def test_assembled_catalogue():
    base = {"column_default": None, "character_maximum_length": None, "numeric_precision": None, "numeric_scale": None}
    col = lambda t, c, i: {"table_name": t, "column_name": c, "ordinal_position": i, "data_type": "integer", "is_nullable": "NO"} | base
    key = lambda t, n, k, c: {"table_name": t, "constraint_name": n, "constraint_type": k, "column_name": c, "ordinal_position": 1}
    rows = {
        "columns": [col("b", "a_id", 2), col("b", "id", 1), col("a", "id", 1)],
        "keys": [key("a", "a_pk", "PRIMARY KEY", "id"), key("b", "b_fk", "FOREIGN KEY", "a_id")],
        "references": [{"constraint_name": "b_fk", "table_name": "a", "column_name": "id", "ordinal_position": 1, "delete_rule": "CASCADE", "update_rule": None}],
        "checks": [{"table_name": "b", "constraint_name": "c", "check_clause": "a_id > 0"}],
    }
    s = catalog.assemble(rows)
    assert [c.name for c in s.tables["b"].columns] == ["id", "a_id"] and s.tables["b"].foreign_keys[0].table == "a" and s.tables["a"].column("id").unique
