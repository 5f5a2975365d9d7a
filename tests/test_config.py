import json

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from weftline.operators.generate import generate_tables
from weftline.plans.build import PlanError, build_plan
from weftline.plans.model import Column, Field, Schema, Table
from weftline.plans.shape import shape_issues
from weftline.sources import stores

SCHEMA = Schema.of(Table("t", (Column("id", "integer", primary=True), Column("a"), Column("b", nullable=True)), ("id",)))


def test_shapes():
    good = {"seed": "x", "nullProbability": "by type", "connection": {"dialect": "sqlite", "port": 1}, "tables": {"t": {"count": {"kind": "uniformInt"}, "columns": {"a": "email", "b": {"kind": "word", "nullProbability": 0.5}, "c": lambda c: None, "d": Field("email")}, "personas": [{"name": "p", "weight": 0.5, "cascades": {"u": 2.0}}], "timeline": {"start_ms": 0, "end_ms": 5, "growth": "scurve", "season": {"11": 2}}, "rows": [{"a": 1}]}}}
    assert shape_issues(good) == [] and shape_issues({}) == []
    bad = {"seed": 1.5, "nullProbability": 2, "connection": {"port": "x"}, "tables": {"t": {"count": -1, "columns": {"a": 5, "b": {"params": {}}}, "personas": [{"weight": -1}], "timeline": {"start_ms": 0, "growth": "wild", "season": "spring", "inflection": 2}, "rows": {}}, "u": []}}
    found = "\n".join(shape_issues(bad))
    for part in ("seed:", "nullProbability:", "connection.port:", "tables.t.count:", "tables.t.columns.a:", "tables.t.columns.b: kind is missing", "personas[0]: name is missing", "personas[0].weight:", "end_ms is missing", "growth: 'wild'", "season:", "inflection:", "tables.t.rows: a list", "tables.u: a mapping"):
        assert part in found, part
    assert shape_issues([]) == ["the configuration: a mapping is needed, not []"]
    with pytest.raises(PlanError, match="count"):
        build_plan(SCHEMA, {"tables": {"t": {"count": "many"}}})


def test_methods_and_paths(spark):
    json_text = Field("derived", {"fn": lambda c, s, x: __import__("pyspark.sql.functions", fromlist=["x"]).to_json(c["place"])})
    schema = Schema.of(Table("t", (Column("id", "integer", primary=True), Column("a"), Column("b"), Column("code"), Column("again")), ("id",)))
    columns = {"a": {"kind": "faker", "method": "person.firstName"}, "b": {"kind": "faker", "method": "no.such"}, "code": {"kind": "path", "sourceColumn": "place", "path": "code"}, "again": {"kind": "path", "sourceColumn": "text", "path": "code", "json": True}}
    plan = build_plan(schema, {"tables": {"t": {"count": 20, "columns": columns}}})
    plan.tables["t"].fields["place"], plan.tables["t"].fields["text"] = Field("geo.city"), json_text
    wide = Schema.of(Table("t", (*schema.tables["t"].columns, Column("place", "json"), Column("text")), ("id",)))
    rows = generate_tables(spark, type(plan)(wide, plan.tables, plan.seed))["t"].collect()
    assert {r["b"] for r in rows} == {"[unresolved-faker:no.such]"} and all(r["a"].isalpha() for r in rows)
    assert all(r["code"] == r["place"]["code"] == r["again"] for r in rows) and len({r["code"] for r in rows}) > 3


def test_configuration_files(tmp_path, monkeypatch):
    for name in ("URL", "SEED", "DIALECT"):
        monkeypatch.delenv(f"WEFTLINE_{name}", raising=False)
    (tmp_path / "c.toml").write_text('seed = 3\n[connection]\nurl = "mysql://h/db"\ndatabase = "shop"\n[tables.t]\ncount = 5\n')
    (tmp_path / "c.json").write_text(json.dumps({"seed": 4}))
    config = stores.load_config(str(tmp_path / "c.toml"))
    assert config["tables"] == {"t": {"count": 5}} and stores.connection(config) == {"dialect": "mysql", "url": "mysql://h/db", "database": "shop"}
    assert stores.load_config(str(tmp_path / "c.json")) == {"seed": 4} and stores.load_config(str(tmp_path / "none")) == {}
    monkeypatch.setenv("WEFTLINE_SEED", "12")
    monkeypatch.setenv("WEFTLINE_URL", "postgres://x")
    config = stores.load_config(str(tmp_path / "c.toml"))
    assert config["seed"] == 12 and stores.connection(config)["dialect"] == "postgres"
    monkeypatch.setenv("WEFTLINE_DIALECT", "sqlite")
    assert stores.connection(config)["dialect"] == "sqlite" and stores.connection({}) == {"dialect": "sqlite"}
    assert [stores.dialect_of(x) for x in ("jdbc:derby:x", "a/b.db", "mongodb+srv://x", "/data")] == ["jdbc", "sqlite", "documents", "files"]


class Upper:
    name = "upper"

    def before_insert_batch(self, table, batch):
        return pa.RecordBatch.from_arrays([pc.utf8_upper(batch.column(0))], batch.schema.names)


def test_plugins_see_batches_and_taps_hear(spark, tmp_path):
    tap, schema = stores.Tap(), Schema.of(Table("t", (Column("a"),)))
    df = spark.range(300).selectExpr("concat('x', id) as a").repartition(3)
    assert stores.write_tables(spark, {"t": df}, schema, str(tmp_path / "o"), plugins=[Upper(), tap], progress=tap.progress) == {"t": 300}
    assert spark.read.parquet(str(tmp_path / "o/t")).filter("a rlike '^X[0-9]+$'").count() == 300
    seen = tap.seen["t"]
    assert seen["rows"] == 300 and seen["began"] < seen["ended"] and tap.rates()["t"] > 0
