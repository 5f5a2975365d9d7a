import json
import math
import sys
import types

import pytest
from pyspark.sql import functions as F

from weftline.operators import generate, runs
from weftline.operators.generate import generate_tables
from weftline.plans import drift, graph
from weftline.plans.build import PlanError, build_plan, with_unresolved
from weftline.plans.hooks import PluginError, load_plugin, through
from weftline.plans.model import Column, Field, ForeignKey, Schema, Table, Timeline
from weftline.plans.semantic import analyze
from weftline.sources import catalog, stores

PEOPLE = Schema.of(
    Table("people", (Column("id", "integer", primary=True), Column("email", nullable=True), Column("tags", "array", nullable=True)), ("id",)),
    Table("visits", (Column("person_id", "integer", nullable=True), Column("note", nullable=True)), (), (ForeignKey(("person_id",), "people", ("id",)),)),
    Table("empty", (Column("id", "integer", primary=True),), ("id",)),
)


def people(spark):
    return {
        "people": spark.createDataFrame([(i, f"p{i % 3}@corp.example" if i else None, ["x", None] if i % 2 else None) for i in range(30)], "id long, email string, tags array<string>"),
        "visits": spark.createDataFrame([(i % 4 or None, None) for i in range(20)], "person_id long, note string"),
        "empty": spark.createDataFrame([], "id long"),
    }


def test_clone(spark, tmp_path):
    path, tables = f"file://{tmp_path}/clone", people(spark)
    with pytest.raises(stores.WriteError, match="production"):
        runs.clone(spark, tables, PEOPLE, path, source="db.prod.internal")
    told = runs.clone(spark, tables, PEOPLE, path, most=12, source="db.prod.internal", force=True)
    assert {(t.table, t.rows) for t in told} == {("people", 12), ("visits", 12)}
    made = spark.read.json(f"{path}/people").collect()
    was = {r.id: r.email for r in tables["people"].collect()}
    assert len(made) == 12 and all((r.email is None) == (was[r.id] is None) and (r.email is None or r.email != was[r.id]) for r in made)
    assert len({(was[r.id], r.email) for r in made}) == len({was[r.id] for r in made})
    again = runs.clone(spark, tables, PEOPLE, path, most=12)
    assert again == told and {r.id for r in spark.read.json(f"{path}/people").collect()} == {r.id for r in made}
    text = runs.summary(told)
    assert "people: 12 rows, 1 columns replaced, 2 kept" in text and "  email: replaced by email" in text and "  id: kept" in text
    assert not runs.looks_like_production("jdbc:postgresql://localhost/products") and runs.looks_like_production("my_prod1")


def test_reset_plugins_and_progress(spark, tmp_path):
    path, heard, seen = f"file://{tmp_path}/made", [], []
    plan = build_plan(Schema.of(Table("a", (Column("id", "integer", primary=True), Column("email")), ("id",)), Table("b", (Column("id", "integer", primary=True),), ("id",))), {"tables": {"a": {"count": 7}, "b": {"count": 4}}})
    plugin = types.SimpleNamespace(
        name="loud",
        before_generate=lambda p: seen.append(p.seed),
        after_generate=lambda made: made | {"a": made["a"].withColumn("email", F.upper("email"))},
        before_insert=lambda table, df: df.filter("id > 2") if table == "a" else None,
        after_insert=lambda table, n: heard.append((table, n)),
    )
    made = generate_tables(spark, plan, plugins=[plugin])
    assert seen == [plan.seed] and made["a"].filter("email = lower(email)").isEmpty()
    assert stores.write_tables(spark, made, plan.schema, path, plugins=[plugin]) == {"a": 5, "b": 4} and heard == [("a", 5), ("b", 4)]
    with pytest.raises(stores.WriteError, match="stopped after a"):
        stores.write_tables(spark, generate_tables(spark, plan), plan.schema, path, "truncate", progress=lambda table, n: table != "a")
    assert spark.read.parquet(f"{path}/a").count() == 5
    lock = drift.make_lock(plan, {}, {}) | {"seed": 9}
    assert runs.reset(spark, plan, lock, path) == {"a": 7, "b": 4}
    other = generate_tables(spark, build_plan(plan.schema, {"seed": 9, "tables": {"a": {"count": 7}, "b": {"count": 4}}}))["a"]
    assert spark.read.parquet(f"{path}/a").exceptAll(other).isEmpty() and not other.exceptAll(generate_tables(spark, plan)["a"]).isEmpty()
    with pytest.raises(stores.WriteError, match="lockfile"):
        runs.reset(spark, plan, None, path)


def test_plugins_are_loaded_and_checked(monkeypatch):
    module = types.ModuleType("some_plugins")
    module.plugin = types.SimpleNamespace(name="plain", on_schema=lambda s: None)
    module.made = lambda rate=1: types.SimpleNamespace(name=f"made {rate}", register_generators=lambda register: register("seven", types=("integer",))(lambda p, s, c: F.lit(7)))
    module.nameless, module.idle = types.SimpleNamespace(on_schema=print), types.SimpleNamespace(name="idle")
    monkeypatch.setitem(sys.modules, "some_plugins", module)
    assert load_plugin("some_plugins").name == "plain" and load_plugin({"name": "some_plugins:made", "options": {"rate": 3}}).name == "made 3"
    from weftline.functions.generators import KINDS

    assert KINDS.pop("seven").types == ("integer",)
    for bad in ("some_plugins:nameless", "some_plugins:idle", "some_plugins:none", "no_such_module"):
        with pytest.raises(PluginError):
            load_plugin(bad)
    assert through([module.plugin, types.SimpleNamespace(on_schema=lambda s: s + 1)], "on_schema", 1) == 2


def test_growth_and_its_inverse(spark):
    day = 86_400_000
    for line in (Timeline(0, 700 * day, "linear", total_growth=3), Timeline(0, 700 * day, "linear"), Timeline(0, 700 * day, "compound", 0.15), Timeline(0, 700 * day, "scurve", steepness=8, inflection=0.3)):
        q = F.col("id") / 50.0
        got = spark.range(51).select(q.alias("q"), generate.growth(line, generate.inverse_growth(line, q)).alias("back")).collect()
        assert all(math.isclose(r.q, r.back, abs_tol=1e-9) for r in got)
    assert Timeline(0, 60 * day, "compound", 1.0).rows == 3 and Timeline(0, 60 * day, "linear", total_growth=3).rows == 4 and Timeline(0, 60 * day, "scurve").rows == 2
    plan = lambda **t: build_plan(Schema.of(Table("t", (Column("id", "integer", primary=True),), ("id",))), {"tables": {"t": {"count": "timeline", **t}}})
    assert plan(timeline={"start_ms": 0, "end_ms": 60 * day, "growth": "compound", "rate": 1.0}).tables["t"].count == 3
    with pytest.raises(PlanError, match="timeline"):
        plan()
    months = spark.range(1).select(generate.seasonal_weight(F.timestamp_seconds(F.lit(0)), lambda t: F.month(t) * 3).alias("a"), generate.seasonal_weight(F.lit(None).cast("timestamp"), F.month).alias("b")).first()
    assert months[:] == (3.0, 1.0)


def test_nulls_by_type_and_opted_in(spark):
    schema = Schema.of(Table("t", (Column("id", "integer", primary=True), Column("email", nullable=True), Column("is_on", "boolean", nullable=True)), ("id",)))
    made = generate_tables(spark, build_plan(schema, {"nullProbability": "by type", "tables": {"t": {"count": 4000}}}))["t"]
    share = made.agg(F.avg(F.isnull("email").cast("int")), F.avg(F.isnull("is_on").cast("int")), F.avg(F.isnull("id").cast("int"))).first()
    assert 0.12 < share[0] < 0.18 and 0.03 < share[1] < 0.07 and share[2] == 0
    two = build_plan(Schema.of(*[Table(n, (Column("x", nullable=True),)) for n in "ab"]))
    drafts = {(n, "x"): Field("word") for n in "ab"}
    assert [n for n, t in with_unresolved(two, drafts, ["b"]).tables.items() if t.fields] == ["b"] and len([t for t in with_unresolved(two, drafts).tables.values() if t.fields]) == 2


def test_references_inside_documents(spark):
    users = spark.createDataFrame([(("u1",),), (("u2",),), (None,)], "_id struct<`$oid`:string>")
    rows = [(("u1",), [{"productId": ("p1",), "tags": ["a", "b"]}, {"productId": None, "tags": None}], (1,)), (None, None, None), (("u9",), [], (2,))]
    orders = spark.createDataFrame(rows, "userId struct<`$oid`:string>, items array<struct<productId:struct<`$oid`:string>,tags:array<string>>>, at struct<place:int>")
    assert graph.leaves(orders.schema) == ["userId", "items[].productId", "items[].tags", "at.place"]
    values = lambda path: {r.v for r in graph.distinct_at(orders, path)[0].collect()}
    assert values("items[].productId") == values("items.productId") == {"p1"} and values("items[].tags") == {"a", "b"} and values("at.place") == {1, 2} and values("at") == {'{"place":1}', '{"place":2}'}
    assert graph.inclusion(orders, "userId", users, "_id").first()[:] == (2, 1, 0.5)
    assert graph.inclusion(orders, "at.place", spark.createDataFrame([("1",)], "k string"), "k").first()[:] == (2, 1, 0.5)
    products = spark.createDataFrame([(("p1",),)], "_id struct<`$oid`:string>")
    found = graph.inferred_keys({"users": users, "products": products, "orders": orders}, {"users": "_id", "products": "_id"}, 0.5).collect()
    assert {(r.child, r.column, r.parent) for r in found} == {("orders", "userId", "users"), ("orders", "items[].productId", "products")}


def test_catalogues_of_two_databases():
    column = lambda name, kind, place, native=None: {"table_name": "t", "column_name": name, "ordinal_position": place, "data_type": kind, "is_nullable": "NO", "column_default": None, "character_maximum_length": None, "numeric_precision": None, "numeric_scale": None, "native": native}
    rest = {"keys": [], "references": [], "checks": []}
    enums = [{"type_name": "mood", "label": x, "place": p} for x, p in (("sad", 1.0), ("glad", 3.0), ("so-so", 2.0))]
    t = catalog.assemble({"columns": [column("m", "USER-DEFINED", 1, "mood"), column("a", "ARRAY", 2, "_text"), column("n", "integer", 3, "int4"), column("i", "inet", 4, "inet")], "enums": enums, **rest}).tables["t"]
    assert [c.type for c in t.columns] == ["enum", "array", "integer", "string"] and t.column("m").enum_values == ("sad", "so-so", "glad")
    assert {m.column: m.meaning for m in analyze(Schema.of(t))}["i"] == "ip"
    t = catalog.assemble({"columns": [column("b", "tinyint", 1, "tinyint(1)"), column("e", "enum", 2, "enum('x','y''z')")], **rest}).tables["t"]
    assert [c.type for c in t.columns] == ["boolean", "enum"] and t.column("e").enum_values == ("x", "y'z")


def test_places_in_pairs():
    t = Table("t", tuple(Column(c, "float") for c in ("home_lat", "home_lng", "latitude", "work_lon")))
    got = {m.column: (m.meaning, m.confidence, m.field.params.get("pair")) for m in analyze(Schema.of(t))}
    assert got == {"home_lat": ("latitude", 0.95, "home_lng"), "home_lng": ("longitude", 0.95, "home_lat"), "latitude": ("latitude", 0.85, None), "work_lon": ("longitude", 0.85, None)}


def test_annotations_and_bundles(spark, tmp_path):
    rows = [{"table": "t", "column": "c", "change": "type changed", "was": "a\nb", "now": "100%"}]
    assert drift.annotations(rows, "x.json") == "::error file=x.json,line=1,title=Schema drift: type changed::~ t.c: type changed (a%0Ab -> 100%25)"
    for name, version in (("b", "1"), ("a", "1"), ("a", "2")):
        stores.export_bundle(spark, f"file://{tmp_path}/{name}/{version}", PEOPLE, {}, {})
    got = stores.bundles(spark, f"file://{tmp_path}").collect()
    assert [(r.name, r.version) for r in got] == [("a", "2"), ("a", "1"), ("b", "1")] and all(r.created for r in got)
    assert json.loads(json.dumps(stores.read_part(spark, f"file://{tmp_path}/a/2", "manifest")))["version"] == 1
