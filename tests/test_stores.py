import pytest
from pyspark.sql import functions as F

from weftline.operators import anonymize, quality
from weftline.plans.drift import make_lock
from weftline.plans.model import Column, Schema, Table
from weftline.plans.shop import shop_plan, shop_schema
from weftline.sources import stores
from weftline.streaming import generate_stream


def test_write_modes(spark, tmp_path):
    schema = Schema.of(Table("t", (Column("id", "integer", primary=True),), ("id",)))
    df, path = spark.range(5), f"file://{tmp_path}/out"
    assert stores.write_tables(spark, {"t": df}, schema, path) == {"t": 5}
    with pytest.raises(stores.WriteError, match="5 rows"):
        stores.write_tables(spark, {"t": df}, schema, path)
    stores.write_tables(spark, {"t": df}, schema, path, "append")
    assert spark.read.parquet(f"{path}/t").count() == 10
    stores.write_tables(spark, {"t": df}, schema, path, "truncate")
    assert spark.read.parquet(f"{path}/t").count() == 5


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_bundle_round_trip(spark, tmp_path, kind):
    plan, path = shop_plan(20, 10, 5), f"file://{tmp_path}/{kind}"
    from weftline.operators.generate import generate_tables

    made = {n: df for n, df in generate_tables(spark, plan).items() if n in ("users", "products")}
    stores.export_bundle(spark, path, plan.schema, {"seed": 42}, make_lock(plan, {}, {}), made, kind)
    back = stores.import_bundle(spark, path, plan.schema)
    for n, df in made.items():
        assert back[n].count() == df.count() and back[n].select(sorted(df.columns)).exceptAll(df.select(sorted(df.columns))).isEmpty()
    smaller = Schema({n: t for n, t in plan.schema.tables.items() if n != "tags"})
    with pytest.raises(stores.WriteError, match="tags"):
        stores.import_bundle(spark, path, smaller, force=True)
    assert stores.read_part(spark, path, "config") == {"seed": 42}


def test_upsert_and_patch(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "k int, v string, n int")
    assert {(r.k, r.v) for r in stores.upsert(old, new, ["k"], "n").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    got = stores.patch(old, spark.createDataFrame([(1, None)], "k int, v string"), "k").collect()
    assert {(r.k, r.v) for r in got} == {(1, None), (2, "b")}


def test_anonymised_values_stay_equal(spark):
    assert set(anonymize.sensitive_columns(shop_schema(), "users")) == {"email", "first_name", "last_name"}
    df = spark.createDataFrame([(1, "a@x.org"), (2, "a@x.org"), (3, None)], "id int, email string")
    got = {r.id: r.email for r in anonymize.anonymize(df, {"email": "email"}, 1).collect()}
    assert got[1] == got[2] != "a@x.org" and got[3] is None
    assert anonymize.looks_like_production("db.prod.internal") and not anonymize.looks_like_production("localhost")


def test_quality_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (None, "x")], "a int, b string")
    assert {(r.column, r.n_null) for r in quality.null_rates(df, "t").collect()} == {("a", 1), ("b", 1)}
    assert [tuple(r) for r in quality.key_violations(df, ["a"]).collect()] == [(1, 2)]
    assert quality.orphans(df, ["a"], df.filter("a is null"), ["a"]).count() == 2
    assert quality.check_violations(df, "a > 1").count() == 2


def test_stream_gives_the_batch_rows(spark, tmp_path):
    schema = Schema.of(Table("t", (Column("id", "integer", primary=True), Column("email")), ("id",)))
    from weftline.operators.generate import generate_tables
    from weftline.plans.build import build_plan

    plan = build_plan(schema, {"tables": {"t": {"count": 30}}})
    spark.range(30).select(F.col("id").alias("value"), F.timestamp_seconds(F.col("id") + 1).alias("timestamp")).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("value long, timestamp timestamp").parquet(f"{tmp_path}/in")
    rows = generate_stream.unique_within(generate_stream.generated(source, plan, "t"), ["email"])
    rows.writeStream.format("memory").queryName("made").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("made").select("id", "email").exceptAll(generate_tables(spark, plan)["t"]).isEmpty() and spark.table("made").count() == 30


def test_all_tables_or_none(spark, tmp_path):
    path, schema = str(tmp_path / "whole"), Schema.of(*[Table(n, (Column("a", "integer"),)) for n in ("one", "two")])
    stores.write_tables(spark, {"one": spark.range(3).toDF("a"), "two": spark.range(4).toDF("a")}, schema, path)
    bad = spark.range(9).selectExpr("raise_error('no') as a")
    with pytest.raises(Exception, match="no"):
        stores.write_tables(spark, {"one": spark.range(5).toDF("a"), "two": bad}, schema, path, "truncate")
    assert spark.read.parquet(f"{path}/one").count() == 3 and spark.read.parquet(f"{path}/two").count() == 4
    assert sorted(p.name for p in (tmp_path / "whole").iterdir()) == ["one", "two"]
    assert stores.write_tables(spark, {"one": spark.range(5).toDF("a"), "two": spark.range(6).toDF("a")}, schema, path, "truncate") == {"one": 5, "two": 6}
    assert spark.read.parquet(f"{path}/one").count() == 5 and sorted(p.name for p in (tmp_path / "whole").iterdir()) == ["one", "two"]


def test_running_rows_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(stores, "BLOCK", 4)
    rows = [(i, "ab"[i % 3 == 0] if i % 7 else None, i % 5) for i in range(60)]
    got = stores.running_rows(spark.createDataFrame(rows, "n long, table string, rows long"), "n").collect()
    want, sums = {}, {}
    for n, t, r in rows:
        sums[t] = want[n] = sums.get(t, 0) + r
    assert {r["n"]: r["written"] for r in got} == want and len(got) == 60


def test_replay_without_rows(spark, tmp_path):
    """A bundle without rows gives, from its configuration and seed, the tables that it was exported from; other rows are told."""
    from weftline.operators.generate import generate_tables
    from weftline.plans.build import build_plan

    config = {"tables": {"users": {"count": 25}, "products": {"count": 12}, "tags": {"count": 6}, "orders": {"countPerParent": {"kind": "uniformInt", "min": 1, "max": 3}}, "order_items": {"countPerParent": 2}, "product_tags": {"countPerParent": 1}}, "seed": 7}
    plan, path = build_plan(shop_schema(), config), f"file://{tmp_path}/bundle"
    made = generate_tables(spark, plan)
    for snapshot, kind in ((False, "parquet"), (True, "json")):
        stores.export_bundle(spark, f"{path}-{kind}", plan.schema, config, make_lock(plan, config, {}), made, kind, snapshot)
        back = stores.import_bundle(spark, f"{path}-{kind}", plan.schema)
        assert set(back) == set(made) and stores.differing(back, stores.read_part(spark, f"{path}-{kind}", "manifest")["prints"]) == []
    assert back["orders"].exceptAll(made["orders"].select(back["orders"].columns)).isEmpty()
    assert not stores.exists(spark, f"{path}-parquet/data")
    stores.export_bundle(spark, path, plan.schema, config, {**make_lock(plan, config, {}), "seed": 8}, made, snapshot=False)
    with pytest.raises(stores.WriteError, match="other rows.*users"):
        stores.import_bundle(spark, path, plan.schema)
    assert stores.import_bundle(spark, path, plan.schema, verify=False)["users"].count() == 25
    with pytest.raises(stores.WriteError, match="functions"):
        stores.export_bundle(spark, path, plan.schema, {"tables": {"users": {"columns": {"email": lambda c: None}}}}, {})
