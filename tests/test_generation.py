import pytest
from pyspark.sql import functions as F

from weftline.operators import quality
from weftline.operators.generate import GenerationError, Generator, generate_tables, preview
from weftline.plans.build import build_plan
from weftline.plans.model import Column, ForeignKey, Schema, Table
from weftline.plans.shop import shop_plan


@pytest.fixture(scope="module")
def shop(spark):
    plan = shop_plan(120, 60, 30)
    return plan, {n: df.cache() for n, df in generate_tables(spark, plan).items()}


def test_references_and_keys_hold(shop):
    plan, made = shop
    assert all(r["n_orphans"] == 0 for r in quality.reference_report(made, plan.schema).collect())
    for n, t in plan.schema.tables.items():
        assert quality.key_violations(made[n], list(t.primary_key)).isEmpty()
    assert made["users"].count() == 120 and made["users"].filter("referred_by = id").isEmpty()
    assert made["order_items"].filter("quantity <= 0").isEmpty()


def test_same_rows_whatever_the_partitions(spark, shop):
    plan, made = shop
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = generate_tables(spark, plan, ["orders"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(again) == {"users", "orders"}
    assert again["orders"].exceptAll(made["orders"]).isEmpty() and made["orders"].exceptAll(again["orders"]).isEmpty()
    assert preview(spark, plan, 3)["users"].exceptAll(made["users"]).isEmpty()


def test_personas_timeline_churn_nulls_and_rows(spark):
    c = Column
    schema = Schema.of(
        Table("users", (c("id", "integer", primary=True), c("created_at", "timestamp"), c("deleted_at", "timestamp", nullable=True), c("note", nullable=True), c("tier")), ("id",)),
        Table("visits", (c("id", "integer", primary=True), c("user_id", "integer")), ("id",), (ForeignKey(("user_id",), "users", ("id",)),)),
    )
    day = 86_400_000
    config = {
        "tables": {
            "users": {
                "count": 2000, "churnRate": 0.2, "timeline": {"start_ms": 1_600_000_000_000, "end_ms": 1_600_000_000_000 + 365 * day, "growth": "compound", "rate": 0.2},
                "columns": {"note": {"kind": "word", "nullProbability": 0.3}, "tier": {"kind": "constant", "value": "free"}},
                "personas": [{"name": "big", "weight": 0.25, "overrides": {"tier": "paid"}, "cascades": {"visits": 4}}, {"name": "rest", "weight": 0.75}],
                "rows": [{"note": "the first"}],
            },
            "visits": {"countPerParent": 2},
        }
    }
    made = generate_tables(spark, build_plan(schema, config))
    users, visits = made["users"].cache(), made["visits"].cache()
    paid = users.filter("tier = 'paid'").count() / 2000
    assert 0.2 < paid < 0.3
    assert 0.25 < users.filter("note is null").count() / 2000 < 0.35 and users.filter("id = 1").first()["note"] == "the first"
    halves = users.agg(F.avg((F.unix_millis("created_at") > 1_600_000_000_000 + 182 * day).cast("double"))).first()[0]
    assert halves > 0.7  # growth puts most rows late
    assert users.filter("deleted_at <= created_at").isEmpty() and not users.filter("deleted_at is not null").isEmpty()
    by = visits.groupBy("user_id").count().join(users, F.col("id") == F.col("user_id"))
    assert by.filter("tier = 'paid'").agg(F.max("count")).first()[0] == 8 and by.filter("tier = 'free'").agg(F.max("count")).first()[0] <= 2
    n = visits.count()
    assert visits.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()[:] == (1, n, n)


def test_redraws_follow_the_plain_rule(spark):
    """Of equal values the first row's stays; the others draw again, and yield to whatever stands already, round by round."""
    schema = Schema.of(Table("t", (Column("id", "integer", primary=True), Column("code", "integer"), Column("side")), ("id",), unique=(("code", "side"),)))
    plan = build_plan(schema, {"tables": {"t": {"count": 60, "columns": {"code": {"kind": "uniformInt", "min": 1, "max": 120}, "side": {"kind": "constant", "value": "left"}}}}, "seed": 3})
    g, field = Generator(spark, plan), plan.tables["t"].fields["code"]
    draws = [g.value("t", "code", field, F.col("id"), {}, *(("__unique__", str(k)) if k else ())).alias(f"v{k}") for k in range(9)]
    drawn = {r["id"]: r for r in spark.range(60).select("id", *draws).collect()}
    settled, waiting = {}, sorted(drawn)
    for k in range(9):
        again = []
        for r in waiting:
            if drawn[r][f"v{k}"] in settled.values():
                again.append(r)
            else:
                settled[r] = drawn[r][f"v{k}"]
        waiting = again
    assert not waiting and any(settled[r] != drawn[r]["v0"] for r in settled)
    assert {r["id"] - 1: r["code"] for r in generate_tables(spark, plan)["t"].collect()} == settled


def test_unique_values_are_drawn_again_or_raise(spark):
    schema = Schema.of(Table("t", (Column("id", "integer", primary=True), Column("code", "integer", unique=True)), ("id",)))
    plan = lambda most, count: build_plan(schema, {"tables": {"t": {"count": count, "columns": {"code": {"kind": "uniformInt", "min": 1, "max": most}}}}})
    made = generate_tables(spark, plan(400, 60))["t"]
    assert made.select("code").distinct().count() == 60
    from weftline.operators import generate

    generate.TRIES, before = 2, generate.TRIES
    try:
        with pytest.raises(GenerationError, match="unique"):
            generate_tables(spark, plan(3, 10))
    finally:
        generate.TRIES = before
