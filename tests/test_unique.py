import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import permute
from weftline.functions.generators import KINDS, numbered_values, unique_value
from weftline.operators.generate import GenerationError, generate_tables
from weftline.plans.build import build_plan
from weftline.plans.model import Column, ForeignKey, Schema, Table


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100, 101, 1009, 4095, 10_007])
def test_a_permutation_of_any_size(spark, size):
    got = [r["p"] for r in spark.range(size).select(permute.permuted(F.col("id"), size, 42, "t", "c").alias("p")).collect()]
    assert sorted(got) == list(range(size))
    if size > 100:
        assert got != sorted(got) and got != [r["p"] for r in spark.range(size).select(permute.permuted(F.col("id"), size, 43, "t", "c").alias("p")).collect()]


@pytest.mark.parametrize("size", [676 * 3 << 32, 36**8, 2**53, 10**15 + 37])
def test_large_sizes_stay_inside(spark, size):
    """Numbers from both ends of a large range stay different and inside; the driver's numbers are those of the expression."""
    a, b = permute.bases(size)
    assert size <= a * b < size + max(1, a // 1000)
    at = np.concatenate([np.arange(5000), size - 1 - np.arange(5000)])
    rows = spark.createDataFrame([(int(x),) for x in at], "id long")
    got = [r["p"] for r in rows.select(permute.permuted(F.col("id"), size, 1, "x").alias("p")).collect()]
    assert len(set(got)) == len(got) and 0 <= min(got) and max(got) < size
    once = permute.numbers(at, a, b, permute.keys(1, "x"))
    assert all(g == o for g, o in zip(got, once.tolist(), strict=True) if o < size)
    assert abs(np.mean(np.array(got, float)) / size - 0.5) < 0.02


def test_every_kind_numbers_its_values(spark):
    """A kind that says it has n values gives n different ones."""
    params = {"enum": {"values": ["a", "b", "c"]}, "weighted-categorical": {"values": {"x": 5, "y": 1}}, "sku": {"length": 2}, "string.alphanumeric": {"length": 2}}
    for name, kind in KINDS.items():
        if kind.nth:
            p = params.get(name, {})
            size = numbered_values(name, p)
            n = min(size, 20_000)
            got = spark.range(n).select(unique_value(name, p, F.lit(size - 1) - F.col("id")).cast("string").alias("v"))
            assert got.filter("v is not null").distinct().count() == n, name


def schema(*columns, **more):
    return Schema.of(Table("t", (Column("id", "integer", primary=True), *columns), ("id",), **more))


def test_unique_columns_without_a_shuffle(spark):
    c = Column
    s = Schema.of(
        Table("t", (c("id", "integer", primary=True), c("email", unique=True), c("code", "integer", unique=True), c("name")), ("id",)),
        Table("u", (c("sku", primary=True), c("t_id", "integer"), c("phone", unique=True)), ("sku",), (ForeignKey(("t_id",), "t", ("id",)),)),
        Table("v", (c("u_sku",), c("id", "integer", primary=True)), ("id",), (ForeignKey(("u_sku",), "u", ("sku",)),)),
    )
    tables = {"t": {"count": 3000, "columns": {"email": "email", "name": "fullName", "code": {"kind": "uniformInt", "min": 1, "max": 3000}}}, "u": {"countPerParent": 2, "columns": {"sku": {"kind": "sku", "length": 3}, "phone": "phone"}}, "v": {"count": 500}}
    made = generate_tables(spark, build_plan(s, {"tables": tables}))
    assert made["t"].select("email").distinct().count() == 3000 == made["t"].select("code").distinct().count()
    assert {r["code"] for r in made["t"].collect()} == set(range(1, 3001))
    assert "Exchange" not in made["t"]._jdf.queryExecution().executedPlan().toString()
    assert made["u"].count() == 6000 == made["u"].select("sku").distinct().count() == made["u"].select("phone").distinct().count()
    assert made["v"].join(made["u"], made["v"].u_sku == made["u"].sku, "left_anti").count() == 0


def test_too_few_values_and_nulls(spark):
    few = {"kind": "uniformInt", "min": 0, "max": 3}
    with pytest.raises(GenerationError, match="no unique values"):
        generate_tables(spark, build_plan(schema(Column("code", "integer", unique=True)), {"tables": {"t": {"count": 5, "columns": {"code": few}}}}))
    whole = generate_tables(spark, build_plan(schema(Column("code", "integer", unique=True)), {"tables": {"t": {"count": 4, "columns": {"code": few}}}}))["t"]
    assert sorted(r["code"] for r in whole.collect()) == [0, 1, 2, 3]
    some = {"tables": {"t": {"count": 60, "columns": {"code": {"kind": "uniformInt", "min": 1, "max": 50, "nullProbability": 0.6}}}}}
    got = generate_tables(spark, build_plan(schema(Column("code", "integer", nullable=True, unique=True)), some))["t"].filter("code is not null")
    assert 5 < got.count() == got.distinct().count()
    child = Schema.of(Table("p", (Column("id", "integer", primary=True),), ("id",)), Table("t", (Column("id", "integer", primary=True), Column("p_id", "integer"), Column("code", "integer", unique=True)), ("id",), (ForeignKey(("p_id",), "p", ("id",)),)))
    late = generate_tables(spark, build_plan(child, {"tables": {"p": {"count": 3}, "t": {"countPerParent": 2, "columns": {"code": few}}}}))["t"]
    with pytest.raises(Exception, match="more rows than the 4 values"):
        late.collect()


def test_set_values_are_drawn_around(spark):
    """A column that personas or rows set is made unique by drawing again."""
    config = {"tables": {"t": {"count": 40, "columns": {"code": {"kind": "uniformInt", "min": 1, "max": 60}}, "rows": [{"code": 7}]}}}
    got = [r["code"] for r in generate_tables(spark, build_plan(schema(Column("code", "integer", unique=True)), config))["t"].collect()]
    assert len(set(got)) == 40 and 7 in got
