import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from weftline.operators import quality
from weftline.operators.generate import generate_tables, growth, inverse_growth, seasons
from weftline.plans import graph
from weftline.plans.build import build_plan
from weftline.plans.model import Column, ForeignKey, Schema, Table, Timeline

START, END = 1_704_931_200_000, 1_750_550_400_000


@pytest.mark.parametrize("more", [{"growth": "linear", "total_growth": 3.0}, {"growth": "compound", "rate": 0.1}, {"growth": "scurve", "rate": 0.6}])
def test_seasons_invert(spark, more):
    """growth and inverse_growth undo each other over months of different weight, and months without weight get no rows."""
    line = Timeline(START, END, season={11: 1.8, "12": 2, 7: 0}, **more)
    q = (F.col("id") + 0.5) / 2000.0
    rows = spark.range(2000).select(q.alias("q"), inverse_growth(line, q).alias("t")).withColumn("back", growth(line, F.col("t"))).collect()
    assert all(math.isclose(r["q"], r["back"], abs_tol=1e-9) for r in rows) and all(0 <= r["t"] <= 1 for r in rows)
    parts = seasons(line)
    assert math.isclose(sum(p[1] for p in parts), 1) and 7 not in {p[4] for p in parts} and len(parts) == 17
    plain = {p[4]: p[1] for p in seasons(Timeline(START, END, season={}, **more))[:12]}
    november = [p for p in parts if p[4] == 11][0]
    assert november[1] / plain[11] == pytest.approx(1.8 * [p[1] for p in parts if p[4] == 8][0] / plain[8])


def test_seasons_by_a_function_of_the_date():
    """Weekends weigh nothing; a date without a weight counts as one."""
    line = Timeline(START, START + 28 * 86_400_000, season=lambda d: 0 if d.weekday() > 4 else None if d.day % 2 else 1)
    parts = seasons(line)
    assert len(parts) in (20, 21) and math.isclose(sum(p[1] for p in parts), 1)


def test_a_seasonal_table_from_configuration(spark):
    schema = Schema.of(Table("t", (Column("id", "integer", primary=True), Column("created_at", "timestamp")), ("id",)))
    config = {"tables": {"t": {"count": 6000, "timeline": {"start_ms": 1_704_067_200_000, "end_ms": 1_735_689_600_000, "jitter": 0.0, "season": "holiday"}}}}
    made = generate_tables(spark, build_plan(schema, config))["t"]
    n = {r["m"]: r["n"] for r in made.groupBy(F.month("created_at").alias("m")).agg(F.count("*").alias("n")).collect()}
    total = 31 * (0.7 + 4 + 0.8 + 2.0) + 29 * 0.85 + 30 * (3 + 1.8)
    for m, w in {1: 0.7 * 31, 2: 0.85 * 29, 6: 30, 11: 1.8 * 30, 12: 62}.items():
        assert abs(n[m] - 6000 * w / total) < 3
    with pytest.raises(ValueError, match="some month"):
        seasons(Timeline(START, START + 86_400_000, season={1: 0}))


def test_inclusions_of_many_columns(spark, monkeypatch):
    """All pairs by sets in plain Python, over more columns than one number can hold; nulls and frequent values among them."""
    monkeypatch.setattr(graph, "WIDTH", 3)
    tables, values = {}, {}
    for t in range(3):
        columns = [f"c{i}" for i in range(3)] + ["a.b"]
        rows = [tuple(None if (x * 7 + t + i) % 11 == 0 else (x * (i + 1) + t) % (20 + 9 * i * t) for i in range(4)) + (f"k{x % (4 + t)}",) for x in range(200)]
        tables[f"t{t}"] = spark.createDataFrame(rows, f"c0 int, c1 long, c2 short, `a.b` long, s{t} string".replace("short", "int"))
        for i, c in enumerate([*columns, f"s{t}"]):
            values[f"t{t}", c] = {r[i] for r in rows} - {None}
    want = {}
    for a in values:
        for b in values:
            same = isinstance(next(iter(values[a])), str) == isinstance(next(iter(values[b])), str)
            if a != b and same and len(values[a] & values[b]) >= 0.5 * len(values[a]):
                want[a + b] = (len(values[a]), len(values[a] & values[b]))
    got = {(r["child"], r["column"], r["parent"], r["key"]): (r["n_distinct"], r["n_found"]) for r in graph.inclusions(tables, 0.5).collect()}
    assert got == want and len(got) > 10
    assert graph.inclusions({"e": tables["t0"].limit(0)}).count() == 0


def test_keys_by_sketches(spark):
    """The smallest keys by counting in plain Python; among them columns that are nearly a key, and a key of three."""
    rows = [(i, i if i != 5 else 4, i % 40, i // 40 % 25, i // 1000, i % 2, None if i == 3 else i) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, almost long, a int, b int, c int, d int, gap long").select("almost", "a", "b", "c", "d", "gap", F.col("id").cast("double").alias("real"))
    names = ["almost", "a", "b", "c", "d"]
    of = lambda s: {tuple(r[names.index(c) + 1] for c in s) for r in rows}
    keys = [s for n in (1, 2, 3) for s in combinations(names, n) if len(of(s)) == 2000]
    keys = {",".join(s) for s in keys if not any(set(k) < set(s) for k in keys)}
    assert {r["columns"] for r in quality.candidate_keys(df, "t").collect()} == keys and "a,b,c" in keys
    assert quality.candidate_keys(df, "t", 2).count() == sum(k.count(",") < 2 for k in keys)
    assert quality.candidate_keys(df.limit(0), "t").count() == 0


def test_keys_shuffle_little(spark):
    """Of sets that nearly are keys most fall in a slice; only what may be a key is shuffled whole."""
    n = 40_000
    of = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)).alias(f"c{k}")
    df = spark.range(n).select((F.col("id") / 4).cast("long").alias("o"), of(1, 100), of(2, 90), of(3, 80), (F.col("id") % 4).alias("line"))
    store = spark.sparkContext._jsc.sc().statusStore()
    empty = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def shuffled() -> int:
        stages = store.stageList(None, False, False, empty, spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    got = {r["columns"] for r in quality.candidate_keys(df, "t").collect()}
    assert shuffled() - before < 5 * n  # once 7: every set's values of all rows
    rows = df.collect()
    distinct = lambda x: len({tuple(r[c] for c in x) for r in rows}) == n
    keys = [x for k in (1, 2, 3) for x in combinations(df.columns, k) if distinct(x)]
    assert got == {",".join(x) for x in keys if not any(set(y) < set(x) for y in keys)} and "o,line" in got


def test_single_repetitions(spark, monkeypatch):
    """One pair of equal rows is found in any slice; equal hashes of other values are no repetition."""
    df = spark.range(2000).withColumn("b", F.col("id").cast("string"))
    for k in (0, 3, 1234):
        assert quality.repeating(df.union(df.filter(F.col("id") == k)), [("id",), ("id", "b")]) == {("id",), ("id", "b")}
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: c[0] % 50)
    assert quality.repeating(df, [("id",), ("id", "b")]) == set()
    assert quality.repeating(df.withColumn("c", F.col("id") % 1999), [("id",), ("c",)]) == {("c",)}


def test_references_of_all_kinds(spark):
    """Keys of two columns, of other types, of the table itself, with nulls; one scan a table."""
    s = Schema.of(
        Table("p", (Column("a", "integer"), Column("b")), ("a", "b"), (), (("a",),)),
        Table("c", (Column("x", "integer"), Column("y"), Column("z")), (), (ForeignKey(("x", "y"), "p", ("a", "b")), ForeignKey(("z",), "p", ("a",)), ForeignKey(("x",), "c", ("x",)))),
        Table("none", (Column("x", "integer"),), (), (ForeignKey(("x",), "p", ("a",)),)),
    )
    p = spark.createDataFrame([(1, "u"), (2, "v"), (None, "w"), (2, "v")], "a long, b string")
    c = spark.createDataFrame([(1, "u", "1"), (1, "v", "9"), (2, None, None), (None, "w", "2"), (2, "v", "2"), (2, "v", "2")], "x int, y string, z string")
    got = {(r["child"], r["column"]): tuple(r)[3:] for r in quality.reference_report({"p": p, "c": c, "none": c.limit(0).select("x")}, s).collect()}
    assert got == {("c", "x,y"): (6, 2, 1), ("c", "z"): (6, 1, 1), ("c", "x"): (6, 1, 0), ("none", "x"): (0, 0, 0)}


def test_distinct_counts_in_one_scan(spark):
    df = spark.createDataFrame([(1, 1.5, [1], None, b"a"), (2, 1.5, [1], None, b"a"), (2, None, [2], None, b"b")], "a int, b double, c array<int>, `d.e` string, f binary")
    assert {tuple(r)[1:] for r in quality.distinct_counts(df, "t").collect()} == {("a", 3, 2, False), ("b", 3, 1, False), ("c", 3, 2, False), ("d.e", 3, 0, False), ("f", 3, 2, False)}
    assert [tuple(r) for r in quality.distinct_counts(df.limit(0), "t", ["a"]).collect()] == [("t", "a", 0, 0, True)]
