import json
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftline.functions import generators
from weftline.operators.generate import generate_tables
from weftline.plans.build import build_plan
from weftline.plans.model import Column, ForeignKey, Schema, Table
from weftline.sources import commits, documents
from weftline.streaming import sinks


def feed(spark, path, rows, name):
    spark.createDataFrame(rows, "k int, v string, n int").coalesce(1).write.mode("append").parquet(f"{path}/in")


def run(spark, path, sink, name="upserts"):
    stream = spark.readStream.schema("k int, v string, n int").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stream.writeStream.foreachBatch(sink).queryName(name).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()


def test_a_restart_neither_loses_nor_repeats(spark, tmp_path, monkeypatch):
    """The sink fails before its manifest, and the query before its own commit; what is read afterwards is each key's last row."""
    path, rng = str(tmp_path), np.random.default_rng(0)
    batches = [[(int(k), f"b{b}", b * 1000 + i) for i, k in enumerate(rng.integers(0, 60, 40))] for b in range(4)]
    want = {}
    for rows in batches:
        feed(spark, path, rows, "x")
        want |= {k: n for k, _, n in rows}
    sink, calls = sinks.upsert_sink(f"{path}/out", ["k"], "n", 4), []

    def fails(batch, number):
        calls.append(number)
        if len(calls) == 2:
            with monkeypatch.context() as m:
                m.setattr(commits.Files, "put", lambda *a: (_ for _ in ()).throw(OSError("lost before the manifest")))
                sink(batch, number)
        sink(batch, number)
        if len(calls) == 4:
            raise OSError("lost after the manifest")

    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            run(spark, path, fails)
    run(spark, path, fails)
    assert calls == [0, 1, 1, 2, 2, 3]
    got = sinks.read_table(spark, f"{path}/out")
    assert {r["k"]: r["n"] for r in got.collect()} == want and got.count() == len(want)
    sink(spark.createDataFrame([(1, "again", 10**6)], "k int, v string, n int"), 3)
    assert got.filter("v = 'again'").isEmpty() and sinks.read_table(spark, f"{path}/out").filter("v = 'again'").isEmpty()
    before = sorted(map(tuple, got.collect()))
    assert sinks.vacuum(spark, f"{path}/out") and sorted(map(tuple, sinks.read_table(spark, f"{path}/out").collect())) == before
    assert sinks.read_table(spark, f"{path}/none") is None


def test_running_counts_go_on_after_a_restart(spark, tmp_path):
    """Counts kept as state, put into a table by upserts; a listener hears of rows and batches."""
    path, taps = str(tmp_path), sinks.Taps()
    spark.streams.addListener(taps)
    total = Counter()
    for turn in range(2):
        rows = [(i, "hot" if i % 4 else "cold", turn) for i in range(100 + turn)]
        total.update(v for _, v, _ in rows)
        feed(spark, path, rows, "x")
        stream = spark.readStream.schema("k int, v string, n int").parquet(f"{path}/in")
        counts = sinks.running_counts(stream, "v", 3)
        sink = sinks.upsert_sink(f"{path}/counts", ["table", "part"], "batches")
        counts.writeStream.foreachBatch(sink).queryName(f"counts{turn}").outputMode("update").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert {r["table"]: r["rows"] for r in sinks.totals(sinks.read_table(spark, f"{path}/counts")).collect()} == total
    spark.range(1).count()
    spark._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    spark.streams.removeListener(taps)
    assert (taps.seen["counts0"]["rows"], taps.seen["counts1"]["rows"]) == (100, 101)
    assert taps.seen["counts1"]["batches"] == 1 and taps.seen["counts0"]["first"] <= taps.seen["counts1"]["last"] and not taps.seen["counts1"]["error"]


def test_types_of_mixed_documents(spark):
    docs = [{"a": 1, "b": {"c": 1}, "t": [1, "x"], "l": [{"q": 1}, {"q": 2.5}], "o": {"z": 1}, "_id": {"$oid": "f"}}, {"a": 2.5, "b": {"c": None, "d": True}, "o": 3, "at": {"$date": "2024-01-01"}}, {"a": None, "b": {"c": "x"}, "o": 4, "x.y": {"k": 1}}]
    frame = spark.createDataFrame([(json.dumps(d),) for d in docs] + [(None,)], "value string")
    got = {r["path"]: (r["n"], r["majority"], r["type"], r["conflict"]) for r in documents.document_types(frame).collect()}
    assert got["a"] == (3, "integer", "float", False) or got["a"] == (3, "float", "float", False)
    assert got["b.c"][2:] == ("string", True) and got["b.d"] == (1, "boolean", "boolean", False)
    assert got["o"] == (3, "integer", "json", True) and "o.z" not in got
    assert got["l[].q"][2:] == ("float", False) and got["t[]"][2:] == ("string", True) and got["_id"][2] == "uuid" and got["at"][2] == "timestamp"
    found = documents.leaves_of(documents.path_types(frame))
    assert dict(found)["t"] == "array" and dict(found)["o"] == "json" and "b" not in dict(found) and "l" not in dict(found)
    assert documents.document_types(frame.limit(0)).count() == 0


def table(*columns):
    return Schema.of(Table("t", (Column("id", "integer", primary=True), *columns), ("id",)))


@pytest.fixture
def arrow_kind():
    @generators.register_arrow("initials", "string", types=("string",), distinct=lambda p: 26**2)
    def initials(params, states):
        letters = [(generators.random_numbers(states, k) * 26).astype(int) + 65 for k in (1, 2)]
        return pa.array([params.get("prefix", "") + chr(a) + chr(b) for a, b in zip(*letters, strict=True)])

    yield
    del generators.KINDS["initials"]


def test_generators_in_arrow(spark, arrow_kind):
    """The same values in other partitions, in keys that others refer to, and in unique columns that are drawn again."""
    s = Schema.of(
        Table("t", (Column("code", primary=True), Column("other", unique=True)), ("code",)),
        Table("u", (Column("id", "integer", primary=True), Column("t_code")), ("id",), (ForeignKey(("t_code",), "t", ("code",)),)),
    )
    config = {"tables": {"t": {"count": 60, "columns": {"code": {"kind": "initials", "prefix": "x"}, "other": "initials"}}, "u": {"count": 40}}}
    made = generate_tables(spark, build_plan(s, config))
    rows = {tuple(r) for r in made["t"].collect()}
    assert len({o for _, o in rows}) == 60 and all(len(c) == 3 and len(o) == 2 for c, o in rows)
    assert made["u"].join(made["t"], made["u"].t_code == made["t"].code, "left_anti").isEmpty()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert {tuple(r) for r in generate_tables(spark, build_plan(s, config))["t"].repartition(7).collect()} == rows
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError, match="does not fit"):
        build_plan(table(Column("n", "integer")), {"tables": {"t": {"columns": {"n": "initials"}}}})


def test_records_stay_together_by_weight(spark):
    places = [{"city": f"c{i}", "land": f"l{i % 3}", "w": w} for i, w in enumerate([50, 1, 0, 9, 40])]
    of = lambda f, group="home": {"kind": "record", "of": "choice", "rows": places, "weight": "w", "group": group, "field": f}
    config = {"tables": {"t": {"count": 4000, "columns": {"city": of("city"), "land": of("land"), "work": of("city", "work"), "geo": {"kind": "record", "of": "geo.city", "field": "city"}, "lat": {"kind": "record", "of": "geo.city", "field": "lat"}}}}}
    s = table(Column("city"), Column("land"), Column("work"), Column("geo"), Column("lat", "float"))
    rows = generate_tables(spark, build_plan(s, config))["t"].collect()
    assert all(r["land"] == {p["city"]: p["land"] for p in places}[r["city"]] for r in rows)
    n = Counter(r["city"] for r in rows)
    assert n["c2"] == 0 and all(abs(n[p["city"]] - 40 * p["w"]) < 140 for p in places)
    assert any(r["city"] != r["work"] for r in rows)
    from weftline.functions.words import CITIES

    assert all((r["geo"], r["lat"]) in {(c[0], c[4]) for c in CITIES} for r in rows)
    share, other = generators.alias_table([p["w"] for p in places])
    back = [share[i] + sum(1 - share[j] for j in range(5) if other[j] == i and j != i) for i in range(5)]
    assert back == pytest.approx([p["w"] / 20 for p in places])
