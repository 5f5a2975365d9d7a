import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from weftline.llm import virtual_slots
from weftline.llm.virtual_slots import Entry, first_map, rebalanced, shard


def held(rows):
    """Checks what holds in every case, and gives the bytes of each shard."""
    loads, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return loads


def test_sizes_checksums_and_balance(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shard(docs, 40).collect()
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {k: (len(t) + 16, zlib.crc32(t)) for k, t in texts.items()}
    loads = held(rows)
    mean = sum(loads.values()) / 40
    assert len(rows) == len(texts) and set(loads) == set(range(40))
    assert max(loads.values()) <= max(1.02 * mean, max(map(len, texts.values())) + 16)


def test_many_rows_of_one_id(spark):
    """A third of all rows share an id, another part has none: shards stay as large as others, and no row is lost."""
    docs = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit("some text").alias("text"))
    rows = shard(docs, 40).collect()
    loads = held(rows)
    assert len(rows) == 30_000 and max(loads.values()) < 1.05 * min(loads.values())


def test_stretches_are_numbered_alike(spark, monkeypatch):
    monkeypatch.setattr(virtual_slots, "BLOCK", 7)
    rows = shard(spark.range(500).selectExpr("id as doc_id", "repeat('x', int(id % 9)) as text").repartition(3), 4).collect()
    assert len(rows) == 500 and len(held(rows)) == 4


def test_growing_moves_little_and_only_to_the_new_shard():
    entries = first_map([Entry(s, 1, 0, 1000 + s % 13) for s in range(8192)], 40)
    grown = rebalanced(entries, 41)
    moved = [(a.shard, b.shard) for a, b in zip(entries, grown, strict=True) if a.shard != b.shard]
    assert {b for _, b in moved} == {40} and len(moved) < 8192 / 41 * 1.1
    loads = [sum(e.bytes for e in grown if e.shard == s) for s in range(41)]
    assert max(loads) < 1.04 * min(loads)  # an entry is half a hundredth of a shard
    fewer = rebalanced(grown, 30)
    assert {e.shard for e in fewer} == set(range(30)) and all(a.shard == b.shard for a, b in zip(grown, fewer, strict=True) if a.shard < 30)
    assert rebalanced(entries, 40) == entries


def test_versions_are_kept_and_edited(spark, tmp_path):
    """A second run over more rows edits the stored map: nearly all slots stay, and both versions can be read."""
    path = f"file://{tmp_path}/map"
    first = spark.range(4000).selectExpr("id as doc_id", "repeat('x', 200) as text")
    a = {r["doc_id"]: r for r in shard(first, 8, path=path).collect()}
    more = first.union(spark.range(4000, 4400).selectExpr("id", "repeat('y', 3000)"))
    b = {r["doc_id"]: r for r in shard(more, 8, path=path).collect()}
    assert virtual_slots.versions(spark, path) == [1, 2] and {r["map_version"] for r in b.values()} == {2}
    assert sum(a[k]["shard"] == b[k]["shard"] for k in a) > 0.7 * len(a)
    loads = held(b.values())
    assert max(loads.values()) < 1.1 * min(loads.values())
    assert virtual_slots.load(spark, path, 1).agg(F.sum("bytes")).first()[0] == 4000 * 216
    assert virtual_slots.load(spark, path).agg(F.sum("bytes")).first()[0] == 4000 * 216 + 400 * 3016


def test_odd_rows(spark, odd_docs, no_docs):
    """Nulls, empty and very long texts, ties, repeated rows, empty tables and other columns."""
    rows = shard(odd_docs, 3).collect()
    held(rows)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in odd_docs.collect()), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == want
    assert shard(no_docs, 3).count() == 0
