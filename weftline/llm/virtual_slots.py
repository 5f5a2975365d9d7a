"""Sharding by fixed virtual slots.

Records are hashed by their id into some thousands of slots; the bytes of each slot are summed; a stored, versioned map says
which shard a slot is in. Rebalancing and growth edit the map, a few slots at a time, and never the hash: what the edit does not
name stays where it is.

A slot that is heavy, as when very many rows share an id or have none, is opened into parts by the rows' places, each with an
entry of its own in the map, so that no key weighs more than a fraction of a shard.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.frames import cut_rows, shared_dir

SLOTS = 1 << 13
#: Bytes that every record has besides its text.
FIXED = 16
#: A slot of more than this share of a shard's mean is opened into parts of about that size.
HEAVY = 1 / 16
#: Rows of a stretch that are numbered together.
BLOCK = 1 << 16
MAP = "virtual_slot int, parts int, part int, bytes long, shard int"


@dataclass(frozen=True)
class Entry:
    """A slot, or a part of one, with its bytes and its shard (-1: none yet)."""

    slot: int
    parts: int
    part: int
    bytes: int
    shard: int = -1


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, file, row) of every row of docs, written to the shared folder."""
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    key = docs[f"`{id_col}`"]
    return cut_rows(docs.select(key.alias("doc_id"), (F.octet_length(text) + F.lit(FIXED)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("virtual_slot")))


def slot_bytes(rows: DataFrame, shards: int, slots: int = SLOTS) -> list[Entry]:
    """An entry for each of the slots and, for heavy ones, each part. What comes to the driver is bounded by slots and shards."""
    sums = {r["virtual_slot"]: r["b"] for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect()}
    most = max(1.0, sum(sums.values()) / shards * HEAVY)
    parts = {s: int(-(-b // most)) for s, b in sums.items() if b > most}
    out = [Entry(s, 1, 0, sums.get(s, 0)) for s in range(slots) if s not in parts]
    if parts:
        cut_up = rows.sparkSession.createDataFrame(sorted(parts.items()), "virtual_slot int, parts int")
        found = rows.join(F.broadcast(cut_up), "virtual_slot").groupBy("virtual_slot", part_of().alias("part")).agg(F.sum("size").alias("b")).collect()
        held = {(r["virtual_slot"], r["part"]): r["b"] for r in found}
        out += [Entry(s, n, k, held.get((s, k), 0)) for s, n in sorted(parts.items()) for k in range(n)]
    return out


def part_of() -> Column:
    """The part of a row, of the parts of its slot, by the row's place."""
    return F.pmod(F.xxhash64("file", "row"), F.col("parts")).cast("int")


def first_map(entries: Iterable[Entry], shards: int) -> list[Entry]:
    """Every entry in a shard: the heaviest first, each into the lightest shard; empty slots in turn."""
    heap, out = [(0, s) for s in range(shards)], []
    for e in sorted(entries, key=lambda e: (-e.bytes, e.slot, e.part)):
        if e.bytes:
            load, s = heapq.heappop(heap)
            heapq.heappush(heap, (load + e.bytes, s))
        else:
            s = e.slot % shards
        out.append(replace(e, shard=s))
    return out


def rebalanced(entries: list[Entry], shards: int) -> list[Entry]:
    """The map edited for the entries' present bytes and for shards shards.

    An entry leaves a shard if that brings the shard closer to the mean, the heaviest first, so that few move, and goes to the
    lightest shard if that does not lift it further above the mean than the entry's half; else it stays. Entries of shards that are
    gone, and new ones, go to the lightest."""
    mean = sum(e.bytes for e in entries) / shards
    loads, at, leaving = [0] * shards, {}, []
    heaviest = lambda found: sorted(found, key=lambda e: (-e.bytes, e.slot, e.part))
    homeless = [e for e in entries if not 0 <= e.shard < shards]
    for e in entries:
        if 0 <= e.shard < shards:
            loads[e.shard] += e.bytes
            at.setdefault(e.shard, []).append(e)
    for s, held in at.items():
        for e in heaviest(held):
            if e.bytes and loads[s] - mean > e.bytes / 2:
                loads[s] -= e.bytes
                leaving.append(e)
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    to = {}
    for e in heaviest(homeless) + heaviest(leaving):
        while heap[0][0] != loads[heap[0][1]]:  # loads that have changed since
            heapq.heappop(heap)
        load, s = heap[0]
        if 0 <= e.shard < shards and load + e.bytes / 2 > mean:
            s = e.shard
        loads[s] += e.bytes
        heapq.heappush(heap, (loads[s], s))
        to[e.slot, e.parts, e.part] = s
    return [replace(e, shard=to.get((e.slot, e.parts, e.part), e.shard)) for e in entries]


def on(entries: list[Entry], old: list[Entry]) -> list[Entry]:
    """The entries, new sums of the same slots, in the shards that an older map has for them; parts cut anew have none yet."""
    known = {(e.slot, e.parts, e.part): e.shard for e in old}
    return [replace(e, shard=known.get((e.slot, e.parts, e.part), -1)) for e in entries]


def save(spark: SparkSession, entries: list[Entry], path: str) -> int:
    """Stores the map as the next version under path, and returns its number. Older versions stay."""
    version = 1 + max(versions(spark, path), default=0)
    rows = [(e.slot, e.parts, e.part, e.bytes, e.shard) for e in entries]
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{path}/version={version}")
    return version


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions under path that were written whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or ()
    return sorted(int(x.getPath().getParent().getName().partition("=")[2]) for x in found)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored map, by default the last."""
    return spark.read.schema(MAP).parquet(f"{path}/version={version or versions(spark, path)[-1]}")


def entries_of(stored: DataFrame) -> list[Entry]:
    return [Entry(r["virtual_slot"], r["parts"], r["part"], r["bytes"], r["shard"]) for r in stored.collect()]


def placed(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """rows of sized() with their shard by a stored map, whose size is bounded by slots and shards."""
    cut_up = F.broadcast(stored.select("virtual_slot", "parts").distinct())
    to = F.broadcast(stored.select("virtual_slot", "part", "shard"))
    return rows.join(cut_up, "virtual_slot").withColumn("part", part_of()).join(to, ["virtual_slot", "part"]).drop("part", "parts")


def numbered(rows: DataFrame) -> DataFrame:
    """rows(file, row, shard, ...) with slot, the place in the shard, from 0 without gaps.

    Counts by stretch of rows and shard are few; each stretch starts where those before it end, and only within a stretch of
    BLOCK rows is a number taken, so that neither a shard nor a key is one task's work."""
    cells = rows.withColumn("block", F.floor(F.col("row") / BLOCK))
    counts = cells.groupBy("file", "block", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("file", "block")
    starts = counts.select("file", "block", "shard", (F.sum("n").over(before) - F.col("n")).alias("start"))
    within = Window.partitionBy("file", "block", "shard").orderBy("row")
    return cells.withColumn("nth", F.row_number().over(within)).join(starts, ["file", "block", "shard"]).withColumn("slot", F.col("start") + F.col("nth") - 1).drop("block", "nth", "start")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version) of every row of docs.

    The law is bytes: shards hold nearly equal sizes, as far as single records allow, since a record is never cut. The map is
    stored under path (a folder of its own in the shared folder by default); if one is there, it is edited instead of made, and
    slots that need not move stay. slot numbers the rows of a shard from 0. A null text has no bytes and the checksum of none;
    null ids hash alike, and rows that repeat an id share a slot, which is opened into parts when it is heavy. Very long texts
    are measured as a whole and weigh what they weigh: one that exceeds a shard's mean makes its shard that much larger. An
    empty table gives no rows; other columns are not read."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = sized(docs, id_col, text_col)
    entries = slot_bytes(rows, shards)
    have = versions(spark, path)
    edited = rebalanced(on(entries, entries_of(load(spark, path))), shards) if have else first_map(entries, shards)
    version = save(spark, edited, path)
    out = numbered(placed(rows, load(spark, path, version)))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"))
