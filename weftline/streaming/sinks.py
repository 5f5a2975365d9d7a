"""Streams into tables: upserts that a restart neither loses nor repeats, running counts kept as state, and what listeners hear.

A table lies in buckets of its keys. A batch writes anew only the buckets that it touches, beside the old ones, and then puts a
manifest into place, named by the batch, that says where each bucket lies. What no manifest names was never there, and a batch
whose manifest is there is not written again: that is what makes a repeated batch harmless.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from weftline.sources.commits import Files
from weftline.sources.stores import upsert

BUCKETS = 32


def manifest(files: Files, path: str) -> dict:
    """The last manifest: its batch (-1: none), the number of buckets and where each lies."""
    names = [n for n in files.names(f"{path}/_manifests") if n.isdigit()]
    return json.loads(files.text(f"{path}/_manifests/{names[-1]}")) if names else {"batch": -1, "at": {}}


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table as of its last batch; None if none has been written."""
    held = manifest(Files(spark, path), path)
    return spark.read.parquet(*[f"{path}/{at}" for at in held["at"].values()]) if held["at"] else None


def upsert_sink(path: str, keys: list[str], order: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: of rows with the same keys, in the table and the batch, the one with the largest order stays, of equal ones
    the newer. The number of buckets is that of the table's first batch."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files = Files(spark, path)
        held = manifest(files, path)
        if number <= held["batch"]:
            return
        n = held.get("buckets", buckets)
        new = batch.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")).persist()
        try:
            touched = [r[0] for r in new.select("__bucket").distinct().collect()]  # at most as many as there are buckets
            there = [f"{path}/{held['at'][str(b)]}" for b in touched if str(b) in held["at"]]
            old = spark.read.parquet(*there) if there else batch.limit(0)
            old = old.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))
            target = f"data/{number}-{uuid.uuid4().hex}"
            if touched:
                upsert(old, new, keys, order).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{path}/{target}")
        finally:
            new.unpersist()
        files.mkdirs(f"{path}/_manifests")
        at = held["at"] | {str(b): f"{target}/__bucket={b}" for b in touched}
        files.put(f"{path}/_manifests/{number:012d}", json.dumps({"batch": number, "buckets": n, "at": at}))

    return write


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes what the last manifest does not name, and older manifests. No batch may be running."""
    files = Files(spark, path)
    used = {at.split("/")[1] for at in manifest(files, path)["at"].values()}
    gone = [n for n in files.names(f"{path}/data") if n not in used]
    for n in gone:
        files.delete(f"{path}/data/{n}")
    for n in files.names(f"{path}/_manifests")[:-1]:
        files.delete(f"{path}/_manifests/{n}")
    return gone


class Counter(StatefulProcessor):
    """Rows and batches of a key so far."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "rows long, batches long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        before = self.seen.get() if self.seen.exists() else (0, 0)
        now = (before[0] + sum(map(len, rows)), before[1] + 1)
        self.seen.update(now)
        yield pd.DataFrame({"table": [key[0]], "part": [key[1]], "rows": [now[0]], "batches": [now[1]]})

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def running_counts(rows: DataFrame, table: str = "table", parts: int = 16) -> DataFrame:
    """(table, part, rows, batches) of a stream, an update for each table and part that a batch has rows of. A table's rows are
    dealt to parts, so that one with most of the rows is not one task's; totals() adds them up."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keyed = rows.select(F.col(table).alias("table"), F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int").alias("part"))
    return keyed.groupBy("table", "part").transformWithStateInPandas(Counter(), "table string, part int, rows long, batches long", "Update", "None")


def totals(counts: DataFrame) -> DataFrame:
    """(table, rows) of a table of running counts, one row for each table and part."""
    return counts.groupBy("table").agg(F.sum("rows").alias("rows"))


class Taps(StreamingQueryListener):
    """Hears every batch of the named queries: self.seen[name] has batches, rows, and the times of the first and last batch."""

    def __init__(self):
        self.seen: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.seen.setdefault(event.name or str(event.id), {"batches": 0, "rows": 0, "first": None, "last": None, "error": None})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            own, at = self.seen[p.name or str(p.id)], datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
            own |= {"batches": own["batches"] + 1, "rows": own["rows"] + p.numInputRows, "first": own["first"] or at, "last": at}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        for own in self.seen.values():
            own["error"] = own["error"] or event.exception
