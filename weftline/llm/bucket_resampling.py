"""Resampling towards a target distribution, without exploding texts.

Higher-order functions make each document's array of feature buckets. A bucket's gain is the log ratio of its share in the target
texts and in all documents; the gains are one literal array, and a document's weight sums its buckets' entries. Gumbel noise
from a hash of the id turns weights into draws without replacement. Only totals by bucket, and the narrow rows that may be drawn,
are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.frames import ascii_words, cut, cut_rows

BUCKETS = 10_000
LEAST_WORDS = 20
#: Counts by score that come to the driver to find how low a drawn score can be.
BINS = 4096


def features(words: Column, most: int) -> Column:
    """All runs of 1 to most consecutive words, joined by one space, repeats kept."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(words, *map(runs, range(2, most + 1)))


def bucketed(docs: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(doc_id, n_words, buckets) of every row; an array of buckets for each, in the shared folder, so that texts are read once."""
    words = docs.select(docs[f"`{id_col}`"].alias("doc_id"), ascii_words(docs[f"`{text_col}`"]).alias("words"))
    bucket = lambda f: (F.crc32(f.cast("binary")) % BUCKETS).cast("short")
    return cut(words.select("doc_id", F.size("words").cast("long").alias("n_words"), F.transform(features(F.col("words"), most), bucket).alias("buckets")))


def totals(rows: DataFrame) -> np.ndarray:
    """How often each bucket occurs in rows(buckets). A task counts all its rows before it gives anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            sums += np.bincount(batch.column(0).flatten().to_numpy(), minlength=BUCKETS)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])], ["bucket", "n"])

    got = rows.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousandth's floor of each bucket's log ratio, both counts raised by one."""
    s, t = int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + BUCKETS) / ((a + 1) * (t + BUCKETS)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)])


def summed(gain: np.ndarray) -> Column:
    """The sum of the gains of a row's buckets; the gains are one literal of the plan."""
    literal = F.lit(gain)
    return F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(literal, b + F.lit(1)))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def lowest_drawn(able: DataFrame, k: int) -> int | None:
    """A score that at least k rows reach, as high as counts in BINS steps can tell; None: no row is drawn."""
    edge = able.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    if k <= 0 or edge["lo"] is None:
        return None
    step = (edge["hi"] - edge["lo"]) // BINS + 1
    counts = {r["b"]: r["n"] for r in able.groupBy(F.floor((F.col("score") - edge["lo"]) / step).alias("b")).agg(F.count("*").alias("n")).collect()}
    for b in sorted(counts, reverse=True):
        k -= counts[b]
        if k <= 0:
            return edge["lo"] + b * step
    return edge["lo"]


def ranked(rows: DataFrame) -> DataFrame:
    """rows with rank, from 1, by falling score and rising doc_id: sorted by ranges, and a row's number in its file added to the
    rows of the files before. Rows that repeat score and id are told apart by their places, so that they may lie in several ranges."""
    sorted_ = cut_rows(rows.withColumn("tie", F.xxhash64("file", "row")).drop("file", "row").orderBy(F.desc("score"), "doc_id", "tie"))
    counts = sorted_.groupBy("file").agg(F.count("*").alias("n"))
    starts = counts.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("start"))  # a row for each task
    return sorted_.join(F.broadcast(starts), "file").withColumn("rank", F.col("start") + F.col("row") + 1).drop("start", "tie", "file", "row")


def resample(docs: DataFrame, targets: DataFrame, percent: int = 10, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", most: int = 1, least: int = LEAST_WORDS, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank is set on those that are drawn.

    Of the N rows with at least least words, floor(percent * N / 100) are drawn, those with the highest scores, of equal scores the
    smaller ids. A null, empty or wordless text has no features, weight 0 and is never drawn; a null id has neither noise nor
    score and is never drawn, but its text counts. Rows that repeat an id get the same noise, and each is drawn on its own. Very
    long texts are scored as a whole: a row's array has two bytes a feature. An empty table gives no rows, an empty target table
    leaves only the documents' own counts; other columns are not read."""
    rows = bucketed(docs, id_col, text_col, most)
    target = bucketed(targets, target_col, target_col, most)
    weight = summed(gains(totals(rows), totals(target)))
    scored = cut_rows(rows.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = (F.col("n_words") >= least) & F.col("score").isNotNull()
    n = scored.filter(F.col("n_words") >= least).count()
    k = percent * n // 100
    low = lowest_drawn(scored.filter(able), k)
    columns = ("doc_id", "n_features", "weight", "score")
    none = F.lit(None).cast("long").alias("rank")
    if low is None:
        return scored.select(*columns, none)
    may = able & (F.col("score") >= low)
    drawn = ranked(scored.filter(may)).select(*columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.filter(~F.coalesce(may, F.lit(False))).select(*columns, none))
