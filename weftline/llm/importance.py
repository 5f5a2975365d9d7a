"""Quality selection by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and pairs of words are hashed into a fixed number of features. The target model counts features over texts that are
labelled good, the raw model over all texts. A text's importance weight is the ratio of its probabilities under the two: the log
ratios of its features, summed. Adding Gumbel noise to the log weight and keeping the k largest draws k texts without
replacement in proportion to these weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.frames import cut, map_arrow
from weftline.llm.tokens import LOWER, ngrams, row_of, slices, word_bounds, word_hashes

FEATURES = 1 << 14


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and every pair of words, in upper or lower case alike."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    h = word_hashes(data, starts, ends)
    pairs, of = ngrams(h, first, 2)
    fold = lambda x: (x >> np.uint64(50)).astype(np.int64)  # noqa: E731  14 bits
    return np.concatenate([row_of(first), of]), np.concatenate([fold(h), fold(pairs)])


def log_ratios(docs: DataFrame, targets: np.ndarray) -> np.ndarray:
    """Log of target over raw probability for each feature, add-one smoothed. docs: (id, text); targets: sorted ids."""
    shared = docs.sparkSession.sparkContext.broadcast(targets)

    def run(batch: pa.RecordBatch):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        good = np.isin(ids, shared.value)
        sums = np.zeros((2, FEATURES), np.int64)
        for lo, hi, data, offsets in slices(batch.column(1)):
            rows, which = features(data, offsets)
            sums[0] += np.bincount(which[good[lo:hi][rows]], minlength=FEATURES)
            sums[1] += np.bincount(which, minlength=FEATURES)
        some = np.flatnonzero(sums[1])
        yield {"feature": some, "target": sums[0][some], "raw": sums[1][some]}

    got = map_arrow(docs, run, "feature int, target bigint, raw bigint").groupBy("feature").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
    counts = np.ones((2, FEATURES))
    at = got["feature"].to_numpy()
    counts[0, at] += got["target"].to_numpy()
    counts[1, at] += got["raw"].to_numpy()
    counts /= counts.sum(1, keepdims=True)
    return np.log(counts[0] / counts[1])


def weigh(docs: DataFrame, ratios: np.ndarray, temper: float) -> DataFrame:
    """(id, n_features, log_weight) of every row of docs(id, text): the sum of its features' log ratios, times temper."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batch: pa.RecordBatch):
        for lo, hi, data, offsets in slices(batch.column(1)):
            rows, which = features(data, offsets)
            n = np.bincount(rows, minlength=hi - lo)
            sums = np.bincount(rows, shared.value[which], minlength=hi - lo)
            yield {"id": batch.column(0).slice(lo, hi - lo), "n_features": n, "log_weight": sums * temper}

    return map_arrow(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, n_features bigint, log_weight double")


def top_k(rows: DataFrame, k: int, bins: int = 4096, few: int = 1000) -> Column:
    """The condition that holds for the k rows with the largest key, of equal keys those with the smaller ids; key is not null.

    Finds the k-th key by counts of ever narrower bins: each round brings bins numbers to the driver, the last one at most few
    rows, however large the table (only rows that repeat both key and id can be more)."""
    if k <= 0:
        return F.lit(False)
    edge = rows.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).first()
    if k >= edge["n"]:
        return F.lit(True)
    lo, hi, left = edge["lo"], edge["hi"], k
    inside = rows
    for _ in range(8):
        step = (hi - lo) / bins
        if not step > 0 or lo + step == lo:
            break
        nth = F.least(F.floor((F.col("key") - lo) / step), F.lit(bins - 1)).cast("int")
        counts = {r["b"]: r["n"] for r in inside.groupBy(nth.alias("b")).agg(F.count("*").alias("n")).collect()}
        for b in sorted(counts, reverse=True):
            if left <= counts[b]:
                break
            left -= counts[b]
        inside = inside.filter(nth == b)
        bound = inside.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
        lo, hi = bound["lo"], bound["hi"]
        if counts[b] <= few:
            break
    last = inside.orderBy(F.desc("key"), "id").limit(left).agg(F.min("key").alias("key"), F.max_by("id", F.struct(-F.col("key"), "id")).alias("id")).first()
    return (F.col("key") > last["key"]) | ((F.col("key") == last["key"]) & (F.col("id") <= F.lit(last["id"])))


def resample(docs: DataFrame, good_ids: DataFrame, share: float, id_col: str = "doc_id", text_col: str = "text", most_targets: int = 20_000, seed: int = 7, temper: float = 1.0) -> DataFrame:
    """(doc_id, n_features, log_weight, gumbel_key, selected) of every row: share of the rows with words are selected.

    good_ids (doc_id) names labelled good texts; at most most_targets of them, by a hash of the id, make the target model, the
    one thing that is fitted on a sample. temper is a power of the weights; 1 draws by the ratio itself. The raw model counts every text. Of equal keys the smaller id is selected. A text
    that is null or has no word has no features, a null key and is never selected; so is a row with a null id. Rows that
    repeat an id get the same noise. Very long texts count with all their words, and weigh as much more. With no good id the models differ by nothing but smoothing. An empty table gives no rows;
    other columns are not read. Ids must be integers."""
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("text"))
    chosen = good_ids.select(F.col(good_ids.columns[0]).cast("long").alias("id")).filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(most_targets)
    targets = np.sort(chosen.toArrow()["id"].to_numpy())
    weighed = weigh(rows, log_ratios(rows, targets), temper)
    uniform = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = cut(weighed.withColumn("key", F.when(F.col("id").isNotNull() & (F.col("n_features") > 0), F.col("log_weight") - F.log(-F.log(uniform)))))
    able = keyed.filter("key is not null")
    wins = top_k(able, round(share * able.count()))
    return keyed.select(F.col("id").alias("doc_id"), "n_features", "log_weight", F.col("key").alias("gumbel_key"), F.coalesce(F.col("key").isNotNull() & wins, F.lit(False)).alias("selected"))


def good_share(labels: DataFrame) -> float:
    """The share of labelled rows that are good: what is drawn from all rows, so that the sample is as large as what is good."""
    got = labels.filter("quality is not null").agg(F.avg((F.col("quality") == 1).cast("double") * F.when(F.coalesce("toxic", F.lit(0)) == 1, 0.0).otherwise(1.0)).alias("s")).first()["s"]
    return float(got if got is not None else 1.0)
