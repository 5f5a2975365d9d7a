"""Language identification by a byte convolutional network over fixed-length windows.

The network has filters of three widths over byte embeddings, takes each filter's maximum over the window and ends in a
softmax. It is trained in numpy on windows of a bounded sample of labelled texts. Applied, embedding and filters are folded
into tables by byte and by pair of bytes, so that a filter's outputs are sums of looked-up rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weftline.llm.frames import map_arrow, pick
from weftline.llm.tokens import slices

WIDTHS = (2, 3, 4)
UNDETERMINED = "und"


@dataclass
class ByteNet:
    """Parameters: emb (256, d), conv[w] (w * d, filters), their biases, and the last layer."""

    languages: list[str]
    window: int
    emb: np.ndarray
    conv: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fit(cls, windows: np.ndarray, labels: list[str], filters: int = 16, dims: int = 8, epochs: int = 6, rate: float = 4e-3, batch: int = 128, seed: int = 1) -> ByteNet:
        """Adam on the cross entropy, classes weighted alike. windows: uint8 (n, window); the order of rows does not depend
        on how Spark returned them if the caller sorts them."""
        rng = np.random.default_rng(seed)
        languages = sorted(set(labels))
        y = np.searchsorted(languages, labels)
        weight = len(y) / len(languages) / np.bincount(y, minlength=len(languages))[y]
        weight = np.minimum(weight, 20).astype(np.float32)
        p = {"emb": rng.normal(0, 0.3, (256, dims)), "out": rng.normal(0, 0.1, (filters * len(WIDTHS), len(languages))), "ob": np.zeros(len(languages))}
        for w in WIDTHS:
            p |= {f"c{w}": rng.normal(0, 1 / np.sqrt(w * dims), (w * dims, filters)), f"b{w}": np.zeros(filters)}
        p = {k: v.astype(np.float32) for k, v in p.items()}
        m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                rows = order[lo : lo + batch]
                grads = cls._gradients(p, windows[rows], y[rows], weight[rows])
                step += 1
                fall = rate * (0.5 if epoch >= epochs - 2 else 1.0)
                for k, g in grads.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    p[k] -= fall * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return cls(languages, windows.shape[1], p["emb"], {w: p[f"c{w}"] for w in WIDTHS}, {w: p[f"b{w}"] for w in WIDTHS}, p["out"], p["ob"])

    @staticmethod
    def _gradients(p: dict, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        n, size = x.shape
        dims = p["emb"].shape[1]
        e = p["emb"][x]
        flat = np.ascontiguousarray(e).reshape(n, size * dims)
        views, peaks, pooled = {}, {}, []
        for w in WIDTHS:
            views[w] = np.lib.stride_tricks.as_strided(flat, (n, size - w + 1, w * dims), (flat.strides[0], flat.strides[1] * dims, flat.strides[1]))
            z = views[w].reshape(-1, w * dims) @ p[f"c{w}"]
            z = z.reshape(n, size - w + 1, -1)
            peaks[w] = z.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(z, peaks[w][:, None], 1)[:, 0] + p[f"b{w}"], 0))
        h = np.concatenate(pooled, 1)
        logits = h @ p["out"] + p["ob"]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        d = prob
        d[np.arange(n), y] -= 1
        d *= (weight / n)[:, None]
        grads = {"out": h.T @ d, "ob": d.sum(0), "emb": np.zeros_like(p["emb"])}
        dh = (d @ p["out"].T) * (h > 0)
        at = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            filters = p[f"c{w}"].shape[1]
            g = dh[:, i * filters : (i + 1) * filters]
            grads[f"b{w}"] = g.sum(0)
            seen = views[w][at, peaks[w]]  # (n, filters, w * dims): what each filter's maximum looked at
            grads[f"c{w}"] = np.einsum("nf,nfk->kf", g, seen)
            back = g[:, :, None] * p[f"c{w}"].T[None]
            for k in range(w):
                np.add.at(grads["emb"], x[at, peaks[w] + k], back[:, :, k * dims : (k + 1) * dims])
        return grads

    def tables(self) -> dict:
        """Filter outputs by pair of bytes (65536 rows) and by byte (256 rows); their sums are the convolutions."""
        d = self.emb.shape[1]
        part = lambda w, k: self.emb @ self.conv[w][k * d : (k + 1) * d]
        pair = lambda w, k: (part(w, k)[:, None] + part(w, k + 1)[None]).reshape(65536, -1)
        return {"2": pair(2, 0), "3": pair(3, 0), "3+": part(3, 2), "4": pair(4, 0), "4+": pair(4, 2)}

    def probabilities(self, windows: np.ndarray, tables: dict, block: int = 96) -> np.ndarray:
        """Softmax outputs of windows (n, window)."""
        pooled = np.empty((len(windows), len(WIDTHS), len(self.bias[2])), np.float32)
        for lo in range(0, len(windows), block):
            x = np.ascontiguousarray(windows[lo : lo + block].T)  # by position, so that maxima run over whole rows
            pairs = x[:-1].astype(np.int32) * 256 + x[1:]
            pooled[lo : lo + block, 0] = np.take(tables["2"], pairs, 0).max(0)
            z = np.take(tables["3"], pairs[:-1], 0)
            z += np.take(tables["3+"], x[2:], 0)
            pooled[lo : lo + block, 1] = z.max(0)
            z = np.take(tables["4"], pairs[:-2], 0)
            z += np.take(tables["4+"], pairs[2:], 0)
            pooled[lo : lo + block, 2] = z.max(0)
        h = np.maximum(pooled + np.stack([self.bias[w] for w in WIDTHS]), 0).reshape(len(windows), -1)
        logits = h @ self.out + self.out_bias
        prob = np.exp(logits - logits.max(1, keepdims=True))
        return prob / prob.sum(1, keepdims=True)


#: Windows that are cut and scored at once, so that memory does not follow the longest text.
AT_ONCE = 4096


def cut_windows(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Every row's bytes in consecutive windows, the last one filled with zeros: in parts of at most AT_ONCE windows, their bytes, each
    one's row and its length."""
    counts = -(-np.diff(offsets) // window)
    before = np.concatenate([[0], np.cumsum(counts)])
    for lo in range(0, int(before[-1]), AT_ONCE):
        nth = np.arange(lo, min(lo + AT_ONCE, int(before[-1])))
        rows = np.searchsorted(before, nth, "right") - 1
        starts = offsets[:-1][rows] + (nth - before[rows]) * window
        lengths = np.minimum(window, offsets[1:][rows] - starts)
        out = np.zeros((len(rows), window), np.uint8)
        inside = np.arange(window) < lengths[:, None]
        out[inside] = data[(starts[:, None] + np.arange(window))[inside]]
        yield out, rows, lengths


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 600, windows_each: int = 6, window: int = 256, seed: int = 1) -> ByteNet:
    """Trains on at most about per_language texts of each language, chosen by a hash of the text, and windows_each windows,
    evenly spread, of each. These bounds are what reaches the driver; they do not depend on the table's size.

    Rows without text or language teach nothing. With no labelled row at all the net knows only 'und'."""
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).filter("text is not null and lang is not null and length(text) > 0")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return ByteNet.fit(np.zeros((1, window), np.uint8), [UNDETERMINED], epochs=1, seed=seed)
    draw = (F.xxhash64("text") % F.lit(1 << 30) + F.lit(1 << 30)) % F.lit(1 << 30)
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, per_language / n) * (1 << 30)))).otherwise(share)
    chosen = rows.filter(draw < share).dropDuplicates()  # copies share their hash; one is enough

    def spread(batch: pa.RecordBatch):
        for lo, hi, data, offsets in slices(batch.column(0)):
            full, done = -(-np.diff(offsets) // window), 0
            for cut, of, _ in cut_windows(data, offsets, window):
                nth = done + np.arange(len(of)) - (np.cumsum(full) - full)[of]
                keep = nth % np.maximum(1, -(-full // windows_each))[of] == 0
                done += len(of)
                yield {"lang": batch.column(1).slice(lo, hi - lo).take(pa.array(of[keep])), "bytes": pa.array([w.tobytes() for w in cut[keep]], pa.binary())}

    got = sorted((bytes(r["bytes"]), r["lang"]) for r in map_arrow(chosen, spread, "lang string, bytes binary").collect())
    x = np.frombuffer(b"".join(b for b, _ in got), np.uint8).reshape(-1, window)
    return ByteNet.fit(x, [lang for _, lang in got], seed=seed)


def scores(net: ByteNet, tables: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities (rows, languages), averaged over each row's windows by their bytes; zeros for an empty row."""
    sums = np.zeros((len(offsets) - 1, len(net.languages)))
    for windows, rows, lengths in cut_windows(data, offsets, net.window):
        np.add.at(sums, rows, net.probabilities(windows, tables) * lengths[:, None].astype(np.float64))
    return sums / np.maximum(np.diff(offsets), 1)[:, None]


def predict(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row: the language with the largest probability, averaged over all windows of the
    whole text by their bytes, and that average. Of equal averages the first language in sorted order is taken.

    A text that is null, empty or without a letter gets 'und' and the score 0. Repeated rows and ids, null ids and any other
    columns are allowed: rows are handled alone and only the two named columns are read. An empty table gives no rows. A very
    long text is cut into windows like any other, AT_ONCE of them at a time. The net, some KB whatever the table, is sent to the executors; tasks make its tables."""
    shared, held = docs.sparkSession.sparkContext.broadcast(net), []

    def run(batch: pa.RecordBatch):
        model = shared.value
        if not held:  # a task makes the tables, a hundred times the net, for itself
            held.append(model.tables())
        tables = held[0]
        for lo, hi, data, offsets in slices(batch.column(1)):
            mean = scores(model, tables, data, offsets)
            best = mean.argmax(1)
            yield {"doc_id": batch.column(0).slice(lo, hi - lo), "guess": pa.array([model.languages[k] for k in best]), "mean": np.clip(mean[np.arange(hi - lo), best], 0, 1), "letters": batch.column(2).slice(lo, hi - lo)}

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    kind = docs.schema[id_col].dataType.simpleString()
    out = map_arrow(rows, run, f"doc_id {kind}, guess string, mean double, letters boolean")
    return out.select("doc_id", F.when(F.col("letters"), F.col("guess")).otherwise(UNDETERMINED).alias("lang_pred"), F.when(F.col("letters"), F.col("mean")).otherwise(0.0).alias("score"))


def accepted(docs: DataFrame, net: ByteNet, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text has a letter and a language with the score least or more, as predict scores
    it. Other columns pass through the tasks untouched, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at, last = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables()
        for batch in batches:
            keep = [scores(model, tables, data, offsets).max(1) >= least for _, _, data, offsets in slices(batch.column(at))]
            letters = batch.column(last).to_numpy(zero_copy_only=False)
            mask = np.concatenate(keep) & letters if keep else letters
            yield pa.RecordBatch.from_arrays(batch.columns[:last], schema=pa.schema(list(batch.schema)[:last])).filter(pa.array(mask.astype(bool)))

    letters = F.coalesce(docs[f"`{text_col}`"].rlike(r"\p{L}"), F.lit(False))
    named = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)], letters.alias("letters"))
    return named.mapInArrow(run, StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])).toDF(*docs.columns)
