"""Runs of neighbouring windows that share a minimizer: how long repeats are found without a row for every position.

A window is a fixed number of consecutive tokens of one row. Its minimizer is the gram in it with the smallest hash, the
leftmost of equals; so equal windows have equal minimizers at the same place. Neighbouring windows with the same minimizer at
the same place make a run; windows that are equal lie in runs whose minimizers are equal. Hashes of minimizers only bring runs
together; which ones are equal is told by 128-bit digests of their bytes or words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from weftline.llm.frames import map_arrow
from weftline.llm.tokens import TABLE, mix, prefix, signed, slices, span_hash, word_bounds, word_hashes

NO_ID = -(1 << 63)


@dataclass
class Runs:
    """row: the row of each run; start: its first window's first token, counted in the row; count: how many windows it has;
    lead: tokens from there to the minimizer; gram: hash of the minimizer; left, right: hashes of the minimizer with half of what a window has beside it, on the left and
    on the right, 0 where the run does not reach so far; lo, hi: the run's tokens, counted in the slice."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    lead: np.ndarray
    gram: np.ndarray
    left: np.ndarray
    right: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all stretches of width values, by minima running forward and back within blocks of width."""
    n = len(values)
    pad = -n % width
    x = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(x, 1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(tokens: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> Runs:
    """The runs of rows whose tokens (64-bit values) are tokens[bounds[i]:bounds[i + 1]]."""
    n = len(tokens)
    none = np.zeros(0, np.int64)
    if n < window or not (np.diff(bounds) >= window).any():
        return Runs(none, none, none, none, *[none.astype(np.uint64)] * 3, none, none)
    sums = prefix(tokens)
    at = np.arange(n - gram + 1)
    grams = span_hash(sums, at, at + gram)
    order = (mix(grams) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    low = (sliding_min(order, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)  # by window's first token
    sizes = np.maximum(np.diff(bounds) - window + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.repeat(bounds[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(rows))
    low = low[starts]
    head = np.ones(len(low), bool)
    head[1:] = (low[1:] != low[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, len(low)))
    begin, anchor, row = starts[first], low[first], rows[first]
    end, half = begin + count - 1 + window, (window - gram) // 2
    before, after = anchor - begin >= half, end - anchor >= gram + half
    left = np.where(before, span_hash(sums, np.where(before, anchor - half, anchor), anchor + gram) | np.uint64(1), np.uint64(0))
    right = np.where(after, span_hash(sums, anchor, np.where(after, anchor + gram + half, anchor)) | np.uint64(1), np.uint64(0))
    return Runs(row, begin - bounds[:-1][row], count, anchor - begin, grams[anchor], left, right, begin, end)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, text): a null id counts as the smallest one; the tag, a hash of the text, tells rows apart that share an id."""
    text = docs[f"`{text_col}`"]
    return docs.select(F.coalesce(docs[f"`{id_col}`"].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words data[starts[i]:ends[i]] with one space behind each, and where each begins and ends there."""
    sizes = ends - starts
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    out = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    out[at + np.repeat(begin - starts, sizes)] = data[at]
    return out.tobytes(), begin, begin + sizes


def digests(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(n, 2): 128-bit hashes of the bytes raw[lo[i]:hi[i]] themselves. Enough for 1e13 stretches: 64 bits are not."""
    return np.frombuffer(b"".join([xxh3_128_digest(raw[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def batch_runs(batch: pa.RecordBatch, by_words: bool, window: int, gram: int) -> Iterator[tuple[int, Runs, np.ndarray]]:
    """The runs of the texts in column 2, slice by slice, with the slice's first row and digests of all tokens of each run."""
    for lo, _, data, offsets in slices(batch.column(2)):
        if by_words:
            starts, ends, first = word_bounds(data, offsets)
            r = runs(word_hashes(data, starts, ends), first, window, gram)
            raw, begin, end = spelled(data, starts, ends)
            yield lo, r, digests(raw, begin[r.lo], end[r.hi - 1])
        else:
            r = runs(TABLE[data], offsets, window, gram)
            yield lo, r, digests(data.tobytes(), r.lo, r.hi)


def run_table(rows: DataFrame, by_words: bool, window: int, gram: int) -> DataFrame:
    """(id, tag, start, windows, h1, h2) of all runs of rows(id, tag, text), over words or bytes; h1, h2: the digest."""

    def find(batch: pa.RecordBatch):
        for lo, r, h in batch_runs(batch, by_words, window, gram):
            at = pa.array(r.row + lo)
            yield {"id": batch.column(0).take(at), "tag": batch.column(1).take(at), "start": r.start, "windows": r.count, "h1": h[:, 0], "h2": h[:, 1]}

    return map_arrow(rows, find, "id bigint, tag bigint, start int, windows int, h1 bigint, h2 bigint")


def classes(rows: DataFrame, by_words: bool, window: int, gram: int) -> DataFrame:
    """(h1, h2, times, windows, lead, place, left, right, n_left, n_right) of the runs that occur more than once or that may share a
    window with others. Equal runs are one row; place (id, tag, start) is the first of their places.

    A window that two different runs share has the minimizer in it, and at least half of the rest lies to the left of it or to
    the right; so both runs have the same left or the same right. n_left and n_right say how many different runs have them.
    Equal runs of a batch are counted in the task, before the shuffle, so a passage that very many rows share costs few rows
    for each task."""

    def find(batch: pa.RecordBatch):
        got = list(batch_runs(batch, by_words, window, gram))
        if not got:
            return
        row, h = np.concatenate([r.row + lo for lo, r, _ in got]), np.concatenate([h for _, _, h in got])
        ids, tags = (batch.column(i).to_numpy()[row] for i in (0, 1))
        start, count, lead, grams, left, right = (np.concatenate([getattr(r, k) for _, r, _ in got]) for k in ("start", "count", "lead", "gram", "left", "right"))
        order = np.lexsort((start, tags, ids, h[:, 1], h[:, 0]))
        sorted_h = h[order]
        head = np.flatnonzero(np.concatenate([[True], (sorted_h[1:] != sorted_h[:-1]).any(1)])) if len(order) else order
        times = np.diff(np.append(head, len(order)))
        first = order[head]
        yield {"gram": signed(grams[first]), "h1": h[first, 0], "h2": h[first, 1], "times": times, "windows": count[first], "lead": lead[first], "id": ids[first], "tag": tags[first], "start": start[first], "left": signed(left[first]), "right": signed(right[first])}

    found = map_arrow(rows, find, "gram bigint, h1 bigint, h2 bigint, times bigint, windows int, lead int, id bigint, tag bigint, start int, left bigint, right bigint")
    # One exchange, by minimizer, serves the classes and the counts of their neighbours.
    each = found.repartition("gram").groupBy("gram", "h1", "h2").agg(F.sum("times").alias("times"), *[F.min(c).alias(c) for c in ("windows", "lead", "left", "right")], F.min(F.struct("id", "tag", "start")).alias("place"))
    near = lambda side: F.when(F.col(side) != 0, F.count("*").over(Window.partitionBy("gram", side))).otherwise(0).alias(f"n_{side}")
    return each.select("h1", "h2", "times", "windows", "lead", "place", "left", "right", near("left"), near("right")).filter("times > 1 or n_left > 1 or n_right > 1")


def opened(rows: DataFrame, of: DataFrame, fn, schema: str) -> DataFrame:
    """Maps the texts at whose first place classes of the table of stand: fn gets batches (id, tag, text, asked) with the classes
    asked for in each row, and gives columns. The requests of one row are gathered; they are fewer than its tokens. Rows that
    repeat id and text are opened once."""
    asked = of.groupBy("place.id", "place.tag").agg(F.collect_list(F.struct("h1", "h2", F.col("place.start").alias("start"), "windows", "lead", "left", "right", "n_left", "n_right")).alias("asked"))
    joined = asked.join(rows.dropDuplicates(["id", "tag"]), ["id", "tag"]).select("id", "tag", "text", "asked")
    return map_arrow(joined, fn, schema)


def merged(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n tokens lie in any stretch [start, end)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:n]) > 0
