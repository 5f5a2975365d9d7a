"""Removal of repeated byte strings with enhanced suffix arrays and their common-prefix interval trees.

The corpus is split so that strings that may be equal meet: windows of the least length are sorted by their minimizer, and
runs of windows that are the same in many places are one class with a count: a leaf of the tree that stands for all of them.
The texts of different classes that may share a window are gathered, and a task builds the suffix array of all their windows
with common-prefix lengths between neighbours. A scan with a stack walks the tree of common-prefix intervals: every interval
at least as deep as the least length is a repeat with all its occurrences, and it is maximal if it cannot be extended to the
left, that is, if the bytes before its occurrences differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.frames import cut, lists, map_arrow
from weftline.llm.tokens import slices
from weftline.llm.windows import NO_ID, classes, digests, merged, numbered, opened, run_table

GRAM = 64
#: Classes that one key brings together in one suffix array; of more, single windows meet by their digests.
MOST = 1024
#: Bytes of class texts in one suffix array, besides those of the last key in it: at most MOST classes of less than 2 * window.
ARRAY_BYTES = 1 << 20
#: Symbols that the first ranking packs into 63 bits: nine for each, as the end of a text is smaller than any byte.
PACKED = 7


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each key, 1 and up, equal keys alike; a rank counts the smaller keys. And which keys are not alone."""
    order = np.argsort(key)
    sorted_key = key[order]
    head = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    sizes = np.diff(np.append(head, len(key)))
    rank = np.empty(len(key), np.int32)
    rank[order] = np.repeat(head + 1, sizes)
    tied = np.empty(len(key), bool)
    tied[order] = np.repeat(sizes > 1, sizes)
    return rank, np.flatnonzero(tied)


def rankings(text: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of all places by their first PACKED, 2 * PACKED, 4 * PACKED ... symbols; a text's end, end[place], comes before any
    byte. Doubles until no two places are alike or the longest text is compared. Only places that are still alike are sorted."""
    n = len(text)
    at = np.arange(n, dtype=np.int32)
    left, symbol = end - at, np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(PACKED, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(PACKED):
        key = key << np.uint64(9) | np.where(left > k, symbol[k : k + n], np.uint64(0))
    rank, tied = ranked(key)
    levels, width, longest = [rank], PACKED, int(left.max())
    while len(tied) and width < longest:
        behind = tied + width
        inside = behind < end[tied]
        nxt = np.zeros(len(tied), np.uint64)
        nxt[inside] = rank[behind[inside]]
        old = rank[tied].astype(np.uint64)
        order = np.argsort(old << np.uint64(32) | nxt)
        old, nxt = old[order].astype(np.int64), nxt[order]
        places = np.arange(len(order))
        group = np.concatenate([[True], old[1:] != old[:-1]])
        head = group | np.concatenate([[True], nxt[1:] != nxt[:-1]])
        base = np.maximum.accumulate(np.where(group, places, 0))
        new = old + np.maximum.accumulate(np.where(head, places, 0)) - base
        rank = rank.copy()
        rank[tied[order]] = new
        sizes = np.diff(np.append(np.flatnonzero(head), len(order)))
        still = np.zeros(len(tied), bool)
        still[order] = np.repeat(sizes > 1, sizes)
        tied = tied[still]
        levels.append(rank)
        width *= 2
    return levels


def suffix_array(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes text[starts[i]:ends[i]] in order, and the length of the common prefix of each with the one before it.

    Ranks by doubled widths give the order; they are kept, so that common prefixes are measured by the same widths, the widest
    first. Memory is about 60 bytes a byte of text, whatever the suffixes' lengths."""
    cuts = np.unique(ends)
    end = cuts[np.searchsorted(cuts, np.arange(int(cuts[-1])), "right")].astype(np.int32)
    levels = rankings(text[: len(end)], end)
    order = np.argsort(levels[-1][starts], kind="stable")
    a, b = starts[order[:-1]], starts[order[1:]]
    end_a, end_b = ends[order[:-1]], ends[order[1:]]
    same = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + same, b + same
        open_ = np.flatnonzero((x < end_a) & (y < end_b))
        alike = open_[levels[k][x[open_]] == levels[k][y[open_]]]
        same[alike] += PACKED << k
    common = np.zeros(len(order), np.int64)
    # What is shorter than a packed ranking is compared symbol by symbol; ranks of ends that are cut off alike count too far.
    same = np.minimum(same, np.minimum(end_a - a, end_b - b))
    for _ in range(PACKED - 1):
        x, y = a + same, b + same
        open_ = np.flatnonzero((x < end_a) & (y < end_b))
        alike = open_[text[x[open_]] == text[y[open_]]]
        same[alike] += 1
    common[1:] = same
    return order, common


def intervals(common: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every common-prefix interval of the suffix array at least as deep as least, children before
    their parents. Only stretches of the array that are deep enough are scanned."""
    deep = np.flatnonzero(common >= least)
    if not len(deep):
        return
    cuts = np.flatnonzero(np.diff(deep) > 1) + 1
    for stretch in np.split(deep, cuts):
        stack = [(0, int(stretch[0]) - 1)]
        for i, depth in zip(stretch.tolist(), common[stretch].tolist(), strict=True):
            left = i - 1
            while depth < stack[-1][0]:
                was, left = stack.pop()
                yield was, left, i - 1
            if depth > stack[-1][0]:
                stack.append((depth, left))
        last = int(stretch[-1])
        while len(stack) > 1:
            was, left = stack.pop()
            yield was, left, last


def maximal_repeats(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, suffixes) of the repeats among the given suffixes that cannot be extended to the left; suffixes are numbers
    into starts. first: where each suffix's own text begins; what stands before that is unknown and counts as different."""
    order, common = suffix_array(text, starts, ends)
    before = np.where(starts > first, text[np.maximum(starts - 1, 0)].astype(np.int64), -1 - np.arange(len(starts)))[order]
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    for depth, lo, hi in intervals(common, least):
        if changes[hi] > changes[lo]:
            yield depth, order[lo : hi + 1]


def class_texts(rows: DataFrame, of: DataFrame, window: int) -> DataFrame:
    """(h1, h2, windows, lead, left, right, n_left, n_right, text) of classes, text from the first place where they stand."""

    def take(batch: pa.RecordBatch):
        for lo, hi, data, offsets in slices(batch.column(2)):
            raw = data.tobytes()
            asked = batch.column(3).slice(lo, hi - lo)
            flat = asked.flatten()
            row = np.repeat(np.arange(hi - lo), asked.value_lengths().to_numpy())
            at = offsets[row] + flat.field("start").to_numpy()
            end = at + flat.field("windows").to_numpy() - 1 + window
            yield {k: flat.field(k) for k in ("h1", "h2", "windows", "lead", "left", "right", "n_left", "n_right")} | {"text": pa.array([raw[a:b] for a, b in zip(at.tolist(), end.tolist(), strict=True)], pa.binary())}

    return opened(rows, of, take, "h1 bigint, h2 bigint, windows int, lead int, left bigint, right bigint, n_left bigint, n_right bigint, text binary")


def covered(part: pa.Table, window: int) -> dict:
    """Of parts of classes (key, h1, h2, skip, windows, text), those with repeated windows: (h1, h2, spans) of the bytes of the class
    that they cover."""
    texts = part["text"].combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    text = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    count = part["windows"].to_numpy().astype(np.int64)
    of = np.repeat(np.arange(len(count)), count)
    starts = offsets[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    reach = np.zeros(len(starts), np.int64)
    for depth, members in maximal_repeats(text, starts, offsets[of + 1], offsets[of], window):
        reach[members] = np.maximum(reach[members], depth)
    hit = np.flatnonzero(reach)
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, starts[hit], 1)
    np.add.at(change, starts[hit] + reach[hit], -1)
    inside = np.cumsum(change) > 0
    edge = np.diff(inside.astype(np.int8), prepend=0)
    # A covered stretch ends where its class ends, even if the next class begins covered.
    cutpoints = offsets[1:-1]
    both = cutpoints[inside[cutpoints] & inside[cutpoints - 1]]
    lo = np.sort(np.concatenate([np.flatnonzero(edge == 1), both]))
    hi = np.sort(np.concatenate([np.flatnonzero(edge == -1), both]))
    row = np.searchsorted(offsets, lo, "right") - 1
    got = np.bincount(row, minlength=len(count))
    some = np.flatnonzero(got)
    base = offsets[row] - part["skip"].to_numpy()[row]
    spans = pa.StructArray.from_arrays([pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32))], ["lo", "hi"])
    take = pa.array(some)
    return {"h1": part["h1"].take(take), "h2": part["h2"].take(take), "spans": lists(spans, got[some])}


def by_arrays(texts: DataFrame, window: int) -> DataFrame:
    """(h1, h2, spans) of the classes that share windows with others of a key that has at most MOST: by suffix arrays of the
    texts of neighbouring keys. Windows that reach half their rest to the left of the minimizer meet by their left key, the
    others by their right one; a text is cut to what these windows cover, and skip says how much of it is cut off before."""
    lefts = F.least(F.greatest(F.col("lead") - (window - GRAM) // 2 + 1, F.lit(0)), F.col("windows"))  # windows of the first kind
    side = lambda key, n, skip, count: F.struct(key.alias("key"), F.col(n).alias("n"), skip.cast("int").alias("skip"), count.cast("int").alias("windows"))
    sides = F.array(side(F.col("left"), "n_left", F.lit(0), lefts), side(F.bitwise_not("right"), "n_right", lefts, F.col("windows") - lefts))
    keyed = texts.withColumn("side", F.explode(F.filter(sides, lambda x: x["n"].between(2, MOST) & (x["windows"] > 0)))).select("side.key", "h1", "h2", "side.skip", "side.windows", F.expr(f"substring(text, side.skip + 1, side.windows + {window - 1})").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def done() -> pa.RecordBatch:
            got = covered(pa.Table.from_batches(held), window)
            return pa.RecordBatch.from_pydict({k: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for k, v in got.items()})

        for batch in batches:
            keys = batch.column(0).to_numpy()
            heads = np.flatnonzero(np.concatenate([[len(keys) > 0 and last != keys[0]], keys[1:] != keys[:-1]]))
            sizes = np.concatenate([[0], np.cumsum(pa.compute.binary_length(batch.column(5)).to_numpy().astype(np.int64))])
            lo = 0
            for head in heads.tolist():  # an array ends between two keys only
                if size + sizes[head] - sizes[lo] >= ARRAY_BYTES:
                    held.append(batch.slice(lo, head - lo))
                    yield done()
                    held, size, lo = [], 0, head
            held.append(batch.slice(lo))
            size += int(sizes[-1] - sizes[lo])
            last = keys[-1] if len(keys) else last
        if held:
            yield done()

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(scan, "h1 bigint, h2 bigint, spans array<struct<lo:int,hi:int>>")


def by_windows(texts: DataFrame, window: int) -> DataFrame:
    """(h1, h2, spans) of the classes that share windows with others, for keys with more than MOST classes: a row and a digest
    for each of their windows, so that work stays in proportion and no task holds a key."""

    def each(batch: pa.RecordBatch):
        for lo, hi, data, offsets in slices(batch.column(2)):
            count = np.diff(offsets) - window + 1
            of = np.repeat(np.arange(hi - lo), count)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            at = offsets[of] + nth
            h = digests(data.tobytes(), at, at + window)
            take = pa.array(of + lo)
            yield {"h1": batch.column(0).take(take), "h2": batch.column(1).take(take), "nth": nth, "w1": h[:, 0], "w2": h[:, 1]}

    large = texts.filter((F.col("n_left") > MOST) | (F.col("n_right") > MOST)).select("h1", "h2", "text")
    found = cut(map_arrow(large, each, "h1 bigint, h2 bigint, nth int, w1 bigint, w2 bigint"))
    again = found.groupBy("w1", "w2").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("h1", "h2") for f in (F.min, F.max)]).filter("min_h1 < max_h1 or min_h2 < max_h2").select("w1", "w2")
    hits = found.join(again, ["w1", "w2"]).groupBy("h1", "h2").agg(F.collect_set("nth").alias("nth"))
    return hits.select("h1", "h2", F.transform("nth", lambda k: F.struct(k.alias("lo"), (k + window).alias("hi"))).alias("spans"))


def repeated_spans(docs: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The numbered rows, and (id, tag, spans) of those with bytes to remove: spans of bytes, possibly overlapping."""
    rows = numbered(docs, id_col, text_col)
    found = cut(classes(rows, False, window, GRAM))
    texts = cut(class_texts(rows, found.filter("n_left > 1 or n_right > 1"), window))
    near = by_arrays(texts, window).unionByName(by_windows(texts, window)).groupBy("h1", "h2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    whole = F.array(F.struct(F.lit(0).alias("lo"), (F.col("windows") - 1 + window).alias("hi")))
    known = found.select("h1", "h2", "times", "windows").join(near, ["h1", "h2"], "left")
    known = known.select("h1", "h2", F.when(F.col("times") > 1, whole).otherwise(F.col("spans")).alias("spans")).filter("spans is not null")
    hits = run_table(rows, False, window, GRAM).join(cut(known), ["h1", "h2"])
    placed = hits.select("id", "tag", F.transform("spans", lambda s: F.struct((s["lo"] + F.col("start")).alias("lo"), (s["hi"] + F.col("start")).alias("hi"))).alias("spans"))
    return rows, cut(placed.groupBy("id", "tag").agg(F.flatten(F.collect_set("spans")).alias("spans")))


def remove_repeats(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, spans, n_bytes, n_removed) of every row: kept holds the bytes that stay (they need not be UTF-8), spans
    the maximal removed stretches [lo, hi) in bytes.

    A byte goes if a string of window bytes that covers it also starts anywhere else, in the same row or another; overlaps
    count, matches stay within a row, and all is judged on the input. A null text counts as empty; texts shorter than window
    lose nothing. Rows that repeat a text, even with the same id, are repeats of each other. Null ids stay null. An empty
    table gives no rows; other columns are not read. A text is worked on as a whole by one task. A suffix array has at most
    ARRAY_BYTES and the texts of one key; where more than MOST different texts share a minimizer and half of a window beside
    it, their single windows meet by digest instead, so that work follows the bytes and no task holds a hot group."""
    rows, spans = repeated_spans(docs, window, id_col, text_col)

    def apply(batch: pa.RecordBatch):
        for lo, hi, data, offsets in slices(batch.column(1)):
            asked = batch.column(2).slice(lo, hi - lo)
            flat = asked.flatten()
            row = np.repeat(np.arange(hi - lo), asked.value_lengths().fill_null(0).to_numpy())
            base = offsets[row]
            gone = merged(len(data), base + flat.field("lo").to_numpy(), base + flat.field("hi").to_numpy())
            before = np.concatenate([[0], np.cumsum(gone)])
            start = gone.copy()
            start[1:] &= ~gone[:-1]
            inner = offsets[:-1][offsets[:-1] < len(data)]
            start[inner] = gone[inner]
            last = gone.copy()
            last[:-1] &= ~gone[1:]
            last[inner[inner > 0] - 1] = gone[inner[inner > 0] - 1]
            a, b = np.flatnonzero(start), np.flatnonzero(last) + 1
            of = np.searchsorted(offsets, a, "right") - 1
            got = pa.StructArray.from_arrays([pa.array((a - offsets[of]).astype(np.int32)), pa.array((b - offsets[of]).astype(np.int32))], ["lo", "hi"])
            left = data[~gone].tobytes()
            ends = (offsets - before[offsets]).tolist()
            yield {"doc_id": batch.column(0).slice(lo, hi - lo), "kept": pa.array([left[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), "spans": lists(got, np.bincount(of, minlength=hi - lo)), "n_bytes": np.diff(offsets), "n_removed": np.diff(before[offsets])}

    out = map_arrow(rows.join(spans, ["id", "tag"], "left").select("id", "text", "spans"), apply, "doc_id bigint, kept binary, spans array<struct<lo:int,hi:int>>, n_bytes bigint, n_removed bigint")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
