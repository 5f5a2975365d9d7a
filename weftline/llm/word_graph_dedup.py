"""Removal of long word passages that occur earlier in the corpus, by compaction of a De Bruijn graph.

Every window of k words is an edge of the graph. A run of windows with one minimizer is a path of edges; where all texts that
hold the minimizer go on alike around it, the path does not branch and is one row with its first place. Only paths that share
a minimizer and half a window beside it, where the graph may branch, are opened into single edges, which a join brings together
with the first place of each; neighbouring edges that were first seen at neighbouring places then compact into paths again.
Hashes of minimizers bring texts together; what is equal is told by 128-bit digests of the words at the source places, so
that a collision of hashes costs work and no words. Source places decide what is the first occurrence and what goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.frames import cut, map_arrow
from weftline.llm.tokens import slices, word_bounds
from weftline.llm.windows import NO_ID, classes, digests, merged, numbered, opened, run_table, spelled

GRAM = 6


def single_edges(rows: DataFrame, branching: DataFrame, window: int) -> DataFrame:
    """(h1, h2, nth, e1, e2, id, tag, at): the edges of the paths in branching, a digest of each one's words, and its place in the
    path's first text."""

    def cut_edges(batch: pa.RecordBatch):
        for lo, hi, data, offsets in slices(batch.column(2)):
            starts, ends, first = word_bounds(data, offsets)
            raw, begins, stops = spelled(data, starts, ends)
            asked = batch.column(3).slice(lo, hi - lo)
            flat = asked.flatten()
            row = np.repeat(np.arange(hi - lo), asked.value_lengths().to_numpy())
            begin, count = flat.field("start").to_numpy().astype(np.int64), flat.field("windows").to_numpy().astype(np.int64)
            which = np.repeat(np.arange(len(begin)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            at = begin[which] + nth
            place = first[row[which]] + at
            edge = digests(raw, begins[place], stops[place + window - 1])
            take, rows_of = pa.array(which), pa.array(row[which] + lo)
            yield {"h1": flat.field("h1").take(take), "h2": flat.field("h2").take(take), "nth": nth, "e1": edge[:, 0], "e2": edge[:, 1], "id": batch.column(0).take(rows_of), "tag": batch.column(1).take(rows_of), "at": at}

    return opened(rows, branching, cut_edges, "h1 bigint, h2 bigint, nth int, e1 bigint, e2 bigint, id bigint, tag bigint, at int")


def earlier_spans(docs: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The numbered rows, and (id, tag, spans) of those with words to remove: spans of words, possibly overlapping."""
    rows = numbered(docs, id_col, text_col)
    paths = cut(classes(rows, True, window, GRAM))
    edges = cut(single_edges(rows, paths.filter("n_left > 1 or n_right > 1"), window))
    own = F.struct("id", "tag", "at")
    firsts = edges.groupBy("e1", "e2").agg(F.min(own).alias("first"), F.max(own).alias("last")).filter("first <> last").select("e1", "e2", "first")
    seen = edges.join(firsts, ["e1", "e2"]).filter(F.col("first") != own)
    # Neighbouring edges with neighbouring first places are one path.
    order = Window.partitionBy("h1", "h2").orderBy("nth")
    before = lambda c: F.lag(c).over(order)
    step = (before("nth") == F.col("nth") - 1) & (before("first.id") == F.col("first.id")) & (before("first.tag") == F.col("first.tag")) & (before("first.at") == F.col("first.at") - 1)
    chained = seen.withColumn("head", F.when(F.coalesce(step, F.lit(False)), 0).otherwise(1)).withColumn("path", F.sum("head").over(order))
    spans = chained.groupBy("h1", "h2", "path").agg(F.min("nth").alias("lo"), (F.max("nth") + window).alias("hi"))
    spans = spans.groupBy("h1", "h2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    known = cut(paths.select("h1", "h2", "times", "place").join(spans, ["h1", "h2"], "left").filter("times > 1 or spans is not null"))
    later = F.struct("id", "tag", "start") != F.col("place")
    all_of_it = F.array(F.struct(F.lit(0).alias("lo"), (F.col("windows") - 1 + window).alias("hi")))
    hits = run_table(rows, True, window, GRAM).join(known, ["h1", "h2"]).withColumn("spans", F.when(later, all_of_it).otherwise(F.col("spans"))).filter("spans is not null")
    placed = hits.select("id", "tag", F.transform("spans", lambda s: F.struct((s["lo"] + F.col("start")).alias("lo"), (s["hi"] + F.col("start")).alias("hi"))).alias("spans"))
    return rows, cut(placed.groupBy("id", "tag").agg(F.flatten(F.collect_set("spans")).alias("spans")))


def remove_earlier(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, n_words, n_removed) of every row: kept holds the words that stay, joined by one space.

    A word goes if a window of that many words that covers it also starts earlier: in a row with a smaller id, or in the same
    row before. Windows are judged on the input. Words are runs without white space, taken as they are. A null, empty or
    short text loses nothing (null: no words, kept ''). A null id counts as smaller than all others; rows that repeat an id
    and their text stand at the same place, so none of them is earlier, but later rows lose what they hold; of rows that repeat
    an id with other texts, the one whose text has the smaller 64-bit hash is earlier. An empty table gives no rows;
    other columns are not read. A text is worked on as a whole by one task. Work grows with the words, and in the shuffle
    with the runs, about a sixth of them, and the edges of branching paths."""
    rows, spans = earlier_spans(docs, window, id_col, text_col)

    def apply(batch: pa.RecordBatch):
        for lo, hi, data, offsets in slices(batch.column(1)):
            starts, ends, first = word_bounds(data, offsets)
            asked = batch.column(2).slice(lo, hi - lo)
            flat = asked.flatten()
            row = np.repeat(np.arange(hi - lo), asked.value_lengths().fill_null(0).to_numpy())
            base = first[row]
            gone = merged(len(starts), base + flat.field("lo").to_numpy(), base + flat.field("hi").to_numpy())
            raw = data.tobytes()
            kept = []
            for i in range(hi - lo):
                part = slice(first[i], first[i + 1])
                stay = ~gone[part]
                kept.append(b" ".join([raw[a:b] for a, b in zip(starts[part][stay].tolist(), ends[part][stay].tolist(), strict=True)]))
            n = np.diff(first)
            lost = np.add.reduceat(np.append(gone, False).astype(np.int64), first[:-1]) if hi > lo else n
            yield {"doc_id": batch.column(0).slice(lo, hi - lo), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": n, "n_removed": np.where(n > 0, lost, 0)}

    out = map_arrow(rows.join(spans, ["id", "tag"], "left").select("id", "text", "spans"), apply, "doc_id bigint, kept string, n_words bigint, n_removed bigint")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
