"""Ranked lexical search of a set of items over all documents, by a threshold-seeded join.

One pass over the texts writes, for each document, which of the items' terms it has and how often. From this the kth largest
impact of every term is stored. A term's kth impact bounds the kth score of every item that has the term from below: k documents
reach it by this term alone. An item's terms are put in the order of what they can give at most; those at the end whose sum stays below
that threshold cannot lift a document into the first k by themselves, so that only the other terms make candidates. A candidate
whose sum from these, with all that the others could add, still stays below goes; the rest are scored exactly. What a task has
found raises its thresholds further.

Documents never move: a task has whole documents, each with all its terms, and the items' terms come to it in blocks of bounded
size. Only the first k of each task and item are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.frames import ascii_words, cut, cut_rows, lists, map_arrow
from weftline.llm.tokens import LOWER, row_of, slices, word_bounds, word_hashes

K = 10
#: Terms of items, counted once an item, that a task holds at a time; more go into further blocks, each with its own pass.
PAIRS = 1 << 18
#: Pairs of a posting and an item that a task looks at together.
TOGETHER = 1 << 20
MARKS = np.zeros(256, bool)
MARKS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of the given lengths, laid end to end: which list each entry is of, and its place in that list."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


class Terms:
    """Terms by number, found by hash and then compared byte by byte."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        self.data = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        self.lengths = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        hashes = word_hashes(self.data[:-1], self.starts, self.starts + self.lengths) if raw else np.zeros(0, np.uint64)
        self.layers, left = [], np.arange(len(raw))
        while len(left):  # one layer, unless two terms have one hash
            h, first = np.unique(hashes[left], return_index=True)
            self.layers.append((h, left[first]))
            left = np.delete(left, first)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it is no term."""
        hashes = word_hashes(data, starts, ends)
        out = np.full(len(starts), -1)
        for h, terms in self.layers:
            at = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
            like = np.flatnonzero((h[at] == hashes) & (self.lengths[terms[at]] == ends - starts))
            term = terms[at[like]]
            of, k = spread(self.lengths[term])
            right = np.ones(len(like), bool)
            right[of[data[starts[like][of] + k] != self.data[self.starts[term][of] + k]]] = False
            out[like[right]] = term[right]
        return out


def index(docs: DataFrame, terms: Terms) -> DataFrame:
    """(doc_id, n, terms, counts) of every row of docs(doc_id, text): how many terms it has in all, and which of those given."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    size = max(1, len(terms.lengths))

    def run(batch: pa.RecordBatch):
        for lo, hi, data, offsets in slices(batch.column(1)):
            data = LOWER[data]
            starts, ends, first = word_bounds(data, offsets, MARKS)
            term = shared.value.find(data, starts, ends)
            hit = term >= 0
            key, n = np.unique(row_of(first)[hit] * size + term[hit], return_counts=True)
            held = np.bincount(key // size, minlength=hi - lo)
            yield {"doc_id": batch.column(0).slice(lo, hi - lo), "n": np.diff(first), "terms": lists((key % size).astype(np.int32), held), "counts": lists(n.astype(np.int32), held)}

    return cut(map_arrow(docs, run, "doc_id long, n long, terms array<int>, counts array<int>"))


def saturated(counts: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """A posting's impact but for the term's weight; n: the terms of its document."""
    norm = 100 - 75 + (75 * n * docs) // max(length, 1)
    return (1_000_000_000 * counts) // (1000 * counts + 8 * norm)


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most TOGETHER postings, or of one row."""
    for batch in batches:
        ends = np.cumsum(batch.column(2).value_lengths().to_numpy())
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOGETHER, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


class Postings:
    """The postings of a batch of the index, by row and term."""

    def __init__(self, batch: pa.RecordBatch, docs: int, length: int):
        column = lambda i: batch.column(i).flatten().to_numpy().astype(np.int64)
        held = batch.column(2).value_lengths().to_numpy().astype(np.int64)
        self.row = np.repeat(np.arange(batch.num_rows), held)
        self.term = column(2)
        self.impact = saturated(column(3), batch.column(1).to_numpy()[self.row], docs, length)


def merge(top: np.ndarray, group: np.ndarray, value: np.ndarray) -> None:
    """Puts values into the sorted rows of top, each of which keeps its largest."""
    k = top.shape[1]
    new = value > top[group, 0]
    group, value = group[new], value[new]
    order = np.lexsort((-value, group))
    group, value = group[order], value[order]
    some, first, n = np.unique(group, return_index=True, return_counts=True)
    nth = np.arange(len(group)) - np.repeat(first, n)
    most = np.zeros((len(some), k), np.int64)
    within = nth < k
    most[np.repeat(np.arange(len(some)), n)[within], nth[within]] = value[within]
    top[some] = np.sort(np.concatenate([top[some], most], 1), 1)[:, -k:]


def impacts(rows: DataFrame, terms: int, docs: int, length: int, k: int) -> DataFrame:
    """(term, df, kth, most) of every term that occurs, stored: how many documents have it, its kth largest impact (0 if fewer
    have it) and its largest, both but for the weight. Tasks hand on k values a term, and these are merged as they come."""
    schema = "term int, df long, top array<long>"

    def gather(batches: Iterator[pa.RecordBatch], raw: bool) -> Iterator[pa.RecordBatch]:
        df, top = np.zeros(terms, np.int64), np.zeros((terms, k), np.int64)
        for batch in stretches(batches) if raw else batches:
            if raw:
                p = Postings(batch, docs, length)
                df += np.bincount(p.term, minlength=terms)
                merge(top, p.term, p.impact)
            else:
                term = batch.column(0).to_numpy()
                np.add.at(df, term, batch.column(1).to_numpy())
                merge(top, np.repeat(term, k), batch.column(2).flatten().to_numpy())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some]), lists(top[some].ravel(), np.full(len(some), k))], ["term", "df", "top"])

    parts = rows.mapInArrow(lambda b: gather(b, True), schema)
    merged = parts.repartition("term").mapInArrow(lambda b: gather(b, False), schema)
    return cut(merged.select("term", "df", F.col("top")[0].alias("kth"), F.col("top")[k - 1].alias("most")))


class Block:
    """The items of a block: their terms with weights, thresholds, and which terms make candidates."""

    def __init__(self, item: np.ndarray, term: np.ndarray, count: np.ndarray, stored: pa.Table, terms: int, docs: int):
        df, kth, most = (np.zeros(terms, np.int64) for _ in range(3))
        for out, name in ((df, "df"), (kth, "kth"), (most, "most")):
            out[stored["term"].to_numpy()] = stored[name].to_numpy()
        weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], np.int64)
        gain = weight[term] * count
        self.items = int(item.max()) + 1 if len(item) else 0
        self.least = np.ones(self.items, np.int64)
        np.maximum.at(self.least, item, gain * kth[term])
        order = np.lexsort((term, -gain * most[term], item))
        item, term, gain = item[order], term[order], gain[order]
        self.starts = np.searchsorted(item, np.arange(self.items + 1))
        self.item, self.term, self.gain = item, term, gain
        bound = gain * most[term]
        after = np.cumsum(bound[::-1])[::-1]
        ends = np.append(after, 0)[self.starts[1:]]
        seed = (after - ends[item] >= self.least[item]) & (bound > 0)  # with those behind it, it can reach the threshold
        self.rest = np.zeros(self.items, np.int64)
        np.add.at(self.rest, item[~seed], bound[~seed])
        by_term = np.lexsort((item[seed], term[seed]))
        self.seed_item, self.seed_gain = item[seed][by_term], gain[seed][by_term]
        self.seed_starts = np.searchsorted(term[seed][by_term], np.arange(terms + 1))


def found(p: Postings, b: Block, least: np.ndarray, terms: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, item, exact score) of the pairs that reach their item's threshold. Rows are taken in stretches of TOGETHER pairs with
    items; a single row has at most as many as the block has terms."""
    degree = b.seed_starts[p.term + 1] - b.seed_starts[p.term]
    key = p.row * terms + p.term
    edges = np.flatnonzero(np.diff(p.row, prepend=-1))
    sums = np.append(np.cumsum(degree) - degree, degree.sum())
    lo = 0
    while lo < len(edges):
        hi = max(lo + 1, int(np.searchsorted(sums[edges], sums[edges[lo]] + TOGETHER, "right")) - 1)
        first, last = edges[lo], edges[hi] if hi < len(edges) else len(p.row)
        lo = hi
        of, k = spread(degree[first:last])
        at = b.seed_starts[p.term[first:last]][of] + k
        pair = p.row[first:last][of] * b.items + b.seed_item[at]
        gain = p.impact[first:last][of] * b.seed_gain[at]
        order = np.argsort(pair, kind="stable")
        pair, start = np.unique(pair[order], return_index=True)
        if not len(pair):
            continue
        item = pair % b.items
        may = np.add.reduceat(gain[order], start) + b.rest[item] >= least[item]
        row, item = pair[may] // b.items, item[may]
        width = b.starts[item + 1] - b.starts[item]
        total = np.zeros(len(row), np.int64)
        begin = 0
        while begin < len(row):
            end = max(begin + 1, int(np.searchsorted(np.cumsum(width[begin:]), TOGETHER, "right")) + begin)
            of, k = spread(width[begin:end])
            at = b.starts[item[begin:end]][of] + k
            want = row[begin:end][of] * terms + b.term[at]
            where = np.minimum(np.searchsorted(key, want), len(key) - 1)
            part = np.where(key[where] == want, p.impact[where] * b.gain[at], 0)
            total[begin:end] = np.add.reduceat(part, np.cumsum(width[begin:end]) - width[begin:end])
            begin = end
        reach = total >= least[item]
        yield row[reach], item[reach], total[reach]


def best(rows: DataFrame, b: Block, terms: int, docs: int, length: int, k: int) -> DataFrame:
    """(number, doc_id, score): of each task and item the k best documents, by falling score and rising id, null ids last."""
    shared = rows.sparkSession.sparkContext.broadcast(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        least = b.least.copy()
        held = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, bool), np.zeros(0, np.int64)]  # item, score, null id, id
        for batch in stretches(batches):
            ids = batch.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for row, item, score in found(Postings(batch, docs, length), b, least, terms):
                all_ = [np.concatenate(x) for x in zip(held, (item, score, null[row], ids[row]), strict=True)]
                order = np.lexsort((all_[3], all_[2], -all_[1], all_[0]))
                item, score = all_[0][order], all_[1][order]
                nth = np.arange(len(item)) - np.searchsorted(item, item)
                full = nth == k - 1
                least[item[full]] = np.maximum(least[item[full]], score[full])
                held = [x[order][nth < k] for x in all_]
        item, score, null, ids = held
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids, mask=null), pa.array(score)], ["number", "doc_id", "score"])

    return rows.mapInArrow(run, "number int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0, or all if fewer.

    A document is a row: rows that repeat an id or a text are ranked each on its own, a null id after other ids of equal score.
    Of items that repeat both id and text one is ranked, others that share an id each on its own; a null id is an id. A null, empty or
    wordless text has no terms: such documents count nowhere, such items give no rows; so do items of words that no document has.
    Very long texts are searched as a whole; a task handles one by itself and holds of it only the items' terms. Empty tables give
    no rows; other columns are not read."""
    spark = docs.sparkSession
    docs = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    named = cut_rows(items.select(items[f"`{item_col}`"].alias("item_id"), items[f"`{item_text}`"].alias("text")).distinct())
    named = named.select("item_id", "text", F.concat_ws(":", "file", "row").alias("item"))
    pairs = cut(named.select("item", F.explode(ascii_words(F.col("text"))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("n")))
    blocks = 1 + 2 * pairs.count() // PAIRS
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    out, sums = None, None
    for block in range(blocks):
        own = pairs.filter(F.col("block") == block).toArrow()
        if not own.num_rows:
            continue
        names, terms = (own[c].combine_chunks().dictionary_encode() for c in ("item", "term"))
        size = len(terms.dictionary)
        rows = index(docs, Terms(terms.dictionary.to_pylist()))
        sums = sums or rows.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        stored = impacts(rows, size, sums["n"], sums["l"], k)
        codes = lambda x: x.indices.to_numpy().astype(np.int64)
        held = Block(codes(names), codes(terms), own["n"].to_numpy(), stored.toArrow(), size, sums["n"])
        back = spark.createDataFrame(list(enumerate(names.dictionary.to_pylist())), "number int, item string")
        got = cut(best(rows, held, size, sums["n"], sums["l"], k).join(F.broadcast(back), "number").drop("number"))
        out = got if out is None else out.unionByName(got)
    if out is None:
        return named.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = out.withColumn("rank", nth).filter(F.col("rank") <= k)
    return ranked.join(named.drop("text"), "item").select("item_id", "rank", "doc_id", "score")
