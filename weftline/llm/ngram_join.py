"""Jaccard self-join of texts on word n-grams: MinHash banding for candidates, full n-gram sets for the verdict.

Texts that are equal are one class from the start, so copies of a text never meet each other. Classes are shuffled on the
hashes of their signature's bands. In a band bucket of few classes every two are a candidate pair. A larger bucket is cut
into blocks, and a task gets two blocks of it and counts links inside, so that no task holds the whole bucket and no row is
made for each of its pairs; such a pair is looked at in the first of its large buckets only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.frames import cut, lists, map_arrow, named_components
from weftline.llm.tokens import ngrams, signed, slices, word_bounds, word_hashes

#: A bucket of more classes than this is taken in blocks of BLOCK.
FEW = 24
BLOCK = 128


def choose_bands(threshold: float, recall: float, hashes: int = 192) -> tuple[int, int]:
    """(bands, rows): the most rows to a band with which a pair at the threshold shares a band with probability recall or
    more, within the number of hashes. More rows mean fewer candidates that fail."""
    for rows in range(hashes, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= hashes and bands <= 62:
            return bands, rows
    raise ValueError("no banding reaches this recall with so few hashes")


def factors(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(grams: np.ndarray, rows: np.ndarray, n: int, bands: int, width: int) -> np.ndarray:
    """(n, bands): hashes of the bands of each row's MinHash signature. Rows without n-grams are left 0."""
    out = np.zeros((n, bands), np.uint64)
    counts = np.bincount(rows, minlength=n)
    some = counts > 0
    if not some.any():
        return out
    heads = (np.cumsum(counts) - counts)[some]
    mults, salts = factors(bands * width), factors(bands * width + 1)[1:]
    for k in range(bands * width):
        low = np.minimum.reduceat((grams * mults[k]) >> np.uint64(32), heads)
        out[some, k // width] += (low + np.uint64(1)) * salts[k]
    return out


def signatures(docs: DataFrame, n: int, bands: int, width: int) -> DataFrame:
    """(row, id, digest, bands): the digest tells equal texts; texts without a word get no bands."""

    def run(batch: pa.RecordBatch):
        for lo, hi, data, offsets in slices(batch.column(1)):
            starts, ends, first = word_bounds(data, offsets)
            grams, rows = ngrams(word_hashes(data, starts, ends), first, n, short=True)
            found = band_hashes(grams, rows, hi - lo, bands, width)
            some = np.diff(first) > 0
            yield {"row": batch.column(3).slice(lo, hi - lo), "id": batch.column(0).slice(lo, hi - lo), "digest": batch.column(2).slice(lo, hi - lo), "bands": lists(signed(found[some].ravel()), some * bands)}

    return map_arrow(docs.select("id", "text", digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")), run, "row bigint, id bigint, digest binary, bands array<bigint>")


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram hash) of every distinct n-gram of every text, sorted."""
    rows, grams = [], []
    for lo, _, data, offsets in slices(texts):
        starts, ends, first = word_bounds(data, offsets)
        g, r = ngrams(word_hashes(data, starts, ends), first, n, short=True)
        order = np.lexsort((g, r))
        g, r = g[order], r[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        rows.append(r[new] + lo)
        grams.append(g[new])
    return (np.concatenate(rows), np.concatenate(grams)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def pair_jaccard(a: pa.Array, b: pa.Array, n: int) -> np.ndarray:
    """The Jaccard similarity of a[i] and b[i] on n-gram sets; 0 where both are empty."""
    (ra, ga), (rb, gb) = gram_sets(a, n), gram_sets(b, n)
    r, g = np.concatenate([ra, rb]), np.concatenate([ga, gb])
    order = np.lexsort((g, r))
    r, g = r[order], g[order]
    both = np.bincount(r[1:][(r[1:] == r[:-1]) & (g[1:] == g[:-1])], minlength=len(a))
    return both / np.maximum(np.bincount(ra, minlength=len(a)) + np.bincount(rb, minlength=len(a)) - both, 1)


def all_jaccard(texts: pa.Array, n: int, columns: int = 2048) -> np.ndarray:
    """Jaccard similarities of all texts of a bounded block with each other, by products of 0/1 matrices."""
    r, g = gram_sets(texts, n)
    sizes = np.bincount(r, minlength=len(texts))
    _, at, times = np.unique(g, return_inverse=True, return_counts=True)
    shared = times[at] > 1
    r, at = r[shared], at[shared]
    _, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    r, at = r[order], at[order]
    both = np.zeros((len(texts), len(texts)))
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        part = slice(*np.searchsorted(at, [lo, lo + columns]))
        hot = np.zeros((len(texts), columns), np.float32)
        hot[r[part], at[part] - lo] = 1
        both += hot @ hot.T
    return both / np.maximum(sizes[:, None] + sizes[None] - both, 1)


def block_links(block: pa.Table, n: int, threshold: float) -> pa.Table:
    """Of the rows (left, right, id, part, size, bands, large, band, text) of two blocks of a bucket: each linked id, the
    number of texts it links with here and the smallest id that links join it with here.

    Pairs within one block count in the unit of that block with itself; pairs that share an earlier large bucket do not."""
    ids = block["id"].to_numpy()
    part, size = block["part"].to_numpy(), block["size"].to_numpy()
    band, left, right = block["band"][0].as_py(), block["left"][0].as_py(), block["right"][0].as_py()
    bands = np.array(block["bands"].to_pylist(), np.int64)
    large = block["large"].to_numpy()
    link = all_jaccard(block["text"].combine_chunks(), n) >= threshold
    np.fill_diagonal(link, False)
    if left != right:
        link &= part[:, None] != part[None]
    for k in range(band):
        flag = (large >> k & 1).astype(bool)
        link &= ~((bands[:, k][:, None] == bands[:, k][None]) & flag[:, None])
    label = ids.copy()
    while True:  # at most as many rounds as the longest chain in the block
        low = np.minimum(label, np.where(link, label[None], np.iinfo(np.int64).max).min(1)) if len(ids) else label
        if (low == label).all():
            break
        label = low
    some = link.any(1)
    return pa.table({"id": ids[some], "root": label[some], "n": (link @ size.astype(np.float64)).astype(np.int64)[some]})


def linked(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(row, id, digest) of every row, the digest null where it links with nothing; and the classes of equal texts: (digest, key,
    text_id, size, n_links, root, class_id). key is one of the class's rows, and what links are made of, as ids may repeat; root
    is the smallest key and class_id the smallest id that links reach."""
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("text"))
    bands, width = choose_bands(threshold, recall)
    signed_rows = cut(signatures(rows, n, bands, width))
    able = signed_rows.filter("size(bands) > 0 and id is not null")
    classes = cut(able.groupBy("digest").agg(F.min("id").alias("text_id"), F.min("row").alias("key"), F.count("*").alias("size")))
    firsts = cut(able.select(F.col("row").alias("key"), "bands").join(classes, "key").select("key", "text_id", "size", "bands", "digest"))
    cells = firsts.select("key", F.posexplode("bands").alias("band", "hash"))
    buckets = cells.groupBy("band", "hash").agg(F.count("*").alias("members")).filter("members > 1")
    members = cut(cells.join(buckets, ["band", "hash"]))
    large = members.groupBy("key").agg(F.bit_or(F.expr(f"if(members > {FEW}, shiftleft(1L, band), 0L)")).alias("large"))
    texts = rows.select(F.col("id").alias("text_id"), digest(F.col("text")).alias("digest"), "text")
    known = cut(firsts.join(large, "key").join(texts, ["text_id", "digest"]).dropDuplicates(["key"]).select("key", "size", "bands", "large", "text"))

    # Buckets of few classes: candidate pairs, each once.
    few = members.filter(F.col("members") <= FEW).select("band", "hash", "key")
    pairs = few.withColumnRenamed("key", "a").join(few.withColumnRenamed("key", "b"), ["band", "hash"]).filter("a < b").select("a", "b").distinct()
    of = lambda s: known.select(F.col("key").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("size", "bands", "large", "text")])
    both = pairs.join(of("a"), "a").join(of("b"), "b").filter("not exists(sequence(0, size(bands_a) - 1), k -> bands_a[k] = bands_b[k] and (shiftright(large_a, k) & 1) = 1)")

    def verify(batch: pa.RecordBatch):
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            yes = pa.array(pair_jaccard(part.column(4), part.column(5), n) >= threshold)
            yield {k: part.column(i).filter(yes) for i, k in enumerate(("a", "b", "size_a", "size_b"))}

    small = cut(map_arrow(both.select("a", "b", "size_a", "size_b", "text_a", "text_b"), verify, "a bigint, b bigint, size_a bigint, size_b bigint"))

    # Large buckets: every two of their blocks.
    blocked = members.filter(F.col("members") > FEW).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    units = blocked.select("band", "hash", "key", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("band", "hash", "key", "part", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"))
    filled = units.join(known, "key").select("band", "hash", "left", "right", F.col("key").alias("id"), "part", "size", "bands", "large", "text")
    blocks = cut(filled.groupBy("band", "hash", "left", "right").applyInArrow(lambda t: block_links(t, n, threshold), "id bigint, root bigint, n bigint"))

    counts = small.select(F.col("a").alias("key"), F.col("size_b").alias("n")).union(small.select("b", "size_a")).union(blocks.select("id", "n")).groupBy("key").agg(F.sum("n").alias("n"))
    joined = named_components(small.select("a", "b").union(blocks.select("id", "root")), classes.select(F.col("key").alias("id"), F.col("text_id").alias("name"))).withColumnRenamed("id", "key")
    result = classes.join(counts, "key", "left").join(joined, "key", "left")
    result = result.select("digest", "key", "text_id", "size", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "key").alias("root"), F.coalesce("name", "text_id").alias("class_id"))
    return signed_rows.select("row", "id", F.when((F.size("bands") > 0) & F.col("id").isNotNull(), F.col("digest")).alias("digest")), result


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """(doc_id, text_id, class_id, n_links) of every row: text_id is the smallest id with the same text, class_id the
    smallest id that links reach, n_links the number of other rows whose texts have a Jaccard similarity of threshold or more
    on the sets of their n-word sequences, copies included. Nothing below the threshold links; of pairs at it the share
    recall is found, of more similar ones more. A text of fewer than n words counts as one sequence.

    Ids must be integers. A row without a word (null, empty, white space) links with nothing and is its own class; so is,
    under a null class, a row with a null id. Rows that repeat a text, with the same id or another, count as copies; rows that
    repeat an id with other texts are told apart, and each links as its own text does. An empty table gives no rows;
    other columns are not read. Work grows with the number of links between different texts, as they are counted one by one
    inside tasks; rows that are shuffled grow with the number of texts and, for a bucket of g texts, with g * g / BLOCK. Very long texts are
    compared on all their sequences; a task holds the texts of two blocks, so memory grows with what BLOCK such texts hold."""
    rows, classes = linked(docs, id_col, text_col, n, threshold, recall)
    out = rows.join(classes.select("digest", "text_id", "class_id", "n_links"), "digest", "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("text_id", "id").alias("text_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """The rows of docs, all columns, of which one stays for each class of linked texts: one with the smallest id, of several texts
    under that id the one with the smallest digest, and of rows that repeat both any one.

    Rows that link with nothing stay as they are: those without a word and those with a null id, also where they repeat. Other
    columns may have any names; a null in them changes nothing. Very long texts are compared as a whole, as link does it. An empty
    table gives no rows."""
    _, classes = linked(docs, id_col, text_col, n, threshold, recall)
    winners = classes.groupBy("root").agg(F.min(F.struct("text_id", "digest")).alias("first")).select("first.text_id", "first.digest")
    text, id_ = docs[f"`{text_col}`"], docs[f"`{id_col}`"]
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), id_.cast("long").alias("text_id"), digest(text).alias("digest"), (id_.isNotNull() & F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).alias("able"))
    kept = whole.filter("able").dropDuplicates(["text_id", "digest"]).join(winners, ["text_id", "digest"], "left_semi")
    return kept.select("doc").union(whole.filter("not able").select("doc")).select("doc.*")
