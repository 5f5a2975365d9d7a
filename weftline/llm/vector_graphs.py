"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

Equal vectors are one from the start. Each shard's vectors are linked into a graph of layers. An audit then asks the graph for
vectors of the shard and for new ones drawn near them, between the threshold and the vector itself, so that there are links to
find however rare they are among the vectors; a scan of the shard gives the truth, and the beam is widened until the audit
passes. Where no beam passes, the shard is scanned for every vector. Every vector searches every shard: the vectors stream past
a graph that a task has loaded once. Where a beam fills up with links it is widened, and at last the shard is scanned for that
vector. Links are decided by cosine in double precision; components are united over all shards.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.frames import cut, named_components
from weftline.llm.tokens import mix

DEGREE = 12
BUILD_BEAM = 40
#: Shards are as many as keep one within SHARD vectors, LEAST_SHARDS at least.
SHARD, LEAST_SHARDS = 50_000, 8
#: A beam wider than this is no cheaper than a scan of the shard.
WIDEST = 256
#: The beams that an audit tries, and the vectors of a shard that it asks for, each as it is and with a new one near it.
BEAMS, AUDIT = (16, 32, 64, 128, 256), 512
SCAN = 2 * WIDEST
SLACK = 1e-4


@dataclass
class Layer:
    """nodes: the vectors in the layer; links: (vectors, most links) of neighbours, -1 where there is none."""

    nodes: np.ndarray
    links: np.ndarray


def dots(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return np.matmul(vectors[ids], queries[:, :, None])[:, :, 0]


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines) of the beam nearest vectors that the graph leads to, best first, for all queries at once; -1 where there
    are fewer. In each round every query looks at the neighbours of its step best vectors not looked at before."""
    n, size = len(queries), len(vectors)
    every = np.arange(n)[:, None]
    visited = np.zeros((n, size + 1), bool)
    visited[:, size] = True  # what -1 points to
    ids = np.full((n, beam), -1)
    cos = np.full((n, beam), -np.inf, np.float32)
    done = np.zeros((n, beam), bool)
    k = min(entries.shape[1], beam)
    ids[:, :k] = entries[:, :k]
    first = ids[:, :k]
    repeated = np.zeros(first.shape, bool)
    for j in range(1, k):
        repeated[:, j] = (first[:, j : j + 1] == first[:, :j]).any(1)
    first[repeated] = -1
    cos[:, :k] = np.where(first >= 0, dots(vectors, first, queries), -np.inf)
    visited[every, first] = True
    active = np.arange(n)
    while len(active):
        open_ = np.where(done[active] | (ids[active] < 0), -np.inf, cos[active])
        pick = np.argpartition(-open_, min(step, beam - 1), 1)[:, :step] if beam > step else np.broadcast_to(np.arange(beam), open_.shape)
        good = np.take_along_axis(open_, pick, 1) > -np.inf
        some = good.any(1)
        active, pick, good = active[some], pick[some], good[some]
        if not len(active):
            break
        rows = active[:, None]
        chosen = np.where(good, ids[rows, pick], -1)
        done[rows, pick] |= good
        near = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(active), -1)
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[visited[rows, near]] = -1
        visited[rows, near] = True
        got = np.where(near >= 0, dots(vectors, near, queries[active]), -np.inf).astype(np.float32)
        all_cos, all_ids = np.concatenate([cos[active], got], 1), np.concatenate([ids[active], near], 1)
        all_done = np.concatenate([done[active], np.zeros(near.shape, bool)], 1)
        top = np.argpartition(-all_cos, beam - 1, 1)[:, :beam]
        cos[active], ids[active], done[active] = (np.take_along_axis(x, top, 1) for x in (all_cos, all_ids, all_done))
    order = np.argsort(-cos, 1, kind="stable")
    cos, ids = np.take_along_axis(cos, order, 1), np.take_along_axis(ids, order, 1)
    return np.where(np.isfinite(cos), ids, -1), cos


def choose(vectors: np.ndarray, of: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates up to most neighbours of the vector of[row]: the nearest first, one only if it is nearer to
    the vector than to any neighbour taken before; what room is left goes to the nearest of the others."""
    sims = np.where(candidates >= 0, dots(vectors, candidates, vectors[of]), -np.inf)
    order = np.argsort(-sims, 1, kind="stable")
    candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    sims[candidates < 0] = -np.inf
    held = vectors[candidates]
    between = np.matmul(held, held.transpose(0, 2, 1))
    n, width = candidates.shape
    taken = np.zeros((n, width), bool)
    count = np.zeros(n, np.int64)
    for c in range(width):
        closest = np.where(taken, between[:, :, c], -np.inf).max(1)
        ok = (candidates[:, c] >= 0) & (count < most) & (sims[:, c] > closest)
        taken[:, c] = ok
        count += ok
    rank = np.where(candidates < 0, 2 * width, np.where(taken, 0, width) + np.arange(width))
    best = np.argsort(rank, 1, kind="stable")[:, :most]
    out = np.take_along_axis(candidates, best, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


def build(vectors: np.ndarray, keys: np.ndarray) -> list[Layer]:
    """The layers from the top to the one that has all vectors. A vector's highest layer comes from a hash of its key."""
    n = len(vectors)
    level = np.floor(-np.log((mix(keys.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 1e-18) / np.log(DEGREE)).astype(np.int64)
    top = int(min(level.max(), 6)) if n else 0
    while top > 0 and (level >= top).sum() < 2:
        top -= 1
    layers: list[Layer] = []
    for at in range(top, -1, -1):
        most = DEGREE * 2 if at == 0 else DEGREE
        links = np.full((n + 1, most), -1)
        above = layers[-1].nodes if layers else np.zeros(0, np.int64)
        new = np.flatnonzero((level >= at) | (at == 0))
        order = np.concatenate([above, np.setdiff1d(new, above)])
        done = 0
        while done < len(order):
            batch = order[done : done + min(max(done, 1), 512)]
            lists = []
            if done:
                entry = descend(vectors, layers, vectors[batch], order[:1])
                if done < len(above):
                    entry = np.full((len(batch), 1), order[0])
                lists.append(beam_search(vectors, links, vectors[batch], entry, BUILD_BEAM)[0])
            if len(batch) > 1:
                sims = vectors[batch] @ vectors[batch].T
                np.fill_diagonal(sims, -np.inf)
                k = min(DEGREE, len(batch) - 1)
                lists.append(batch[np.argpartition(-sims, k - 1, 1)[:, :k]])
            if lists:
                links[batch] = choose(vectors, batch, np.concatenate(lists, 1), most)
                back(vectors, links, batch, most)
            done += len(batch)
        layers.append(Layer(order, links))
    return layers


def back(vectors: np.ndarray, links: np.ndarray, batch: np.ndarray, most: int) -> None:
    """Links in the other direction of what batch links to; where they are too many, the best are chosen anew."""
    source = np.repeat(batch, most)
    target = links[batch].ravel()
    ok = target >= 0
    source, target = source[ok], target[ok]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, head, count = np.unique(target, return_index=True, return_counts=True)
    nth = np.arange(len(target)) - np.repeat(head, count)
    keep = nth < 4 * most
    incoming = np.full((len(nodes), min(int(count.max()), 4 * most) if len(count) else 0), -1)
    incoming[np.repeat(np.arange(len(nodes)), count)[keep], nth[keep]] = source[keep]
    for lo in range(0, len(nodes), 512):
        part = slice(lo, lo + 512)
        both = np.sort(np.concatenate([links[nodes[part]], incoming[part]], 1), 1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        links[nodes[part]] = choose(vectors, nodes[part], both, most)


def descend(vectors: np.ndarray, layers: list[Layer], queries: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Entries into the layer below the given ones."""
    entry = np.full((len(queries), 1), layers[0].nodes[0] if layers else start[0])
    for layer in layers:
        entry = beam_search(vectors, layer.links, queries, entry, 4)[0]
    return entry


@dataclass
class Shard:
    """keys, how many equal vectors each stands for, the vectors as they are and at length 1, the graph, and the beam it needs."""

    keys: np.ndarray
    sizes: np.ndarray
    raw: np.ndarray
    unit: np.ndarray
    layers: list[Layer]
    beam: int = SCAN


def unit_vectors(raw: np.ndarray) -> np.ndarray:
    scaled = raw.astype(np.float64) / np.abs(raw).max(1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a with the same rows of b, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def near_pairs(shard: Shard, queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) of the pairs near the threshold that beams of this width find; a query whose beam fills up with such
    vectors is searched with a wider one, and beyond WIDEST the shard is scanned for it."""
    floor = threshold - SLACK
    open_, out = np.arange(len(queries)), []
    while len(open_) and beam <= min(WIDEST, len(shard.unit)):
        full = []
        for lo in range(0, len(open_), 256):
            which = open_[lo : lo + 256]
            entry = descend(shard.unit, shard.layers[:-1], queries[which], shard.layers[-1].nodes)
            ids, cos = beam_search(shard.unit, shard.layers[-1].links, queries[which], entry, beam)
            hit = cos >= floor
            again = hit.sum(1) > beam // 2
            full.append(which[again])
            i, j = np.nonzero(hit & ~again[:, None])
            out.append(np.stack([which[i], ids[i, j]]))
        open_, beam = np.concatenate(full), beam * 4
    for lo in range(0, len(open_), 256):
        which = open_[lo : lo + 256]
        i, j = np.nonzero(queries[which] @ shard.unit.T >= floor)
        out.append(np.stack([which[i], j]))
    return tuple(np.concatenate(out, 1)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def audit(shard: Shard, threshold: float) -> tuple[int, dict[int, int]]:
    """The links that a scan finds in the shard, and how many of them each of BEAMS finds, for up to AUDIT of its vectors and as many
    new ones at cosines between the threshold and 0.999 to them. A vector's link with itself does not count."""
    some = np.argsort(mix(shard.keys.astype(np.uint64)), kind="stable")[:AUDIT]
    own = shard.unit[some]
    rng = np.random.default_rng(3)
    aside = rng.normal(size=own.shape)
    aside -= (aside * own).sum(1, keepdims=True) * own
    far = np.linalg.norm(aside, axis=1, keepdims=True)
    t = rng.uniform(threshold, max(threshold, 0.999), (len(own), 1))
    new = np.where(far > 1e-9, t * own + np.sqrt(1 - t * t) * aside / np.maximum(far, 1e-9), own).astype(np.float32)
    queries, self_ = np.concatenate([own, new]), np.concatenate([some, np.full(len(new), -1)])

    def links(beam: int) -> np.ndarray:
        i, j = near_pairs(shard, queries, threshold, beam)
        return np.unique(i[self_[i] != j] * len(shard.keys) + j[self_[i] != j])

    true = links(SCAN)
    return len(true), {b: len(np.intersect1d(true, links(b))) for b in BEAMS}


def narrowest(true: int, found: dict[int, int], recall: float) -> int:
    """The first beam that found the share recall of the true links; SCAN where none did."""
    return next((b for b in BEAMS if found[b] >= recall * true), SCAN)


def search(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Of rows (unit, key, embedding, blob), sorted by unit with the unit's graph first: (id, n, root) of every query with links in
    the graph's shard and every vector linked to: how many rows it links with (queries only) and the smallest key that links
    join it with, among the queries of one batch and the shard."""
    unit, shard = None, None
    for batch in batches:
        units = batch.column(0).to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1]])) if len(units) else []
        for lo, hi in zip(heads, [*heads[1:], len(units)], strict=True):
            if units[lo] != unit:
                unit, blob = units[lo], batch.column(3)[int(lo)].as_py()
                shard = pickle.loads(blob) if blob is not None else None
                lo += blob is not None
            if shard is None or lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            raw, link = stacked(part.column(2)), Links(shard, part.column(1).to_numpy())
            of_unit = unit_vectors(raw)
            for at in range(0, len(raw), 1024):
                i, j = near_pairs(shard, of_unit[at : at + 1024], threshold, shard.beam)
                link.add(i + at, j, raw, threshold)
            yield pa.RecordBatch.from_pydict(link.rows(), schema=pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))


class Links:
    """Counts and components of the links between a block's queries and a shard."""

    def __init__(self, shard: Shard, keys: np.ndarray):
        self.shard, self.keys = shard, keys
        self.ids = np.concatenate([keys, shard.keys])
        self.up = np.arange(len(self.ids))
        self.count = np.zeros(len(keys), np.int64)
        self.seen = np.zeros(len(self.ids), bool)

    def add(self, i: np.ndarray, j: np.ndarray, raw: np.ndarray, threshold: float) -> None:
        for lo in range(0, len(i), 100_000):
            a, b = i[lo : lo + 100_000], j[lo : lo + 100_000]
            ok = (cosines(raw[a], self.shard.raw[b]) >= threshold) & (self.keys[a] != self.shard.keys[b])
            a, b = a[ok], b[ok]
            self.count += np.bincount(a, self.shard.sizes[b], minlength=len(self.keys)).astype(np.int64)
            self.unite(a, b + len(self.keys))

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        self.seen[a] = self.seen[b] = True
        while True:  # hooks roots to smaller ones and halves paths until all links lie within one tree
            ra, rb = self.root(a), self.root(b)
            apart = ra != rb
            if not apart.any():
                return
            np.minimum.at(self.up, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])

    def root(self, x: np.ndarray) -> np.ndarray:
        while True:
            self.up = self.up[self.up]
            if (self.up == self.up[self.up]).all():
                return self.up[x]

    def rows(self) -> dict:
        at = np.flatnonzero(self.seen)
        root = self.root(at)
        low = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(low, root, self.ids[at])
        n = np.concatenate([self.count, np.zeros(len(self.shard.keys), np.int64)])
        return {"id": self.ids[at], "n": n[at], "root": low[root]}


def stacked(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def make_shard(part: pa.Table, threshold: float, recall: float) -> pa.Table:
    part = part.sort_by("key")
    raw = stacked(part["embedding"])
    unit, keys = unit_vectors(raw), part["key"].to_numpy()
    shard = Shard(keys, part["size"].to_numpy(), raw, unit, build(unit, keys))
    true, found = audit(shard, threshold)
    shard.beam = narrowest(true, found, recall)
    columns = {"dims": part["dims"].slice(0, 1), "shard": part["shard"].slice(0, 1), "beam": np.array([shard.beam], np.int32), "links": np.array([true]), "found": np.array([found.get(shard.beam, true)])}
    return pa.table(columns | {"blob": pa.array([pickle.dumps(shard, protocol=5)], pa.binary())})


def link(vectors: DataFrame, threshold: float = 0.95, recall: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: n_links counts the other rows with a cosine of threshold or more,
    component_id is the smallest id that links reach, kept says that it is the row's own.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own component, as
    does any with a null id (a null component). Vectors of different lengths do not link. Equal vectors, also under the same
    id, link with each other and are searched once; rows that repeat an id with other vectors are told apart. An empty table
    gives no rows; other columns are not read. Ids must be integers. recall is the share of the links of the audited vectors
    that a shard's beam must find; where none does, the shard is scanned. Cosines are never below the threshold. Every vector
    searches every shard, so work grows with vectors times shards, and a shard holds up to SHARD; a graph is sent as often as it
    takes to occupy the cluster, not once for each block of vectors."""
    v = vectors[f"`{vector_col}`"]
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), vectors[f"`{id_col}`"].cast("long").alias("id"), v.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # -0.0 is made 0.0, so that equal vectors have equal digests.
    told = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0).cast("float") if dict(vectors.dtypes)[vector_col] == "array<float>" else x + 0.0)).withColumn("digest", F.when(usable, F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b"))))
    told = cut(told)
    single = cut(told.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.min("row").alias("key"), F.count("*").alias("size"), F.first("embedding").alias("embedding")).withColumn("dims", F.size("embedding")))
    shards = max(LEAST_SHARDS, -(-single.count() // SHARD))
    copies = max(1, -(-4 * vectors.sparkSession.sparkContext.defaultParallelism // shards))
    sharded = single.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    index = cut(sharded.select("dims", "shard", "key", "size", "embedding").groupBy("dims", "shard").applyInArrow(lambda t: make_shard(t, threshold, recall), "dims int, shard int, beam int, links bigint, found bigint, blob binary"))
    unit = lambda copy: ((F.col("dims").cast("long") * shards + F.col("shard")) * copies + copy).alias("unit")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    kind = single.schema["embedding"].dataType
    offered = index.withColumn("copy", each(copies)).select(unit(F.col("copy")), F.lit(None).cast("long").alias("key"), F.lit(None).cast(kind).alias("embedding"), "blob")
    asked = single.withColumn("shard", each(shards)).select(unit(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(copies))), "key", "embedding", F.lit(None).cast("binary").alias("blob"))
    streamed = offered.union(asked).repartition("unit").sortWithinPartitions("unit", F.col("key").asc_nulls_first())
    found = cut(streamed.mapInArrow(lambda batches: search(batches, threshold), "id bigint, n bigint, root bigint"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    joined = named_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), single.select(F.col("key").alias("id"), F.col("id").alias("name")))
    result = single.select("digest", F.col("id").alias("own"), F.col("key").alias("id"), "size").join(counts, "id", "left").join(joined, "id", "left")
    result = result.select("digest", F.coalesce("name", "own").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("links"))
    out = told.select("id", "digest").join(result, "digest", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"), (F.coalesce("component", "id") == F.col("id")).alias("kept"))
