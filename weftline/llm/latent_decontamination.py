"""Benchmark decontamination by latent semantic retrieval, checked by longest common subsequences and answers.

Passages of the corpus are rows of a TF-IDF matrix over hashed words. A randomised sketch of its rows, summed over all tasks, gives
its leading right singular vectors and values; passages and benchmark items are compared by cosine in that space, scaled by
the singular values. An index of the items' answer words leaves the windows that have room for an answer; those of them near
the item by cosine are candidates; an item counts as contained if a large part of its words
stands there in its order, and with them its answer, the words that tell it from other texts. An item whose words stand in a
text one by one is found whatever its length or cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.frames import map_arrow, pick
from weftline.llm.tokens import LOWER, SLICE_BYTES, row_of, slices, word_bounds

BITS = 13
PASSAGE = 32
#: Rows of the sketch, and the columns in which a row of the sums table holds them.
SKETCH_BITS, WIDTH, RANK = 7, 32, 64
SKETCH = 1 << SKETCH_BITS
PARTS = SKETCH // WIDTH
BLOCK = 8
#: Windows in blocks of words; an item is looked for in the largest that is not longer than it.
SCALES = (2, 4, 8)
LEAST_ITEM = 5
#: The cosine of a window and an item that makes them candidates.
COSINE = 0.3
#: Words of an item, the rarest that stand together, by which its exact copies are found.
ANCHOR = 5
#: Items of one pass over the corpus, 300 bytes and their words each; of more, a pass for each so many.
ITEMS = 65_536
# ASCII characters that are neither letters nor digits part words.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


# Code points of scripts without spaces, whose characters are words of their own, and of punctuation.
ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF))
PUNCTUATION = ((0x2000, 0x206F), (0x3000, 0x3004), (0x3008, 0x303F), (0x30FB, 0x30FB), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
ANCHOR_MULTS = np.random.Generator(np.random.PCG64(23)).integers(1, 1 << 63, ANCHOR, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


TABLE32 = np.random.Generator(np.random.PCG64(17)).integers(1, 1 << 31, 256, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
BASE32, BACK32 = 0x9E3779B1, pow(0x9E3779B1, -1, 1 << 32)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, SLICE_BYTES + 1), base, np.uint32)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out, dtype=np.uint32)
    return _powers[base][:n]


def mix32(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 32 bits: every input bit moves every output bit."""
    h = h ^ (h >> np.uint32(16))
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def within(codes: np.ndarray, ranges: tuple) -> np.ndarray:
    return np.any([(codes >= lo) & (codes <= hi) for lo, hi in ranges], 0)


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words and each row's first word; characters of scripts without spaces are words of their own."""
    lead = np.flatnonzero(data >= 0xE0)
    lead = lead[lead + 2 + (data[lead] >= 0xF0) < len(data)]
    if not len(lead):
        return word_bounds(data, offsets, APART)
    long = data[lead] >= 0xF0
    codes = ((data[lead].astype(np.int64) & 15) << 12) | ((data[lead + 1].astype(np.int64) & 63) << 6) | (data[lead + 2] & 63)
    part = ~long & within(codes, PUNCTUATION)
    alone = np.where(long, (data[lead] == 0xF0) & (data[lead + 1] >= 0xA0) & (data[lead + 1] < 0xB0), within(codes, ALONE) & ~part)
    clean = data.copy()
    for k in range(3):
        clean[lead[part] + k] = 0x20
    starts, ends, first = word_bounds(clean, offsets, APART)
    if not alone.any():
        return starts, ends, first
    edges = np.union1d(lead[alone], (lead + 3 + long)[alone])
    solid = np.append(~APART[clean], False)
    starts, ends = np.union1d(starts, edges[solid[edges]]), np.union1d(ends, edges[(edges > 0) & solid[edges - 1]])
    return starts, ends, np.searchsorted(starts, offsets)


def split_at(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, without ASCII case and punctuation, each row's first word, and the words' starts and ends. 32 bits
    are enough to tell the words of an item and of a text's region apart, and halve the work."""
    data = LOWER[data]
    starts, ends, first = bounds(data, offsets)
    sums = np.zeros(len(data) + 1, np.uint32)
    np.cumsum(TABLE32[data] * powers(BASE32, len(data)), out=sums[1:])
    return mix32((sums[ends] - sums[starts]) * powers(BACK32, len(data) + 1)[starts]), first, starts, ends


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return split_at(data, offsets)[:2]


def spelling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words as they are compared, a space between two."""
    return b" ".join(LOWER[data[s:e]].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True))


def pieces(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every piece of size words, cut row by row, and the first piece of each row."""
    counts = -(-np.diff(first) // size)
    head = np.concatenate([[0], np.cumsum(counts)])
    rows = np.repeat(np.arange(len(counts)), counts)
    return first[:-1][rows] + (np.arange(len(rows)) - head[:-1][rows]) * size, head


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint32(32 - BITS)).astype(np.uint16)


@dataclass
class LatentSpace:
    """word: what a word of each bucket adds to a window's vector, IDF and scaling included."""

    idf: np.ndarray
    word: np.ndarray

    @classmethod
    def fit(cls, docs: DataFrame) -> LatentSpace:
        """The leading right singular vectors of the passages' TF-IDF rows A over all of docs(id, text), from a random sketch SA.

        S adds every row of A, with a random sign, to one of SKETCH rows. IDF scales columns only, so one pass sums both the
        sketch of the term counts and the passages that hold each bucket. Each task sums its part, a table of fixed size,
        before the shuffle. Sign and row follow from id, place and words of a passage, not from the partition."""
        fields = pa.schema([("b", pa.int32()), ("part", pa.int32()), ("n", pa.int64())] + [(f"v{j}", pa.float32()) for j in range(WIDTH)])
        keyed = docs.select(F.xxhash64("id").alias("key"), "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts, total = np.zeros((1 << BITS) * SKETCH), np.zeros(1 << BITS, np.int64), 0
            for batch in batches:
                keys = batch.column(0).to_numpy().astype(np.uint32)
                for lo, hi, data, offsets in slices(batch.column(1)):
                    h, first = split(data, offsets)
                    if not len(h):
                        continue
                    b = bucket(h)
                    heads, head_of = pieces(first, PASSAGE)
                    total += len(heads)
                    sizes = np.diff(np.append(heads, len(h)))
                    which = np.repeat(np.arange(len(heads), dtype=np.uint64), sizes)
                    pairs = np.sort((which << np.uint64(BITS)) | b)
                    new = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
                    at = (pairs[new] & np.uint64((1 << BITS) - 1)).astype(np.int64)
                    counts += np.bincount(at, minlength=1 << BITS)
                    of = row_of(head_of)
                    place = (np.arange(len(heads)) - head_of[:-1][of]).astype(np.uint32)
                    drawn = mix32(np.add.reduceat(h, heads, dtype=np.uint32) ^ mix32(keys[lo:hi][of] + place * np.uint32(BASE32)))
                    weight = np.where(drawn & 1, 1, -1) / np.sqrt(sizes)
                    of = (pairs[new] >> np.uint64(BITS)).astype(np.int64)
                    times = np.diff(np.append(new, len(pairs)))
                    np.add.at(sums, at * SKETCH + (drawn >> np.uint32(32 - SKETCH_BITS))[of], times * weight[of])
            some = np.flatnonzero(sums.reshape(-1, WIDTH).any(1))
            held, n = some // PARTS, np.zeros(len(some), np.int64)
            values = sums.reshape(-1, WIDTH)[some]
            seen = np.flatnonzero(counts)
            rows = np.concatenate([held, seen, [0]]).astype(np.int32)
            part = np.concatenate([some % PARTS, np.full(len(seen), PARTS), [PARTS + 1]]).astype(np.int32)
            n = np.concatenate([n, counts[seen], [total]])
            values = np.concatenate([values, np.zeros((len(seen) + 1, WIDTH))]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(part), pa.array(n), *[pa.array(np.ascontiguousarray(values[:, j])) for j in range(WIDTH)]], schema=fields)

        schema = "b int, part int, n bigint, " + ", ".join(f"v{j} float" for j in range(WIDTH))
        got = keyed.mapInArrow(run, schema).groupBy("b", "part").agg(F.sum("n").alias("n"), *[F.sum(f"v{j}").alias(f"v{j}") for j in range(WIDTH)]).toArrow()
        b, part, n = (got[c].to_numpy() for c in ("b", "part", "n"))
        counts, total = np.zeros(1 << BITS), int(n[part == PARTS + 1].sum())
        counts[b[part == PARTS]] = n[part == PARTS]
        idf = np.log((1 + total) / (1 + counts)) + 1e-3
        sketch = np.zeros((1 << BITS, PARTS, WIDTH))
        inner = part < PARTS
        sketch[b[inner], part[inner]] = np.stack([got[f"v{j}"].to_numpy()[inner] for j in range(WIDTH)], 1)
        left, singular, _ = np.linalg.svd(sketch.reshape(1 << BITS, SKETCH) * idf[:, None], full_matrices=False)
        power = singular[:RANK] ** 2 - (singular[RANK:] ** 2).mean()  # what the sketch adds to every direction taken off
        keep = power > singular[0] ** 2 * 1e-8
        return cls(idf, (left[:, :RANK][:, keep] / np.sqrt(power[keep]) * idf[:, None]).astype(np.float32))


@dataclass
class Item:
    """A benchmark item: its id, words, answer words and vector of length 1; scale is 0 where it is looked for exactly only,
    anchor the first of the words by which exact copies are found."""

    key: int
    words: list[int]
    answer: set[int]
    vector: np.ndarray
    scale: int
    spelled: bytes = b""
    anchor: int = 0

    def common(self, region: list[int]) -> int:
        """Length of the longest common subsequence with region; bit i of the masks is the item's word i."""
        masks: dict[int, int] = {}
        for i, w in enumerate(self.words):
            masks[w] = masks.get(w, 0) | 1 << i
        full = (1 << len(self.words)) - 1
        row = full
        for w in region:
            if m := masks.get(w):
                u = row & m
                row = ((row + u) | (row - u)) & full
        return len(self.words) - row.bit_count()


def items_of(benchmark: DataFrame, space: LatentSpace) -> Iterator[list[Item]]:
    """The items of benchmark(id, text) that have a word, in blocks of at most ITEMS."""
    rows = benchmark.filter("id is not null and text is not null").select(F.col("id").cast("long"), "text").orderBy("id").toLocalIterator(prefetchPartitions=True)
    block: list[Item] = []
    for row in rows:
        data = np.frombuffer(row["text"].encode(), np.uint8)
        h, _, starts, ends = split_at(data, np.array([0, len(data)]))
        if not len(h):
            continue
        b = bucket(h)
        anchor = int(np.argmax(np.convolve(space.idf[b], np.ones(min(ANCHOR, len(h))), "valid")))
        spelled = spelling(data, starts, ends)
        vector = space.word[b].sum(0)
        distinct, at = np.unique(h, return_index=True)
        rare = distinct[np.argsort(-space.idf[b[at]], kind="stable")][: max(2, -(-len(h) // 5))]
        scale = max([m for m in SCALES if m * BLOCK <= len(h)], default=SCALES[0]) if len(h) >= LEAST_ITEM else 0
        block.append(Item(row["id"], h.tolist(), set(rare.tolist()) if scale else set(), vector / max(np.linalg.norm(vector), 1e-12), scale, spelled, anchor))
        if len(block) == ITEMS:
            yield block
            block = []
    if block:
        yield block


def contained(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cosine: float = COSINE, subsequence: float = 0.6, answer: float = 0.5, space: LatentSpace | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, subsequence, answer) of every text and benchmark item it contains, at least nearly.

    Windows of the text whose cosine with the item reaches cosine and that have room for its answer are candidates; around the
    best of neighbouring ones the share of the item's words in a longest common subsequence must reach subsequence, and the share of its answer words,
    the rarest fifth, must reach answer. A text that holds all words of an item one by one contains it in any case, with ones for
    what was not measured; items of fewer than LEAST_ITEM words are looked for in this way only, and those without a word not
    at all. A character of a script without spaces counts as a word. A null or
    empty text contains nothing. Rows are judged alone, so repeated rows repeat their hits; null ids are kept. Ids of items
    must be integers. An empty table on either side gives no rows; other columns are not read. The statistics come from all
    passages of docs; items go to the tasks in blocks of at most ITEMS, a pass over docs for each block. Of two texts that
    repeat an id each has its own hits. A very long text is looked through from end to end and makes
    a slice of its own in its task."""
    rows = pick(docs, id=id_col, text=text_col)
    space = space or LatentSpace.fit(rows)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, cosine double, subsequence double, answer double"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in items_of(pick(benchmark, id=item_col, text=item_text_col), space):
        out = out.unionByName(search(rows, items, space, schema, cosine, subsequence, answer))
    return out


def search(rows: DataFrame, items: list[Item], space: LatentSpace, schema: str, cosine: float, subsequence: float, answer: float) -> DataFrame:
    told = np.array(sorted((w, i) for i, x in enumerate(items) for w in x.answer), np.int64).reshape(-1, 2)
    answers, head = np.unique(told[:, 0].astype(np.uint32), return_index=True)
    matrix = np.stack([x.vector for x in items]).astype(np.float32)
    shared = rows.sparkSession.sparkContext.broadcast((items, space.word, matrix, answers, np.append(head, len(told)), told[:, 1], anchors_of(items), answer))

    def run(batch: pa.RecordBatch):
        items, word, matrix, answers, head, holders, anchors, answer = shared.value
        sizes, scales = np.array([len(x.words) for x in items]), np.array([x.scale for x in items])
        least = np.maximum(np.ceil([answer * len(x.answer) - 1e-9 for x in items]), 1).astype(np.int64)
        known = np.zeros(1 << BITS, bool)
        known[bucket(answers)] = True
        for lo, _, data, offsets in slices(batch.column(1)):
            h, first, begins, ends = split_at(data, offsets)
            if not len(h):
                continue
            b = bucket(h)
            item, place = answer_places(h, np.flatnonzero(known[b]), answers, head, holders)
            row, item, start = windows_with_answers(item, place, first, sizes, scales, least)
            found = []
            for part in range(0, len(row), 4096):
                r, i, at = row[part : part + 4096], item[part : part + 4096], start[part : part + 4096]
                stop = np.minimum(at + scales[i] * BLOCK, first[r + 1])
                near = np.einsum("ij,ij->i", window_vectors(word, b, at, stop), matrix[i])
                ok = near >= cosine
                found += zip(*(x[ok].tolist() for x in (r, i, at, near, np.maximum(first[r], at - sizes[i]), np.minimum(first[r + 1], at + scales[i] * BLOCK + sizes[i]))), strict=True)
            best: dict = {}
            for r, i, _, near, begin, stop in best_windows(found, items):
                x = items[i]
                region = h[begin:stop].tolist()
                held = len(x.answer.intersection(region)) / len(x.answer)
                if held >= answer and (share := x.common(region) / len(x.words)) >= subsequence:
                    best[r, i] = max(best.get((r, i), (0, 0, 0)), (near, share, held))
            for r, i, at in exact_copies(h, first, items, anchors):
                stop = at + len(items[i].words)
                if (r, i) not in best and spelling(data, begins[at:stop], ends[at:stop]) == items[i].spelled:
                    best[r, i] = (1.0, 1.0, 1.0)
            if best:
                columns = list(zip(*best.values(), strict=True))
                yield {"doc_id": batch.column(0).take(pa.array([lo + r for r, _ in best])), "item_id": [items[i].key for _, i in best], "cosine": list(columns[0]), "subsequence": list(columns[1]), "answer": list(columns[2])}

    return map_arrow(rows, run, schema)


def windows_with_answers(item: np.ndarray, place: np.ndarray, first: np.ndarray, sizes: np.ndarray, scales: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, first word) of the windows near which at least least[item] answer words of the item stand: the candidates that an
    index of the answer words leaves for the comparison of vectors. item, place: the answer words found, sorted.

    A window has scales[item] * BLOCK words and begins at a step of a quarter of its blocks; near it means up to sizes[item]
    words further on either side, within the row. As the answer is asked for in any case, no other window can be a hit."""
    last = np.arange(len(item)) + least[item] - 1
    ok = last < len(item)
    head, last = np.flatnonzero(ok), last[ok]
    lo, hi, i = place[head], place[last], item[head]
    row = np.searchsorted(first, lo, "right") - 1
    width = scales[i] * BLOCK
    ok = (item[last] == i) & (hi < first[row + 1]) & (hi - lo < width + 2 * sizes[i])
    lo, hi, i, row, width = lo[ok], hi[ok], i[ok], row[ok], width[ok]
    base, words = first[row], first[row + 1] - first[row]
    step = np.maximum(scales[i] // 4, 1) * BLOCK
    final = np.maximum(-(-words // BLOCK) * BLOCK - width, 0)  # where the last whole window begins
    nth = np.maximum(-(-(hi - width - sizes[i] + 1 - base) // step), 0)
    upto = np.minimum((lo + sizes[i] - base) // step, final // step)
    count = np.maximum(upto - nth + 1, 0)
    which = np.repeat(np.arange(len(count)), count)
    starts = (nth[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)) * step[which]
    ends_too = np.flatnonzero((final % step != 0) & (final <= lo + sizes[i] - base) & (final + width + sizes[i] > hi - base))
    which, starts = np.concatenate([which, ends_too]), np.concatenate([starts, final[ends_too]])
    got = np.unique(np.stack([i[which], base[which] + starts, row[which]]), axis=1)
    return got[2], got[0], got[1]


def window_vectors(word: np.ndarray, b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The vectors, of length 1, of the words in each window."""
    size = stop - start
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out = np.add.reduceat(word[b[at]], np.cumsum(size) - size, axis=0) if len(size) else np.zeros((0, word.shape[1]), np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-12)[:, None]


def anchors_of(items: list[Item]) -> tuple[np.ndarray, list]:
    """Which upper halves of word hashes begin an anchor, and for each anchor length the sorted keys of the anchors and their items."""
    begin, by_size = np.zeros(1 << 16, bool), {}
    for i, x in enumerate(items):
        words = np.array(x.words[x.anchor : x.anchor + ANCHOR], np.uint64)
        begin[int(words[0]) >> 16] = True
        by_size.setdefault(len(words), []).append((int((words * ANCHOR_MULTS[: len(words)]).sum(dtype=np.uint64)), i))
    return begin, [(n, np.array([k for k, _ in sorted(both)], np.uint64), np.array([i for _, i in sorted(both)])) for n, both in sorted(by_size.items())]


def exact_copies(h: np.ndarray, first: np.ndarray, items: list[Item], anchors: tuple[np.ndarray, list]) -> Iterator[tuple[int, int, int]]:
    """(row, item, first word) of the places where the words h have all hashes of an item one by one."""
    begin, tables = anchors
    at = np.flatnonzero(begin[h >> np.uint32(16)])
    for n, keys, which in tables:
        at = at[at + n <= len(h)]  # sizes ascend
        sums = np.zeros(len(at), np.uint64)
        for k in range(n):
            sums += h[at + k].astype(np.uint64) * ANCHOR_MULTS[k]
        lo, hi = np.searchsorted(keys, sums), np.searchsorted(keys, sums, "right")
        for j in np.flatnonzero(hi > lo).tolist():
            for i in which[lo[j] : hi[j]].tolist():
                start = int(at[j]) - items[i].anchor
                stop = start + len(items[i].words)
                if start < 0 or stop > len(h):
                    continue
                row = int(np.searchsorted(first, start, "right")) - 1
                if stop <= first[row + 1] and h[start:stop].tolist() == items[i].words:
                    yield row, i, start


def answer_places(h: np.ndarray, at: np.ndarray, answers: np.ndarray, head: np.ndarray, holders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, place), sorted, for every place (of those in at) of a word that is an answer word of the item."""
    if not len(answers):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    which = np.minimum(np.searchsorted(answers, h[at]), len(answers) - 1)
    same = answers[which] == h[at]
    at, which = at[same], which[same]
    counts = np.diff(head)[which]
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return tuple(np.divmod(np.sort(holders[np.repeat(head[:-1][which], counts) + nth] * len(h) + np.repeat(at, counts)), len(h)))


def best_windows(found: list, items: list[Item]) -> Iterator[tuple]:
    """Of windows (row, item, start, cosine, ...) that overlap, row and item alike, the one with the largest cosine."""
    last = None
    for window in sorted(found):
        if last and last[:2] == window[:2] and window[2] - last[2] < items[window[1]].scale * BLOCK:
            if window[3] > last[3]:
                last = window
            continue
        if last:
            yield last
        last = window
    if last:
        yield last


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, whose text contains no benchmark item. Every row is judged by its own text, also where ids
    repeat or are null; rows that repeat both go or stay together. A null or empty text stays. Other columns may have any names."""
    text = docs[f"`{text_col}`"]
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), F.struct(docs[f"`{id_col}`"].alias("id"), F.xxhash64(text).alias("tag")).alias("key"), text.alias("text"))
    bad = contained(whole, benchmark, "key", "text", **how).select(F.col("doc_id.id").alias("bad_id"), F.col("doc_id.tag").alias("bad_tag")).distinct()
    return whole.join(bad, whole["key.id"].eqNullSafe(bad["bad_id"]) & (whole["key.tag"] == bad["bad_tag"]), "left_anti").select("doc.*")
