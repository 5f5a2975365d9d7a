"""Language-model scoring with a probabilistic suffix tree.

A text is lower-cased (A-Z) and read as its words, each with a space behind, and an end. A token's first HEAD bytes are symbols of
their own, a token that is shorter ends with a space or, at the end of the text, with an end mark; what is left of a longer word is
one more symbol, or escapes to its bytes.

Bytes are scored in the tree: the corpus gives counts of every byte after the bytes before it, up to DEPTH of them; before a head's
bytes stand the words before, before a later byte of a word only the last REACH bytes of the word itself. A context stays in the tree if its next-symbol
distribution diverges from that of its suffix, with the evidence of an absolute number of symbols; suffixes of what stays also
stay. A byte is scored in the state of the longest context in the tree that the text so far ends in; a state's distribution is
smoothed by its parent's, with as much weight as it has different symbols. The rest of a word is scored in the state of the word's
own beginning, its head: by the counts of the words that begin so, smoothed, with as much weight as there are different ones, by the
probability that the tree gives to the word's further bytes and its space. So every byte of a word never seen counts, and the
probabilities of all rests of a head sum to one.

The score of a text is the sum of log10 P(symbol | longest suffix state) over all its symbols.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.frames import cut, lists, map_arrow
from weftline.llm.tokens import LOWER, row_of, signed, slices, word_bounds, word_hashes

#: Bytes of the longest context, and bytes of a word before its rest.
DEPTH, HEAD = 7, 2
#: Bytes of the longest context inside a word. In place of the further ones stands a byte that no text in UTF-8 has.
REACH, BLANK = 4, 0xFF
END = 0x0A
#: The end token stands in the word counts under this key.
END_KEY = -(1 << 63)
#: A word of at least this share of all tokens is sent to every task; there are at most 1 / FREQUENT of them. Others are joined.
FREQUENT = 5e-7
WORD, GRAM = 0, 1
#: Entries of the tree that a task holds at once. A larger tree is dealt by the last three bytes of its contexts, and the texts
#: are read once for each part.
PART = 2_000_000
SLOTS = 20
#: Counts that a task gathers before it hands them on to be summed.
HELD = 500_000


def symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (context, symbol), eight bits each, for every symbol of a head of every row, and each one's row.

    A row is spelled as its words, each with a space behind, and an end mark. Before its first symbol stand end marks."""
    rows, n = row_of(first), len(first) - 1
    sizes = ends - starts
    full = np.bincount(rows, sizes + 1, minlength=n).astype(np.int64) + 1 + DEPTH
    at = np.cumsum(full) - full
    out = np.full(int(full.sum()), 0x20, np.uint8)
    for k in range(DEPTH):
        out[at + k] = END
    out[at + full - 1] = END
    word_at = np.cumsum(sizes + 1) - (sizes + 1) + (rows + 1) * DEPTH + rows
    put(out, word_at, data, starts, sizes)
    heads, of = [at + full - 1], [np.arange(n)]
    for k in range(HEAD):
        long = sizes >= k  # a word of k bytes ends with its space here
        heads.append(word_at[long] + k)
        of.append(rows[long])
    return codes_at(out, np.concatenate(heads)), np.concatenate(of)


def spellings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (context, symbol) for every byte behind the head and the space of words of HEAD bytes or more, and each one's word.

    Before a word stand spaces, so contexts that reach further back than one tell nothing more and never enter the tree; what lies
    further back than REACH is blank."""
    sizes = ends - starts
    full = sizes + DEPTH + 1
    at = np.cumsum(full) - full
    out = np.full(int(full.sum()), 0x20, np.uint8)
    put(out, at + DEPTH, data, starts, sizes)
    of, nth = counted(sizes - HEAD + 1)
    blank = np.uint64(int.from_bytes(bytes([BLANK] * (DEPTH - REACH)) + bytes(REACH + 1), "big"))
    return codes_at(out, at[of] + DEPTH + HEAD + nth) | blank, of


def counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owner of each of sizes[i] things of every i, and its number among the owner's."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def put(out: np.ndarray, to: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
    """Copies the words to their places in out."""
    of, nth = counted(sizes)
    out[to[of] + nth] = data[starts[of] + nth]


def codes_at(out: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The byte at each place with the DEPTH bytes before it."""
    codes = np.zeros(len(places), np.uint64)
    for k in range(DEPTH + 1):
        codes = (codes << np.uint64(8)) | out[places - DEPTH + k]
    return codes


def head_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first HEAD bytes of words that are as long, as a number."""
    out = np.zeros(len(starts), np.int64)
    for k in range(HEAD):
        out = out << 8 | data[starts + k]
    return out


def summed(keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys, their sums of counts, and more columns of each one's first place."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts, *(x[order[at]] for x in more)


class Tally:
    """Counts by key of one kind that a task gathers, handed on as rows when HELD different keys have come together."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[dict]:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > 2 * HELD:
            self.parts = [summed(*map(np.concatenate, zip(*self.parts, strict=True)))]
            self.size = len(self.parts[0][0])
            if self.size > HELD:
                yield from self.rows()

    def rows(self) -> Iterator[dict]:
        if self.parts:
            keys, counts, *head = summed(*map(np.concatenate, zip(*self.parts, strict=True)))
            yield {"kind": np.full(len(keys), self.kind, np.int8), "key": signed(keys), "head": head[0] if head else np.full(len(keys), -1), "n": counts}
        self.parts, self.size = [], 0


def statistics(docs: DataFrame) -> DataFrame:
    """(kind, key, head, n) over the rows of docs(text, teaches) that teach: counts of words by hash, with their heads (-1: none), the
    end token under END_KEY, and counts of codes of context and symbol. Counts are summed in the task, before the shuffle."""

    def run(batch: pa.RecordBatch):
        yield {"kind": [WORD], "key": [END_KEY], "head": [-1], "n": [batch.num_rows]}
        words, heads, rests = Tally(WORD), Tally(GRAM), Tally(GRAM)
        for _, _, data, offsets in slices(batch.column(0)):
            data = LOWER[data]
            starts, ends, first = word_bounds(data, offsets)
            h, at, n = np.unique(word_hashes(data, starts, ends), return_index=True, return_counts=True)
            long = (ends - starts)[at] >= HEAD
            head = np.full(len(h), -1)
            head[long] = head_of(data, starts[at[long]])
            yield from words.add(h, n, head)
            yield from heads.add(*np.unique(symbols(data, starts, ends, first)[0], return_counts=True))
            codes, of = spellings(data, starts[at[long]], ends[at[long]])
            yield from rests.add(*summed(codes, n[long][of]))
        for tally in (words, heads, rests):
            yield from tally.rows()

    return map_arrow(docs.filter("teaches").select("text"), run, "kind tinyint, key bigint, head int, n bigint").groupBy("kind", "key").agg(F.min("head").alias("head"), F.sum("n").alias("n"))


@dataclass
class SuffixTree:
    """Of each depth d: contexts[d], sorted codes of the contexts in the tree, and back[d], log10 of the weight of the parent's
    distribution there; codes[d], sorted codes of (context, symbol) that were seen, and log[d], log10 of their probabilities."""

    contexts: list[np.ndarray]
    back: list[np.ndarray]
    codes: list[np.ndarray]
    log: list[np.ndarray]

    @classmethod
    def build(cls, depth: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> SuffixTree:
        """From counts of (depth, context, symbol) of every context in the tree. The root is smoothed by one of each byte."""
        tree = cls([], [], [], [])
        for d in range(DEPTH + 1):
            of = depth == d
            code = (context[of].astype(np.uint64) << np.uint64(8)) | symbol[of].astype(np.uint64)
            order = np.argsort(code)
            code, count = code[order], n[of][order].astype(np.float64)
            states, at, kinds = np.unique(code >> np.uint64(8), return_inverse=True, return_counts=True)
            total = np.bincount(at, count, minlength=len(states))
            if d == 0:
                tree.contexts.append(np.zeros(1, np.uint64))
                tree.back.append(np.array([-np.log10(total.sum() + 256)]))  # times one for each byte that was never seen
                p = (count + 1) / (total.sum() + 256)
            else:
                parent = tree.find(code & np.uint64((1 << 8 * d) - 1), d - 1)
                p = (count + kinds[at] * 10**parent) / (total + kinds)[at]
                tree.contexts.append(states)
                tree.back.append(np.log10(kinds / (total + kinds)))
            tree.codes.append(code)
            tree.log.append(np.log10(p))
        return tree

    def find(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """log10 P(symbol | context) of codes whose contexts, depth bytes of them, are in the tree."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for d in range(depth, -1, -1):
            mask = np.uint64((1 << 64) - 1 >> 8 * (7 - d))
            code = codes[left] & mask
            known = self.codes[d]
            at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            hit = known[at] == code if len(known) else np.zeros(len(code), bool)
            out[left[hit]] += self.log[d][at[hit]]
            left, code = left[~hit], code[~hit]
            if not len(left):
                break
            out[left] += self.back[d][np.searchsorted(self.contexts[d], code >> np.uint64(8))]
        return out

    def score(self, codes: np.ndarray) -> np.ndarray:
        """log10 P(symbol | longest context in the tree) of each code."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for d in range(DEPTH + 1):
            if d == DEPTH or not len(self.contexts[d + 1]):
                deeper = np.zeros(len(left), bool)
            else:
                known, context = self.contexts[d + 1], (codes[left] >> np.uint64(8)) & np.uint64((1 << 8 * (d + 1)) - 1)
                deeper = known[np.minimum(np.searchsorted(known, context), len(known) - 1)] == context
            stay = left[~deeper]
            out[stay] = self.find(codes[stay], d)
            left = left[deeper]
            if not len(left):
                return out
        return out


class Memo:
    """Values of keys met before, by a slot of fixed number; a slot holds the last key."""

    def __init__(self):
        self.keys, self.values = np.full(1 << SLOTS, np.uint64((1 << 64) - 1)), np.zeros(1 << SLOTS, np.float64)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def get(self, keys: np.ndarray, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The value of each key; make gives those of the keys at some places."""
        slot = self.slot(keys)
        out, miss = self.values[slot], np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            new, at, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            got = make(miss[at])
            out[miss] = got[back]
            at, last = np.unique(self.slot(new), return_index=True)
            self.keys[at], self.values[at] = new[last], got[last]
        return out


def tree_rows(grams: DataFrame, least: int = 8, divergence: float = 0.005, evidence: float = 12.0, each: float = 2.0) -> DataFrame:
    """(depth, context, symbol, n) of the contexts that stay, from the counts of codes (key, n).

    A context stays if it was seen at least least times, and its distribution's divergence from its parent's is at least
    divergence nats, and that times its count at least evidence and each nats more for every symbol seen after it, as a state with
    more symbols has more to fit to chance. Its suffixes stay too; the root always does. All are
    absolute, so more text makes a larger tree."""
    below = lambda depth: F.expr(f"shiftleft(1L, ({depth}) * 8) - 1")
    reach = F.when(F.shiftrightunsigned("key", 56) == BLANK, F.lit(REACH)).otherwise(F.lit(DEPTH))
    spread = grams.select(F.explode(F.sequence(F.lit(0), reach)).alias("depth"), F.shiftrightunsigned("key", 8).alias("context"), F.col("key").bitwiseAND(F.lit(255)).alias("symbol"), "n")
    rows = cut(spread.withColumn("context", F.col("context").bitwiseAND(below("depth"))).groupBy("depth", "context", "symbol").agg(F.sum("n").alias("n")))
    totals = rows.groupBy("depth", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    child = rows.join(totals.filter((F.col("depth") > 0) & (F.col("total") >= least)), ["depth", "context"])
    child = child.select("depth", "context", "symbol", "n", "total", "kinds", (F.col("depth") - 1).alias("up_depth"), F.col("context").bitwiseAND(below("depth - 1")).alias("up"))
    both = child.join(rows.select(F.col("depth").alias("up_depth"), F.col("context").alias("up"), "symbol", F.col("n").alias("up_n")), ["up_depth", "up", "symbol"])
    both = both.join(totals.select(F.col("depth").alias("up_depth"), F.col("context").alias("up"), F.col("total").alias("up_total")), ["up_depth", "up"])
    term = F.col("n") / F.col("total") * F.log((F.col("n") / F.col("total")) / (F.col("up_n") / F.col("up_total")))
    kept = both.groupBy("depth", "context", "total", "kinds").agg(F.sum(term).alias("kl")).filter((F.col("kl") >= divergence) & (F.col("kl") * F.col("total") >= evidence + each * F.col("kinds")))
    closed = kept.select(F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("depth"), "context").select("depth", F.col("context").bitwiseAND(below("depth")).alias("context")).distinct()
    return cut(rows.join(closed, ["depth", "context"], "left_semi").unionByName(rows.filter("depth = 0")))


def part_of(context, parts: int):
    """The part of the tree that holds the states of a context (a column or an array of codes): by its last three bytes, so that all
    its suffixes of three bytes or more are there too; shorter ones are in every part."""
    if isinstance(context, np.ndarray):
        return ((context & np.uint64(0xFFFFFF)) * np.uint64(40503) >> np.uint64(7)) % np.uint64(parts)
    return F.shiftrightunsigned(context.bitwiseAND(F.lit(0xFFFFFF)).cast("long") * 40503, 7) % parts


def tree_part(rows: DataFrame, part: int, parts: int) -> SuffixTree:
    got = rows.filter((F.col("depth") < 3) | (part_of(F.col("context"), parts) == part)).toArrow()
    return SuffixTree.build(*(got[c].to_numpy() for c in ("depth", "context", "symbol", "n")))


class Scorer:
    """A part of the tree, with what a task has looked up in it."""

    def __init__(self, tree: SuffixTree, part: int, parts: int):
        self.tree, self.part, self.parts, self.of_codes, self.of_words = tree, part, parts, Memo(), Memo()

    def sums(self, codes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """The sums of log10 probabilities of the codes whose contexts fall into the part, by owner."""
        if self.parts > 1:
            mine = part_of(codes >> np.uint64(8), self.parts) == self.part
            codes, of = codes[mine], of[mine]
        return np.bincount(of, self.of_codes.get(codes, lambda at: self.tree.score(codes[at])), minlength=n)

    def heads(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The sum over each row's head symbols."""
        return self.sums(*symbols(data, starts, ends, first), len(first) - 1)

    def rests(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The sum over the bytes behind each word's head; 0 for words that are shorter. h: hashes of the words."""
        out, long = np.zeros(len(h)), np.flatnonzero(ends - starts >= HEAD)
        out[long] = self.of_words.get(h[long], lambda at: self.sums(*spellings(data, starts[long[at]], ends[long[at]]), len(at)))
        return out


def scorer(tree: SuffixTree, part: int, parts: int) -> Scorer:
    """One for each part that a Python worker meets; the last is kept."""
    if id(tree) not in _scorers:
        _scorers.clear()
        _scorers[id(tree)] = Scorer(tree, part, parts)
    return _scorers[id(tree)]


def score(docs: DataFrame, teaches, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every row of docs with what the rows where the condition teaches holds taught.

    Returns doc_id, held_out (the condition does not hold), n_tokens (words and one end), n_known (tokens that occur in
    training), train_tokens, base_score (add-one unigram log10 probability of the tokens), score (the model's log10 probability
    of the text, every byte of it, also of words never seen), unseen_score (the part of score that spells the
    further bytes of words never seen; score without it takes the words never seen that share a head as one, as the base takes them
    all). A null or empty text has the end token alone. A null condition counts as false. Repeated rows, ties and null ids are allowed: rows are
    told apart by a number of their own. Without training rows every score is still defined (uniform symbols). An empty table
    gives no rows; other columns are not read.

    Very long texts are scored as a whole, symbol by symbol, and make a slice of their own in their task.

    To tasks go a part of the tree, about PART entries, the sums of at most 256 ** HEAD heads, and the counts of words of a share
    of FREQUENT or more, at most 1 / FREQUENT; the counts of rarer words are joined by hash, one row for each of their
    occurrences. A tree of more parts has the texts written once and read once for each part, with the sums so far beside them."""
    spark = docs.sparkSession
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"), F.coalesce(teaches, F.lit(False)).alias("teaches"))
    stats = cut(statistics(rows))
    words = stats.filter(F.col("kind") == WORD).select("key", "head", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("kinds")).first()
    tokens, kinds = int(total["tokens"]), int(total["kinds"])
    least = max(2, int(np.ceil(tokens * FREQUENT)))
    common = words.filter((F.col("n") >= least) & (F.col("key") != END_KEY)).select("key", "n").toArrow()
    keys = common["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    begun = words.filter("head >= 0").groupBy("head").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()
    heads = np.zeros((2, 256**HEAD))
    heads[:, begun["head"].to_numpy()] = begun["n"].to_numpy(), begun["kinds"].to_numpy()
    grown = tree_rows(stats.filter(F.col("kind") == GRAM).select("key", "n"))
    parts = -(-grown.count() // PART) or 1
    end = words.filter(F.col("key") == END_KEY).first()
    shared = spark.sparkContext.broadcast((tree_part(grown, 0, parts), keys[order], common["n"].to_numpy()[order], int(end["n"]) if end else 0, heads))

    def run(batch: pa.RecordBatch):
        tree, keys, counts, ends_n, heads = shared.value
        for lo, hi, data, offsets in slices(batch.column(1)):
            data = LOWER[data]
            starts, ends, first = word_bounds(data, offsets)
            h = word_hashes(data, starts, ends)
            of, n = row_of(first), hi - lo
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            seen = counts[at[hit]].astype(np.float64)
            base, rest = np.zeros(len(h)), np.zeros(len(h))
            base[hit] = np.log10(seen + 1)
            long = ends - starts >= HEAD
            byte = scorer(tree, 0, parts)
            model, spelled = byte.heads(data, starts, ends, first), byte.rests(data, starts, ends, h)
            if parts > 1:
                model += batch.column(4).slice(lo, n).to_numpy()
                spelled += batch.column(5).slice(lo, n).flatten().to_numpy()
            all_n, kinds = np.zeros(len(h)), np.zeros(len(h))
            all_n[long], kinds[long] = heads[:, head_of(data, starts[long])]
            kinds[long] = np.maximum(kinds[long], 1)
            rest[long] = np.log10(kinds[long]) + spelled[long]
            rest[hit] = np.log10(seen + kinds[hit] * 10.0 ** spelled[hit])
            rest[long] -= np.log10(all_n[long] + kinds[long])
            rest[~long] = 0
            other = pa.StructArray.from_arrays([pa.array(signed(h[~hit])), pa.array(kinds[~hit].astype(np.int64)), pa.array(spelled[~hit])], ["key", "kinds", "spelled"])
            yield {
                "row": batch.column(3).slice(lo, n),
                "doc_id": batch.column(0).slice(lo, n),
                "held_out": pa.compute.invert(batch.column(2).slice(lo, n)),
                "n_tokens": np.diff(first) + 1,
                "known": np.bincount(of[hit], minlength=n) + (ends_n > 0),
                "base": np.bincount(of, base, minlength=n) + np.log10(ends_n + 1.0),
                "model": np.bincount(of, rest, minlength=n) + model,
                "unseen": np.bincount(of[~hit], spelled[~hit], minlength=n),
                "rare": lists(other, np.bincount(of[~hit], minlength=n)),
            }

    kind = docs.schema[id_col].dataType.simpleString()
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "text", "teaches", "row")
    if parts > 1:
        numbered = cut(numbered.withColumns({"tree": F.lit(0.0), "rests": F.lit(None).cast("array<double>")}))
    for k in range(1, parts):
        numbered = further(numbered, kind, tree_part(grown, k, parts), k, parts)
    scored = cut(map_arrow(numbered, run, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, model double, unseen double, rare array<struct<key:bigint,kinds:bigint,spelled:double>>"))
    rare = scored.select("row", F.inline("rare"))
    told = F.when(F.col("kinds") > 0, F.log10(F.col("n") + F.col("kinds") * F.pow(F.lit(10.0), "spelled")) - F.log10("kinds") - F.col("spelled")).otherwise(0.0)
    found = rare.join(words.filter((F.col("n") < least) & (F.col("key") != END_KEY)), "key").groupBy("row").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_base"), F.sum(told).alias("more_model"), F.sum("spelled").alias("more_spelled"))
    out = scored.drop("rare").join(found, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(tokens + kinds + 1))).alias("base_score"),
        (F.col("model") + F.coalesce("more_model", F.lit(0.0))).alias("score"),
        (F.col("unseen") - F.coalesce("more_spelled", F.lit(0.0))).alias("unseen_score"),
    )


def further(numbered: DataFrame, kind: str, tree: SuffixTree, part: int, parts: int) -> DataFrame:
    """numbered(doc_id, text, teaches, row, tree, rests) with what falls into a further part of the tree added: to tree, the sum of
    a row's head symbols, and to rests, those of the further bytes of each of its words (null: none so far)."""
    shared = numbered.sparkSession.sparkContext.broadcast(tree)

    def run(batch: pa.RecordBatch):
        byte = scorer(shared.value, part, parts)
        for lo, hi, data, offsets in slices(batch.column(1)):
            data, n = LOWER[data], hi - lo
            starts, ends, first = word_bounds(data, offsets)
            rests, before = byte.rests(data, starts, ends, word_hashes(data, starts, ends)), batch.column(5).slice(lo, n)
            if not before.null_count:
                rests += before.flatten().to_numpy()
            same = dict(zip(("doc_id", "text", "teaches", "row"), (batch.column(i).slice(lo, n) for i in range(4)), strict=True))
            yield {**same, "tree": byte.heads(data, starts, ends, first) + batch.column(4).slice(lo, n).to_numpy(), "rests": lists(rests, np.diff(first))}

    done = cut(map_arrow(numbered, run, f"doc_id {kind}, text string, teaches boolean, row bigint, tree double, rests array<double>"))
    shared.unpersist()
    return done


_scorers: dict = {}
