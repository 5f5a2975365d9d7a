import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import queries, suffix_tree_lm
from weftline.llm.tokens import LOWER, word_bounds


def tokens(t):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [None]


def teaches(k):
    return zlib.crc32(str(k).encode()) % 7 != 2


def test_base_and_counts(docs, texts):
    counts = Counter()
    for k, t in texts:
        if teaches(k):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in suffix_tree_lm.score(docs, queries.id_crc(7) != 2).collect()}
    for k, t in texts:
        r, w = got[k], tokens(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(counts[x] > 0 for x in w), n, not teaches(k))
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), abs_tol=1e-6)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_model_beats_base_on_held_out_texts(spark, sf):
    """The base takes all words never seen as one and does not spell them, so that part of the score is left out here."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = suffix_tree_lm.score(docs, queries.id_crc(7) != 2)
    sums = got.groupBy("held_out").agg(F.sum(F.col("score") - F.col("unseen_score")).alias("model"), F.sum("unseen_score").alias("spelled"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") - F.col("n_known")).alias("unseen")).collect()
    assert len(sums) == 2
    for r in sums:
        print(sf, r["held_out"], "model", r["model"] / r["n"], "with spelling", (r["model"] + r["spelled"]) / r["n"], "base", r["base"] / r["n"])
        assert r["model"] / r["n"] > r["base"] / r["n"] + (0.3 if r["held_out"] else 0)
        if r["held_out"]:
            assert -6.5 < r["spelled"] / r["unseen"] < -3  # some seven bytes each, at less than a log10 of one
        else:
            assert abs(r["spelled"]) < 1e-6


def plain_score(texts, train, least=8, divergence=0.005, evidence=12.0, each=2.0):
    """The model by dictionaries and one symbol at a time."""
    depth, head = suffix_tree_lm.DEPTH, suffix_tree_lm.HEAD

    def symbols(t):
        before, out = b"\n" * depth, []
        for w in tokens(t):
            spelled = b"\n" if w is None else w + b" "
            for i in range(len(spelled) if w is None else min(head, len(spelled))):
                out.append(((before + spelled[:i])[-depth:], spelled[i]))
            before = (before + spelled)[-depth:]
        return out

    def further(w):
        spelled = b" " * depth + w + b" "
        reach = suffix_tree_lm.REACH
        return [(b"\xff" * (depth - reach) + spelled[i - reach : i], spelled[i]) for i in range(depth + head, len(spelled))]

    counts = [defaultdict(Counter) for _ in range(depth + 1)]
    words = Counter(w for t in train for w in tokens(t) if w is not None and len(w) >= head)
    for t in train:
        for context, x in symbols(t) + [s for w in tokens(t)[:-1] for s in further(w)]:
            for d in range(depth + 1):
                if context[depth - d : depth - d + 1] != b"\xff":
                    counts[d][context[depth - d :]][x] += 1
    tree = set()
    for d in range(1, depth + 1):
        for context, c in counts[d].items():
            up, n = counts[d - 1][context[1:]], sum(c.values())
            kl = sum(k / n * math.log(k / n / (up[x] / sum(up.values()))) for x, k in c.items())
            if n >= least and kl >= divergence and kl * n >= evidence + each * len(c):
                tree |= {context[i:] for i in range(d)}

    def p(context, x):
        if not context:
            c = counts[0][b""]
            return (c[x] + 1) / (sum(c.values()) + 256)
        c = counts[len(context)][context]
        return (c[x] + len(c) * p(context[1:], x)) / (sum(c.values()) + len(c))

    def state(context):
        return next((context[i:] for i in range(depth) if context[i:] in tree), b"")

    begun = defaultdict(list)
    for w, n in words.items():
        begun[w[:head]].append(n)
    out = []
    for t in texts:
        s = sum(math.log10(p(state(context), x)) for context, x in symbols(t))
        for w in tokens(t)[:-1]:
            if len(w) >= head:
                b, spelled = begun.get(w[:head], []), math.prod(p(state(context), x) for context, x in further(w))
                s += math.log10((words[w] + max(len(b), 1) * spelled) / (sum(b) + max(len(b), 1)))
        out.append(s)
    return out, len(tree)


@pytest.mark.parametrize("part", [2_000_000, 150])
def test_same_as_plain_tree(spark, texts, monkeypatch, part):
    """part: entries of a part of the tree; with 150 there are many parts."""
    monkeypatch.setattr(suffix_tree_lm, "PART", part)
    some = [(k, t[:1500]) for k, t in texts[:60]] + [(900, "A b"), (901, ""), (902, None), (903, "zz\u00e9 \U0001f600 a")]
    want, states = plain_score([t for _, t in some], [t for k, t in some if k % 3])
    got = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(spark.createDataFrame(some, "doc_id long, text string"), F.col("doc_id") % 3 != 0).collect()}
    assert states > 40 and all(math.isclose(got[k], w, abs_tol=1e-6) for (k, _), w in zip(some, want, strict=True))


def test_more_text_grows_a_larger_tree(spark):
    sizes = [suffix_tree_lm.tree_rows(suffix_tree_lm.statistics(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text", F.lit(True).alias("teaches"))).filter(F.col("kind") == suffix_tree_lm.GRAM).select("key", "n")).select("depth", "context").distinct().count() for sf in ("sf0.001", "sf0.01")]
    assert sizes[1] > 2 * sizes[0]


def test_symbols():
    data = np.frombuffer(b"Abc d", np.uint8)
    starts, ends, first = word_bounds(data, np.array([0, 5, 5]))
    codes, of = suffix_tree_lm.symbols(LOWER[data], starts, ends, first)
    got = sorted((int(r), (int(c) >> 8).to_bytes(7, "big"), int(c) & 255) for c, r in zip(codes, of, strict=True))
    assert got == sorted([(0, b"\n" * 7, 97), (0, b"\n" * 6 + b"a", 98), (0, b"\n\n\nabc ", 100), (0, b"\n\nabc d", 32), (0, b"\nabc d ", 10), (1, b"\n" * 7, 10)])


def test_spellings():
    data = np.frombuffer(b"abc d ef", np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, 8]))
    long = ends - starts >= 2
    codes, of = suffix_tree_lm.spellings(data, starts[long], ends[long])
    got = [(int(r), (int(c) >> 8).to_bytes(7, "big"), int(c) & 255) for c, r in zip(codes, of, strict=True)]
    assert got == [(0, b"\xff\xff\xff  ab", 99), (0, b"\xff\xff\xff abc", 32), (1, b"\xff\xff\xff  ef", 32)]


def scores_of(spark, train, texts):
    rows = [(i, t, True) for i, t in enumerate(train)] + [(-1 - i, t, False) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, teaches boolean")
    got = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(docs, F.col("teaches")).collect()}
    return [got[-1 - i] for i in range(len(texts))]


def test_every_byte_of_an_unseen_word_costs(spark, texts):
    train = [t[:3000] for _, t in texts[:80]]
    rng = np.random.default_rng(3)
    letters = "".join(chr(97 + k) for k in rng.integers(0, 26, 400))
    made = [["th" + letters[:n] for n in (8, 20, 80, 400)], ["\u5b57" * n for n in (1, 2, 20, 2000)], ["zq" + "e" * n for n in (1, 10, 100)]]
    for words in made:
        got = scores_of(spark, train, words)
        assert all(b < a - 0.02 for a, b in zip(got, got[1:], strict=False)), got
    one, other = scores_of(spark, train, ["thzzqq", "thenin"])  # they differ only in how an unseen word goes on
    assert one < other


def test_probabilities_sum_to_one_in_every_state(spark, texts):
    docs = spark.createDataFrame([(t[:3000],) for _, t in texts[:80]], "text string").withColumn("teaches", F.lit(True))
    rows = suffix_tree_lm.tree_rows(suffix_tree_lm.statistics(docs).filter(F.col("kind") == suffix_tree_lm.GRAM).select("key", "n"))
    tree = suffix_tree_lm.tree_part(rows, 0, 1)
    bytes_ = np.arange(256, dtype=np.uint64)
    for d in range(suffix_tree_lm.DEPTH + 1):
        for context in tree.contexts[d]:
            assert math.isclose((10.0 ** tree.find((context << np.uint64(8)) | bytes_, d)).sum(), 1, abs_tol=1e-9)


def test_rests_of_a_head_sum_to_less_than_one_and_grow(spark):
    """Words over two letters, all up to a length; what is missing is what longer words have, which shrinks with the length."""
    train = ["ab aba abb abab abab ba abba", "ab ab aba bab"]
    left = []
    for longest in (4, 8):
        words = ["ab" + "".join("ab"[n >> i & 1] for i in range(k)) for k in range(longest - 1) for n in range(1 << k)]
        tails = ["ab" + "\u00e9"]  # a byte outside the letters: only its smoothing remains
        got = scores_of(spark, train, ["ab", *words, *tails])
        # all these texts are one word and an end: the head's symbols are the same, and so is the end mark but for its state
        least = min(got[1 : len(words) + 1])
        assert got[-1] < max(got[:-1]) and least > -40
        left.append(sum(10.0**x for x in got[1 : len(words) + 1]))
    assert left[0] < left[1] < 1


def test_odd_rows(odd_docs, no_docs):
    got = suffix_tree_lm.score(odd_docs, F.col("doc_id") % 2 == 0).collect()
    assert len(got) == odd_docs.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (4, 5, 6)} == {1}
    assert suffix_tree_lm.score(no_docs, F.lit(True)).count() == 0
    assert all(math.isfinite(r["score"]) for r in suffix_tree_lm.score(odd_docs, F.lit(None).cast("boolean")).collect())
