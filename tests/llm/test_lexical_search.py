import math
import re
from collections import Counter

import numpy as np
import pytest

from weftline.llm import lexical_search
from weftline.llm.lexical_search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    """Every document scored for every item, by dictionaries; rows are documents, item numbers are places in the list."""
    tf = [Counter(TERM.findall((t or "").translate(LOW))) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    count, length = sum(x > 0 for x in n), sum(n)
    df = Counter(w for c in tf for w in c)
    out = []
    for item, text in items:
        score = [0] * len(docs)
        for w, c in Counter(TERM.findall((text or "").translate(LOW))).items():
            weight = math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1)))
            for i, have in enumerate(tf):
                if w in have:
                    m = 100 - 75 + (75 * n[i] * count) // length
                    score[i] += c * weight * ((1_000_000_000 * have[w]) // (1000 * have[w] + 8 * m))
        order = sorted((-s, docs[i][0] is None, docs[i][0] or 0) for i, s in enumerate(score) if s > 0)[:k]
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(order)]
    return sorted(out, key=repr)


def got(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    return sorted((tuple(r) for r in search(d, spark.createDataFrame(items, "item_id long, text string"), **more).collect()), key=repr)


def random_rows(seed, docs, items, vocabulary=300):
    rng = np.random.default_rng(seed)
    words = [f"W{i}" if i % 7 else f"wört{i}" for i in range(vocabulary)]
    share = 1 / np.arange(1, vocabulary + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    return [(i, text(rng.integers(1, 120))) for i in range(docs)], [(i, text(rng.integers(1, 40))) for i in range(items)]


@pytest.mark.parametrize("seed", [0, 1])
def test_by_brute_force(spark, seed):
    docs, items = random_rows(seed, 400, 25)
    docs += [(1000 + i, docs[3][1]) for i in range(150)] + [(2000, "common " * 3000), (2001, None), (2002, " ,"), (None, docs[5][1])]
    assert got(spark, docs, items) == plain(docs, items)
    assert got(spark, docs, items[:4], k=3) == plain(docs, items[:4], k=3)


def test_same_in_many_blocks_and_stretches(spark, monkeypatch):
    docs, items = random_rows(2, 150, 12)
    want = plain(docs, items)
    monkeypatch.setattr(lexical_search, "PAIRS", 60)
    monkeypatch.setattr(lexical_search, "TOGETHER", 7)
    assert got(spark, docs, items) == want


def test_terms_at_the_end_make_no_candidates():
    """A rare term's threshold is above all that the common ones can give together."""
    import pyarrow as pa

    stored = pa.table({"term": [0, 1, 2], "df": [10, 900, 950], "kth": [900_000] * 3, "most": [950_000] * 3})
    b = lexical_search.Block(np.zeros(3, np.int64), np.arange(3), np.ones(3, np.int64), stored, 3, 1000)
    assert np.diff(b.seed_starts).tolist() == [1, 0, 0] and b.rest[0] == sum((b.gain * 950_000)[1:]) < b.least[0]


def test_words_with_one_hash(monkeypatch):
    """Terms are told apart by their bytes, whatever their hashes."""
    monkeypatch.setattr(lexical_search, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    data = np.frombuffer(b"ab cd ef xyz", np.uint8)
    terms = lexical_search.Terms(["cd", "ab", "xyy"])
    assert terms.find(data, np.array([0, 3, 6, 9]), np.array([2, 5, 8, 12])).tolist() == [1, 0, -1, -1]


def test_odd_rows(spark, odd_docs, no_docs):
    """Nulls, empty and very long texts, ties, repeated rows, empty tables and other columns."""
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    items = [(1, "the QUICK fox"), (1, "the QUICK fox"), (1, "Wetter wetter"), (None, "a row"), (2, None), (3, ""), (4, "nowhere"), (5, "word39999 goes on")]
    table = spark.createDataFrame([(i, t, 7, "z") for i, t in items], "item_id long, text string, score int, item string")
    want = plain(rows, items[1:])
    assert sorted((tuple(r) for r in search(odd_docs, table).collect()), key=repr) == want
    assert {r[0] for r in want} == {1, None, 5}
    assert search(no_docs, table).count() == 0 and search(odd_docs, table.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert search(odd_docs, table.limit(0)).count() == 0 and search(no_docs, table.limit(0)).count() == 0
