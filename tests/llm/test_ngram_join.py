import itertools
import re
from collections import defaultdict

import pytest

from weftline.llm import ngram_join


def brute(texts, n=5, threshold=0.8):
    sets = {}
    for k, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold]
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    counts = defaultdict(int)
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {k: (root(k), counts[k]) for k in sets}


@pytest.mark.parametrize(("few", "block"), [(24, 128), (2, 3)])
def test_same_as_brute_force(spark, monkeypatch, few, block):
    """Near copies in groups of many sizes, so that both small buckets and blocks of large ones are used."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = []
    for g, size in enumerate([1, 2, 3, 9]):
        words = [f"g{g}w{i}" for i in range(80)]
        for k in range(size):
            own = list(words)
            own[(7 * k) % 80] = f"changed{k}"
            texts.append((len(texts), " ".join(own)))
            if k % 3 == 2:
                texts.append((len(texts), " ".join(own)))
    got = ngram_join.link(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute(texts)


def test_documents(docs, texts):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.link(docs).collect()}
    assert got == brute(texts)


def test_odd_rows(odd_docs, no_docs):
    linked = ngram_join.link(odd_docs)
    got = linked.collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["class_id"] == by[2]["class_id"] == by[3]["class_id"] == 1 and by[1]["n_links"] == 2
    assert by[8]["n_links"] == 1 and by[None]["class_id"] is None
    assert all(by[k]["class_id"] == k and by[k]["n_links"] == 0 for k in (4, 5, 6, 7))
    kept = ngram_join.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 10, 11, 12]
    assert ngram_join.keep_first(no_docs).count() == 0
    assert ngram_join.link(no_docs).count() == 0


def test_bands():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 192


def test_repeated_ids_with_other_texts(spark):
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    near = lambda w: " ".join([*w[:-1], "new"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (3, near(b)), (4, "alone here"), (None, near(b)), (5, " "), (5, " ")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in ngram_join.link(table).collect())
    assert got == [(0, 0, 0, 0), (1, 1, 1, 1), (1, 1, 1, 2), (2, 2, 1, 1), (3, 3, 1, 2), (3, 3, 1, 2), (4, 4, 4, 0), (5, 5, 5, 0), (5, 5, 5, 0)]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in ngram_join.keep_first(table).collect())
    assert kept == sorted([(1, " ".join(a)), (1, " ".join(b)), (4, "alone here"), (0, near(b)), (5, " "), (5, " ")])


def test_many_long_near_copies_in_one_bucket(spark):
    """Texts of 15,000 words, of which each changes a few: all link, none with a long text of its own words."""
    words = [f"w{i * 7919 % 100_003}" for i in range(15_000)]
    texts = []
    for i in range(30):
        own = list(words)
        own[i * 400 : i * 400 + 3] = [f"x{i}", f"y{i}", f"z{i}"]
        texts.append((i, " ".join(own)))
    texts.append((99, " ".join(f"v{i}" for i in range(15_000))))
    got = {r["doc_id"]: r for r in ngram_join.link(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).collect()}
    assert all((got[i]["class_id"], got[i]["n_links"]) == (0, 29) for i in range(30)) and (got[99]["class_id"], got[99]["n_links"]) == (99, 0)
