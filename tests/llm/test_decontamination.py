import random
import re

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import latent_decontamination as L


def plain(t):
    return " ".join(re.findall(r"[^\W_]+", t.lower()))


def test_same_items_as_search_for_the_whole_passage(spark, docs, texts):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r["item_id"]: plain(r["text"]) for r in benchmark.collect()}
    true = {(k, i) for k, t in texts for i, x in items.items() if x in plain(t)}
    got = {(r["doc_id"], r["item_id"]) for r in L.contained(docs, benchmark).collect()}
    assert true and got == true
    left = L.decontaminate(docs, benchmark)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {k for k, _ in texts} - {k for k, _ in true}


def test_paraphrase_is_found(spark, docs, texts):
    item = next(r for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").collect() if len(r["text"].split()) > 35)
    w = item["text"].split()
    del w[5], w[17]
    w.insert(9, "indeed")
    rows = spark.createDataFrame([(99_999, texts[0][1][:400] + " " + " ".join(w) + " " + texts[1][1][:300])], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    benchmark = spark.createDataFrame([(item["item_id"], item["text"])], "item_id long, text string")
    assert 99_999 in {r["doc_id"] for r in L.contained(rows, benchmark).collect()}


def test_longest_common_subsequence():
    item = L.Item(1, [1, 2, 3, 2, 5], {5}, None, 2)
    assert item.common([9, 1, 3, 2, 2, 5]) == 4 and item.common([]) == 0 and item.common([5, 2, 1]) == 1


def test_odd_rows(spark, odd_docs, no_docs):
    benchmark = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the quiet river bank", 1), (2, None, 2), (3, "", 3), (None, "x", 4), (4, "too short", 5)], "item_id long, text string, doc_id int")
    got = L.contained(odd_docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 1), (3, 1)}
    assert L.decontaminate(odd_docs, benchmark).count() == odd_docs.count() - 3
    assert L.contained(no_docs, benchmark).count() == 0 and L.contained(odd_docs, benchmark.limit(0)).count() == 0


def test_short_items_and_scripts_without_spaces(spark, docs):
    zh, th, short, mid = "请问中国的首都是哪一座城市？", "เมืองหลวงของประเทศไทย", "Zorblat quux!", "zarn obli vent kurm tesk bilo narp"
    other = docs.orderBy("doc_id").first()["text"]
    rows = [(90_001, f"{other} 前言。{zh}后记 {other}"), (90_002, f"xx{th} {other}"), (90_003, f"{other} zorblat, QUUX {other}"), (90_004, f"{other} {mid} {other}"), (90_005, "zorblat quuxes"), (90_006, "zorblat"), (90_007, "quux 请问")]
    table = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    benchmark = spark.createDataFrame(list(enumerate([zh, th, short, mid])), "item_id int, text string")
    assert {(r["doc_id"], r["item_id"]) for r in L.contained(table, benchmark).collect()} == {(90_001, 0), (90_002, 1), (90_003, 2), (90_004, 3)}


def paraphrases(rng, words, foreign):
    """The words with up to four tenths of them dropped, doubled by a foreign one, or changed in place with a neighbour."""
    out = list(words)
    for _ in range(rng.randrange(1, max(2, len(words) * 2 // 5))):
        i, what = rng.randrange(len(out)), rng.random()
        if what < 0.4:
            del out[i]
        elif what < 0.7:
            out.insert(i, rng.choice(foreign))
        elif i:
            out[i - 1], out[i] = out[i], out[i - 1]
        if not out:
            return list(words)
    return out


def test_recall_over_paraphrases(spark):
    """Against brute force: which paraphrases hold enough of an item in its order, and of its answer, by plain Python."""
    rng = random.Random(8)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    foreign = [w for r in docs.filter("doc_id % 50 = 7").collect() for w in r["text"].split()]
    some = []
    for r in benchmark.orderBy("item_id").collect():
        w = r["text"].split()
        some += [(r["item_id"], rng.sample(foreign, 60) + paraphrases(rng, w, foreign) + rng.sample(foreign, 60)) for _ in range(6)]
        some += [(r["item_id"], rng.sample(foreign, 60) + paraphrases(rng, w[k : k + 9], foreign) + rng.sample(foreign, 60)) for k in (0, 5) if len(w) > 8]
        short = w[:7]
        some.append((-r["item_id"] - 1, rng.sample(foreign, 60) + paraphrases(rng, short, foreign) + rng.sample(foreign, 60)))
    short = [(-r["item_id"] - 1, " ".join(r["text"].split()[:7])) for r in benchmark.collect()]
    table = benchmark.select("item_id", "text").unionByName(spark.createDataFrame(short, "item_id long, text string"))
    rows = spark.createDataFrame([(10**6 + k, " ".join(w)) for k, (_, w) in enumerate(some)], "doc_id long, text string").unionByName(docs)
    space = L.LatentSpace.fit(rows.select(F.col("doc_id").alias("id"), "text"))
    items = {x.key: x for block in L.items_of(table.select(F.col("item_id").alias("id"), "text"), space) for x in block}

    def holds(item, text):
        data = np.frombuffer(text.encode(), np.uint8)
        h = L.split(data, np.array([0, len(data)]))[0].tolist()
        m = len(item.words)
        regions = [h[a : a + 3 * m] for a in range(0, max(1, len(h) - 3 * m + 1))]
        return any(len(item.answer & set(g)) >= 0.5 * len(item.answer) and item.common(g) >= 0.6 * m for g in regions)

    true = {(10**6 + k, i) for k, (of, w) in enumerate(some) for i in (of,) if holds(items[i], " ".join(w))}
    got = {(r["doc_id"], r["item_id"]) for r in L.contained(rows, table, space=space).filter("doc_id >= 1000000").collect()}
    print(f"recall {len(true & got) / len(true)} of {len(true)}, {sum(i < 0 for _, i in true)} of them of 7 words")
    assert len(true) > 200 and len(true & got) >= 0.9 * len(true)


def test_rows_are_judged_alone(spark, docs):
    """Clean rows that share an id with a dirty one, or have none, stay; extra columns have the operator's own names."""
    item, clean = "zarn obli vent kurm tesk bilo narp quel dosh", "something else altogether here"
    rows = [(1, item, "a", 1), (1, clean, "b", 2), (None, f"x {item} y", "c", 3), (None, clean, None, 4), (None, None, "d", 5), (2, "", "e", 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, bad_id string, key int")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = L.decontaminate(table, benchmark)
    assert kept.columns == table.columns and sorted(r["key"] for r in kept.collect()) == [2, 4, 5, 6]


def test_windows_with_answers_same_as_all_windows():
    rng = np.random.default_rng(2)
    for _ in range(200):
        first = np.concatenate([[0], np.cumsum(rng.integers(1, 90, 3))])
        sizes, scales = rng.integers(5, 40, 4), rng.choice(L.SCALES, 4)
        least = rng.integers(1, 4, 4)
        pairs = np.unique(rng.integers(0, 4 * first[-1], rng.integers(1, 40)))
        item, place = np.divmod(pairs, first[-1])
        want = set()
        for r in range(3):
            words = first[r + 1] - first[r]
            for i in range(4):
                width, step = scales[i] * L.BLOCK, max(scales[i] // 4, 1) * L.BLOCK
                final = max(-(-words // L.BLOCK) * L.BLOCK - width, 0)
                for at in {*range(0, final + 1, step), final}:
                    lo, hi = max(0, at - sizes[i]), min(words, at + width + sizes[i])
                    if ((item == i) & (place >= first[r] + lo) & (place < first[r] + hi)).sum() >= least[i]:
                        want.add((r, i, int(first[r] + at)))
        got = L.windows_with_answers(item, place, first, sizes, scales, least)
        assert set(zip(*(x.tolist() for x in got), strict=True)) == want
