import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import importance


def test_good_texts_weigh_more(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = importance.resample(docs, labels.filter("quality = 1 and toxic = 0").select("doc_id"), importance.good_share(labels)).join(labels, "doc_id")
    means = {r["quality"]: r["m"] for r in got.groupBy("quality").agg(F.avg(F.col("selected").cast("double")).alias("m")).collect()}
    assert means[1] > 0.8 and means[0] < 0.3


def test_top_k_is_exact(spark):
    keys = np.random.default_rng(0).normal(size=3000).round(1)
    rows = spark.createDataFrame([(i, float(k)) for i, k in enumerate(keys)], "id long, key double")
    for k in (0, 1, 1234, 2999, 3000):
        want = {i for _, i in sorted((-x, i) for i, x in enumerate(keys))[:k]}
        assert {r["id"] for r in rows.filter(importance.top_k(rows, k, bins=16, few=10)).collect()} == want


def test_odd_rows(spark, odd_docs, no_docs):
    good = spark.createDataFrame([(1,), (1,), (None,), (77,)], "doc_id long")
    got = importance.resample(odd_docs, good, 0.5).collect()
    assert len(got) == odd_docs.count()
    assert not any(r["selected"] for r in got if r["doc_id"] in (None, 4, 5, 6)) and sum(r["selected"] for r in got) == 4
    assert importance.resample(no_docs, good, 0.5).count() == 0
    assert importance.resample(odd_docs, good.limit(0), 1.0).filter("selected").count() == 9


def test_weights_by_brute_force(spark, texts):
    """The ratio of two add-one models over hashed words and pairs, by dictionaries."""
    some = [(k, t[:600]) for k, t in texts[:40]] + [(900, "Same same"), (901, "same SAME"), (902, "x")]
    good = [k for k, _ in some if k % 3 == 0]

    def features(t):
        data = np.frombuffer(t.encode(), np.uint8)
        return importance.features(data, np.array([0, len(data)]))[1].tolist()

    target, raw = Counter(), Counter()
    for k, t in some:
        raw.update(features(t))
        target.update(features(t) if k in good else [])
    n, m, v = sum(target.values()), sum(raw.values()), importance.FEATURES
    got = importance.resample(spark.createDataFrame(some, "doc_id long, text string"), spark.createDataFrame([(k,) for k in good], "doc_id long"), 0.5).collect()
    for r, (k, t) in zip(sorted(got, key=lambda r: r["doc_id"]), sorted(some), strict=True):
        want = sum(math.log((target[f] + 1) / (n + v)) - math.log((raw[f] + 1) / (m + v)) for f in features(t))
        assert r["n_features"] == len(features(t)) == max(0, 2 * len(t.split()) - 1) and math.isclose(r["log_weight"], want, abs_tol=1e-6)
    chosen = sorted(got, key=lambda r: (-r["gumbel_key"], r["doc_id"]))[: round(0.5 * len(got))]
    assert {r["doc_id"] for r in got if r["selected"]} == {r["doc_id"] for r in chosen}


def test_ties_between_ids(spark):
    """Equal keys: the smaller ids are taken; rows that repeat an id and a text are drawn together."""
    rows = spark.createDataFrame([(i, 1.5) for i in (9, 3, 7, 5)] + [(1, 0.5)], "id long, key double")
    assert {r["id"] for r in rows.filter(importance.top_k(rows, 2)).collect()} == {3, 5}
    table = spark.createDataFrame([(i % 5, "a b c") for i in range(20)], "doc_id long, text string")
    got = importance.resample(table, table.select("doc_id"), 0.4).filter("selected").groupBy("doc_id").count().collect()
    assert [r["count"] for r in got] == [4, 4]
