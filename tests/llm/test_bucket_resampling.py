import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from weftline.llm import bucket_resampling
from weftline.llm.bucket_resampling import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, targets, percent=10, most=1, least=20):
    def buckets(text):
        words = WORD.findall((text or "").translate(LOW))
        runs = [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]

    rows = [(k, *buckets(t)) for k, t in docs]
    raw, target = Counter(b for *_, x in rows for b in x), Counter(b for t in targets for b in buckets(t)[1])
    s, t = sum(raw.values()), sum(target.values())
    out = []
    for k, n, x in rows:
        weight = sum(math.floor(1000 * math.log((target[b] + 1) * (s + 10_000) / ((raw[b] + 1) * (t + 10_000)))) for b in x)
        h = int(hashlib.sha256(f"2024:{k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(x), weight, None if k is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(able[: percent * sum(r[5] >= least for r in out) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(spark, docs, targets, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return sorted((tuple(r) for r in resample(d, spark.createDataFrame([(t,) for t in targets], "text string"), **more).collect()), key=repr)


@pytest.mark.parametrize("more", [{}, {"most": 3, "percent": 50}, {"least": 0, "percent": 100}])
def test_by_brute_force(spark, texts, more):
    docs = [(k, t[:900]) for k, t in texts] + [(1001, "Éa éA ÀÉ x" * 9), (1002, "A-b_c d1`e{f|" * 9), (None, "word " * 30), (1003, None), (1004, ""), (1005, "one")]
    targets = [t for _, t in texts[:20]] + [None, "", "New words only"]
    assert got(spark, docs, targets, **more) == plain(docs, targets, **more)


def test_ties_over_many_ranges(spark, monkeypatch):
    """Rows that repeat an id have one score; ranks stay without gaps, also when counts by score tell little."""
    monkeypatch.setattr(bucket_resampling, "BINS", 3)
    docs = [(i % 40, " ".join(f"w{i % 40}" for _ in range(25))) for i in range(400)]
    rows = got(spark, docs, ["w1 w2 w3"], percent=35)
    ranks = sorted(r[4] for r in rows if r[4])
    assert ranks == list(range(1, 141)) and len(rows) == 400
    by = sorted((r for r in rows if r[4]), key=lambda r: r[4])
    assert all((-a[3], a[0]) <= (-b[3], b[0]) for a, b in zip(by, by[1:], strict=False))
    assert min(r[3] for r in by) >= max(r[3] for r in rows if not r[4])


def test_scores_are_one_literal_and_no_explode(spark, docs):
    rows = bucket_resampling.bucketed(docs, "doc_id", "text", 1)
    weight = bucket_resampling.summed(np.arange(bucket_resampling.BUCKETS))
    plan = rows.select(weight)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "element_at([0,1,2,3," in plan


def test_odd_rows(spark, odd_docs, no_docs):
    """Nulls, empty and very long texts, ties, repeated rows, empty tables and other columns."""
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    targets = spark.createDataFrame([("the quick brown", 1), (None, 2), ("", 3)], "text string, doc_id long")
    for percent in (0, 10, 60, 100):
        assert sorted((tuple(r) for r in resample(odd_docs, targets, percent).collect()), key=repr) == plain(rows, ["the quick brown"], percent)
    assert resample(no_docs, targets).count() == 0
    assert sorted((tuple(r) for r in resample(odd_docs, targets.limit(0), 60).collect()), key=repr) == plain(rows, [], 60)
