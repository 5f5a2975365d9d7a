import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import suffix_dedup, windows, word_graph_dedup


def words_left(texts, window=20):
    seen, out = set(), {}
    for k, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[k] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def bytes_left(texts, window):
    data = [(k, (t or "").encode()) for k, t in texts]
    counts = Counter(b[i : i + window] for _, b in data for i in range(len(b) - window + 1))
    out = {}
    for k, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if counts[b[i : i + window]] > 1:
                gone[i : i + window] = True
        out[k] = (len(b), int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def test_words_same_as_brute_force(docs, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in word_graph_dedup.remove_earlier(docs).collect()}
    assert got == words_left(texts)


@pytest.mark.parametrize("most", [1024, 2])
def test_bytes_same_as_brute_force(spark, texts, monkeypatch, most):
    """most: classes of one key in a suffix array; with 2 nearly all meet by single windows."""
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    some = texts[:60] + [(1000 + i, t[3:] + "x") for i, (_, t) in enumerate(texts[:8])] + [(2000, "ab" * 600), (2001, "z" * 900)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(some, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got} == bytes_left(some, 400)
    for r in got:
        assert sum(s["hi"] - s["lo"] for s in r["spans"]) == r["n_removed"]


def test_maximal_repeats():
    text = np.frombuffer(b"xabcdy_zabcdw_qabcde", np.uint8)
    starts = np.arange(len(text))
    found = {(n, tuple(sorted(m.tolist()))) for n, m in suffix_dedup.maximal_repeats(text, starts, np.full(len(text), len(text)), np.zeros(len(text), np.int64), 3)}
    assert found == {(4, (1, 8, 15))}  # bcd is left out: it always follows a


def test_runs_meet_at_equal_windows():
    rng = np.random.default_rng(2)
    a, b, c = (rng.integers(0, 1 << 60, n, dtype=np.uint64) for n in (50, 40, 30))
    tokens = np.concatenate([a, b, c, b])
    r = windows.runs(tokens, np.array([0, 90, 160]), 20, 6)
    whole = [tokens[lo:hi].tobytes() for lo, hi in zip(r.lo, r.hi, strict=True)]
    inner = {w for w, row in zip(whole, r.row, strict=True) if row == 0} & {w for w, row in zip(whole, r.row, strict=True) if row == 1}
    assert r.count.sum() == 71 + 51 and inner


@pytest.mark.parametrize("most", [1024, 2])
def test_zero_bytes(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    rng = random.Random(4)
    letters = "".join(rng.choice("abcdefgh") for _ in range(420))
    some = [(i, letters + "\0" * i) for i in range(5)] + [(10 + i, "\0" * (398 + i)) for i in range(6)]
    some += [(20 + i, "".join(rng.choice("\0\0\0a") for _ in range(rng.randrange(380, 460)))) for i in range(4)]
    some += [(30 + i, letters[i:] + "\0" * rng.randrange(9) + letters[: 400 - i] + "\0x") for i in range(12)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(some, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got} == bytes_left(some, 400)


def test_a_key_of_many_texts(spark):
    """A passage of 300 bytes with 1500 different ones around it, some of them alike: more than MOST, and as many in a lighter one."""
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    middle, other = draw(300), draw(320)
    some = [(i, draw(250) + middle + draw(250)) for i in range(1500)] + [(2000 + i, draw(250) + other + draw(250)) for i in range(300)]
    some += [(3000 + i, draw(20) + some[i][1][200:650] + draw(9)) for i in (3, 4, 1600, 1700)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(some, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got} == bytes_left(some, 400)


def test_suffix_array_of_several_texts():
    rng = random.Random(6)
    for _ in range(60):
        texts = [bytes(rng.choice([0, 0, 97, 98]) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 5))]
        offsets = np.cumsum([0] + [len(t) for t in texts])
        text, starts = np.frombuffer(b"".join(texts), np.uint8), np.arange(offsets[-1])
        ends = offsets[1:][np.searchsorted(offsets, starts, "right") - 1]
        order, common = suffix_dedup.suffix_array(text, starts, ends)
        got = [text[starts[i] : ends[i]].tobytes() for i in order]
        assert got == sorted(got)
        for a, b, n in zip(got, got[1:], common[1:], strict=False):
            assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_colliding_hashes_keep_texts_apart(monkeypatch):
    monkeypatch.setattr(windows, "span_hash", lambda sums, starts, ends: np.zeros(len(starts), np.uint64))
    texts = [" ".join(f"{k}{i}" for i in range(30)) for k in "abab"]
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4], "tag": [0] * 4, "text": texts})
    for by_words, window, gram in ((True, 20, 6), (False, 40, 8)):
        [(_, r, h)] = windows.batch_runs(batch, by_words, window, gram)
        by_row = [{tuple(x) for x, row in zip(h.tolist(), r.row, strict=True) if row == k} for k in range(4)]
        assert by_row[0] == by_row[2] and by_row[1] == by_row[3] and not by_row[0] & by_row[1]


def test_words_of_repeated_ids(spark):
    rng = random.Random(7)
    draw = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common, own = draw(30), draw(40)
    rows = [(1, " ".join(draw(5) + common)), (1, " ".join(draw(9) + common)), (2, " ".join(common)), (3, " ".join(own)), (3, " ".join(own))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = None
    for parts in (1, 5):
        got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in word_graph_dedup.remove_earlier(table.repartition(parts)).collect())
        assert want in (None, got)
        want = got
    assert sum(r[2] for r in got if r[0] == 1) == 30 and (2, 30, 30) in got and got.count((3, 40, 0)) == 2


def test_odd_rows(odd_docs, no_docs):
    for got in (word_graph_dedup.remove_earlier(odd_docs), suffix_dedup.remove_repeats(odd_docs)):
        assert got.count() == odd_docs.count()
    by = {r["doc_id"]: r for r in word_graph_dedup.remove_earlier(odd_docs).collect()}
    assert by[1]["n_removed"] == 0 and by[2]["n_removed"] == by[2]["n_words"] == 23 and by[3]["kept"] == "today"
    assert by[4]["kept"] == "" and by[6]["n_words"] == 0
    assert hashlib.sha256(by[8]["kept"].encode()).hexdigest() == hashlib.sha256("ein kleiner Satz über das Wetter mit ö und ß".encode()).hexdigest()
    assert word_graph_dedup.remove_earlier(no_docs).count() == suffix_dedup.remove_repeats(no_docs).count() == 0
