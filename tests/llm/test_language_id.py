import pickle

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import language_id, queries


def test_held_out_accuracy(docs):
    net = language_id.fit(docs.filter(queries.id_crc(5) != 0), per_language=60)
    got = language_id.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").filter(queries.id_crc(5) == 0)
    share = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert share > 0.9


def test_odd_rows(odd_docs, no_docs):
    net = language_id.fit(odd_docs, per_language=20)
    got = language_id.predict(odd_docs, net).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    for k in (4, 5, 6, 12):
        assert (by[k]["lang_pred"], by[k]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = language_id.accepted(odd_docs, net, 0.0)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 7, 8, None, 10, 11}
    assert language_id.predict(no_docs, language_id.fit(no_docs)).count() == 0


def test_long_texts_in_parts(spark, docs, monkeypatch):
    """A text of many parts of windows scores as its windows do one by one; columns may have any names."""
    monkeypatch.setattr(language_id, "AT_ONCE", 3)
    net = language_id.fit(docs, per_language=20)
    t = "".join(r["text"] for r in docs.limit(30).collect()).encode()
    data, offsets = np.frombuffer(t, np.uint8), np.array([0, 10, 10, len(t) - 5, len(t)])
    got = language_id.scores(net, net.tables(), data, offsets)
    for i in range(4):
        part = data[offsets[i] : offsets[i + 1]]
        want = np.zeros(len(net.languages))
        for at in range(0, len(part), net.window):
            w = np.zeros((1, net.window), np.uint8)
            w[0, : len(part[at : at + net.window])] = part[at : at + net.window]
            want += net.probabilities(w, net.tables())[0] * len(part[at : at + net.window])
        assert np.allclose(got[i], want / max(len(part), 1))
    table = docs.select("doc_id", "text", F.lit(1).alias("__letters"), F.lit(None).cast("string").alias("letters"))
    kept = language_id.accepted(table, net, 0.0)
    assert kept.columns == table.columns and kept.count() > 100


def test_probabilities_by_plain_convolution(docs):
    """Every filter at every place of a window, byte by byte; the largest output, and a softmax of the last layer."""
    net = language_id.fit(docs, per_language=20)
    rng, dims = np.random.default_rng(3), net.emb.shape[1]
    windows = np.concatenate([rng.integers(0, 256, (4, net.window), dtype=np.uint8), np.zeros((1, net.window), np.uint8)])
    got = net.probabilities(windows, net.tables())
    for row, x in zip(got, windows, strict=True):
        hidden = []
        for w in language_id.WIDTHS:
            places = [sum(net.emb[x[p + k]] @ net.conv[w][k * dims : (k + 1) * dims] for k in range(w)) for p in range(net.window - w + 1)]
            hidden.append(np.maximum(np.max(places, 0) + net.bias[w], 0))
        logits = np.concatenate(hidden).astype(float) @ net.out + net.out_bias
        want = np.exp(logits - logits.max())
        assert np.allclose(row, want / want.sum(), atol=1e-5)


def test_only_the_net_is_sent(spark, monkeypatch):
    """The driver holds no tables of the net, which are a hundred times its size."""
    net = language_id.ByteNet.fit(np.frombuffer(b"ab" * 8 + b"cd" * 8, np.uint8).reshape(2, 16), ["x", "y"], epochs=1)
    sent, put = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (sent.append(len(pickle.dumps(value))), put(self, value))[1])
    docs = spark.createDataFrame([(1, "abab"), (2, None)], "doc_id long, text string")
    assert language_id.predict(docs, net).count() == 2 and language_id.accepted(docs, net, 0.0).count() == 1
    assert len(sent) == 2 and max(sent) < 1e6  # once 17 MB
