import pickle

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import vector_graphs as V


def brute(keys, x, threshold=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array(keys)
    while True:
        low = np.minimum(label, np.where(near, label[None], 1 << 60).min(1))
        if (low == label).all():
            return {k: (int(n), int(c)) for k, n, c in zip(keys, near.sum(1), label, strict=True)}
        label = low


def clumps(n, dims, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for i in range(0, n // 2):
        x[i] = x[i % 40] + rng.normal(size=dims) * rng.choice([0.02, 0.1, 0.2])
    return x.astype(np.float32)


def test_graph_finds_all_neighbours():
    x = clumps(3000, 24, 1)
    unit = V.unit_vectors(x)
    shard = V.Shard(np.arange(3000), np.ones(3000, np.int64), x, unit, V.build(unit, np.arange(3000)))
    i, j = V.near_pairs(shard, unit, 0.95, 32)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    true = set(zip(*(k.tolist() for k in np.nonzero(unit @ unit.T >= 0.95)), strict=True))
    assert len(true & found) >= 0.999 * len(true)


def test_same_as_brute_force(spark):
    x = clumps(900, 16, 2)
    x[7] = x[11]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = V.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute(range(900), x.astype(float))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_odd_vectors(spark):
    one, nan, inf = [1.0, 2.0], float("nan"), float("inf")
    rows = [(1, one, 5), (2, one, None), (3, [2.0, 4.0], 5), (4, None, 5), (5, [], 5), (6, [0.0, 0.0], 5), (7, [1.0, None], 5), (8, [nan, 1.0], 5), (9, [inf, 1.0], 5), (None, one, 5), (10, [1.0, 2.0, 0.0], 5), (2, one, 5), (11, [1e-30, 2e-30], 1)]
    for kind in ("float", "double"):
        got = V.link(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, size int")).collect()
        assert len(got) == len(rows)
        by = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
        assert by[1] == by[2] == by[3] == by[11] == (4, 1)
        assert all(by[k] == (0, k) for k in (4, 5, 6, 7, 8, 9, 10)) and by[None] == (0, None)
    assert V.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def lost_graph(x):
    """A shard, and a search that leads no beam to any vector but the query itself."""
    unit = V.unit_vectors(x)
    shard = V.Shard(np.arange(len(x)), np.ones(len(x), np.int64), x, unit, V.build(unit, np.arange(len(x))))
    real = V.near_pairs

    def near_pairs(shard, queries, threshold, beam):
        i, j = real(shard, queries, threshold, V.SCAN)
        ok = (beam > V.WIDEST) | (np.einsum("ij,ij->i", queries[i], shard.unit[j]) > 0.9999)
        return i[ok], j[ok]

    return shard, near_pairs


def test_audit_sees_what_beams_do_not_reach(monkeypatch):
    x = np.random.default_rng(5).normal(size=(1200, 24)).astype(np.float32)
    for i in range(0, 60, 2):
        x[i + 1] = x[i] + 0.01
    shard, near_pairs = lost_graph(x)
    true, found = V.audit(shard, 0.95)
    assert true >= V.AUDIT and V.narrowest(true, found, 1.0) < V.SCAN  # links are rare, but those drawn for the audit are not
    monkeypatch.setattr(V, "near_pairs", near_pairs)
    true, found = V.audit(shard, 0.95)
    assert true >= V.AUDIT and found[256] < 0.1 * true and V.narrowest(true, found, 1.0) == V.SCAN
    rows = [{"unit": 1, "key": None, "embedding": None, "blob": pickle.dumps(shard)}] + [{"unit": 1, "key": i, "embedding": v.tolist(), "blob": None} for i, v in enumerate(x)] + [{"unit": 2, "key": 5, "embedding": x[5].tolist(), "blob": None}]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("unit", pa.int64()), ("key", pa.int64()), ("embedding", pa.list_(pa.float32())), ("blob", pa.binary())]))
    for parts in ([batch], [batch.slice(0, 1), batch.slice(1, 500), batch.slice(501)]):
        assert sum(sum(b["n"].to_pylist()) for b in map(pa.Table.from_batches, ([b] for b in V.search(iter(parts), 0.95)))) == 60


def test_repeated_ids_with_other_vectors(spark):
    x = clumps(300, 8, 4)
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 120, 300)
    rows = [(int(k), v.tolist()) for k, v in zip(ids, x, strict=True)] + [(4, [5.0, 5.0, 5.0]), (4, [5.0, 5.0, 5.01]), (1, [1.0, 0.0]), (1, [0.0, 1.0])]
    got = V.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    true = brute(range(300), x.astype(float))
    label = {}
    for i, (_, c) in true.items():
        label[c] = min(label.get(c, 1 << 60), int(ids[i]))
    want = [(int(ids[i]), n, label[c]) for i, (n, c) in true.items()] + [(4, 1, 4), (4, 1, 4), (1, 0, 1), (1, 0, 1)]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(want)


@pytest.mark.parametrize("dims", [24, 48])
def test_recall_on_many_clusters(dims):
    """A shard of which a half is in clusters of some hundred, with links of all strengths: the audited beam against brute force."""
    x = clumps(6000, dims, 9)
    shard, _ = lost_graph(x)
    true, found = V.audit(shard, 0.95)
    shard.beam = V.narrowest(true, found, 1.0)
    i, j = V.near_pairs(shard, shard.unit, 0.95, shard.beam)
    want = np.argwhere(shard.unit @ shard.unit.T >= 0.95)
    got = set((i[i != j] * 6000 + j[i != j]).tolist())
    links = [a * 6000 + b for a, b in want.tolist() if a != b]
    share = sum(k in got for k in links) / len(links)
    print(f"recall {share} of {len(links)} links, beam {shard.beam}")
    assert len(links) > 1000 and share >= 0.999
