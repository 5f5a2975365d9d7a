import corpus_pipeline


def test_stages(spark, docs, texts):
    from weftline.llm.frames import cut

    dir_ = "/root/testdata/sf0.001"
    counts, rows = [], docs
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, rows, dir_))
        counts.append(out.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        if name in ("pii", "sentencepiece"):
            assert counts[-1] == counts[-2]
        rows = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "decontamination", "pii", "sentencepiece"]
    assert len(texts) >= counts[0] > counts[1] > counts[2] > 0.8 * len(texts)


def brute_first_stages(rows, benchmark, net):
    """The ids that the first three stages keep: languages by the net row by row, classes by all pairs, items by plain search."""
    import re

    import numpy as np

    from tests.llm.test_ngram_join import brute
    from weftline.llm import language_id

    tables = net.tables()
    spoken = []
    for k, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        p = language_id.scores(net, tables, data, np.array([0, len(data)]))[0].max()
        if re.search(r"[^\W\d_]", t or "") and p >= 1 / 3:
            spoken.append((k, t))
    first = brute(spoken)
    left = [(k, t) for k, t in spoken if first[k][0] == k]
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [plain(t) for t in benchmark]
    return [k for k, _ in spoken], [k for k, _ in left], [k for k, t in left if not any(x in plain(t) for x in items)]


def test_same_as_brute_force(spark, docs, texts):
    import hashlib

    import sentencepiece

    from weftline.llm import disclosure, language_id, queries

    dir_ = "/root/testdata/sf0.001"
    net = language_id.fit(docs.filter(queries.id_crc(5) != 0))
    want = brute_first_stages(texts, [r["text"] for r in spark.read.parquet(f"{dir_}/benchmark.parquet").collect()], net)
    rows = docs
    for (_, stage), ids in zip(corpus_pipeline.STAGES, want, strict=False):
        rows = stage(spark, rows, dir_)
        assert sorted(r["doc_id"] for r in rows.select("doc_id").collect()) == sorted(ids)
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitise(rows).collect()}
    theirs = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, dir_).collect()}
    assert set(got) == set(want[-1]) == set(clean)
    for k, t in clean.items():
        ids = theirs.encode(t)
        assert got[k]["n_tokens"] == len(ids) and got[k]["decoded_sha256"] == hashlib.sha256(theirs.decode(ids).encode()).hexdigest()


def test_odd_tables(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, "a benchmark item that no text has"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = odd_docs.withColumnsRenamed({"row": "__tag", "a": "key"})
    odd = odd.selectExpr(*odd.columns, "cast(length(text) as bigint) as n_chars", "null as digest", "1 as able", "'d' as doc")
    odd = odd.withColumn("digest", odd["digest"].cast("string"))
    rows = odd
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, str(tmp_path))
        got = [r["doc_id"] for r in rows.collect()]
        if name == "language_id":
            assert not {4, 5, 6, 12} & set(got) and got.count(8) == 2
        elif name == "ngram_join":
            assert got.count(8) == 1 and None in got and 2 not in got and 3 not in got
        if name != "sentencepiece":
            assert rows.columns == odd.columns
    rows = no_docs.selectExpr("*", "0L as n_chars")
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.count() == 0
