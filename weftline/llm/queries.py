"""The numbered queries over the test tables: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bucket_resampling, disclosure, importance, language_id, latent_decontamination, lexical_search, ngram_join, sentencepiece_codec, suffix_dedup, suffix_tree_lm, vector_graphs, virtual_slots, word_graph_dedup

WORDS = r"[^\x20\x09-\x0D]+"
#: Lower-cased words of op11 and op13, and a word's CRC-32, in DuckDB.
TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"
#: SQL for the operators whose results are exact. Others are held against brute force, the library or held-out rows by tests.
ORACLES: dict[str, str] = {
    "op2_vector_graphs": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
pair AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.l > 0 AND b.l > 0 AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.95),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, p.y FROM reach r JOIN pair p ON r.y = p.x)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, r.c AS component_id, r.c = v.vec_id AS kept
FROM v JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = v.vec_id LEFT JOIN (SELECT x, count(*) AS n FROM pair GROUP BY x) c ON c.x = v.vec_id""",
    "op4_ngram_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, text, coalesce(regexp_extract_all(text, '{WORDS}'), []) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
pair AS (SELECT x, y FROM both_ JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE both_.n / (a.n + b.n - both_.n) >= 0.8),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, p.y FROM reach r JOIN pair p ON r.y = p.x)
SELECT d.doc_id, CASE WHEN len(w) > 0 THEN min(d.doc_id) OVER (PARTITION BY text) ELSE d.doc_id END AS text_id, r.c AS class_id, coalesce(l.n, 0) AS n_links, r.c = d.doc_id AS kept
FROM d JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = d.doc_id LEFT JOIN (SELECT x, count(*) AS n FROM pair GROUP BY x) l ON l.x = d.doc_id""",
    "op5_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS e FROM documents),
byte_ AS (SELECT doc_id, e, unnest(range(octet_length(e))) AS p FROM d),
win AS (SELECT doc_id, p, md5(array_slice(e, p + 1, p + 400)) AS k FROM byte_ WHERE octet_length(e) - p >= 400),
again AS (SELECT doc_id, p FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
marked AS (SELECT byte_.doc_id, byte_.p, hex(array_slice(e, byte_.p + 1, byte_.p + 1)) AS b, coalesce(max(again.p) OVER (PARTITION BY byte_.doc_id ORDER BY byte_.p) >= byte_.p - 399, false) AS gone FROM byte_ LEFT JOIN again USING (doc_id, p)),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS head FROM marked),
sums AS (SELECT doc_id, count(*) FILTER (gone) AS r, count(*) FILTER (head) AS s, string_agg(b, '' ORDER BY p) FILTER (NOT gone) AS left_ FROM edge GROUP BY 1)
SELECT doc_id, octet_length(e) AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(s, 0) AS n_spans, sha256(unhex(coalesce(left_, ''))) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id)""",
    "op6_word_graph_dedup": f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORDS}'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS later FROM win),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM ranked, (SELECT unnest(range(20)) AS j) WHERE later),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_lexical_search": f"""
WITH tf AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS w FROM documents) GROUP BY ALL),
long_ AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
all_ AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM long_),
q AS (SELECT item_id, w, count(*) AS c FROM (SELECT item_id, unnest({TERMS}) AS w FROM benchmark) GROUP BY ALL),
weight AS (SELECT w, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, all_ GROUP BY 1),
score AS (SELECT item_id, doc_id, sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // len))))::BIGINT AS score FROM q JOIN tf USING (w) JOIN weight USING (w) JOIN long_ USING (doc_id), all_ GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM score WHERE score > 0) WHERE rank <= 10""",
    "op13_bucket_resampling": f"""
WITH d AS (SELECT doc_id, {TERMS} AS ws FROM documents),
docs AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
item AS (SELECT unnest({TERMS}) AS w FROM benchmark),
word AS (SELECT w, {CRC} % 10000 AS b FROM (SELECT w FROM docs UNION SELECT w FROM item)),
raw AS (SELECT b, sum(c)::BIGINT AS s FROM docs JOIN word USING (w) GROUP BY 1),
target AS (SELECT b, count(*) AS t FROM item JOIN word USING (w) GROUP BY 1),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM raw) + 10000)::DOUBLE / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM target) + 10000)::DOUBLE)))::BIGINT AS gain FROM raw LEFT JOIN target USING (b)),
sums AS (SELECT doc_id, sum(c * gain)::BIGINT AS weight FROM docs JOIN word USING (w) JOIN gain USING (b) GROUP BY 1),
scored AS (SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN sums USING (doc_id)),
nth AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM nth) // 100 THEN rank END AS rank FROM scored LEFT JOIN nth USING (doc_id)""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_vector_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graphs.link(table(spark, sf_dir, "embeddings"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), piece_model()))


def id_crc(n: int) -> Column:
    """The CRC-32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs.filter(id_crc(5) != 0))
    return language_id.predict(docs, net).select("doc_id", (id_crc(5) == 0).alias("held_out"), "lang_pred", "score")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_word_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = word_graph_dedup.remove_earlier(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"), id_crc(7) != 2)


def op8_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digest(disclosure.find_spans(table(spark, sf_dir, "documents")))


def op9_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    return importance.resample(table(spark, sf_dir, "documents"), good, importance.good_share(labels))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual_slots.shard(table(spark, sf_dir, "documents"), 40)


def op13_bucket_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_vector_graphs": op2_vector_graphs,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_ngram_join": op4_ngram_join,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_word_graph_dedup": op6_word_graph_dedup,
    "op7_suffix_tree_lm": op7_suffix_tree_lm,
    "op8_disclosure": op8_disclosure,
    "op9_latent_decontamination": op9_latent_decontamination,
    "op10_importance": op10_importance,
    "op11_lexical_search": op11_lexical_search,
    "op12_virtual_slots": op12_virtual_slots,
    "op13_bucket_resampling": op13_bucket_resampling,
}
