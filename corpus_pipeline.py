"""A corpus pipeline of five stages; each stage's rows are written and read again before the next.

Languages are identified and texts without one go; of texts that are near copies of each other one stays; texts that hold
benchmark items go; personal data and what discloses it is replaced; what is left is encoded. No stage drops anything else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import disclosure, language_id, latent_decontamination, ngram_join, queries, sentencepiece_codec
from weftline.llm.frames import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose best language has less than a third of the probability."""
    net = language_id.fit(docs.filter(queries.id_crc(5) != 0))
    return language_id.accepted(docs, net, least=1 / 3)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, with the smallest id, of each class of texts that links of five-word Jaccard similarity 0.8 connect."""
    return ngram_join.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that contain a benchmark item."""
    return latent_decontamination.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and disclosing terms in every text."""
    return disclosure.sanitise(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the hashes of ids and decoded text of every document."""
    coded = sentencepiece_codec.encode_decode(docs, queries.piece_model())
    return sentencepiece_codec.digest(coded, "ids")


STAGES = [("language_id", identify_language), ("ngram_join", join_near_copies), ("decontamination", decontaminate), ("pii", sanitise), ("sentencepiece", encode)]

#: Trained and approximate stages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table.

    Rows are handled by their own text, also where ids repeat or are null: a null, empty or letterless text goes in the first
    stage; of rows that repeat id and text one stays, of rows that repeat an id with other texts each that is the first of its
    class; rows with a null id are compared with nothing and stay unless they have no language or hold a benchmark item. Other
    columns of docs pass through the stages before the last, whatever their names and nulls. Very long texts pass every stage as a whole.
    An empty table gives no rows, with the same columns."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
