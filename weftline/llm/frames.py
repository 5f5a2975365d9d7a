"""What the operators share on the side of Spark: lineage cuts in the shared folder, Arrow maps, components of link tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where none is set, as in tests on one machine, a local folder is made."""
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        set_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not set_dir:
        set_dir = sc.getCheckpointDir()
    if not set_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="weftline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(set_dir)
    return set_dir


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: a short lineage that lost executors cannot take away.

    What was shuffled for it is no longer needed and goes at once; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def cut_rows(df: DataFrame) -> DataFrame:
    """cut, with the place of each row: file (in the order of the tasks that wrote them) and row (its number in the file).

    The places stay the same however often and in whatever splits the table is read."""
    part = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).cast("long")
    file = part(r"^part-(\d+)") * 100_000 + part(r"-c(\d+)")
    return cut(df).select("*", file.alias("file"), F.col("_metadata.row_index").alias("row"))


def ascii_words(text: Column) -> Column:
    """The runs of letters, digits and characters beyond ASCII of a text, with only A-Z lower-cased; none for null.

    Words of ASCII alone are lower-cased as a whole, others letter by letter, since lower() knows more letters than A-Z."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, upper, upper.lower())))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], schema: str) -> DataFrame:
    """mapInArrow over batches; fn returns columns by name, or yields several such sets."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            for columns in [out] if isinstance(out, dict) else out or ():
                yield pa.RecordBatch.from_arrays([as_arrow(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def lists(values, lengths) -> pa.Array:
    """An Arrow list column from flat values and each row's length."""
    import numpy as np

    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that clashing extra columns cannot disturb it."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])


#: Labels that a task of a round writes.
LABELS = 250_000


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(id, component) for every id of links(a, b): the smallest id that links reach.

    Each round hands every id the smallest label of its neighbours and then the label of its label, so that chains halve.
    Labels are aggregated before the shuffle, so that an id with very many links costs one row for each task. Every round's
    labels are written to the shared folder, dealt anew to a task for each LABELS of them, as a round of small files costs more
    than its rows. Ends when a round changes nothing; links that lead to themselves are allowed."""
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    tasks = 1 + labels.count() // LABELS
    for _ in range(most):
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(near, labels.id == near.a, "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("up"), F.col("label").alias("top"))
        nxt = cut(own.join(up, own.label == up.up, "left").select("id", F.coalesce("top", "label").alias("label"), (F.coalesce("top", "label") < F.col("old")).alias("moved")).repartition(tasks))
        labels = nxt.select("id", "label")
        if nxt.filter("moved").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def named_components(links: DataFrame, names: DataFrame) -> DataFrame:
    """(id, component, name) for every id of links(a, b): name is the smallest of the names(id, name) in its component."""
    of = components(links)
    named = cut(of.join(names, "id"))
    return named.select("id", "component").join(named.groupBy("component").agg(F.min("name").alias("name")), "component").select("id", "component", "name")
