"""Writing generated tables, reading snapshots, and bundles that hold both with what made them."""

from __future__ import annotations

import json
import os
import tempfile
import time
import tomllib
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from weftline.plans.graph import build
from weftline.plans.hooks import batchwise, through
from weftline.plans.model import Schema, schema_hash
from weftline.sources.commits import Commit, Files, WriteError, recover

FORMATS = ("parquet", "json", "csv", "orc")


def encoded(df: DataFrame) -> DataFrame:
    """For text formats: structs, maps and arrays as JSON."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("struct", "map", "array")) else F.col(c) for c, t in df.dtypes])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for what a run keeps on the way: in the folder of spark.checkpoint.dir, which executors share; only where none is set,
    as in tests on one machine, a local one."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return f"{set_dir}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_tables(spark: SparkSession, tables: dict[str, DataFrame], schema: Schema, path: str, mode: str = "fresh", kind: str = "parquet", plugins: Sequence = (), progress: Callable[[str, int], bool | None] | None = None, **options) -> dict[str, int]:
    """Writes each table under path, parents first, and returns how many rows each got.

    fresh: an error, before anything is written, if any table has rows; truncate: what is there is replaced; append: adds. All
    tables or none are written: they go to a folder beside and, when all of them are whole, into place by a commit that a lost
    driver cannot leave half done for good: the next write, or recover(spark, path), finishes it. If anything fails, the old tables
    stand as before. Counts come with the write, not from another pass. One writer at a time may use a path.

    Plugins see each table before and after. progress hears of every table and its rows; if it says False, the run ends and
    nothing has changed."""
    if mode not in ("fresh", "truncate", "append") or kind not in FORMATS:
        raise ValueError(f"no mode {mode!r} or format {kind!r}")
    recover(spark, path)
    order = [n for n in build(schema).order if n in tables] + [n for n in tables if n not in schema.tables]
    if mode == "fresh":
        for n in order:
            if exists(spark, f"{path}/{n}") and (count := spark.read.format(kind).load(f"{path}/{n}").count()):
                raise WriteError(f"{n} has {count} rows; use truncate or append")
    counts, files = {}, Files(spark, path)
    commit = Commit(files, path)
    try:
        for n in order:
            seen = Observation(f"rows of {n}")
            df = batchwise(plugins, n, through(plugins, "before_insert", tables[n], n)).observe(seen, F.count(F.lit(1)).alias("n"))
            (encoded(df) if kind == "csv" else df).write.format(kind).options(**options).save(f"{commit.new}/{n}")
            counts[n] = seen.get["n"]
            if progress and progress(n, counts[n]) is False:
                raise WriteError(f"stopped after {n}")
    except BaseException:
        files.delete(commit.beside)
        raise
    commit.finish(order, add=mode == "append")
    for n in order:
        through(plugins, "after_insert", counts[n], n)
    return counts


STAGED = "__new"


def write_jdbc(tables: dict[str, DataFrame], schema: Schema, url: str, mode: str = "append", batch: int = 5000, **options: str) -> dict[str, int]:
    """The same to a database, and how many rows each table got: all tables or none, parents first.

    Executors fill a table of its own, named with __new, beside each; one transaction then empties the tables, if mode is
    truncate, and copies all of them, so that the database does the work and either commits it or not. fresh: an error if a table has
    rows. Tables that are not there are made from the first rows' types. Quotes in names follow the database's own rules."""
    order = [n for n in build(schema).order if n in tables] + [n for n in tables if n not in schema.tables]
    spark = next(iter(tables.values())).sparkSession
    jvm = spark._jvm
    properties = jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    if options.get("driver"):
        jvm.org.apache.spark.util.Utils.classForName(options["driver"], True, False)
    dialect = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
    name = dialect.quoteIdentifier
    there, counts = set(), {}
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        connection.setAutoCommit(False)

        def run(text: str) -> int:
            statement = connection.createStatement()
            try:
                return statement.executeUpdate(text)
            finally:
                statement.close()

        def size(table: str) -> int | None:
            """Rows of a table, None if there is none."""
            statement = connection.createStatement()
            try:
                found = statement.executeQuery(f"SELECT count(*) FROM {name(table)}")
                found.next()
                return found.getLong(1)
            except Exception:
                connection.rollback()
                return None
            finally:
                statement.close()

        for n in order:
            if (rows := size(n)) is not None:
                there.add(n)
                if rows and mode == "fresh":
                    raise WriteError(f"{n} has {rows} rows; use truncate or append")
        connection.commit()
        for n in order:
            target = encoded(tables[n]).write.format("jdbc").options(url=url, dbtable=name(n + STAGED), batchsize=str(batch), **options)
            target.mode("overwrite").save()
            if n not in there:
                encoded(tables[n]).limit(0).write.format("jdbc").options(url=url, dbtable=name(n), **options).save()
        try:
            if mode == "truncate":
                for n in reversed(order):
                    run(f"DELETE FROM {name(n)}")
            for n in order:
                columns = ", ".join(map(name, tables[n].columns))
                counts[n] = run(f"INSERT INTO {name(n)} ({columns}) SELECT {columns} FROM {name(n + STAGED)}")
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
    finally:
        for n in order:
            if size(n + STAGED) is not None:
                run(f"DROP TABLE {name(n + STAGED)}")
        connection.commit()
        connection.close()
    return counts


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old and new rows, of those with the same keys the one with the largest order; of ties the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", "__new")


def patch(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Base with the columns of changes(key, ...) put in where a row of changes has the key."""
    new = [c for c in changes.columns if c != key]
    joined = base.join(changes.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in new]), key, "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in base.columns])


#: Values of the order column whose rows share a running sum.
BLOCK = 1 << 14


def running_rows(batches: DataFrame, order: str, table: str = "table", rows: str = "rows") -> DataFrame:
    """Progress: the rows written of each table after each batch; order is the number of a batch.

    Sums by table and block of numbers are few and taken before the shuffle; a block starts with the sum of those before it, and
    only within a block is a running sum taken. So a table with very many batches is no one task's work."""
    blocked = batches.withColumn("__block", F.floor(F.col(order) / BLOCK))
    sums = blocked.groupBy(F.col(table).alias("__of"), F.col("__block").alias("__at")).agg(F.sum(rows).alias("__sum"))
    starts = sums.withColumn("__from", F.sum("__sum").over(Window.partitionBy("__of").orderBy("__at")) - F.col("__sum"))
    within = Window.partitionBy(table, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = blocked.join(starts, F.col(table).eqNullSafe(F.col("__of")) & (F.col("__block") == F.col("__at")))
    return placed.withColumn("written", F.col("__from") + F.sum(rows).over(within)).drop("__block", "__of", "__at", "__sum", "__from")


@dataclass(frozen=True)
class Import:
    ok: bool
    warnings: tuple[str, ...]
    missing: tuple[str, ...]


def fingerprint(df: DataFrame) -> list[Column]:
    """Aggregates that tell whether two tables hold the same rows, in whatever order and partitions: their number and two
    combinations of the rows' hashes."""
    row = F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in sorted(df.columns)])
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("s")]


def as_print(found: dict) -> list:
    return [found["n"], found["x"] or 0, found["s"] or 0]


def export_bundle(spark: SparkSession, path: str, schema: Schema, config: dict, lock: dict, tables: dict[str, DataFrame] | None = None, kind: str = "parquet", snapshot: bool = True) -> None:
    """A folder with manifest, configuration and lockfile, and with tables their rows: Parquet, or gzipped JSON lines. Without
    snapshot only what tells the tables' rows apart is kept of them, and import makes them again from configuration and seed."""
    prints = {}
    if not (snapshot and tables) and functions_in(config):
        raise WriteError("a configuration with functions cannot be kept to make the rows again; keep the rows")
    for n, df in (tables or {}).items():
        if snapshot:
            seen = Observation(f"rows of {n}")
            writer = df.observe(seen, *fingerprint(df)).write.mode("overwrite")
            (writer.option("compression", "gzip").json if kind == "json" else writer.parquet)(f"{path}/data/{n}")
            prints[n] = as_print(seen.get)
        else:
            prints[n] = as_print(df.agg(*fingerprint(df)).first().asDict())
    manifest = {"version": 1, "schemaHash": schema_hash(schema), "tables": list(schema.tables), "rows": {n: x[0] for n, x in prints.items()}, "prints": prints, "snapshot": bool(tables) and snapshot, "format": kind, "schema": schema.as_dict()}
    for name, value in (("manifest", manifest), ("config", config), ("lockfile", lock)):
        spark.createDataFrame([(json.dumps(value, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def functions_in(value) -> bool:
    if isinstance(value, dict):
        value = list(value.values())
    return any(map(functions_in, value)) if isinstance(value, (list, tuple)) else callable(value)


def replay(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a bundle made again: the plan from its schema and configuration, the seed from its lockfile."""
    from weftline.operators.generate import generate_tables
    from weftline.plans.build import build_plan

    config, lock = read_part(spark, path, "config"), read_part(spark, path, "lockfile")
    schema = Schema.from_dict(read_part(spark, path, "manifest")["schema"])
    plan = build_plan(schema, {**config, "seed": lock["seed"]})
    return generate_tables(spark, plan)


def differing(tables: dict[str, DataFrame], prints: dict[str, list]) -> list[str]:
    """The tables that are missing or do not hold the rows that a bundle's prints stand for."""
    return [n for n, p in prints.items() if n not in tables or as_print(tables[n].agg(*fingerprint(tables[n])).first().asDict()) != p]


def read_part(spark: SparkSession, path: str, name: str) -> dict:
    return json.loads(spark.read.text(f"{path}/{name}", wholetext=True).first()["value"])


def check_import(manifest: dict, schema: Schema, force: bool = False) -> Import:
    """A table that the target lacks blocks, even by force; a different schema hash only warns, and blocks nothing by force."""
    missing = tuple(sorted(set(manifest["tables"]) - set(schema.tables)))
    changed = manifest["schemaHash"] != schema_hash(schema)
    return Import(not missing and (force or not changed), ("the schema has changed since the export",) if changed else (), missing)


def import_bundle(spark: SparkSession, path: str, schema: Schema, force: bool = False, verify: bool = True) -> dict[str, DataFrame]:
    """The rows of a bundle's tables, with the types that the bundle's schema says; if it has none, the tables are made again from its
    configuration and seed. verify compares every table's rows with those that were exported."""
    manifest = read_part(spark, path, "manifest")
    found = check_import(manifest, schema, force)
    if not found.ok:
        raise WriteError(f"cannot import: {', '.join(found.missing) or found.warnings[0]}")
    if manifest["snapshot"]:
        out = {}
        for n in manifest["rows"]:
            if manifest["format"] == "json":
                fields = ", ".join(f"`{c.name}` {c.spark_type.simpleString()}" for c in Schema.from_dict(manifest["schema"]).tables[n].columns)
                out[n] = spark.read.schema(fields).json(f"{path}/data/{n}")
            else:
                out[n] = spark.read.parquet(f"{path}/data/{n}")
    else:
        out = replay(spark, path)
    if verify and (wrong := differing(out, manifest.get("prints", {}))):
        raise WriteError(f"other rows than were exported: {', '.join(wrong)}")
    return out


def bundles(spark: SparkSession, root: str) -> DataFrame:
    """(name, version, created) of the bundles under root/name/version, of each name the last version first, as texts sort."""
    found = spark.read.text(f"{root}/*/*/manifest", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("created"))
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)/manifest/[^/]+$", i)
    return found.select(part(1).alias("name"), part(2).alias("version"), "created").orderBy("name", F.desc("version"))


#: What an address begins with, and the dialect that it says.
DIALECTS = {"postgres": ("postgres://", "postgresql://", "jdbc:postgresql:"), "mysql": ("mysql://", "mysql2://", "jdbc:mysql:"), "documents": ("mongodb://", "mongodb+srv://"), "sqlite": ("sqlite:", "jdbc:sqlite:"), "jdbc": ("jdbc:",)}


def dialect_of(address: str) -> str:
    """The dialect of a database's address, or of a file's; files where nothing says another."""
    found = next((d for d, starts in DIALECTS.items() if address.startswith(starts)), None)
    return found or ("sqlite" if address.endswith((".sqlite", ".db")) else "files")


def load_config(path: str) -> dict:
    """A configuration in JSON or TOML; none where there is no file. WEFTLINE_SEED, WEFTLINE_URL and WEFTLINE_DIALECT override its seed
    and where it connects to."""
    config = {}
    if os.path.exists(path):
        with open(path, "rb") as f:
            config = tomllib.load(f) if path.endswith(".toml") else json.load(f)
    if url := os.environ.get("WEFTLINE_URL"):
        config = {**config, "url": url}
    if seed := os.environ.get("WEFTLINE_SEED"):
        config = {**config, "seed": int(seed) if seed.lstrip("-").isdigit() else seed}
    return config


def connection(config: dict) -> dict:
    """Where to connect: address, dialect (by the address where none is named) and database, if there is one."""
    own = config.get("connection", {})
    url = config.get("url") or own.get("url")
    dialect = os.environ.get("WEFTLINE_DIALECT") or own.get("dialect") or dialect_of(url or "")
    return {k: v for k, v in (("dialect", dialect), ("url", url), ("database", own.get("database"))) if v}


class Tap:
    """Hears of a write's tables: give it as a plugin and its progress. seen[table] has began and ended (seconds since the epoch) and rows."""

    name = "tap"

    def __init__(self):
        self.seen: dict[str, dict] = {}

    def before_insert(self, table: str, rows: DataFrame) -> None:
        self.seen[table] = {"began": time.time(), "ended": None, "rows": None}

    def progress(self, table: str, rows: int) -> None:
        self.seen[table] |= {"ended": time.time(), "rows": rows}

    def rates(self) -> dict[str, float]:
        """Rows a second by table."""
        return {n: x["rows"] / max(x["ended"] - x["began"], 1e-9) for n, x in self.seen.items() if x["ended"]}
