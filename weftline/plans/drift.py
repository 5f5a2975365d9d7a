"""Schema drift: the lockfile that remembers a schema, and what changed since."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.model import Plan, Schema, canonical, config_hash, schema_hash

COLUMN = "table string, column string, type string, nullable boolean, detail string"
CONSTRAINT = "table string, kind string, name string, detail string"


def columns_frame(spark: SparkSession, schema: Schema) -> DataFrame:
    """One row for each column; detail holds all else that the hash covers."""
    rows = []
    for t in schema.tables.values():
        for c in t.columns:
            rows.append((t.name, c.name, c.type, c.nullable, canonical({"enum": sorted(c.enum_values), "primary": c.primary, "unique": c.unique, "default": c.default, "native": c.native, "length": c.max_length, "precision": c.precision, "scale": c.scale})))
    return spark.createDataFrame(rows, COLUMN)


def constraints_frame(spark: SparkSession, schema: Schema) -> DataFrame:
    rows = []
    for t in schema.tables.values():
        rows += [(t.name, "foreign key", ",".join(f.columns), f"{f.table}({','.join(f.references)})") for f in t.foreign_keys]
        rows += [(t.name, "unique", ",".join(sorted(u)), "") for u in t.unique]
        rows += [(t.name, "check", c.name, c.expression) for c in t.checks]
    return spark.createDataFrame(rows, CONSTRAINT)


def diff_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table, column, change, was, now): a full outer join by name. A table that one side lacks is one change, not one for
    each of its columns."""
    a = old.select("table", "column", F.struct("type", "nullable", "detail").alias("o"))
    b = new.select("table", "column", F.struct("type", "nullable", "detail").alias("n"))
    both = a.join(b, ["table", "column"], "full_outer")
    tables = old.select("table").distinct().withColumn("in_old", F.lit(True)).join(new.select("table").distinct().withColumn("in_new", F.lit(True)), "table", "full_outer")
    whole = tables.filter("in_old is null or in_new is null").select("table", F.lit(None).cast("string").alias("column"), F.when(F.col("in_old").isNull(), "table added").otherwise("table removed").alias("change"), F.lit(None).cast("string").alias("was"), F.lit(None).cast("string").alias("now"))
    shared = both.join(tables.filter("in_old and in_new").select("table"), "table", "left_semi")
    change = (
        F.when(F.col("o").isNull(), F.struct(F.lit("column added").alias("change"), F.lit(None).cast("string").alias("was"), F.col("n.type").alias("now")))
        .when(F.col("n").isNull(), F.struct(F.lit("column removed").alias("change"), F.col("o.type").alias("was"), F.lit(None).cast("string").alias("now")))
        .when(F.col("o.type") != F.col("n.type"), F.struct(F.lit("type changed").alias("change"), F.col("o.type").alias("was"), F.col("n.type").alias("now")))
        .when(F.col("o.nullable") != F.col("n.nullable"), F.struct(F.lit("nullability changed").alias("change"), F.col("o.nullable").cast("string").alias("was"), F.col("n.nullable").cast("string").alias("now")))
        .when(F.col("o.detail") != F.col("n.detail"), F.struct(F.lit("details changed").alias("change"), F.col("o.detail").alias("was"), F.col("n.detail").alias("now")))
    )
    return whole.unionByName(shared.withColumn("c", change).filter("c is not null").select("table", "column", "c.*"))


def diff_constraints(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table, kind, name, change, was, now) of foreign keys, unique and CHECK constraints."""
    joined = old.withColumnRenamed("detail", "was").join(new.withColumnRenamed("detail", "now"), ["table", "kind", "name"], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return joined.withColumn("change", change).filter("change is not null").select("table", "kind", "name", "change", "was", "now")


def describe(rows: list) -> str:
    """The differences as text: + added, - removed, ~ changed."""
    sign = lambda c: "+" if "added" in c else "-" if "removed" in c else "~"
    return "\n".join(f"{sign(r['change'])} {r['table']}{'.' + (r['column'] or '') if r['column'] else ''}: {r['change']}" + (f" ({r['was']} -> {r['now']})" if sign(r["change"]) == "~" else "") for r in rows)


def annotations(rows: list, file: str = "weftline.json") -> str:
    """The differences as errors that a build service shows beside the file."""
    # What the service's syntax gives another meaning, and how it is written instead.
    escape = lambda s: s.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    return "\n".join(f"::error file={file},line=1,title=Schema drift: {r['change']}::{escape(describe([r]))}" for r in rows)


@dataclass(frozen=True)
class Drift:
    proceed: bool
    reason: str
    changes: tuple = ()


def make_lock(plan: Plan, config: dict, rows: dict[str, int]) -> dict:
    return {"version": 1, "schemaHash": schema_hash(plan.schema), "configHash": config_hash(config), "seed": plan.seed, "rows": rows, "schema": plan.schema.as_dict(), "acknowledged": []}


def write_lock(path: str, lock: dict) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        json.dump(lock, f, indent=2, sort_keys=True)


def read_lock(path: str) -> dict | None:
    """None where there is no lockfile or it cannot be read."""
    try:
        with open(path) as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


def acknowledge(lock: dict, schema: Schema) -> dict:
    return {**lock, "acknowledged": [*lock.get("acknowledged", []), schema_hash(schema)]}


def check_drift(spark: SparkSession, lock: dict | None, schema: Schema, force: bool = False) -> Drift:
    """Whether to go on: without a lockfile, with an equal or acknowledged schema, or by force; else the changes say why not."""
    if lock is None:
        return Drift(True, "no lockfile")
    now = schema_hash(schema)
    if now == lock["schemaHash"]:
        return Drift(True, "unchanged")
    old = Schema.from_dict(lock["schema"])
    changes = diff_columns(columns_frame(spark, old), columns_frame(spark, schema)).orderBy("table", "column").collect()
    if now in lock.get("acknowledged", []):
        return Drift(True, "acknowledged", tuple(changes))
    return Drift(force, "forced" if force else "changed", tuple(changes))
