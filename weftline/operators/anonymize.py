"""Anonymised clones: sensitive columns are replaced by generated values, keys and the rest stay."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.generators import Context, generate
from weftline.functions.rng import stream
from weftline.plans.model import Schema
from weftline.plans.semantic import analyze

# Meanings of columns that say something about a person, and hints at a database in production.
SENSITIVE = {"email", "phone", "firstName", "lastName", "fullName", "street", "city", "state", "zip", "country", "ip", "url", "image", "longText", "latitude", "longitude"}
PRODUCTION = [r"(?<![a-z])prod(uction)?(?![a-z])", r"\blive\b", r"rds\.amazonaws", r"\.azure\.", r"cloudsql"]


def looks_like_production(address: str) -> bool:
    return any(re.search(p, address, re.I) for p in PRODUCTION)


def sensitive_columns(schema: Schema, table: str) -> dict[str, str]:
    """Column to generator kind of the columns to replace; keys and foreign keys never are."""
    t = schema.tables[table]
    kept = set(t.primary_key) | {c for fk in t.foreign_keys for c in fk.columns}
    return {m.column: m.field.kind for m in analyze(schema) if m.table == table and m.meaning in SENSITIVE and m.column not in kept}


def anonymize(df: DataFrame, replace: dict[str, str], seed: int, reference_ms: int = 1_720_000_000_000) -> DataFrame:
    """Each value of a column to replace becomes one that its kind generates from a stream named by the value itself: equal
    values stay equal, also across tables, and nulls stay null. No rows are matched or moved."""
    def new(column: str, kind: str):
        value = generate(kind, {}, stream(str(seed), "__anonymize__", kind, F.sha2(F.col(column).cast("string"), 256)), Context(reference_ms))
        return F.when(F.col(column).isNotNull(), value.cast(df.schema[column].dataType))

    return df.withColumns({c: new(c, k) for c, k in replace.items()})


def sample(df: DataFrame, key: str | list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash of key and seed: the same rows whenever it runs, by a top-n of each task. A key of several
    columns may hold nulls, structs, maps and arrays."""
    kinds = dict(df.dtypes)
    texts = [F.to_json(c) if kinds[c].startswith(("struct", "map", "array")) else F.col(c).cast("string") for c in ([key] if isinstance(key, str) else key)]
    ties = [F.col(key)] if isinstance(key, str) else texts
    return df.orderBy(F.md5(F.concat_ws(":", *texts, F.lit(str(seed)))), *ties).limit(n)
