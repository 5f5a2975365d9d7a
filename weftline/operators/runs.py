"""Whole runs: an anonymised clone of some tables, and a reset to what a lockfile remembers."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from weftline.operators.anonymize import anonymize, looks_like_production, sample, sensitive_columns
from weftline.operators.generate import generate_tables
from weftline.plans.model import Plan, Schema
from weftline.sources.stores import WriteError, write_tables


@dataclass(frozen=True)
class Cloned:
    """A table of a clone: its rows, and its columns with the generator that replaced each, or None."""

    table: str
    rows: int
    columns: dict[str, str | None]


def clone(spark: SparkSession, tables: dict[str, DataFrame], schema: Schema, path: str, most: int = 1000, seed: int = 42, source: str = "", force: bool = False) -> list[Cloned]:
    """Up to most rows of each table, sensitive columns replaced, as JSON lines under path: all tables or none.

    The rows are the first by a hash of the key, or of the whole row where a table has no key, so they are the same whenever it
    runs. Tables without rows are left out of what is told. A source that looks like production needs force."""
    if looks_like_production(source) and not force:
        raise WriteError(f"{source} looks like production; clone it only by force")
    kinds = {n: sensitive_columns(schema, n) for n in tables}
    made = {n: anonymize(sample(df, list(schema.tables[n].primary_key) or df.columns, most, seed), kinds[n], seed) for n, df in tables.items()}
    counts = write_tables(spark, made, schema, path, "truncate", "json")
    return [Cloned(n, counts[n], {c: kinds[n].get(c) for c in df.columns}) for n, df in tables.items() if counts[n]]


def summary(clones: Iterable[Cloned]) -> str:
    """What a clone has, as text: a line for each table and one for each of its columns."""
    lines = []
    for t in clones:
        replaced = sum(k is not None for k in t.columns.values())
        lines.append(f"{t.table}: {t.rows} rows, {replaced} columns replaced, {len(t.columns) - replaced} kept")
        lines += [f"  {c}: {'replaced by ' + k if k else 'kept'}" for c, k in t.columns.items()]
    return "\n".join(lines)


def reset(spark: SparkSession, plan: Plan, lock: dict | None, path: str, **options) -> dict[str, int]:
    """Generates the plan's tables again with the lockfile's seed, in place of what lies under path."""
    if lock is None:
        raise WriteError("there is no lockfile to reset to")
    plan = replace(plan, seed=lock["seed"])
    return write_tables(spark, generate_tables(spark, plan), plan.schema, path, "truncate", **options)
