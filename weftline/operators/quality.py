"""Data quality: profiles of what tables hold, and checks of keys, references and counts. Checks are exact, over all rows."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.model import Schema


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def null_rates(df: DataFrame, name: str) -> DataFrame:
    """(table, column, n_rows, n_null, null_rate): one pass, all columns at once."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_null")) for i, c in enumerate(df.columns)])
    each = counts.select("n", F.inline(rows))
    return each.select(F.lit(name).alias("table"), "column", F.col("n").alias("n_rows"), "n_null", F.when(F.col("n") > 0, F.col("n_null") / F.col("n")).alias("null_rate"))


def distinct_counts(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """(table, column, n_rows, n_distinct, unique) of every column: one scan, and one shuffle of counts by column and value. Null is no
    value; arrays, maps and structs are told apart by their JSON texts."""
    columns = columns or df.columns
    each = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), as_text(df, c).alias("v")) for i, c in enumerate(columns)])))
    sums = each.groupBy("c", "v").agg(F.count("*").alias("n")).groupBy("c").agg(F.sum("n").alias("n_rows"), F.count("v").alias("n_distinct"))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "c int, column string")
    full = names.join(F.broadcast(sums), "c", "left").select(F.lit(name).alias("table"), "column", *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("n_rows", "n_distinct")])
    return full.withColumn("unique", F.col("n_rows") == F.col("n_distinct"))


def as_text(df: DataFrame, column: str) -> Column:
    kind, value = df.schema[column].dataType.typeName(), F.col("`" + column.replace("`", "``") + "`")
    return F.to_json(value) if kind in ("array", "map", "struct") else F.hex(value) if kind == "binary" else value.cast("string")


def key_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """The values of columns that occur in more than one row, with how often; rows with a null among them are no violation."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.filter(whole).groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


#: Registers of a sketch, as a power of two, and how far an estimate may be off: four standard deviations.
REGISTERS = 12
OFF = 4 * 1.04 / 2 ** (REGISTERS / 2)


#: Of a set's values, told apart by their hashes, the share in which repetitions are looked for before all of them are compared: one in so many.
SLICE = 16


def candidate_keys(df: DataFrame, name: str, most: int = 3) -> DataFrame:
    """(table, columns, n_rows, n_distinct) of the smallest sets of up to most columns that have no null and no repetition.

    One scan sketches every column, a second one all sets that these do not rule out: whose parts are no key, have no null and
    enough values together; then all rows decide on what the sketches leave. Should a set fail there, the sets around it are
    looked at too. Columns of floating point, arrays, maps and structs are no part of keys."""
    usable = [c for c, t in df.dtypes if not t.startswith(("map", "array", "struct", "double", "float"))]
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in usable}
    estimate = lambda columns: F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*[quoted[c] for c in columns]), REGISTERS))
    one = df.agg(F.count("*").alias("n"), *[F.count(quoted[c]) for c in usable], *[estimate([c]) for c in usable]).first()
    n, filled = one[0], dict(zip(usable, one[1:], strict=False))
    values = dict(zip(usable, one[1 + len(usable) :], strict=True))
    whole = [c for c in usable if filled[c] == n]
    near = lambda found: found >= n * (1 - OFF)
    over = lambda sets, columns: any(set(s) <= set(columns) for s in sets)
    waiting = [(c,) for c in whole if n and near(values[c])]
    sets = [x for k in range(2, most + 1) for x in combinations(whole, k) if n and not over(waiting, x) and near(math.prod(values[c] * (1 + OFF) for c in x))]
    if sets:
        found = df.agg(*[estimate(x) for x in sets]).first()
        for x, e in zip(sets, found, strict=True):
            if near(e) and not over(waiting, x):  # smaller sets come first
                waiting.append(x)
    keys: list[tuple[str, ...]] = []
    while waiting:
        failed = repeating(df, waiting)
        keys += [x for x in waiting if x not in failed]
        wider = {tuple(c for c in whole if c in x or c == more) for x in failed if len(x) < most for more in whole if more not in x}
        waiting = sorted(x for x in wider if not over(keys, x))
    keys = [x for x in keys if not any(set(y) < set(x) for y in keys)]
    return df.sparkSession.createDataFrame([(name, ",".join(x), n, n) for x in keys], "table string, columns string, n_rows long, n_distinct long")


def repeating(df: DataFrame, sets: list[tuple[str, ...]]) -> set[tuple[str, ...]]:
    """Those of the sets of columns, without nulls, whose values repeat in some row: exact, over all rows.

    Only a hash of a row's values is shuffled for each set: values without equal hashes do not repeat. A slice of the hashes comes first;
    most sets that repeat do so there, and only the others are shuffled whole. For each set with equal hashes the values behind one
    of them are compared; should they differ, the set's values are counted."""
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for x in sets for c in x}
    hashed = lambda x: F.xxhash64(*[quoted[c] for c in x])
    kinds = dict(df.dtypes)
    plain = [x for x in sets if not any("collate" in kinds[c].lower() for c in x)]  # equal strings of other collations have different hashes
    met: dict[tuple[str, ...], int] = {}
    for inside in (True, False):
        left = [x for x in plain if x not in met]
        if left:
            each = F.array(*[F.struct(F.lit(i).alias("of"), hashed(x).alias("h")) for i, x in enumerate(left)])
            rows = df.select(F.inline(F.filter(each, lambda s: (F.pmod(s["h"], F.lit(SLICE)) == 0) == F.lit(inside))))  # noqa: B023
            # Dealt out before they are counted: next to no row has an equal one in its task, so sums before the shuffle would only fill memory.
            again = rows.repartition("of", "h").groupBy("of", "h").agg(F.count("*").alias("n")).filter("n > 1")
            met |= {left[r["of"]]: r["h"] for r in again.groupBy("of").agg(F.min("h").alias("h")).collect()}
    failed: set[tuple[str, ...]] = set()
    if met:
        behind = [F.when(hashed(x) == h, F.struct(*[quoted[c] for c in x])) for x, h in met.items()]
        some = df.filter(reduce(lambda a, b: a | b, [b.isNotNull() for b in behind]))
        found = some.agg(*[F.count_distinct(b) for b in behind], *[F.count(b) for b in behind]).first()
        failed = {x for i, x in enumerate(met) if found[i] < found[len(met) + i]}
    rest = [x for x in sets if x not in plain or x in met and x not in failed]
    if rest:
        found = df.agg(F.count("*"), *[F.count_distinct(*[quoted[c] for c in x]) for x in rest]).first()
        failed |= {x for i, x in enumerate(rest) if found[1 + i] < found[0]}
    return failed


def domain(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of a column with few values."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("all")))).select("value", "n", (F.col("n") / F.col("all")).alias("share"))


def outside(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """The values of a column that are not allowed, with how often."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the child whose reference the parent lacks; a reference with a null refers to nothing. The parent's keys are made
    distinct first, and the join is by key: skewed children are split by the engine."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    right = parent.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__k{i}") for i, c in enumerate(columns)])
    return child.filter(whole).join(right, on, "left_anti")


def reference_report(tables: dict[str, DataFrame], schema: Schema) -> DataFrame:
    """(child, column, parent, n_rows, n_null, n_orphans) of every declared foreign key whose tables are given.

    Each table is read once, whatever the number of its keys and references: a row gives its value of each, counts of equal values are
    put together before the only shuffle, by reference and value, and meet there the parent's keys, of which only their
    presence goes along. So a parent that very many rows share is one row for each task. Values are compared in the types of the
    parent's keys; a reference with a null among its columns refers to nothing."""
    keys = [(t.name, fk) for t in schema.tables.values() for fk in t.foreign_keys if t.name in tables and fk.table in tables]
    if not keys:
        raise ValueError("no foreign key of these tables")
    entries: dict[str, list[Column]] = {}

    def entry(i: int, columns, kinds, child: int) -> Column:
        """A row's value of a reference or key: whole numbers as such, all else as text; null if any of its columns is."""
        parts = [F.col(c).cast(k) for c, k in zip(columns, kinds, strict=True)]
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        number = len(parts) == 1 and isinstance(kinds[0], (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        text = parts[0].cast("string") if len(parts) == 1 else F.to_json(F.array(*[p.cast("string") for p in parts]))
        none = F.lit(None)
        return F.struct(F.lit(i).alias("fk"), (parts[0] if number else none).cast("long").alias("v"), (none if number else F.when(whole, text)).cast("string").alias("t"), F.lit(child).cast("long").alias("n"))

    for i, (name, fk) in enumerate(keys):
        kinds = [tables[fk.table].schema[r].dataType for r in fk.references]
        entries.setdefault(name, []).append(entry(i, fk.columns, kinds, 1))
        entries.setdefault(fk.table, []).append(entry(i, fk.references, kinds, 0))
    each = union_all([tables[t].select(F.inline(F.array(*own))) for t, own in entries.items()])
    met = each.groupBy("fk", "v", "t").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    null, known = F.col("v").isNull() & F.col("t").isNull(), F.col("least") == 0
    sums = met.groupBy("fk").agg(F.sum("n").alias("n_rows"), F.sum(F.when(null, F.col("n"))).alias("n_null"), F.sum(F.when(~null & ~known, F.col("n"))).alias("n_orphans"))
    names = tables[keys[0][0]].sparkSession.createDataFrame([(i, n, ",".join(fk.columns), fk.table) for i, (n, fk) in enumerate(keys)], "fk int, child string, column string, parent string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return names.join(F.broadcast(sums), "fk", "left").select("child", "column", "parent", zero("n_rows"), zero("n_null"), zero("n_orphans"))


def row_counts(spark: SparkSession, tables: dict[str, DataFrame], expected: dict[str, tuple[int, int]]) -> DataFrame:
    """(table, n_rows, at_least, at_most, ok) against a range for each table."""
    frames = []
    for name, (low, high) in expected.items():
        one = tables[name].agg(F.count("*").alias("n_rows"))
        frames.append(one.select(F.lit(name).alias("table"), "n_rows", F.lit(low).cast("long").alias("at_least"), F.lit(high).cast("long").alias("at_most"), F.col("n_rows").between(low, high).alias("ok")))
    return union_all(frames)


def check_violations(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which a CHECK expression is false; null passes, as in SQL."""
    return df.filter(~F.coalesce(F.expr(expression).cast("boolean"), F.lit(True)))
