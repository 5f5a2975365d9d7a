"""The graph of foreign keys: edges, insertion order, cycles and levels, and keys found by inclusion."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.model import Schema, Table


@dataclass(frozen=True)
class Edge:
    child: str
    parent: str
    columns: tuple[str, ...]
    kind: str
    via: str | None = None


@dataclass(frozen=True)
class Graph:
    edges: tuple[Edge, ...]
    order: tuple[str, ...]
    levels: tuple[tuple[str, ...], ...]
    cycles: tuple[tuple[str, ...], ...]


def edges_of(table: Table) -> list[Edge]:
    """One for each foreign key: self-referential, one-to-one if the key is unique, else one-to-many."""
    kind = lambda fk: "self-referential" if fk.table == table.name else "one-to-one" if table.has_unique(fk.columns) else "one-to-many"
    return [Edge(table.name, fk.table, fk.columns, kind(fk)) for fk in table.foreign_keys]


STAMPS = {"created_at", "updated_at", "createdat", "updatedat"}


def is_junction(table: Table) -> bool:
    """Two foreign keys that together are the key or unique, and nothing else but times of creation and change."""
    if len(table.foreign_keys) != 2 or any(fk.table == table.name for fk in table.foreign_keys):
        return False
    columns = {c for fk in table.foreign_keys for c in fk.columns}
    others = {c.name for c in table.columns} - columns
    surrogate = {c for c in others if table.column(c).primary and table.primary_key == (c,)} if any(set(u) == columns for u in table.unique) else set()
    return table.has_unique(columns) and all(c.lower() in STAMPS for c in others - surrogate)


def build(schema: Schema) -> Graph:
    """Edges with junctions merged to many-to-many; a topological order, first in, first out, over known tables; levels of
    tables whose parents are all on earlier ones; cycles, a self-reference being one of one table. Tables on or behind a
    cycle of several tables are in no order."""
    tables = schema.tables
    edges: list[Edge] = []
    for t in tables.values():
        own = edges_of(t)
        if is_junction(t):
            first, second = own
            edges.append(Edge(first.parent, second.parent, first.columns + second.columns, "many-to-many", t.name))
        else:
            edges += own
    needs = {t.name: {fk.table for fk in t.foreign_keys if fk.table in tables and fk.table != t.name} for t in tables.values()}
    order: list[str] = []
    levels: list[tuple[str, ...]] = []
    left = dict(needs)
    while ready := [n for n, parents in left.items() if parents <= set(order)]:
        levels.append(tuple(ready))
        order += ready
        left = {n: p for n, p in left.items() if n not in ready}
    cycles = [(t.name,) for t in tables.values() if any(fk.table == t.name for fk in t.foreign_keys)]
    return Graph(tuple(edges), tuple(order), tuple(levels), tuple(cycles + find_cycles(left)))


def find_cycles(needs: dict[str, set[str]]) -> list[tuple[str, ...]]:
    """One cycle for each edge that closes one, walking depth first from each table in turn."""
    state: dict[str, int] = {}
    path: list[str] = []
    found: list[tuple[str, ...]] = []

    def walk(name: str) -> None:
        state[name] = 1
        path.append(name)
        for parent in sorted(needs[name] & needs.keys()):
            if state.get(parent) == 1:
                found.append(tuple(path[path.index(parent) :]))
            elif parent not in state:
                walk(parent)
        path.pop()
        state[name] = 2

    for name in needs:
        if name not in state:
            walk(name)
    return found


NAMED = re.compile(r"^(.+?)(Id|_id|Ref|_ref|_key|key)$")


def plural(word: str) -> str:
    if re.search(r"[^aeiou]y$", word):
        return word[:-1] + "ies"
    return word + ("es" if re.search(r"(s|x|z|ch|sh)$", word) else "s")


def target_of(column: str, tables: list[str]) -> str | None:
    """The table that a column's name points to, in the singular or plural."""
    m = NAMED.match(column)
    if not m:
        return None
    stem = m[1].rsplit(".", 1)[-1].lower()
    names = {t.lower(): t for t in tables}
    return next((names[n] for n in (stem, plural(stem), stem.removesuffix("s")) if n in names), None)


def leaves(shape: T.DataType, at: str = "") -> list[str]:
    """The paths of all fields, [] behind an array of objects; a {"$oid"} or {"$date"} is one value."""
    if isinstance(shape, T.ArrayType) and isinstance(shape.elementType, T.StructType):
        return leaves(shape.elementType, f"{at}[]")
    if isinstance(shape, T.StructType) and not wrapped(shape):
        return [x for f in shape.fields for x in leaves(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return [at]


def wrapped(shape: T.DataType) -> bool:
    return isinstance(shape, T.StructType) and shape.names in (["$oid"], ["$date"])


def at_path(df: DataFrame, path: str) -> tuple[Column, T.DataType]:
    """The value at a dotted path and its type. Behind an array it is the array of all values; a column whose name is the whole
    path comes first."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    if path in df.columns:
        return unwrap(quoted(path), df.schema[path].dataType)
    first, *rest = path.replace("[]", "").split(".")
    value, kind = quoted(first), df.schema[first].dataType
    for part in rest:
        many = isinstance(kind, T.ArrayType)
        inner = (kind.elementType if many else kind)[part].dataType
        value = value.getField(part)
        value, kind = (F.flatten(F.array_compact(value)), inner) if many and isinstance(inner, T.ArrayType) else (value, T.ArrayType(inner) if many else inner)
    return unwrap(value, kind)


def unwrap(value: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if not wrapped(inner):
        return value, kind
    plain = inner.fields[0].dataType
    return value.getField(inner.names[0]), T.ArrayType(plain) if isinstance(kind, T.ArrayType) else plain


def distinct_at(df: DataFrame, path: str) -> tuple[DataFrame, T.DataType]:
    """The distinct values at a path as column v, without null, and their type; an array stands for its elements, an object for its
    JSON text."""
    value, kind = at_path(df, path)
    if isinstance(kind, T.ArrayType):
        value, kind = F.explode(value), kind.elementType
    out = df.select(value.alias("v"))
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        out, kind = out.select(F.to_json("v").alias("v")), T.StringType()
    return out.filter("v is not null").distinct(), kind


def inclusion(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """(n_distinct, n_found, ratio): how many of the child's distinct values the parent's key has. Both sides are made
    distinct before they meet, so a value that very many rows share is one row. Both may be paths into objects and arrays; values
    of different types are compared as texts."""
    values, a = distinct_at(child, column)
    keys, b = distinct_at(parent, key)
    if a != b and not all(isinstance(x, T.NumericType) for x in (a, b)):
        values, keys = (df.select(F.col("v").cast("string").alias("v")) for df in (values, keys))
    keys = keys.withColumnRenamed("v", "k")
    joined = values.join(keys, values.v == keys.k, "left").agg(F.count("*").alias("n_distinct"), F.count("k").alias("n_found"))
    return joined.withColumn("ratio", F.when(F.col("n_distinct") > 0, F.col("n_found") / F.col("n_distinct")))


def inferred_keys(tables: dict[str, DataFrame], keys: dict[str, str], least: float = 0.8) -> DataFrame:
    """(child, column, parent, key, n_distinct, n_found, ratio) of columns whose names point to a table and whose values lie
    in its key to the share least or more."""
    out = None
    for name, df in tables.items():
        for column in leaves(df.schema):
            parent = target_of(column, [t for t in tables if t in keys])
            if parent and (parent, keys[parent]) != (name, column):
                one = inclusion(df, column, tables[parent], keys[parent]).select(F.lit(name).alias("child"), F.lit(column).alias("column"), F.lit(parent).alias("parent"), F.lit(keys[parent]).alias("key"), "n_distinct", "n_found", "ratio")
                out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no column's name points to a table")
    return out.filter(F.col("ratio") >= least)


#: Columns whose membership one number holds.
WIDTH = 62
#: What values are compared as: whole numbers, or texts.
KINDS = {"bigint": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "string": (T.StringType,)}


def inclusions(tables: dict[str, DataFrame], least: float = 1.0) -> DataFrame:
    """(child, column, parent, key, n_distinct, n_found, ratio) of all pairs of columns, of whole numbers or of texts, of which the second
    holds the share least or more of the first's distinct values; nulls are no values, and a column without values is in no pair.

    All pairs at once: each table is read once, and each value is shuffled once, with the set of columns that hold it, put together
    before and after the shuffle, so that frequent values weigh nothing. Values with the same set are counted; from then on
    there are only as many rows as different sets."""
    out = [of_kind(tables, kind, types, least) for kind, types in KINDS.items()]
    out = [x for x in out if x is not None]
    if not out:
        raise ValueError("no table has a column of whole numbers or texts")
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def of_kind(tables: dict[str, DataFrame], kind: str, types: tuple, least: float) -> DataFrame | None:
    columns = [(t, f.name) for t, df in tables.items() for f in df.schema.fields if isinstance(f.dataType, types)]
    if not columns:
        return None
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    values = None
    for t, df in tables.items():
        own = [F.struct(quoted(c).cast(kind).alias("v"), F.lit(i).alias("c")) for i, (name, c) in enumerate(columns) if name == t]
        if own:
            each = df.select(F.inline(F.array(*own)))
            values = each if values is None else values.unionByName(each)
    spark, masks = values.sparkSession, [f"m{w}" for w in range(1 + (len(columns) - 1) // WIDTH)]
    bit = lambda w: F.bit_or(F.when(F.floor(F.col("c") / WIDTH) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("c") % WIDTH)).otherwise(F.lit(0).cast("long")))
    sets = values.filter("v is not null").groupBy("v").agg(*[bit(w).alias(m) for w, m in enumerate(masks)]).groupBy(*masks).agg(F.count("*").alias("n"))

    def members(w: int) -> Column:
        numbers = F.sequence(F.lit(w * WIDTH), F.lit(min(len(columns), (w + 1) * WIDTH) - 1))
        return F.filter(numbers, lambda i: F.call_function("shiftright", F.col(masks[w]), i % WIDTH).bitwiseAND(1) == 1)

    both = sets.select("n", F.flatten(F.array(*map(members, range(len(masks))))).alias("in")).select("n", "in", F.explode("in").alias("a")).select("n", "a", F.explode("in").alias("b"))
    shared = both.groupBy("a", "b").agg(F.sum("n").alias("n"))
    names = F.broadcast(spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(columns)], "i int, table string, name string"))  # the schema's columns
    sizes = F.broadcast(shared.filter("a = b").select(F.col("a").alias("of"), F.col("n").alias("n_distinct")))
    pairs = shared.filter("a <> b").join(sizes, F.col("a") == F.col("of")).withColumn("ratio", F.col("n") / F.col("n_distinct")).filter(F.col("ratio") >= least)
    named = pairs.join(names.select(F.col("i").alias("a"), F.col("table").alias("child"), F.col("name").alias("column")), "a").join(names.select(F.col("i").alias("b"), F.col("table").alias("parent"), F.col("name").alias("key")), "b")
    return named.select("child", "column", "parent", "key", "n_distinct", F.col("n").alias("n_found"), "ratio")
