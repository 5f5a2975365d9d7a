"""What JSON documents hold: the types of every path by count, and one type for each path."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types that a wider one holds, each with the wider ones.
WIDER = {"integer": ("float", "string"), "float": ("string",), "uuid": ("string",), "timestamp": ("string",), "boolean": ("string",)}
#: Levels of nesting that are followed.
DEPTH = 32


def kind_of(value: Column) -> Column:
    """The type of a variant; an object of $oid or $date alone is one value."""
    shape = F.schema_of_variant(value)
    is_ = shape.rlike
    kinds = [(r"^OBJECT<`?\$oid`?: \w+>$", "uuid"), (r"^OBJECT<`?\$date`?: \w+>$", "timestamp"), ("^OBJECT", "object"), ("^ARRAY", "array"), ("^BIGINT", "integer"), (r"^DECIMAL\(\d+,0\)", "integer"), ("^(DECIMAL|DOUBLE|FLOAT)", "float"), ("^BOOLEAN", "boolean"), ("^VOID", "null")]
    out = F.lit("string")
    for pattern, kind in reversed(kinds):
        out = F.when(is_(pattern), kind).otherwise(out)
    return out


def path_types(docs: DataFrame, column: str = "value") -> list[tuple[str, str, int]]:
    """(path, type, number of values) of every path and type of JSON texts; elements of arrays lie at the array's path with []. Levels of
    nesting are counted by the cluster, one after the other; what comes to the driver has the size of a schema."""
    level = docs.select(F.lit("").alias("path"), F.parse_json(F.col(column)).alias("v")).filter("v is not null")
    found = []
    for depth in range(DEPTH):
        typed = level.withColumn("kind", kind_of(F.col("v")))
        counts = typed.groupBy("path", "kind").agg(F.count("*").alias("n")).collect()
        found += [(r["path"], r["kind"], r["n"]) for r in counts if depth]
        if not any(r["kind"] in ("object", "array") for r in counts):
            break
        inner = typed.filter("kind in ('object', 'array')").lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("v").outer()))
        name = F.when(F.col("kind") == "array", F.lit("[]")).when(F.col("path") == "", F.col("key")).otherwise(F.concat(F.lit("."), F.col("key")))
        level = inner.select(F.concat("path", name).alias("path"), F.col("value").alias("v"))
    return found


def merged(types: set[str]) -> str | None:
    """The smallest type that holds all of them; nulls are held by any, and nothing but text holds what only texts have in common."""
    types = types - {"null"}
    if len(types) <= 1:
        return next(iter(types), "string")
    for wide in ("float", "string"):
        if all(t == wide or wide in WIDER.get(t, ()) for t in types):
            return wide
    return None


def folded(found: list[tuple[str, str, int]]) -> list[dict]:
    """For each path its values, the type of most of them, the type that holds all, and whether they are in conflict: then their
    type is the texts' if all are plain values, and otherwise one JSON value's, whose inside is looked at no further."""
    by: dict[str, dict[str, int]] = defaultdict(dict)
    for path, kind, n in found:
        by[path][kind] = n
    out, closed = [], []
    for path in sorted(by):
        counts = by[path]
        if any(path.startswith((p + ".", p + "[]")) for p in closed):
            continue
        most = max(counts, key=lambda k: (k != "null", counts[k], k))
        kind = merged(set(counts))
        plain = not {"object", "array"} & set(counts)
        if kind is None:
            kind = "string" if plain else "json"
            closed += [] if plain else [path]
        conflict = len(set(counts) - {"null"}) > 1 and (kind == "json" or kind == "string")
        out.append({"path": path, "n": sum(counts.values()), "majority": most, "share": counts[most] / sum(counts.values()), "type": kind, "conflict": conflict})
    return out


def document_types(docs: DataFrame, column: str = "value") -> DataFrame:
    """(path, n, majority, share, type, conflict) of JSON texts."""
    rows = [tuple(x.values()) for x in folded(path_types(docs, column))]
    return docs.sparkSession.createDataFrame(rows, "path string, n long, majority string, share double, type string, conflict boolean")


def leaves_of(found: list[tuple[str, str, int]]) -> list[tuple[str, str]]:
    """(path, type) of the columns of a table of such documents: objects are their fields, arrays of objects their elements' fields."""
    types = {x["path"]: x["type"] for x in folded(found)}
    return sorted((p, t) for p, t in types.items() if t != "object" and not p.endswith("[]") and not (t == "array" and types.get(p + "[]") == "object"))
