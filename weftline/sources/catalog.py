"""Schemas from where data lies: files, databases over JDBC, SQLite files and documents. A registry names the sources."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.model import Check, Column, ForeignKey, Schema, Table
from weftline.sources.documents import leaves_of, path_types

SOURCES: dict[str, Callable[..., Schema]] = {}
TYPES = {"string": "string", "bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "float", "float": "float", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "binary": "binary"}
# Logical types by the first word of a database's type name.
NATIVE = {
    "integer": "int integer smallint bigint tinyint mediumint int2 int4 int8 serial bigserial smallserial oid year".split(),
    "float": "real double float float4 float8 numeric decimal money dec".split(),
    "boolean": "bool boolean bit".split(),
    "date": ["date"],
    "timestamp": "timestamp timestamptz datetime".split(),
    "uuid": ["uuid"],
    "json": "json jsonb".split(),
    "binary": "bytea blob binary varbinary tinyblob mediumblob longblob".split(),
    "array": ["array"],
}


def source(name: str):
    def add(fn):
        SOURCES[name] = fn
        return fn

    return add


def introspect(dialect: str, *args, **kwargs) -> Schema:
    if dialect not in SOURCES:
        raise ValueError(f"no source named {dialect!r}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[dialect](*args, **kwargs)


def logical_type(native: str) -> str:
    """The logical type of a database's type name, string if it is none known; tinyint(1) is a boolean."""
    name = native.strip().lower()
    if name.startswith("tinyint(1)"):
        return "boolean"
    if name.endswith("[]"):
        return "array"
    if name.startswith("enum"):
        return "enum"
    word = re.split(r"[\s(]", name)[0]
    return next((t for t, names in NATIVE.items() if word in names), "string")


def enum_values(native: str) -> tuple[str, ...]:
    """The values of an ENUM('a','b'); a doubled quote is a quote."""
    return tuple(v.replace("''", "'") for v in re.findall(r"'((?:[^']|'')*)'", native))


@source("files")
def from_frames(tables: dict[str, DataFrame], declared: dict[str, dict] | None = None) -> Schema:
    """Columns by the frames' types; keys, references and checks as declared, since files keep none."""
    out = []
    for name, df in tables.items():
        own = (declared or {}).get(name, {})
        key = tuple(own.get("primary_key", ()))
        columns = []
        for f in df.schema.fields:
            kind = f.dataType.simpleString()
            logical = "array" if kind.startswith("array") else "float" if kind.startswith("decimal") else TYPES.get(kind, "json")
            d = f.dataType if isinstance(f.dataType, T.DecimalType) else None
            columns.append(Column(f.name, logical, kind, f.nullable and f.name not in key, f.name in key, key == (f.name,), precision=d.precision if d else None, scale=d.scale if d else None))
        keys = tuple(ForeignKey((c,), t, (r,)) for c, (t, r) in own.get("foreign_keys", {}).items())
        out.append(Table(name, tuple(columns), key, keys, tuple(map(tuple, own.get("unique", ()))), tuple(Check(n, e) for n, e in own.get("checks", {}).items())))
    return Schema.of(*out)


@source("sqlite")
def from_sqlite(path: str) -> Schema:
    """Tables of an SQLite file by its own catalogue."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        out = []
        for name, ddl in db.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name"):
            info = db.execute(f'PRAGMA table_info("{name}")').fetchall()
            key = tuple(r[1] for r in sorted((r for r in info if r[5]), key=lambda r: r[5]))
            unique = []
            for index in db.execute(f'PRAGMA index_list("{name}")').fetchall():
                if index[2] and index[3] == "u":
                    unique.append(tuple(r[2] for r in db.execute(f'PRAGMA index_info("{index[1]}")')))
            groups: dict[int, list] = {}
            for r in db.execute(f'PRAGMA foreign_key_list("{name}")'):
                groups.setdefault(r[0], []).append(r)
            action = lambda a: None if a == "NO ACTION" else a
            keys = tuple(ForeignKey(tuple(r[3] for r in sorted(g, key=lambda r: r[1])), g[0][2], tuple(r[4] or r[3] for r in sorted(g, key=lambda r: r[1])), action(g[0][6]), action(g[0][5])) for _, g in sorted(groups.items()))
            checks = tuple(Check(n or f"check_{i}", e) for i, (n, e) in enumerate(ddl_checks(ddl or "")))
            columns = tuple(Column(r[1], logical_type(r[2]), r[2], not r[3] and not r[5], bool(r[5]), (r[1],) in unique or key == (r[1],), r[4]) for r in info)
            out.append(Table(name, columns, key, keys, tuple(unique), checks))
        return Schema.of(*out, dialect="sqlite")


def ddl_checks(ddl: str) -> list[tuple[str | None, str]]:
    """(name or None, expression) of the CHECK clauses in a CREATE TABLE text, parentheses balanced."""
    found = []
    for m in re.finditer(r"(?:CONSTRAINT\s+[\"`\[]?(\w+)[\"`\]]?\s+)?CHECK\s*\(", ddl, re.I):
        depth, i = 1, m.end()
        while i < len(ddl) and depth:
            depth += {"(": 1, ")": -1}.get(ddl[i], 0)
            i += 1
        found.append((m[1], ddl[m.end() : i - 1].strip()))
    return found


#: The catalogue queries of the standard information schema, one for each kind of thing, not one for each table.
CATALOG = {
    "columns": "SELECT table_name, column_name, ordinal_position, data_type, is_nullable, column_default, character_maximum_length, numeric_precision, numeric_scale FROM information_schema.columns WHERE table_schema = '{schema}'",
    "keys": "SELECT c.table_name, c.constraint_name, c.constraint_type, k.column_name, k.ordinal_position FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k ON c.constraint_schema = k.constraint_schema AND c.constraint_name = k.constraint_name AND c.table_name = k.table_name WHERE c.table_schema = '{schema}' AND c.constraint_type IN ('PRIMARY KEY', 'UNIQUE', 'FOREIGN KEY')",
    "references": "SELECT r.constraint_name, k.table_name, k.column_name, k.ordinal_position, r.delete_rule, r.update_rule FROM information_schema.referential_constraints r JOIN information_schema.key_column_usage k ON r.unique_constraint_schema = k.constraint_schema AND r.unique_constraint_name = k.constraint_name WHERE r.constraint_schema = '{schema}'",
    "checks": "SELECT t.table_name, c.constraint_name, c.check_clause FROM information_schema.check_constraints c JOIN information_schema.table_constraints t ON c.constraint_schema = t.constraint_schema AND c.constraint_name = t.constraint_name WHERE t.table_schema = '{schema}' AND t.constraint_type = 'CHECK'",
}


#: What databases tell in their own way: Postgres the labels of its enums and a column's type by its own name; MySQL its types in
#: full, and what a foreign key refers to beside the key. MySQL's names would come in capitals without an alias.
MYSQL_COLUMNS = "table_name column_name ordinal_position data_type is_nullable column_default character_maximum_length numeric_precision numeric_scale".split()
DIALECTS = {
    "postgresql": {
        "columns": CATALOG["columns"].replace("data_type,", "data_type, udt_name AS native,"),
        "enums": "SELECT t.typname AS type_name, e.enumlabel AS label, e.enumsortorder AS place FROM pg_type t JOIN pg_enum e ON e.enumtypid = t.oid JOIN pg_namespace n ON n.oid = t.typnamespace WHERE n.nspname = '{schema}'",
    },
    "mysql": {
        "columns": f"SELECT {', '.join(f'{c} AS {c}' for c in MYSQL_COLUMNS)}, column_type AS native FROM information_schema.columns WHERE table_schema = '{{schema}}'",
        "keys": "SELECT c.table_name AS table_name, c.constraint_name AS constraint_name, c.constraint_type AS constraint_type, k.column_name AS column_name, k.ordinal_position AS ordinal_position FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k ON c.constraint_schema = k.constraint_schema AND c.constraint_name = k.constraint_name AND c.table_name = k.table_name WHERE c.table_schema = '{schema}' AND c.constraint_type IN ('PRIMARY KEY', 'UNIQUE', 'FOREIGN KEY')",
        "references": "SELECT r.constraint_name AS constraint_name, k.referenced_table_name AS table_name, k.referenced_column_name AS column_name, k.ordinal_position AS ordinal_position, r.delete_rule AS delete_rule, r.update_rule AS update_rule FROM information_schema.referential_constraints r JOIN information_schema.key_column_usage k ON r.constraint_schema = k.constraint_schema AND r.constraint_name = k.constraint_name AND r.table_name = k.table_name WHERE r.constraint_schema = '{schema}'",
        "checks": "SELECT t.table_name AS table_name, c.constraint_name AS constraint_name, c.check_clause AS check_clause FROM information_schema.check_constraints c JOIN information_schema.table_constraints t ON c.constraint_schema = t.constraint_schema AND c.constraint_name = t.constraint_name WHERE t.table_schema = '{schema}' AND t.constraint_type = 'CHECK'",
    },
}


@source("jdbc")
def from_jdbc(spark: SparkSession, url: str, schema: str | None = None, **options: str) -> Schema:
    """Tables of a database with an information schema, by a query for each kind of thing; the schema is public, with MySQL the
    database of the address, where none is named. No driver is at hand here, so this path is not tested
    against a database; assemble(), which it ends in, is."""
    read = lambda q: [r.asDict() for r in spark.read.format("jdbc").options(url=url, query=q.format(schema=schema), **options).load().collect()]  # noqa: E731  a catalogue is small
    dialect = url.split(":")[1] if ":" in url else "jdbc"
    schema = schema or (re.sub(r".*/|\?.*", "", url) if dialect == "mysql" else "public")
    return assemble({k: read(q) for k, q in (CATALOG | DIALECTS.get(dialect, {})).items()}, dialect)


def assemble(rows: dict[str, list[dict]], dialect: str = "jdbc") -> Schema:
    """A schema from the rows of the catalogue queries."""
    ordered = lambda xs: sorted(xs, key=lambda r: r["ordinal_position"])
    labels: dict[str, tuple] = {}
    for r in sorted(rows.get("enums", ()), key=lambda r: r["place"]):
        labels[r["type_name"]] = (*labels.get(r["type_name"], ()), r["label"])

    def typed(r: dict) -> tuple[str, str, tuple[str, ...]]:
        """A column's logical type, native type and enum labels."""
        native = r.get("native") or r["data_type"]
        if native in labels:
            return "enum", native, labels[native]
        return ("array" if r["data_type"] == "ARRAY" else logical_type(native)), native, enum_values(native) if native.lower().startswith("enum(") else ()

    constraints: dict[tuple, list[dict]] = {}
    for r in rows["keys"]:
        constraints.setdefault((r["table_name"], r["constraint_name"], r["constraint_type"]), []).append(r)
    targets: dict[str, list[dict]] = {}
    for r in rows["references"]:
        targets.setdefault(r["constraint_name"], []).append(r)
    by_table: dict[str, list[dict]] = {}
    for r in rows["columns"]:
        by_table.setdefault(r["table_name"], []).append(r)
    out = []
    for name in sorted(by_table):
        own = {k: tuple(r["column_name"] for r in ordered(v)) for k, v in constraints.items() if k[0] == name}
        key = next((c for k, c in own.items() if k[2] == "PRIMARY KEY"), ())
        unique = tuple(c for k, c in sorted(own.items()) if k[2] == "UNIQUE")
        keys = tuple(ForeignKey(c, t[0]["table_name"], tuple(r["column_name"] for r in ordered(t)), t[0]["delete_rule"], t[0]["update_rule"]) for k, c in sorted(own.items()) if k[2] == "FOREIGN KEY" and (t := targets.get(k[1])))
        columns = tuple(Column(r["column_name"], *typed(r)[:2], r["is_nullable"] == "YES", r["column_name"] in key, (r["column_name"],) in unique or key == (r["column_name"],), r["column_default"], typed(r)[2], r["character_maximum_length"], r["numeric_precision"], r["numeric_scale"]) for r in ordered(by_table[name]))
        out.append(Table(name, columns, key, keys, unique, tuple(Check(r["constraint_name"], r["check_clause"]) for r in rows["checks"] if r["table_name"] == name)))
    return Schema.of(*out, dialect=dialect)


@source("documents")
def from_documents(collections: dict[str, DataFrame], column: str = "value") -> Schema:
    """Collections of JSON documents, a text column each: the types of all documents' paths are counted by the cluster and merged, nested
    fields become dotted names, arrays of objects get [] behind theirs, and a field that any document lacks may be null."""
    out = []
    for name, df in collections.items():
        text = df.select(F.col(column).alias("j")).filter("j is not null")
        fields, n = leaves_of(path_types(text, "j")), text.count()
        if not n:
            out.append(Table(name, ()))
            continue
        present = text.agg(*[F.count_if(F.get_json_object("j", "$." + p.replace("[].", "[*].")).isNotNull()).alias(f"c{i}") for i, (p, _) in enumerate(fields)]).first()
        columns = tuple(Column(p, kind, kind, nullable=present[f"c{i}"] < n, primary=p == "_id", unique=p == "_id") for i, (p, kind) in enumerate(fields))
        out.append(Table(name, columns, ("_id",) if any(c.primary for c in columns) else ()))
    return Schema.of(*out, dialect="documents")
