"""Schemas and generation plans as plain data."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

#: Logical types and the Spark types that hold them.
LOGICAL = {
    "string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "json": T.StringType(), "uuid": T.StringType(), "enum": T.StringType(), "binary": T.BinaryType(),
    "array": T.ArrayType(T.StringType()),
}


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "string"
    native: str = ""
    nullable: bool = False
    primary: bool = False
    unique: bool = False
    default: str | None = None
    enum_values: tuple[str, ...] = ()
    max_length: int | None = None
    precision: int | None = None
    scale: int | None = None
    comment: str | None = None

    @property
    def spark_type(self) -> T.DataType:
        if self.type == "float" and self.precision:
            return T.DecimalType(min(self.precision, 38), self.scale or 0)
        return LOGICAL[self.type]


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...]
    on_delete: str | None = None
    on_update: str | None = None


@dataclass(frozen=True)
class Check:
    name: str
    expression: str


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[Check, ...] = ()
    estimated_rows: int | None = None
    comment: str | None = None

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def has_unique(self, columns: Iterable[str]) -> bool:
        """Whether a key or unique constraint is exactly these columns."""
        wanted = set(columns)
        single = next(iter(wanted)) if len(wanted) == 1 else None
        flagged = single is not None and (c := self.column(single)) is not None and (c.unique or c.primary and len(self.primary_key) <= 1)
        return flagged or set(self.primary_key) == wanted or any(set(u) == wanted for u in self.unique)


@dataclass(frozen=True)
class Schema:
    tables: dict[str, Table]
    dialect: str = "files"

    @classmethod
    def of(cls, *tables: Table, dialect: str = "files") -> Schema:
        return cls({t.name: t for t in tables}, dialect)

    def as_dict(self) -> dict:
        return {"dialect": self.dialect, "tables": {n: asdict(t) for n, t in self.tables.items()}}

    @classmethod
    def from_dict(cls, data: dict) -> Schema:
        def table(t: dict) -> Table:
            keys = lambda x: tuple(x or ())
            return Table(
                t["name"],
                tuple(Column(**{**c, "enum_values": keys(c.get("enum_values"))}) for c in t["columns"]),
                keys(t.get("primary_key")),
                tuple(ForeignKey(**{**f, "columns": keys(f["columns"]), "references": keys(f["references"])}) for f in t.get("foreign_keys") or ()),
                tuple(keys(u) for u in t.get("unique") or ()),
                tuple(Check(**c) for c in t.get("checks") or ()),
                t.get("estimated_rows"),
                t.get("comment"),
            )

        return cls({n: table(t) for n, t in data["tables"].items()}, data.get("dialect", "files"))


def canonical(value: Any) -> str:
    """JSON with sorted keys; functions are told apart from data but not from each other."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=lambda v: "<function>" if callable(v) else str(v))


def schema_hash(schema: Schema) -> str:
    return hashlib.sha256(canonical(schema.as_dict()).encode()).hexdigest()


def config_hash(config: dict) -> str:
    """Of what the configuration says about tables."""
    return hashlib.sha256(canonical(config.get("tables", {})).encode()).hexdigest()


# Generation


@dataclass(frozen=True)
class Field:
    kind: str
    params: dict = field(default_factory=dict)
    source: str = "config"
    confidence: float = 1.0
    null_probability: float = 0.0


@dataclass(frozen=True)
class Persona:
    """A part of a table's rows: its weight, column overrides (literals or Fields), fan-out factors by child table, churn."""

    name: str
    weight: float
    overrides: dict = field(default_factory=dict)
    cascades: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Timeline:
    """Row i of n falls where growth has reached the share i / (n - 1) of its total between start and end, in milliseconds.

    compound grows by rate a month; linear ends at total_growth times the rows a month that it starts with; scurve is steepest at
    inflection, a share of the time, with steepness (10 * rate where none is given). season weighs each calendar month's part of the
    growth: weights by month (1 where a month has none), "holiday" for the year's fixed ones, or a function of the date, by day."""

    start_ms: int
    end_ms: int
    growth: str = "linear"
    rate: float = 0.1
    jitter: float = 0.01
    total_growth: float = 1.0
    steepness: float | None = None
    inflection: float = 0.5
    season: Any = None

    @property
    def curve(self) -> tuple[float, float, float]:
        """Of an scurve: its steepness, and the logistic function at start and end."""
        k = self.steepness or 10 * self.rate or 5.0
        return k, 1 / (1 + math.exp(k * self.inflection)), 1 / (1 + math.exp(k * (self.inflection - 1)))

    @property
    def rows(self) -> int:
        """How many rows the growth gives that starts with one a month."""
        months = math.ceil((self.end_ms - self.start_ms) / (86_400_000 * 30.436875))
        total = {"compound": sum((1 + self.rate) ** m for m in range(months)), "linear": (1 + self.total_growth) / 2 * months, "scurve": months}[self.growth]
        return max(1, int(total + 0.5))


@dataclass(frozen=True)
class TablePlan:
    table: str
    count: Any = 10
    fields: dict[str, Field] = field(default_factory=dict)
    parent: str | None = None
    count_per_parent: Any = None
    personas: tuple[Persona, ...] = ()
    timeline: Timeline | None = None
    churn_rate: float | None = None
    rows: tuple[dict, ...] = ()


@dataclass(frozen=True)
class Plan:
    schema: Schema
    tables: dict[str, TablePlan]
    seed: int = 42
    reference_ms: int = 1_720_000_000_000
    #: For inferred columns that may be null: a share, or "by type".
    null_probability: float | str | None = None

    def scaled(self, total: int, target: str | None = None) -> Plan:
        """Numeric counts scaled so that they sum to total, one row at least; target limits it to one table."""
        numeric = {n: t.count for n, t in self.tables.items() if isinstance(t.count, (int, float)) and t.count_per_parent is None and target in (None, n)}
        now = sum(numeric.values()) or 1
        tables = {n: replace(t, count=max(1, int(t.count * total / now + 0.5))) if n in numeric else t for n, t in self.tables.items()}
        return replace(self, tables=tables)
