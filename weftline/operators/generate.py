"""Generation: a plan becomes one DataFrame for each table.

Every cell is a pure function of its row's number, so tables are ranges of numbers with expressions on top. A foreign key
draws its parent's row number and computes the parent's key from it by the parent's own expression; nothing is looked up, and
no key is shuffled or collected. Unique columns are permutations of row numbers, mapped to values, so that they need no look at
other rows. Only fan-out, whose children are numbered in sequence, and unique constraints over several columns, or over values
that cannot be numbered, shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import distributions as D
from weftline.functions.generators import Context, generate, numbered_values, unique_value
from weftline.functions.permute import MOST, permuted
from weftline.functions.rng import SEP, Digits, State, fold_text, let, number, stream, uniform
from weftline.plans.graph import build
from weftline.plans.hooks import through
from weftline.plans.model import Field, Plan, Table, TablePlan, Timeline

ROW, OWN = "__row", "__own"
#: Parents of one block share a prefix sum; blocks are summed in turn.
BLOCK = 1 << 16
MONTH_MS = 86_400_000 * 30.436875
#: Rows of a table that a join of redrawn values may broadcast.
SMALL = 200_000
TRIES = 50
# Shares of nulls by logical type, for the null probability "by type"; 0.15 for the others.
DEFAULT_NULLS = {"boolean": 0.05, "string": 0.15, "float": 0.1, "integer": 0.1, "timestamp": 0.05, "date": 0.05, "uuid": 0.02}
CHURNED = ("deactivated_at", "deleted_at", "deactivatedAt", "deletedAt")
CREATED = ("created_at", "createdAt")


class GenerationError(RuntimeError):
    pass


@dataclass
class Made:
    """A table under way: its rows by number, how many, and how to compute a column of any row."""

    frame: DataFrame
    rows: int | None
    #: (__parent0, __n) of a table whose rows are counted by parent: their sum is the number of rows.
    counts: DataFrame | None = None


def range_of(spark: SparkSession, n: int) -> DataFrame:
    """Row numbers, in enough partitions for the cluster and of a size that fits a task."""
    parts = max(1, min(max(spark.sparkContext.defaultParallelism, math.ceil(n / 2_000_000)), math.ceil(n / 5000)))
    return spark.range(0, n, 1, parts).withColumnRenamed("id", ROW)


class Generator:
    def __init__(self, spark: SparkSession, plan: Plan):
        self.spark, self.plan = spark, plan
        self.graph = build(plan.schema)
        if missing := [n for n in plan.tables if n not in self.graph.order]:
            raise GenerationError(f"tables in a cycle of foreign keys, or behind one: {', '.join(missing)}")
        self.made: dict[str, Made] = {}
        self.own_row: Column | None = None
        self.states: dict[str, State] = {}

    # Expressions of a row's number

    def cell(self, table: str, row: Column | str, column: str, *retry: str) -> Column:
        """The stream of a cell; row is a number or the name of a column of numbers. For the table under way the part of the path up
        to the row is hashed once a row, not a cell."""
        path = (retry[0], column, *retry[1:]) if retry else (column,)
        if row == ROW if isinstance(row, str) else row is self.own_row:
            return fold_text(F.col(OWN), SEP + SEP.join(path))
        if isinstance(row, str):
            return stream(self.plan.seed, table, "__row__", Digits(row), *path)
        return fold_text(stream(self.plan.seed, table, "__row__", row.cast("string")), SEP + SEP.join(path))

    def state(self, name: str = "__state") -> State:
        return self.states.setdefault(name, State(name))

    def by_row(self, *path: str, row: str = ROW) -> Column:
        """The stream whose path ends with the digits of a column."""
        return stream(self.plan.seed, *path, Digits(row))

    def key_name(self, table: str) -> str:
        t = self.plan.schema.tables[table]
        return t.primary_key[0] if t.primary_key else t.columns[0].name

    def key(self, table: str, row: Column) -> Column:
        """The first key column of a table's row, from the row's number."""
        name = self.key_name(table)
        f = self.plan.tables[table].fields.get(name)
        if f is None:
            raise GenerationError(f"{table}.{name}: a key that other tables refer to needs a generator")
        return self.value(table, name, f, row, {})

    def value(self, table: str, name: str, f: Field, row: Column, columns: dict[str, Column], *retry: str, state: State | None = None) -> Column:
        """A cell; state, if given, is its stream."""
        column = self.plan.schema.tables[table].column(name)
        if f.kind == "row-number":
            out = row + 1
        elif not retry and (size := self.capacity(table, name)):
            at = permuted(row, size, self.plan.seed, table, "__unique__", name)
            out = F.when(row < size, unique_value(f.kind, f.params, at)).otherwise(F.raise_error(F.lit(f"{table}.{name}: more rows than the {size} values of a unique column")))
        elif f.kind == "record":
            group = f"__record__{SEP}{f.params.get('group', '')}"
            drawn = generate(f.params["of"], {k: v for k, v in f.params.items() if k not in ("of", "group", "field")}, self.cell(table, row, group), Context(self.plan.reference_ms, columns))
            out = drawn.getField(f.params["field"])
        elif f.kind == "fk-reference":
            target = f.params["referencedTable"]
            out = self.key(target, self.pick(target, state or self.cell(table, row, name)))
        else:
            out = generate(f.kind, f.params, state or self.cell(table, row, name, *retry), Context(self.plan.reference_ms, columns))
        kind = column.spark_type
        return out if f.kind in ("geo.city",) or isinstance(kind, T.ArrayType) else out.cast(kind)

    def referred(self, out: DataFrame, column: str, table: str, name: str, row: str) -> DataFrame:
        """out with a column of another table's row, whose number is the column row: its stream first, then what is drawn from it."""
        state = self.state()
        with_state = out.withColumn(state.name, self.cell(table, row, name))
        f = self.plan.tables[table].fields.get(name)
        if f is None:
            raise GenerationError(f"{table}.{name}: a key that other tables refer to needs a generator")
        return with_state.withColumn(column, self.value(table, name, f, F.col(row), {}, state=state)).drop(state.name)

    def drawn_parent(self, out: DataFrame, column: str, table: str, *path: str) -> DataFrame:
        """out with a row number of a table, drawn from the stream of path and the row."""
        state = self.state()
        return out.withColumn(state.name, self.by_row(*path)).withColumn(column, self.pick(table, state)).drop(state.name)

    def capacity(self, table: str, name: str) -> int | None:
        """How many values a unique column has that takes each once at most, by the permuted number of its row; None if it is not
        made so: values that cannot be numbered, that personas or rows set, or fewer values than rows of which some are null."""
        t, schema = self.plan.tables[table], self.plan.schema.tables[table]
        f = t.fields.get(name)
        size = numbered_values(f.kind, f.params) if f and schema.has_unique([name]) else None
        if not size or any(name in p.overrides for p in t.personas) or any(name in r for r in t.rows):
            return None
        size = min(size, MOST)
        if self.simple(t, schema) and int(t.count) > size:
            if self.null_share(t, schema.column(name)):
                return None
            raise GenerationError(f"{table}: no unique values for {name}: {int(t.count)} rows and {size} values")
        return size

    def simple(self, t: TablePlan, table: Table) -> bool:
        """Whether the plan says how many rows there are."""
        keys = [fk for fk in table.foreign_keys if fk.table != table.name]
        return t.count_per_parent is None and len(keys) < 2 and isinstance(t.count, (int, float))

    def size(self, table: str) -> int:
        """How many rows a table has; those of a table by parent are summed, not made."""
        made = self.made[table]
        if made.rows is None:
            made.rows = made.frame.count() if made.counts is None else made.counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
        return made.rows

    def pick(self, table: str, state: Column | State) -> Column:
        """A row number of a table, uniformly."""
        return F.floor(uniform(state) * float(self.size(table))).cast("long")

    # Rows

    def rows(self, t: TablePlan, table: Table) -> DataFrame:
        """Row numbers with the row numbers of their parents, as __parent0, __parent1 and so on by foreign key."""
        keys = [fk for fk in table.foreign_keys if fk.table != table.name]
        if len(keys) >= 2:
            return self.pairs(t, table, keys)
        if keys and t.count_per_parent is not None:
            return self.fan_out(t, table)
        n = max(1, int(D.most(t.count))) if isinstance(t.count, (int, float)) else self.drawn(t)
        out = range_of(self.spark, n)
        if keys:
            out = self.drawn_parent(out, "__parent0", keys[0].table, t.table, "__parent__", keys[0].table)
        return out

    def drawn(self, t: TablePlan) -> int:
        """A count drawn once for the table."""
        state = stream(self.plan.seed, t.table, "__count__")
        return max(1, self.spark.range(1).select(D.count_of(t.count, state).alias("n")).first()["n"])

    def children(self, t: TablePlan, parent: str, default) -> DataFrame:
        """(__parent0, __n): how many children each row of the parent has; personas multiply, churn tapers."""
        p = self.made[parent].frame.withColumn("__state", self.by_row(t.table, "__parent__", parent))
        row = F.col(ROW)
        n = D.count_of(t.count_per_parent if t.count_per_parent is not None else default, self.state()).cast("double")
        factors = {x.name: x.cascades[t.table] for x in self.plan.tables[parent].personas if t.table in x.cascades}
        if factors:
            by = F.lit(1.0)
            for name, k in factors.items():
                by = F.when(F.col("__persona") == name, F.lit(float(k))).otherwise(by)
            n = D.half_up(n * by)
        line = self.plan.tables[parent].timeline
        if self.plan.tables[parent].churn_rate and line:
            end = next((F.col(c) for c in CHURNED if c in p.columns), None)
            start = next((F.col(c) for c in CREATED if c in p.columns), None)
            if end is not None and start is not None:
                active = (F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))) / F.greatest(F.lit(line.end_ms) - F.unix_millis(start.cast("timestamp")), F.lit(1))
                n = F.when(end.isNotNull(), F.greatest(F.lit(1.0), D.half_up(n * F.least(F.lit(1.0), active)))).otherwise(n)
        return p.select(row.alias("__parent0"), F.greatest(n, F.lit(0.0)).cast("long").alias("__n"))

    def numbered(self, counts: DataFrame) -> DataFrame:
        """counts(__parent0, __n) opened to one row for each child, numbered in sequence over all parents.

        Sums by block of parents are few; each block starts where the blocks before it end, and only within a block is a
        running sum taken."""
        blocked = counts.withColumn("__block", F.floor(F.col("__parent0") / BLOCK))
        sums = blocked.groupBy("__block").agg(F.sum("__n").alias("s"))
        starts = sums.withColumn("__from", F.sum("s").over(Window.orderBy("__block")) - F.col("s")).drop("s")
        within = Window.partitionBy("__block").orderBy("__parent0")
        placed = blocked.join(starts, "__block").withColumn("__from", F.col("__from") + F.sum("__n").over(within) - F.col("__n"))
        return placed.filter("__n > 0").select("__parent0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__k"), "__from").select((F.col("__from") + F.col("__k")).alias(ROW), "__parent0", "__k")

    def fan_out(self, t: TablePlan, table: Table) -> DataFrame:
        parent = t.parent or next(fk.table for fk in table.foreign_keys if fk.table != table.name)
        self.counts = self.children(t, parent, 1)
        return self.numbered(self.counts).drop("__k")

    def pairs(self, t: TablePlan, table: Table, keys: list) -> DataFrame:
        """Rows of a table with several parents: for each row of the first a number of rows of the second, all different if
        the two are a key, and any row of the others. The different ones step through the second table by a stride that
        shares no factor with its size, from a random start."""
        first, second = keys[0].table, keys[1].table
        size = self.size(second)
        counts = self.children(t, first, {"kind": "uniformInt", "min": 1, "max": 5})
        distinct = table.has_unique(keys[0].columns + keys[1].columns)
        if distinct:
            counts = counts.withColumn("__n", F.least("__n", F.lit(size)))
        self.counts = counts
        out = self.numbered(counts)
        if distinct:
            stride = 1 + int(number(self.plan.seed, t.table, "__stride__") * size)
            while math.gcd(stride, size) != 1:
                stride += 1
            start = F.floor(uniform(self.state()) * float(size)).cast("long")
            drawn = out.withColumn("__state", self.by_row(t.table, "__junction__", row="__parent0"))
            out = drawn.withColumn("__parent1", F.pmod(start + F.col("__k") * F.lit(stride), F.lit(size))).drop("__state")
        else:
            out = self.drawn_parent(out, "__parent1", second, t.table, "__junction__")
        for i, fk in enumerate(keys[2:], 2):
            out = self.drawn_parent(out, f"__parent{i}", fk.table, t.table, "__parent__", fk.table)
        return out.drop("__k")

    # Columns

    def table(self, name: str) -> DataFrame:
        t, table = self.plan.tables[name], self.plan.schema.tables[name]
        keys = [fk for fk in table.foreign_keys if fk.table != name]
        self.own_row = self.counts = None
        out = self.rows(t, table)
        self.made[name] = Made(out, max(1, int(t.count)) if self.simple(t, table) else None, self.counts)
        out = out.withColumn(OWN, self.by_row(name, "__row__"))
        row = self.own_row = F.col(ROW)
        for i, fk in enumerate(keys):
            out = self.referred(out, fk.columns[0], fk.table, self.key_name(fk.table), f"__parent{i}")
            for c, r in list(zip(fk.columns, fk.references, strict=True))[1:]:
                out = self.referred(out, c, fk.table, r, f"__parent{i}")
        out = out.drop(*[f"__parent{i}" for i in range(len(keys))])
        if t.personas:
            out = out.withColumn("__persona", D.weighted(self.by_row(name, "__persona__"), {p.name: p.weight for p in t.personas}))
        if t.timeline:
            out = self.on_timeline(out, t, table, self.size(name))
        bound = set(out.columns) - {OWN}
        for layer in layers({c: f for c, f in t.fields.items() if c not in bound}):
            have = {c: F.col(c) for c in out.columns if c != OWN}
            states = {c: self.state(f"__state{i}") for i, c in enumerate(layer)}
            out = out.withColumns({s.name: self.cell(name, ROW, c) for c, s in states.items()})
            out = out.withColumns({c: self.personal(t, c, self.value(name, c, f, row, have, state=states[c]), have) for c, f in layer.items()})
            out = out.drop(*[s.name for s in states.values()])
        blank = {}
        for c in table.columns:
            p = self.null_share(t, c) if c.name in out.columns else 0.0
            if c.name not in out.columns:
                blank[c.name] = F.lit(None).cast(c.spark_type)
            elif p > 0:
                blank[c.name] = F.when(uniform(self.by_row(name, "__nullable__", c.name)) >= p, F.col(c.name))
        out = out.withColumns(blank) if blank else out
        for i, fixed in enumerate(t.rows):
            out = out.withColumns({c: F.when(row == i, F.lit(v).cast(table.column(c).spark_type)).otherwise(F.col(c)) for c, v in fixed.items()})
        out = self.unique(out, t, table)
        own = next((fk for fk in table.foreign_keys if fk.table == name), None)
        if own:
            out = self.self_reference(out, name, own.columns[0], self.size(name))
        extra = [c for c in ("__persona",) if c in out.columns]
        out = out.select(ROW, *[c.name for c in table.columns], *extra)
        self.made[name].frame = out
        return out

    def null_share(self, t: TablePlan, column) -> float:
        """The share of a column's values that become null: its own, or for inferred columns that may be null the plan's."""
        f = t.fields.get(column.name)
        share = f.null_probability if f and f.null_probability else 0.0
        if column.nullable and not share and self.plan.null_probability and f and f.source != "config":
            share = DEFAULT_NULLS.get(column.type, 0.15) if self.plan.null_probability == "by type" else self.plan.null_probability
        return share

    def personal(self, t: TablePlan, column: str, value: Column, have: dict[str, Column]) -> Column:
        for p in t.personas:
            if column in p.overrides:
                o = p.overrides[column]
                if isinstance(o, dict):
                    o = Field(o["kind"], {k: v for k, v in o.items() if k != "kind"} | o.get("params", {}))
                new = self.value(t.table, column, o, self.own_row, have) if isinstance(o, Field) else F.lit(o)
                value = F.when(F.col("__persona") == p.name, new).otherwise(value)
        return value

    def on_timeline(self, out: DataFrame, t: TablePlan, table: Table, n: int) -> DataFrame:
        """Times of creation along the growth curve, and of leaving after an exponential life."""
        out, state = out.withColumn("__state", self.by_row(t.table, "__timeline__")), self.state()
        q = F.lit(0.0) if n <= 1 else F.col(ROW) / float(n - 1)
        q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), q + (uniform(state) - 0.5) * t.timeline.jitter))
        ms = F.lit(float(t.timeline.start_ms)) + inverse_growth(t.timeline, q) * float(t.timeline.end_ms - t.timeline.start_ms)
        created = next((c for c in CREATED if table.column(c)), None)
        if created:
            out = out.withColumn(created, F.timestamp_millis(F.floor(ms).cast("long")).cast(table.column(created).spark_type))
        left = next((c for c in CHURNED if table.column(c)), None)
        if left and created and t.churn_rate:
            out = out.withColumn("__state", self.by_row(t.table, "__churn__"))
            life = D.exponential(self.state(), t.churn_rate) * MONTH_MS
            gone = F.unix_millis(F.col(created).cast("timestamp")) + life
            out = out.withColumn(left, F.when(gone < t.timeline.end_ms, F.timestamp_millis(F.floor(gone).cast("long"))).cast(table.column(left).spark_type))
        return out.drop("__state")

    def unique(self, out: DataFrame, t: TablePlan, table: Table) -> DataFrame:
        """Rows that repeat the values of a unique constraint, all but the first, draw them again until none is left.

        Only the constraint's columns are shuffled to find repeats, and only the rows that repeat are drawn again, so that a
        round costs what it still has to change; a table without repeats keeps its plan."""
        keyed = {c for fk in table.foreign_keys for c in fk.columns}
        settled = {c for c in t.fields if self.capacity(t.table, c)}
        constraints = [u for u in [*table.unique, *[(c.name,) for c in table.columns if c.unique and not c.primary]] if not set(u) <= keyed and not set(u) & settled]
        for columns in constraints:
            free = [c for c in columns if c in t.fields and t.fields[c].kind not in ("row-number", "derived", "constant")]
            if free and not all(t.fields[c].kind in ("uuid",) for c in free):
                out = self.redrawn(out, t, columns, free)
        return out

    def redrawn(self, out: DataFrame, t: TablePlan, columns: Sequence[str], free: list[str]) -> DataFrame:
        """out with the free columns of a constraint drawn again where its columns repeat an earlier row's values."""
        complete = F.lit(True)
        for c in columns:
            complete &= F.col(c).isNotNull()
        repeats = F.row_number().over(Window.partitionBy(*columns).orderBy(ROW)) > 1
        used, self.kept = out.filter(complete).select(ROW, *columns), []
        late = self.held(used.withColumn("__late", repeats).filter("__late").select(ROW))
        n = first = late.count()
        if not n:
            return out
        small = lambda df, size: F.broadcast(df) if size <= SMALL else df
        taken = self.held(used.join(small(late, n), ROW, "left_anti").select(*columns))
        rows, changes = out.join(small(late, n), ROW, "left_semi"), None
        for attempt in range(1, TRIES + 1):
            have = {x: F.col(x) for x in rows.columns}
            drawn = self.held(rows.withColumns({c: self.value(t.table, c, t.fields[c], self.own_row, have, "__unique__", str(attempt)) for c in free}))
            met = taken.join(small(drawn.select(*columns), n), list(columns), "left_semi").distinct().withColumn("__met", F.lit(True))
            marked = self.held(drawn.withColumn("__late", repeats).join(met, list(columns), "left").withColumn("__late", F.col("__late") & complete | F.coalesce("__met", F.lit(False))).drop("__met"))
            n = marked.filter("__late").count()
            settled = marked.filter("not __late")
            changed = settled.select(F.col(ROW).alias("__changed"), *[F.col(c).alias(f"__new_{c}") for c in free])
            changes = changed if changes is None else changes.unionByName(changed)
            if not n:
                rounds, self.kept = self.kept, []
                changes = self.held(changes)
                if changes.count() and rounds:  # what is left are the changed rows
                    for df in rounds:
                        df.unpersist()
                kept = [F.when(F.col("__changed").isNotNull(), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in free else F.col(c) for c in out.columns]
                return out.join(small(changes, first), out[ROW] == F.col("__changed"), "left").select(*kept)
            taken = taken.unionByName(settled.filter(complete).select(*columns))
            rows = marked.filter("__late").select(*out.columns)
        raise GenerationError(f"{t.table}: no unique values for {', '.join(columns)} after {TRIES} tries")

    def held(self, df: DataFrame) -> DataFrame:
        """df, computed once: in the checkpoint folder if the session has one, else kept by the executors until the constraint is
        settled."""
        if self.spark.sparkContext.getCheckpointDir():
            return df.checkpoint()
        self.kept.append(df.persist())
        return df

    def self_reference(self, out: DataFrame, name: str, column: str, n: int) -> DataFrame:
        """Another row's key: never the row's own, unless there is but one."""
        row = F.col(ROW)
        out = out.withColumn("__state", self.by_row(name, "__selfref__"))
        step = F.floor(uniform(self.state()) * float(max(n - 1, 1))).cast("long")
        out = out.withColumn("__other", F.pmod(row + 1 + step, F.lit(n)) if n > 1 else row).drop("__state")
        return self.referred(out, column, name, self.key_name(name), "__other").drop("__other")

    def run(self) -> dict[str, DataFrame]:
        for name in self.graph.order:
            if name in self.plan.tables:
                self.table(name)
        return {n: m.frame.drop(ROW, "__persona") for n, m in self.made.items()}


def layers(fields: dict[str, Field]) -> list[dict[str, Field]]:
    """Fields in the order of what they depend on; those of a cycle come last, together."""
    out, left = [], dict(fields)
    while left:
        need = lambda f: [x for x in (f.params.get("dependsOn"), f.params.get("sourceColumn")) if x in left]
        ready = {c: f for c, f in left.items() if not need(f) and f.kind != "derived"} or {c: f for c, f in left.items() if not need(f)} or left
        out.append(dict(ready))
        left = {c: f for c, f in left.items() if c not in ready}
    return out


def inverse_growth(line: Timeline, q: Column) -> Column:
    """The share of the time span at which growth has reached the share q of its total."""
    if line.season:
        return inverse_growth(replace(line, season=None), let(q, lambda v: piecewise(v, [(c, g, (h - g) / m) for c, m, g, h, _ in seasons(line)])))
    months = (line.end_ms - line.start_ms) / MONTH_MS
    if not months > 0:
        raise ValueError("a timeline must end after it starts")
    if line.growth == "linear":
        g = line.total_growth
        return q if g == 1 else (F.sqrt(1 + (g * g - 1) * q) - 1) / (g - 1)
    if line.growth == "compound":
        k = math.log1p(line.rate) * months
        return q if k == 0 else F.log(1 + q * (math.exp(k) - 1)) / k
    if line.growth == "scurve":
        k, low, high = line.curve
        p = F.lit(low) + q * (high - low)
        return F.least(F.greatest(line.inflection - F.log(1 / p - 1) / k, F.lit(0.0)), F.lit(1.0))
    raise ValueError(f"unknown growth {line.growth!r}")


def growth(line: Timeline, at: Column) -> Column:
    """The share of its total that growth has reached at a share of the time span; inverse_growth turned round."""
    if line.season:
        return let(growth(replace(line, season=None), at), lambda v: piecewise(v, [(g, c, m / (h - g)) for c, m, g, h, _ in seasons(line)]))
    t = F.least(F.greatest(at, F.lit(0.0)), F.lit(1.0))
    months = (line.end_ms - line.start_ms) / MONTH_MS
    if line.growth == "linear":
        g = line.total_growth
        return (2 * t + (g - 1) * t * t) / (g + 1)
    if line.growth == "compound":
        k = math.log1p(line.rate) * months
        return t if k == 0 else (F.exp(t * k) - 1) / (math.exp(k) - 1)
    if line.growth == "scurve":
        k, low, high = line.curve
        return (1 / (1 + F.exp((line.inflection - t) * k)) - low) / (high - low)
    raise ValueError(f"unknown growth {line.growth!r}")


def grown(line: Timeline, t: float) -> float:
    """growth of a number on the driver, without the season."""
    months = (line.end_ms - line.start_ms) / MONTH_MS
    if line.growth == "linear":
        g = line.total_growth
        return (2 * t + (g - 1) * t * t) / (g + 1)
    if line.growth == "compound":
        k = math.log1p(line.rate) * months
        return t if k == 0 else math.expm1(t * k) / math.expm1(k)
    if line.growth == "scurve":
        k, low, high = line.curve
        return (1 / (1 + math.exp((line.inflection - t) * k)) - low) / (high - low)
    raise ValueError(f"unknown growth {line.growth!r}")


def seasons(line: Timeline) -> list[tuple[float, float, float, float, int]]:
    """The calendar months (days, if the season is a function of dates) of a timeline with any weight: (share of all rows before it, its
    own share, growth at its start and at its end, month). The one table that a season needs; it is as long as the timeline has
    months or days."""
    daily, given = callable(line.season), SEASON if line.season == "holiday" else line.season
    weight_of = given if daily else lambda day, by={int(m): float(w) for m, w in given.items()}: by.get(day.month, 1.0)
    span, parts = line.end_ms - line.start_ms, []
    at = datetime.fromtimestamp(line.start_ms / 1000, timezone.utc).replace(hour=0, minute=0, second=0, microsecond=0)
    at = at if daily else at.replace(day=1)
    while at.timestamp() * 1000 < line.end_ms:
        after = at + timedelta(days=1) if daily else (at + timedelta(days=32)).replace(day=1)
        lo, hi = (min(1.0, max(0.0, (x.timestamp() * 1000 - line.start_ms) / span)) for x in (at, after))
        low, high = grown(line, lo), grown(line, hi)
        wanted = weight_of(at.date())
        if (weight := (1.0 if wanted is None else float(wanted)) * (high - low)) > 0:
            parts.append((weight, low, high, at.month))
        at = after
    total, before, out = math.fsum(w for w, *_ in parts), 0.0, []
    if not total > 0:
        raise ValueError("a season must give some month of the timeline weight")
    for weight, low, high, number_ in parts:
        out.append((before, weight / total, low, high, number_))
        before += weight / total
    return out


def piecewise(x: Column, parts: list[tuple[float, float, float]]) -> Column:
    """A function that is linear between steps, (from, value there, slope), in rising order: a binary search as an expression."""
    if len(parts) == 1:
        start, value, slope = parts[0]
        return (x - start) * slope + value
    middle = len(parts) // 2
    return F.when(x < parts[middle][0], piecewise(x, parts[:middle])).otherwise(piecewise(x, parts[middle:]))


#: A year's weights by month; the other months weigh 1.
SEASON = {1: 0.7, 2: 0.85, 10: 0.8, 11: 1.8, 12: 2.0}


def seasonal_weight(time: Column, weight: Callable[[Column], Column] | None = None) -> Column:
    """The weight of a time by the year's weights, or by a function of the time; 1 where that gives null."""
    if weight:
        return F.coalesce(weight(time).cast("double"), F.lit(1.0))
    month, out = F.month(time), F.lit(1.0)
    for m, w in SEASON.items():
        out = F.when(month == m, F.lit(w)).otherwise(out)
    return out


def generate_tables(spark: SparkSession, plan: Plan, tables: list[str] | None = None, plugins: Sequence = ()) -> dict[str, DataFrame]:
    """The plan's tables; with tables, those and whatever they refer to. Plugins see the plan before and the tables after."""
    plan = through(plugins, "before_generate", plan)
    if tables is not None:
        wanted, todo = set(), list(tables)
        while todo:
            if (name := todo.pop()) not in wanted:
                wanted.add(name)
                todo += [fk.table for fk in plan.schema.tables[name].foreign_keys]
        plan = Plan(plan.schema, {n: t for n, t in plan.tables.items() if n in wanted}, plan.seed, plan.reference_ms, plan.null_probability)
    return through(plugins, "after_generate", Generator(spark, plan).run())


def preview(spark: SparkSession, plan: Plan, n: int) -> dict[str, DataFrame]:
    """The first n rows of each table, by row number; they are what a full run gives, and only they are computed."""
    g = Generator(spark, plan)
    g.run()
    return {name: m.frame.filter(F.col(ROW) < n).drop(ROW, "__persona") for name, m in g.made.items()}
