"""A generation plan from a schema, a configuration and what the rules infer; and the checks before it runs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from weftline.functions.distributions import most
from weftline.functions.generators import KINDS, distinct_values
from weftline.plans.graph import Graph, build
from weftline.plans.model import Field, Persona, Plan, Schema, Table, TablePlan, Timeline
from weftline.plans.semantic import analyze, bounds
from weftline.plans.shape import shape_issues

ENGINE = {"fk-reference", "record"}


class PlanError(ValueError):
    """Everything that is wrong with a plan, in one message."""

    def __init__(self, issues: Iterable[str]):
        self.issues = list(issues)
        super().__init__("; ".join(self.issues))


@dataclass(frozen=True)
class Finding:
    level: str
    table: str
    column: str | None
    message: str


def as_field(value) -> Field:
    """A configuration's field: a kind's name, a mapping with kind and parameters (null among them: its null probability), or
    a function of the row's columns."""
    if isinstance(value, Field):
        return value
    if callable(value):
        return Field("derived", {"fn": value})
    if isinstance(value, str):
        return Field(value)
    rest = {k: v for k, v in value.items() if k not in ("kind", "params", "nullProbability")}
    return Field(value["kind"], {**rest, **value.get("params", {})}, null_probability=value.get("nullProbability", 0.0))


def validate_config(config: dict, schema: Schema) -> list[str]:
    """Values of the wrong shape; unknown tables, columns, parents and persona columns; kinds that do not exist or do not fit a
    column's type."""
    if issues := shape_issues(config):
        return issues
    for name, t in config.get("tables", {}).items():
        table = schema.tables.get(name)
        if not table:
            issues.append(f"no table {name}")
            continue
        if t.get("parent") and t["parent"] not in schema.tables:
            issues.append(f"{name}: no parent table {t['parent']}")
        named = [(c, as_field(f)) for c, f in t.get("columns", {}).items()]
        for p in t.get("personas", ()):
            named += [(c, as_field(f)) for c, f in p.get("overrides", {}).items() if isinstance(f, (dict, Field))]
            issues += [f"{name}: persona {p.get('name')} cascades to unknown table {c}" for c in p.get("cascades", {}) if c not in schema.tables]
        for c, f in named:
            column = table.column(c)
            kind = KINDS.get(f.kind.removeprefix("faker."))
            if not column:
                issues.append(f"{name}: no column {c}")
            elif not kind and f.kind not in ENGINE:
                issues.append(f"{name}.{c}: unknown generator {f.kind}")
            elif kind and "*" not in kind.types and column.type not in kind.types:
                issues.append(f"{name}.{c}: generator {f.kind} does not fit the type {column.type}")
    return issues


def build_plan(schema: Schema, config: dict | None = None, least: float = 0.6) -> Plan:
    """Each column by the configuration, else by a rule, else null if it may be; what is left is an error, as is a cycle of
    several tables. Ids of rows that no rule covers but that are integer keys are numbered."""
    config = config or {}
    if shape := shape_issues(config):
        raise PlanError(shape)
    issues = validate_config(config, schema)
    graph = build(schema)
    issues += [f"tables in a cycle of foreign keys: {' -> '.join(c)}" for c in graph.cycles if len(c) > 1]
    inferred = {(m.table, m.column): m.field for m in analyze(schema, least)}
    plans = {}
    for name, table in schema.tables.items():
        own = config.get("tables", {}).get(name, {})
        keyed = {c for fk in table.foreign_keys for c in fk.columns}
        fields = {}
        for c in table.columns:
            if c.name in own.get("columns", {}):
                fields[c.name] = as_field(own["columns"][c.name])
            elif c.name in keyed:
                continue
            elif c.primary and c.type == "integer":
                fields[c.name] = Field("row-number", {}, "inferred")
            elif found := inferred.get((name, c.name)):
                fields[c.name] = found
            elif not c.nullable:
                issues.append(f"{name}.{c.name}: no generator for a column that may not be null")
        personas = tuple(Persona(p["name"], p["weight"], p.get("overrides", {}), p.get("cascades", {})) for p in own.get("personas", ()))
        line = Timeline(**own["timeline"]) if own.get("timeline") else None
        count = own.get("count", 10)
        if count == "timeline" and not line:
            issues.append(f"{name}: a count by a timeline that there is not")
        count = line.rows if line and count == "timeline" else count
        plans[name] = TablePlan(name, count, fields, own.get("parent"), own.get("countPerParent"), personas, line, own.get("churnRate"), tuple(own.get("rows", ())))
    if issues:
        raise PlanError(issues)
    return Plan(schema, plans, config.get("seed", 42), config.get("referenceMs", 1_720_000_000_000), config.get("nullProbability"))


def with_unresolved(plan: Plan, fields: dict[tuple[str, str], Field], opted_in: Iterable[str] = ()) -> Plan:
    """The plan with fields added that it does not have; of the tables opted in, if any are named."""
    tables, opted_in = dict(plan.tables), set(opted_in)
    for (t, c), f in fields.items():
        if c not in tables[t].fields and (not opted_in or t in opted_in):
            tables[t] = replace(tables[t], fields={**tables[t].fields, c: f})
    return replace(plan, tables=tables)


def expected_counts(plan: Plan, graph: Graph) -> dict[str, int]:
    """The largest count to expect of each table, parents before children."""
    out: dict[str, int] = {}
    for name in graph.order:
        t = plan.tables.get(name)
        if not t:
            continue
        parents = [fk.table for fk in plan.schema.tables[name].foreign_keys if fk.table != name]
        if parents and (t.count_per_parent is not None or len(parents) >= 2):
            per = most(t.count_per_parent) if t.count_per_parent is not None else 5
            out[name] = out.get(t.parent or parents[0], 10) * per
        elif parents:
            out[name] = out.get(parents[0], 10)
        else:
            out[name] = most(t.count)
    return out


def preflight(plan: Plan) -> list[Finding]:
    """What would go wrong: nulls in columns that may not be null, values outside of enum or CHECK, too few different values
    for a unique column, tables whose parents are not planned."""
    graph, found = build(plan.schema), []
    counts = expected_counts(plan, graph)
    for name, t in plan.tables.items():
        table = plan.schema.tables[name]
        for c in table.columns:
            f = t.fields.get(c.name)
            if not c.nullable and f and f.null_probability > 0:
                found.append(Finding("error", name, c.name, "the column may not be null but is given a null probability"))
            if f:
                found += allowed(table, c.name, f)
            if f and (table.has_unique([c.name])) and f.kind != "row-number":
                n = distinct_values(f.kind, f.params)
                if n is not None and n >= 0 and n < counts.get(name, 0):
                    found.append(Finding("error" if n < 0.1 * counts[name] else "warning", name, c.name, f"{n} values for {counts[name]} rows of a unique column"))
        for fk in table.foreign_keys:
            if fk.table not in plan.tables:
                found.append(Finding("error", name, fk.columns[0], f"its parent {fk.table} is not generated"))
    return found


def allowed(table: Table, column: str, f: Field) -> list[Finding]:
    c = table.column(column)
    limit = bounds(table, column) or {}
    values = list(c.enum_values) or limit.get("values")
    given = f.params.get("values") or f.params.get("enumValues")
    if values and given:
        extra = sorted(set(map(str, given)) - set(map(str, values)))
        return [Finding("error", table.name, column, f"values that the schema does not allow: {', '.join(extra)}")] if extra else []
    if "min" in limit and f.kind in ("bounded-integer", "uniformInt") and (f.params.get("min", 0) < limit["min"] or f.params.get("max", 100) > limit["max"]):
        return [Finding("error", table.name, column, f"the generator's range leaves {limit['min']} to {limit['max']}")]
    return []
