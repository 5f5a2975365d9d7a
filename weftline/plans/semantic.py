"""What a column means, by rules on its name, type and constraints; the first that applies decides."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from weftline.plans.graph import target_of
from weftline.plans.model import Column, Field, Schema, Table

Guess = tuple[str, float, str, dict]


@dataclass(frozen=True)
class Match:
    table: str
    column: str
    meaning: str | None
    confidence: float
    field: Field | None


def bounds(table: Table, column: str) -> dict | None:
    """min and max (or values) that the CHECK clauses on a column allow; strict comparisons move by one."""
    low = high = None
    values: list[str] = []
    number = r"(-?[0-9]+(?:\.[0-9]+)?)"
    name = rf"[\"`(]?\b{re.escape(column)}\b[\"`)]?"
    for check in table.checks:
        text = check.expression
        for op, n in re.findall(rf"{name}\s*(>=|<=|>|<)\s*{number}", text, re.I):
            v = float(n)
            if op[0] == ">":
                v = v + 1 if op == ">" else v
                low = v if low is None else max(low, v)
            else:
                v = v - 1 if op == "<" else v
                high = v if high is None else min(high, v)
        for a, b in re.findall(rf"{name}\s+BETWEEN\s+{number}\s+AND\s+{number}", text, re.I):
            low, high = float(a) if low is None else max(low, float(a)), float(b) if high is None else min(high, float(b))
        for inside in re.findall(rf"{name}\s+IN\s*\(([^)]*)\)", text, re.I):
            values += [v.strip().strip("'") for v in inside.split(",")]
    if values:
        return {"values": values}
    if low is None and high is None:
        return None
    return {"min": int(low if low is not None else 0), "max": int(high if high is not None else (low or 0) + 100)}


def named(pattern: str, types: tuple[str, ...], meaning: str, confidence: float, kind: str, params: dict | None = None) -> Callable[[Column, Table, Schema], Guess | None]:
    match = re.compile(pattern, re.I)
    return lambda c, t, s: (meaning, confidence, kind, params or {}) if match.search(c.name) and c.type in types else None


TEXT, NUMBER, TIME = ("string",), ("float", "integer"), ("timestamp", "date")


def enum_rule(c: Column, t: Table, s: Schema) -> Guess | None:
    return ("enum", 1.0, "weighted-categorical", {"values": list(c.enum_values)}) if c.type == "enum" and c.enum_values else None


def reference_rule(c: Column, t: Table, s: Schema) -> Guess | None:
    declared = next((fk.table for fk in t.foreign_keys if fk.columns == (c.name,)), None)
    target = declared or target_of(c.name, list(s.tables))
    return ("foreignKey", 1.0 if declared else 0.8, "fk-reference", {"referencedTable": target}) if target else None


def check_rule(c: Column, t: Table, s: Schema) -> Guess | None:
    found = bounds(t, c.name) if c.type in ("integer", "string") else None
    if not found:
        return None
    if "values" in found:
        if c.type == "integer":
            numbers = [int(v) for v in found["values"]]
            return ("bounded-integer", 0.95, "bounded-integer", {"min": min(numbers), "max": max(numbers)})
        return ("enum", 0.95, "weighted-categorical", {"values": found["values"]})
    return ("bounded-integer", 0.95, "bounded-integer", found) if c.type == "integer" else None


def uuid_rule(c: Column, t: Table, s: Schema) -> Guess | None:
    if c.type == "uuid":
        return ("uuid", 1.0, "uuid", {})
    return ("uuid", 0.9, "uuid", {}) if c.type == "string" and c.native.lower().startswith("uuid") else None


def flag_rule(c: Column, t: Table, s: Schema) -> Guess | None:
    if re.match(r"is_", c.name, re.I) and c.type in ("boolean", "integer"):
        return ("booleanFlag", 1.0 if c.type == "boolean" else 0.85, "boolean-skewed", {"skew": 0.8})
    return None


def time_rule(c: Column, t: Table, s: Schema) -> Guess | None:
    name = c.name.lower().replace("_", "")
    if c.type not in TIME and not (c.type == "string" and re.search(r"_(at|date|time)$", c.name, re.I)):
        return None
    share = 1.0 if c.type in TIME else 0.9
    if name in ("createdat", "created"):
        return ("createdAt", 1.0 * share, "recent-timestamp", {"withinDays": 365})
    if name in ("updatedat", "updated", "modifiedat"):
        created = next((x.name for x in t.columns if x.name.lower().replace("_", "") == "createdat"), "created_at")
        return ("updatedAt", 1.0 * share, "dependent-timestamp", {"dependsOn": created})
    if name in ("deletedat", "deleted"):
        return ("deletedAt", 0.9 * share, "recent-timestamp", {"withinDays": 90})
    if re.search(r"(at|date|time)$", name):
        return ("timestamp", 0.9 * share, "recent-timestamp", {"withinDays": 365})
    return None


def place_rule(c: Column, t: Table, s: Schema) -> Guess | None:
    if c.type != "float":
        return None
    place = lambda name: (m[1] or "", "lat" if m[2] else "lng") if (m := re.fullmatch(r"(.*_)?(?:(lat(?:itude)?)|lng|lon|longitude)", name, re.I)) else None
    own = place(c.name)
    if not own:
        return None
    prefix, axis = own
    other = next((x.name for x in t.columns if x.type == "float" and place(x.name) == (prefix, "lng" if axis == "lat" else "lat")), None)
    return ("latitude" if axis == "lat" else "longitude", 0.95 if other else 0.85, "lat-lng-pair", {"axis": axis} | ({"pair": other} if other else {}))


NAMED_IP = named(r"ip_address|ipv4|ipv6|^ip$", TEXT, "ip", 0.95, "ip")


def ip_rule(c: Column, t: Table, s: Schema) -> Guess | None:
    return NAMED_IP(c, t, s) or (("ip", 0.9, "ip", {}) if c.native.lower() in ("inet", "cidr") else None)


def slug_rule(c: Column, t: Table, s: Schema) -> Guess | None:
    if c.type != "string" or not re.search(r"(^|_)slug$", c.name, re.I):
        return None
    source = next((x.name for x in t.columns if x.name.lower() in ("name", "title")), None)
    return ("slug", 0.95 if source else 0.8, "derived-slug", {"sourceColumn": source} if source else {})


def text_rule(c: Column, t: Table, s: Schema) -> Guess | None:
    if c.type != "string" or not re.search(r"description|bio|notes?$|summary|content|body|comment|about", c.name, re.I):
        return None
    share = 0.9 if c.native.lower() == "text" else 0.85 if (c.max_length or 0) >= 100 else 0.7 if (c.max_length or 0) >= 50 else 0.65
    return ("longText", share, "longText", {})


def rating_rule(c: Column, t: Table, s: Schema) -> Guess | None:
    if c.type != "integer" or not re.search(r"rating|score|stars", c.name, re.I):
        return None
    return ("rating", 0.85, "bounded-integer", bounds(t, c.name) or {"min": 1, "max": 5})


# Priorities, name patterns, confidences and what they stand for.
#: The rules by priority.
RULES: list[tuple[int, Callable[[Column, Table, Schema], Guess | None]]] = [
    (100, enum_rule),
    (96, reference_rule),
    (95, check_rule),
    (90, uuid_rule),
    (85, named(r"^email$|_email$", TEXT, "email", 1.0, "email")),
    (84, named(r"phone|telephone|mobile|cell|contact_no", TEXT, "phone", 0.95, "phone")),
    (83, named(r"^first_?name$", TEXT, "firstName", 1.0, "firstName")),
    (83, named(r"^last_?name$|^surname$", TEXT, "lastName", 1.0, "lastName")),
    (83, named(r"^(full_?|author_?)?name$|^display_?name$", TEXT, "fullName", 1.0, "fullName")),
    (82, flag_rule),
    (81, time_rule),
    (80, named(r"price|amount|cost|total|balance|salary|fee|revenue|acctbal", NUMBER, "currency", 0.95, "log-normal-currency", {"mean": 4, "sd": 1.5})),
    (79, named(r"street|^address", TEXT, "street", 0.95, "street")),
    (79, named(r"^city$|town", TEXT, "city", 0.95, "city")),
    (79, named(r"^state$|province|region$", TEXT, "state", 0.95, "state")),
    (79, named(r"zip|postal", TEXT, "zip", 0.95, "zip")),
    (79, named(r"country", TEXT, "country", 0.95, "country")),
    (78, named(r"url|website|domain|link|href", TEXT, "url", 0.95, "url")),
    (77, ip_rule),
    (76, place_rule),
    (75, slug_rule),
    (74, named(r"avatar|photo|image|picture|thumbnail", TEXT, "image", 0.9, "imageUrl")),
    (73, text_rule),
    (71, named(r"quantity|count$|qty|stock|size$", ("integer",), "quantity", 0.85, "quantity")),
    (70, named(r"^sku$", TEXT, "sku", 0.9, "sku")),
    (69, rating_rule),
]


def classify(column: Column, table: Table, schema: Schema, least: float = 0.6) -> Match:
    """The first rule that applies, if it is sure enough; one that is not ends the search."""
    for _, rule in sorted(RULES, key=lambda r: -r[0]):
        if guess := rule(column, table, schema):
            meaning, confidence, kind, params = guess
            if confidence < least:
                break
            return Match(table.name, column.name, meaning, confidence, Field(kind, params, "inferred", confidence))
    return Match(table.name, column.name, None, 0.0, None)


def analyze(schema: Schema, least: float = 0.6) -> list[Match]:
    return [classify(c, t, schema, least) for t in schema.tables.values() for c in t.columns]


def coverage(matches: list[Match]) -> float:
    return sum(m.meaning is not None for m in matches) / len(matches) if matches else 1.0
