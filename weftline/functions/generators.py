"""Column generators by kind: parameters and a stream's state give a column. Plugins may register more."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import words
from weftline.functions.distributions import exponential, half_up, normal, pareto_int, recency, uniform_int, uniform_real, weighted, zipf
from weftline.functions.rng import MASK, STEP, State, bits, let, uniform

WEEK_MS = 7 * 86_400_000


@dataclass
class Context:
    """What a generator may use besides its stream: the row's other columns by name, and the run's reference time."""

    reference_ms: int
    columns: dict[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class Kind:
    make: Callable[[dict, Column, Context], Column]
    #: Logical types it fits; * fits all.
    types: tuple[str, ...]
    #: How many different values it can give; None if without bound, -1 if unknown.
    distinct: Callable[[dict], int | None]
    #: Its nth value, from 0, all different: what a unique column is made of. None if values cannot be numbered.
    nth: Callable[[dict, Column], Column] | None = None
    #: Whether make is a function of Arrow arrays, which cannot stand inside other expressions' functions.
    arrow: bool = False


KINDS: dict[str, Kind] = {}


def register(*names: str, types: tuple[str, ...] = ("*",), distinct: Callable[[dict], int | None] = lambda p: -1, nth: Callable[[dict, Column], Column] | None = None):
    """Registers a generator under its names. With nth, distinct must say exactly how many values there are."""

    def add(fn):
        for name in names:
            KINDS[name] = Kind(fn, types, distinct, nth)
        return fn

    return add


def register_arrow(name: str, returns: str, types: tuple[str, ...] = ("*",), distinct: Callable[[dict], int | None] = lambda p: -1):
    """Registers a generator in Python: its function gets the parameters and an Arrow array of stream states, a batch of rows at a time,
    and gives an array of as many values of the Spark type returns. random_numbers draws from the states."""

    def add(fn):
        def make(params: dict, state: Column, context: Context) -> Column:
            return F.arrow_udf(lambda states: fn(params, states), returns)(state)

        KINDS[name] = Kind(make, types, distinct, arrow=True)
        return fn

    return add


def random_numbers(states, draw: int = 1):
    """The numbers, from 0 to below 1, that uniform draws from the states, as a numpy array."""
    import numpy as np

    mask = np.uint64(MASK)
    s = (np.asarray(states).astype(np.uint64) + np.uint64(draw * STEP & MASK)) & mask
    t = s ^ s >> np.uint64(15)
    t = (t + ((t ^ t >> np.uint64(7)) * (t | np.uint64(61)) & mask)) & mask
    return (t ^ t >> np.uint64(14)) / 4294967296.0


def generate(kind: str, params: dict[str, Any], state: Column | State, context: Context) -> Column:
    name = kind.removeprefix("faker.") if kind.startswith("faker.") else kind
    if name not in KINDS:
        raise ValueError(f"unknown generator {kind!r}")
    make = KINDS[name].make
    if KINDS[name].arrow:
        return make(params, state.column if isinstance(state, State) else state, context)
    if isinstance(state, State):  # generators from elsewhere get the column itself
        return make(params, state if make.__module__ == __name__ and name != "derived" else state.column, context)
    return let(state, lambda s: make(params, s, context))


def pick(state: Column, values: list, draw: int = 1) -> Column:
    return F.element_at(F.lit(values), (F.floor(uniform(state, draw) * len(values)) + 1).cast("int"))


def digits(n: Column, *bases: int) -> list[Column]:
    """The digits of a number below the product of the bases, the highest first."""
    out = []
    for b in reversed(bases):
        out.append(n % b)
        n = ((n - n % b) / b).cast("long")
    return out[::-1]


def at(values: list, n: Column) -> Column:
    return F.element_at(F.lit(values), (n + 1).cast("int"))


def hex8(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 8, "0")


NAMES = (words.FIRST, words.LAST)
LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def email_of(first: Column, last: Column, tag: Column, domain: Column) -> Column:
    return F.concat(F.lower(first), F.lit("."), F.lower(last), hex8(tag), F.lit("@"), domain)


def nth_email(params: dict, n: Column) -> Column:
    first, last, domain, tag = digits(n, len(words.FIRST), len(words.LAST), len(words.DOMAINS), 1 << 32)
    return email_of(at(words.FIRST, first), at(words.LAST, last), tag, at(words.DOMAINS, domain))


def phone_of(first: Column, last: Column) -> Column:
    return F.concat(F.lit("+1-555-"), F.lpad(first.cast("string"), 3, "0"), F.lit("-"), F.lpad(last.cast("string"), 4, "0"))


def nth_ip(params: dict, n: Column) -> Column:
    first, *rest = digits(n, 254, 255, 255, 255)
    return F.concat_ws(".", (first + 1).cast("string"), *[d.cast("string") for d in rest])


@register("uuid", types=("uuid", "string"), distinct=lambda p: None)
def uuid(params: dict, state: Column, context: Context) -> Column:
    """Four draws give 32 hexadecimal digits; the version digit is 4 and a fifth draw gives the variant digit."""
    variant = F.substring(F.lit("89ab"), (F.floor(uniform(state, 5) * 4) + 1).cast("int"), F.lit(1))
    first, second, third, fourth = (hex8(bits(state, k)) for k in range(1, 5))
    return F.concat_ws("-", first, F.substring(second, 1, 4), F.concat(F.lit("4"), F.substring(second, 6, 3)), F.concat(variant, F.substring(third, 2, 3)), F.concat(F.substring(third, 5, 4), fourth))


@register("weighted-categorical", "enum", types=("string", "enum"), distinct=lambda p: len(set(p.get("values") or p.get("enumValues") or ())), nth=lambda p, n: at(list(dict.fromkeys(p.get("values") or p.get("enumValues"))), n))
def categorical(params: dict, state: Column, context: Context) -> Column:
    """values: a mapping of weights, or a list of equals (with weights, a list, if given); enumValues: a list of equals."""
    values = params.get("values") or params.get("enumValues")
    if not values:
        raise ValueError("weighted-categorical needs values or enumValues")
    if not isinstance(values, dict):
        values = dict(zip(values, params.get("weights") or [1] * len(values), strict=True))
    return weighted(state, values)


@register("bounded-integer", "uniformInt", types=("integer", "float"), distinct=lambda p: p.get("max", 100) - p.get("min", 0) + 1, nth=lambda p, n: n + p.get("min", 0))
def bounded_integer(params: dict, state: Column, context: Context) -> Column:
    return uniform_int(state, params.get("min", 0), params.get("max", 100))


@register("quantity", "number.int", types=("integer",), distinct=lambda p: p.get("max", 10) - p.get("min", 1) + 1, nth=lambda p, n: n + p.get("min", 1))
def quantity(params: dict, state: Column, context: Context) -> Column:
    return uniform_int(state, params.get("min", 1), params.get("max", 10))


@register("uniformReal", "float", types=("float",), distinct=lambda p: None)
def real(params: dict, state: Column, context: Context) -> Column:
    return uniform_real(state, params.get("min", 0.0), params.get("max", 1.0))


@register("pareto", "paretoInt", types=("integer", "float"), distinct=lambda p: p.get("max", 100) - p.get("min", 1) + 1)
def pareto(params: dict, state: Column, context: Context) -> Column:
    return pareto_int(state, params.get("min", 1), params.get("max", 100), params.get("alpha", 1.5))


@register("exponential", types=("float",), distinct=lambda p: None)
def exponential_kind(params: dict, state: Column, context: Context) -> Column:
    return exponential(state, params.get("rate", 1.0))


@register("normal", types=("float",), distinct=lambda p: None)
def normal_kind(params: dict, state: Column, context: Context) -> Column:
    return normal(state, params.get("mean", 0.0), params.get("sd", 1.0))


@register("zipf", types=("integer",), distinct=lambda p: p.get("n", 10))
def zipf_kind(params: dict, state: Column, context: Context) -> Column:
    return zipf(state, params.get("n", 10), params.get("s", 1.0))


@register("boolean", "boolean-skewed", types=("boolean", "integer"), distinct=lambda p: 2, nth=lambda p, n: n == 1)
def boolean(params: dict, state: Column, context: Context) -> Column:
    return uniform(state) < float(params.get("probability", params.get("skew", 0.5)))


@register("recent-timestamp", "timestamp", types=("timestamp", "date", "string"), distinct=lambda p: 1_000_000)
def recent_timestamp(params: dict, state: Column, context: Context) -> Column:
    return F.timestamp_millis(recency(state, params.get("withinDays", 365), params.get("weighted", "recent"), context.reference_ms))


@register("dependent-timestamp", types=("timestamp", "date", "string"), distinct=lambda p: 1_000_000)
def dependent_timestamp(params: dict, state: Column, context: Context) -> Column:
    """Up to maxOffsetMs after another column, or after thirty days before the reference where that is null."""
    base = context.columns.get(params.get("dependsOn", "created_at"))
    start = F.lit(context.reference_ms - 30 * 86_400_000).cast("long")
    if base is not None:
        start = F.coalesce(F.unix_millis(base.cast("timestamp")), start)
    return F.timestamp_millis((start + uniform(state) * float(params.get("maxOffsetMs", WEEK_MS))).cast("long"))


@register("log-normal-currency", "currency", types=("float", "integer"), distinct=lambda p: None)
def currency(params: dict, state: Column, context: Context) -> Column:
    return half_up(F.exp(normal(state, params.get("mean", 4), params.get("sd", 1.5))) * 100) / 100


@register("lat-lng-pair", types=("float",), distinct=lambda p: None)
def coordinate(params: dict, state: Column, context: Context) -> Column:
    most = 90.0 if params.get("axis", "lat") in ("lat", "latitude") else 180.0
    return uniform_real(state, -most, most)


@register("derived-slug", "slug", types=("string",))
def slug(params: dict, state: Column, context: Context) -> Column:
    source = context.columns.get(params.get("sourceColumn", ""))
    if source is None:
        return F.concat_ws("-", pick(state, words.WORDS, 1), pick(state, words.WORDS, 2))
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.lower(source.cast("string")), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


@register("derived", types=("*",))
def derived(params: dict, state: Column, context: Context) -> Column:
    """fn(columns, state, context) returns a column."""
    return params["fn"](context.columns, state, context)


@register("constant", types=("*",), distinct=lambda p: 1)
def constant(params: dict, state: Column, context: Context) -> Column:
    return F.lit(params.get("value"))


@register("faker", types=("*",))
def by_method(params: dict, state: Column, context: Context) -> Column:
    """The generator that method names, with args as its parameters; a text that says so where there is none."""
    name = params.get("method", "").removeprefix("faker.")
    if name not in KINDS or KINDS[name].arrow:
        return F.lit(f"[unresolved-faker:{name}]")
    return KINDS[name].make(params.get("args", {}), state, context)


@register("path", types=("*",), distinct=lambda p: -1)
def at_path(params: dict, state: Column, context: Context) -> Column:
    """What lies at a dotted path of another column, sourceColumn: fields of structs, or of a JSON text (json); null where there is none."""
    source = context.columns.get(params["sourceColumn"])
    if source is None:
        return F.lit(None)
    if params.get("json"):
        return F.get_json_object(source, "$." + params["path"])
    for part in params["path"].split("."):
        source = source.getField(part)
    return source


@register("firstName", "person.firstName", types=("string",), distinct=lambda p: len(words.FIRST), nth=lambda p, n: at(words.FIRST, n))
def first_name(params: dict, state: Column, context: Context) -> Column:
    return pick(state, words.FIRST)


@register("lastName", "person.lastName", types=("string",), distinct=lambda p: len(words.LAST), nth=lambda p, n: at(words.LAST, n))
def last_name(params: dict, state: Column, context: Context) -> Column:
    return pick(state, words.LAST)


@register("fullName", "person.fullName", types=("string",), distinct=lambda p: len(words.FIRST) * len(words.LAST), nth=lambda p, n: F.concat_ws(" ", *map(at, NAMES, digits(n, *map(len, NAMES)))))
def full_name(params: dict, state: Column, context: Context) -> Column:
    return F.concat_ws(" ", pick(state, words.FIRST, 1), pick(state, words.LAST, 2))


@register("email", "internet.email", types=("string",), distinct=lambda p: len(words.FIRST) * len(words.LAST) * len(words.DOMAINS) << 32, nth=nth_email)
def email(params: dict, state: Column, context: Context) -> Column:
    return email_of(pick(state, words.FIRST, 1), pick(state, words.LAST, 2), bits(state, 3), pick(state, words.DOMAINS, 4))


@register("phone", "phone.number", types=("string",), distinct=lambda p: 10_000_000, nth=lambda p, n: phone_of(*digits(n, 1000, 10_000)))
def phone(params: dict, state: Column, context: Context) -> Column:
    return phone_of(uniform_int(state, 0, 999, 1), uniform_int(state, 0, 9999, 2))


@register("street", "location.streetAddress", types=("string",))
def street(params: dict, state: Column, context: Context) -> Column:
    return F.concat_ws(" ", uniform_int(state, 1, 999, 1).cast("string"), pick(state, words.STREETS, 2), F.lit("Street"))


@register("city", "location.city", types=("string",), distinct=lambda p: len(words.CITIES), nth=lambda p, n: at([c[0] for c in words.CITIES], n))
def city(params: dict, state: Column, context: Context) -> Column:
    return pick(state, [c[0] for c in words.CITIES])


@register("state", "location.state", types=("string",), distinct=lambda p: len(words.STATES), nth=lambda p, n: at(words.STATES, n))
def state_name(params: dict, state: Column, context: Context) -> Column:
    return pick(state, words.STATES)


@register("country", "location.country", types=("string",))
def country(params: dict, state: Column, context: Context) -> Column:
    return pick(state, sorted({c[2] for c in words.CITIES}))


@register("zip", "location.zipCode", types=("string",), distinct=lambda p: 100_000, nth=lambda p, n: F.lpad(n.cast("string"), 5, "0"))
def zip_code(params: dict, state: Column, context: Context) -> Column:
    return F.lpad(uniform_int(state, 0, 99_999).cast("string"), 5, "0")


@register("url", "internet.url", types=("string",))
def url(params: dict, state: Column, context: Context) -> Column:
    return F.concat(F.lit("https://"), pick(state, words.DOMAINS, 1), F.lit("/"), pick(state, words.WORDS, 2))


@register("imageUrl", "image.url", types=("string",))
def image_url(params: dict, state: Column, context: Context) -> Column:
    return F.concat(F.lit("https://"), pick(state, words.DOMAINS, 1), F.lit("/"), hex8(bits(state, 2)), F.lit(".png"))


@register("ip", "internet.ip", types=("string",), distinct=lambda p: 254 * 255**3, nth=nth_ip)
def ip(params: dict, state: Column, context: Context) -> Column:
    return F.concat_ws(".", *[uniform_int(state, 1 if k == 1 else 0, 254, k).cast("string") for k in range(1, 5)])


@register("longText", "lorem.paragraph", "lorem.sentence", types=("string",))
def long_text(params: dict, state: Column, context: Context) -> Column:
    n = int(params.get("count", 12))
    return F.concat(F.initcap(pick(state, words.WORDS, 1)), F.lit(" "), F.concat_ws(" ", *[pick(state, words.WORDS, k) for k in range(2, n + 1)]), F.lit("."))


@register("word", "lorem.word", "commerce.productName", types=("string",), distinct=lambda p: len(words.WORDS) ** 2, nth=lambda p, n: F.concat_ws(" ", *[F.initcap(at(words.WORDS, d)) for d in digits(n, *[len(words.WORDS)] * 2)]))
def word(params: dict, state: Column, context: Context) -> Column:
    return F.concat_ws(" ", F.initcap(pick(state, words.WORDS, 1)), F.initcap(pick(state, words.WORDS, 2)))


@register("sku", "string.alphanumeric", types=("string",), distinct=lambda p: min(36 ** int(p.get("length", 8)), 2**53), nth=lambda p, n: F.concat(*[F.substring(F.lit(LETTERS), (d + 1).cast("int"), F.lit(1)) for d in digits(n, *[36] * int(p.get("length", 8)))]))
def alphanumeric(params: dict, state: Column, context: Context) -> Column:
    return F.concat(*[F.substring(F.lit(LETTERS), uniform_int(state, 1, 36, k).cast("int"), F.lit(1)) for k in range(1, int(params.get("length", 8)) + 1)])


@register("geo.city", types=("*",))
def geo_city(params: dict, state: Column, context: Context) -> Column:
    """A city as a struct; country or countryCode narrows the choice, and where none is left all are."""
    pool = [c for c in words.CITIES if params.get("country") in (None, c[2]) and params.get("countryCode") in (None, c[3])] or words.CITIES
    names = ("city", "region", "country", "code", "lat", "lng")
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, c, strict=True)]) for c in pool])
    return F.element_at(rows, uniform_int(state, 1, len(pool)).cast("int"))


def alias_table(weights: list[float]) -> tuple[list[float], list[int]]:
    """For each choice the share of its cell that is its own, and the choice that has the rest: two draws choose by weight, however
    many choices there are."""
    n, total = len(weights), math.fsum(weights)
    if not total > 0 or min(weights) < 0:
        raise ValueError("weights must have a positive sum and none below 0")
    share, other = [w * n / total for w in weights], list(range(n))
    small, large = ([i for i, x in enumerate(share) if (x < 1) == low] for low in (True, False))
    while small and large:
        i, j = small.pop(), large.pop()
        other[i] = j
        share[j] -= 1 - share[i]
        (small if share[j] < 1 else large).append(j)
    for i in small + large:
        share[i] = 1.0
    return share, other


@register("choice", types=("*",), distinct=lambda p: len(p.get("rows", ())))
def choice(params: dict, state: Column, context: Context) -> Column:
    """One of rows, mappings with the same names, as a struct: what belongs together stays together. weight names the field that holds
    weights; without it all are equal."""
    rows = params["rows"]
    share, other = alias_table([float(r[params["weight"]]) if params.get("weight") else 1.0 for r in rows])
    cell = (F.floor(uniform(state, 1) * len(rows)) + 1).cast("int")
    chosen = F.when(uniform(state, 2) < F.element_at(F.lit(share), cell), cell).otherwise(F.element_at(F.lit(other), cell) + 1)
    return F.element_at(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in r.items()]) for r in rows]), chosen)


def unique_value(kind: str, params: dict[str, Any], n: Column) -> Column:
    """The nth value of a kind whose values can be numbered; n is computed once."""
    return let(n, lambda i: KINDS[kind.removeprefix("faker.")].nth(params, i))


def numbered_values(kind: str, params: dict) -> int | None:
    """How many values a kind has whose values can be numbered; None of other kinds."""
    found = KINDS.get(kind.removeprefix("faker."))
    return found.distinct(params) if found and found.nth else None


def distinct_values(kind: str, params: dict) -> int | None:
    """An estimate of how many values a generator has: None without bound, -1 unknown."""
    return KINDS[kind].distinct(params) if kind in KINDS else -1
