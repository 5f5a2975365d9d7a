"""Whether a configuration has the shape that plans are built from: kinds and ranges of its values, before any table is looked at."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

Check = Callable[[Any, str], Iterator[str]]


def number(low: float | None = None, high: float | None = None, whole: bool = False, above: bool = False) -> Check:
    """A number from low (above: beyond it) to high."""

    def check(value: Any, at: str) -> Iterator[str]:
        if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)):
            yield f"{at}: a {'whole ' if whole else ''}number is needed, not {value!r}"
        elif low is not None and (value < low or above and value == low) or high is not None and value > high:
            yield f"{at}: {value} is not {'above' if above else 'at least'} {low}" + (f" and at most {high}" if high is not None else "")

    return check


def of(kind: type | tuple, said: str) -> Check:
    def check(value: Any, at: str) -> Iterator[str]:
        if not isinstance(value, kind):
            yield f"{at}: {said} is needed, not {value!r}"

    return check


def one_of(*values: Any) -> Check:
    def check(value: Any, at: str) -> Iterator[str]:
        if value not in values:
            yield f"{at}: {value!r} is none of {', '.join(map(str, values))}"

    return check


def one_of_texts(*values: str) -> Check:
    return lambda value, at: one_of(*values)(value if isinstance(value, str) else repr(value), at)


def either(*checks: Check) -> Check:
    """The issues of none, if one of the checks has none; else those of the last."""

    def check(value: Any, at: str) -> Iterator[str]:
        found = [list(c(value, at)) for c in checks]
        if all(found):
            yield from found[-1]

    return check


def each(check_one: Check, kind: type = dict) -> Check:
    def check(value: Any, at: str) -> Iterator[str]:
        if not isinstance(value, (list, tuple) if kind is list else kind):
            yield f"{at}: a {'list' if kind is list else 'mapping'} is needed, not {value!r}"
            return
        for k, v in enumerate(value) if kind is list else value.items():
            yield from check_one(v, f"{at}[{k}]" if kind is list else f"{at}.{k}")

    return check


def fields(needed: tuple[str, ...] = (), **checks: Check) -> Check:
    """A mapping; what it has besides is not looked at, and None is as good as nothing."""

    def check(value: Any, at: str) -> Iterator[str]:
        if not isinstance(value, dict):
            yield f"{at or 'the configuration'}: a mapping is needed, not {value!r}"
            return
        yield from (f"{at}: {k} is missing" for k in needed if k not in value)
        for k, c in checks.items():
            if value.get(k) is not None:
                yield from c(value[k], f"{at}.{k}" if at else k)

    return check


TEXT, SHARE = of(str, "a text"), number(0, 1)
ANY: Check = lambda value, at: iter(())
GENERATOR = either(TEXT, of(Callable, "a function"), lambda v, at: fields(("kind",), kind=TEXT, nullProbability=SHARE)(v, at) if not hasattr(v, "kind") else iter(()))
COUNT = either(number(0, whole=True), one_of("timeline"), fields(("kind",), kind=TEXT))
PERSONA = fields(("name", "weight"), name=TEXT, weight=number(0), overrides=each(ANY), cascades=each(number(0)))
GROWTH = one_of("linear", "compound", "scurve")
SEASON = either(of(Callable, "a function"), one_of_texts("holiday"), each(number(0)))
TIMELINE = fields(("start_ms", "end_ms"), start_ms=number(), end_ms=number(), growth=GROWTH, rate=number(0), jitter=SHARE, total_growth=number(0, above=True), steepness=number(0, above=True), inflection=SHARE, season=SEASON)
TABLE = fields(count=COUNT, columns=each(GENERATOR), parent=TEXT, countPerParent=COUNT, personas=each(PERSONA, list), timeline=TIMELINE, churnRate=number(0), rows=each(of(dict, "a mapping"), list))
CONNECTION = fields(dialect=one_of("files", "postgres", "mysql", "sqlite", "jdbc", "documents"), url=TEXT, database=TEXT, port=number(1, 65535, whole=True))
CONFIG = fields(tables=each(TABLE), connection=CONNECTION, seed=either(number(whole=True), TEXT), referenceMs=number(), nullProbability=either(one_of("by type"), SHARE))


def shape_issues(config: Any) -> list[str]:
    """Everything about a configuration's shape that is wrong, each with the place where it stands."""
    return list(CONFIG(config, ""))
