"""Distributions as column expressions of a stream's state; each says how many draws it takes."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.rng import State, let, uniform

DAY_MS = 86_400_000


def half_up(x: Column) -> Column:
    """Rounds to the nearest whole number, halves towards positive infinity."""
    return F.floor(x + 0.5)


def uniform_int(state: Column | State, low: int, high: int, draw: int = 1) -> Column:
    return (F.floor(uniform(state, draw) * float(high - low + 1)) + F.lit(low)).cast("long")


def uniform_real(state: Column | State, low: float, high: float, draw: int = 1) -> Column:
    return uniform(state, draw) * (high - low) + low


def weighted(state: Column | State, weights: Mapping[str, float], draw: int = 1) -> Column:
    """A key with probability in proportion to its weight, in the mapping's order."""
    total = math.fsum(weights.values())
    if not weights or not total > 0:
        raise ValueError("weights must have a positive sum")
    keys, below, steps = list(weights), 0.0, []
    for key in keys[:-1]:
        below += weights[key] / total
        steps.append((below, key))

    def choice(u: Column) -> Column:
        out = F.lit(keys[-1])
        for bound, key in reversed(steps):
            out = F.when(u < bound, F.lit(key)).otherwise(out)
        return out

    return let(uniform(state, draw), choice)


def pareto_int(state: Column | State, low: float, high: float, alpha: float, draw: int = 1) -> Column:
    """Bounded Pareto, rounded."""
    if not (0 < low <= high and alpha > 0):
        raise ValueError("pareto needs 0 < low <= high and a positive alpha")
    x = F.lit(low) * F.pow(1 - uniform(state, draw) * (1 - (low / high) ** alpha), F.lit(-1 / alpha))
    return F.least(F.greatest(half_up(x), F.lit(math.ceil(low))), F.lit(math.floor(high))).cast("long")


def exponential(state: Column | State, rate: float, draw: int = 1) -> Column:
    if not rate > 0:
        raise ValueError("the rate must be positive")
    return -F.log(F.greatest(1 - uniform(state, draw), F.lit(1e-16))) / rate


def normal(state: Column | State, mean: float, sd: float, draw: int = 1) -> Column:
    """Takes two draws; none if sd is 0."""
    if sd == 0:
        return F.lit(float(mean))
    u = F.greatest(uniform(state, draw), F.lit(1e-16))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(state, draw + 1)) * sd + mean


def zipf(state: Column | State, n: int, s: float, draw: int = 1) -> Column:
    """A rank from 1 to n with probability in proportion to rank ** -s. The distribution function is made once, on the driver;
    n is a parameter of the plan, not of the data."""
    parts = [k**-s for k in range(1, n + 1)]
    total, run, cdf = math.fsum(parts), 0.0, []
    for p in parts:
        run += p / total
        cdf.append(run)
    return let(uniform(state, draw), lambda u: F.least(F.size(F.filter(F.lit(cdf), lambda x: x <= u)) + 1, F.lit(n)).cast("long"))


def recency(state: Column | State, days: float, skew: str, reference_ms: int, draw: int = 1) -> Column:
    """Milliseconds since the epoch within days before the reference: skewed towards it, away from it, or uniform."""
    both = lambda: uniform(state, draw) * uniform(state, draw + 1)
    share = {"recent": both, "old": lambda: 1 - both(), "uniform": lambda: uniform(state, draw)}[skew]()
    return F.floor(F.lit(float(reference_ms)) - share * (days * DAY_MS)).cast("long")


def count_of(spec, state: Column | State) -> Column:
    """A number of rows by a specification: a number, or a mapping with kind and parameters."""
    if isinstance(spec, (int, float)):
        return F.lit(int(spec)).cast("long")
    kind = spec["kind"]
    if kind in ("pareto", "paretoInt"):
        return pareto_int(state, spec.get("min", 1), spec.get("max", 100), spec.get("alpha", 1.5))
    if kind == "uniformInt":
        return uniform_int(state, spec.get("min", 0), spec.get("max", 10))
    if kind == "exponential":
        return half_up(exponential(state, spec.get("rate", 0.1))).cast("long")
    if kind == "normal":
        return F.greatest(half_up(normal(state, spec.get("mean", 10), spec.get("sd", 2))), F.lit(0)).cast("long")
    if kind == "zipf":
        return zipf(state, spec.get("n", 10), spec.get("s", 1.0))
    raise ValueError(f"unknown distribution {kind!r}")


def most(spec) -> int:
    """The largest count that a specification is expected to give, for checks before the run."""
    if isinstance(spec, (int, float)):
        return int(spec)
    kind = spec["kind"]
    return int({"uniformInt": spec.get("max", 10), "pareto": spec.get("max", 100), "paretoInt": spec.get("max", 100), "exponential": 50, "zipf": spec.get("n", 10)}.get(kind, 10))
