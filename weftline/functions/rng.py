"""Counter-based random numbers as column expressions.

Every cell has a stream of its own, named by the seed, the table, a purpose, a row number and a column. The stream's 32-bit
state is the FNV-1a hash of that path, so a value depends on nothing but its name: not on partitions, order or other tables.
The part of the path that is the same for all rows is hashed on the driver; draw k is a jump, not k steps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The FNV-1a constants, the generator's step, 32 bits.
OFFSET, PRIME, STEP, MASK = 2166136261, 16777619, 0x6D2B79F5, 0xFFFFFFFF
SEP = "\0"


@dataclass(frozen=True)
class State:
    """A stream's state that stands in a column of its own. What is drawn from it is plain arithmetic on that column, which the
    engine compiles, and of which it computes common parts once. Draws are kept, so that an expression is built once for all
    tables that name their columns alike."""

    name: str
    drawn: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def column(self) -> Column:
        return F.col(self.name)


@dataclass(frozen=True)
class Digits:
    """A part of a stream's path: the decimal digits of a column of whole numbers, none negative."""

    name: str


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it; without it expressions would grow as powers."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def units(text: str) -> list[int]:
    """UTF-16 code units."""
    raw = text.encode("utf-16-le")
    return [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]


def fnv(text: str, state: int = OFFSET) -> int:
    for u in units(text):
        state = (state ^ u) * PRIME & MASK
    return state


def step(state: Column, unit: Column | int) -> Column:
    return (state.bitwiseXOR(unit) * PRIME).bitwiseAND(MASK)


def fold_text(state: Column | int, text: str) -> Column:
    """state after the characters of a fixed text."""
    out = F.lit(state).cast("long") if isinstance(state, int) else state
    for u in units(text):
        out = step(out, u)
    return out


def fold_column(state: Column | int, column: Column) -> Column:
    """state after the characters of a string column (of the basic plane)."""
    start = F.lit(state).cast("long") if isinstance(state, int) else state
    letters = F.filter(F.split(column.cast("string"), ""), lambda c: c != "")
    return F.aggregate(letters, start, lambda h, c: step(h, F.ascii(c).cast("long")))


def stream(seed: int | str, *path: str | Column | Digits) -> Column:
    """The state of the stream with this path; parts may be columns, or digits of columns."""
    state: Column | int = fnv(str(seed))
    for part in path:
        if isinstance(part, (Column, Digits)):
            state = fnv(SEP, state) if isinstance(state, int) else fold_text(state, SEP)
            state = fold_column(state, F.col(part.name) if isinstance(part, Digits) else part)
        else:
            state = fnv(SEP + part, state) if isinstance(state, int) else fold_text(state, SEP + part)
    return F.lit(state).cast("long") if isinstance(state, int) else state


def multiply(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of 32-bit numbers, without leaving 64."""
    low = a.bitwiseAND(0xFFFF) * b
    high = (F.shiftright(a, 16) * b).bitwiseAND(0xFFFF) * 65536
    return (low + high).bitwiseAND(MASK)


def bits(state: Column | State, draw: int = 1) -> Column:
    """The 32-bit output of the stream's draw, counted from 1."""
    leaf = isinstance(state, State)
    if leaf and draw in state.drawn:
        return state.drawn[draw]
    once = (lambda value, body: body(value)) if leaf else let
    jumped = ((state.column if leaf else state) + (draw * STEP & MASK)).bitwiseAND(MASK)
    turn = lambda t: (t + multiply(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(61))).bitwiseAND(MASK)
    out = once(once(once(jumped, lambda s: s.bitwiseXOR(F.shiftright(s, 15))), turn), lambda t: t.bitwiseXOR(F.shiftright(t, 14)))
    if leaf:
        state.drawn[draw] = out
    return out


def uniform(state: Column | State, draw: int = 1) -> Column:
    """A double in [0, 1)."""
    return bits(state, draw) / 4294967296.0


def number(seed: int | str, *path: str) -> float:
    """The first draw of a fixed path, on the driver."""
    s = (fnv(SEP.join([str(seed), *path])) + STEP) & MASK
    t = s ^ s >> 15
    t = t + (t ^ t >> 7) * (t | 61) & MASK
    return ((t ^ t >> 14) & MASK) / 4294967296
