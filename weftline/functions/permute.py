"""A keyed permutation of the numbers below a size, as column expressions: what makes a column unique without looking at it.

A number below a * b is a pair of digits; each round adds to one digit, modulo its base, a hash of the other, which can be undone,
so that different numbers stay different (an unbalanced Feistel network). What lands at or beyond the size is put through again
until it lies below it (cycle walking). How often that can happen is found on the driver, since only the few numbers between the size and
a * b can be passed on the way.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.rng import MASK, SEP, STEP, bits, fnv, let

ROUNDS = 3
#: Tells the key of a round's second half from that of its first.
OTHER = 0x5BD1E995
#: Spreads a digit over the hash's 32 bits.
SPREAD = 0x9E3779B1
#: Numbers of this size and below are permuted; beyond it digits would not fit the hash.
MOST = 1 << 53


@functools.cache
def bases(size: int) -> tuple[int, int]:
    """a <= b, not far from each other, with a * b at or a little beyond size: the best of some ten thousand choices of a."""
    root = math.isqrt(size - 1) + 1 if size > 1 else 1
    a = np.unique(np.linspace(max(1, root // 2), root, 1 << 16).astype(np.int64))
    b = -(-size // a)
    best = int(np.argmin(a * b - size))
    return int(a[best]), int(b[best])


def keys(seed: int | str, *path: str) -> list[int]:
    start = fnv(SEP.join([str(seed), *path]))
    return [fnv(f"{SEP}{r}", start) for r in range(ROUNDS)]


def once(x: Column, a: int, b: int, rounds: list[int]) -> Column:
    """x, below a * b, put through the network."""
    add = lambda digit, other, key, base: (digit + bits((other * SPREAD + key).bitwiseAND(MASK))) % base
    pair = lambda high, low: F.struct(high.alias("high"), low.alias("low"))

    def turn(at: Column, key: Column) -> Column:
        high, low = at["high"], at["low"]
        return let(add(high, low, key, a), lambda new: pair(new, add(low, new, key.bitwiseXOR(OTHER), b)))

    start = let(x, lambda v: pair(((v - v % b) / b).cast("long"), (v % b).cast("long")))
    return F.aggregate(F.lit(rounds).cast("array<bigint>"), start, turn, lambda at: at["high"] * b + at["low"])


def numbers(x: np.ndarray, a: int, b: int, rounds: list[int]) -> np.ndarray:
    """once, of whole numbers on the driver."""
    high, low = x // b, x % b

    def hashed(digit: np.ndarray, key: int) -> np.ndarray:
        mask = np.uint64(MASK)
        s = (digit.astype(np.uint64) * np.uint64(SPREAD) + np.uint64((key + STEP) & MASK)) & mask
        t = s ^ s >> np.uint64(15)
        t = (t + ((t ^ t >> np.uint64(7)) * (t | np.uint64(61)) & mask)) & mask
        return (t ^ t >> np.uint64(14)).astype(np.int64)

    for key in rounds:
        high = (high + hashed(low, key)) % a
        low = (low + hashed(high, key ^ OTHER)) % b
    return high * b + low


@functools.cache
def walks(size: int, rounds: tuple[int, ...]) -> int:
    """How often at most a number below size has to be put through again. Only numbers at or beyond size are followed, from where
    the others can enter among them: a walk from there ends below size."""
    a, b = bases(size)
    beyond = np.arange(size, a * b)
    at = np.setdiff1d(beyond, numbers(beyond, a, b, list(rounds)))
    steps = 0
    while len(at):
        at = numbers(at, a, b, list(rounds))
        at = at[at >= size]
        steps += 1
    return steps


def permuted(x: Column, size: int, seed: int | str, *path: str) -> Column:
    """The place of x, below size, in a permutation of the numbers below size that seed and path name."""
    if not 0 < size <= MOST:
        raise ValueError(f"no permutation of {size} numbers")
    (a, b), rounds = bases(size), keys(seed, *path)
    out, again = once(x, a, b, rounds), walks(size, tuple(rounds))
    if not again:
        return out
    return F.aggregate(F.lit([0] * again), out, lambda v, _: F.when(v < size, v).otherwise(once(v, a, b, rounds)))
