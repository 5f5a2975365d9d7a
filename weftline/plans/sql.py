"""DuckDB SQL for the random numbers, written apart from the column expressions: what the queries' oracles are made of."""

from __future__ import annotations

M = 4294967296


def units(part: str) -> str:
    """The code units of an SQL expression's characters."""
    return f"list_transform(string_split({part}, ''), lambda c: unicode(c)::BIGINT)"


def state(*path: str) -> str:
    """The stream's state; parts are SQL expressions of strings."""
    joined = units(path[0])
    for p in path[1:]:
        joined = f"list_concat(list_concat({joined}, [0::BIGINT]), {units(p)})"
    return f"list_reduce(list_prepend(2166136261::BIGINT, {joined}), lambda h, c: (xor(h, c) * 16777619) % {M})"


def draws(source: str, columns: str, path: tuple[str, ...], n: int = 1) -> str:
    """A query with columns of source, the state s, the outputs x1 ... xn and the uniform numbers u1 ... un."""
    numbers = range(1, n + 1)
    step = ", ".join(f"(s + {k * 0x6D2B79F5}) % {M} AS a{k}" for k in numbers)
    second = ", ".join(f"xor(a{k}, a{k} >> 15) AS b{k}" for k in numbers)
    third = ", ".join(f"((b{k} + ((xor(b{k}, b{k} >> 7)::HUGEINT * (b{k} | 61)) % {M})::BIGINT) % {M}) AS c{k}" for k in numbers)
    last = ", ".join(f"xor(c{k}, c{k} >> 14) AS x{k}" for k in numbers)
    share = ", ".join(f"x{k} / {M}.0::DOUBLE AS u{k}" for k in numbers)
    return f"(SELECT *, {share} FROM (SELECT *, {last} FROM (SELECT *, {third} FROM (SELECT *, {second} FROM (SELECT *, {step} FROM (SELECT {columns}, {state(*path)} AS s FROM {source}))))))"


def permuted(source: str, row: str, size: int, path: tuple[str, ...]) -> str:
    """A query of source's rows with x, the place of row in the permutation of the numbers below size that path names; for sizes
    that are a product of two whole numbers near their root."""
    from weftline.functions.permute import OTHER, SPREAD, bases, keys, walks

    (a, b), rounds = bases(size), keys(path[0], *path[1:])
    if walks(size, tuple(rounds)):
        raise ValueError("only sizes without a second walk")
    out = f"(SELECT *, {row} // {b} AS high, {row} % {b} AS low FROM {source})"
    for key in rounds:
        for digit, other, base, k in (("high", "low", a, key), ("low", "high", b, key ^ OTHER)):
            hashed = draws_of(f"({other} * {SPREAD} + {k}) % {M}", out)
            out = f"(SELECT * EXCLUDE ({digit}, h), ({digit} + h) % {base} AS {digit} FROM {hashed})"
    return f"(SELECT * EXCLUDE (high, low), high * {b} + low AS x FROM {out})"


def draws_of(state: str, source: str) -> str:
    """source with h, the first output of a stream with this state."""
    a = f"(SELECT *, ({state} + {0x6D2B79F5}) % {M} AS t0 FROM {source})"
    b = f"(SELECT *, xor(t0, t0 >> 15) AS t1 FROM {a})"
    c = f"(SELECT *, (t1 + ((xor(t1, t1 >> 7)::HUGEINT * (t1 | 61)) % {M})::BIGINT) % {M} AS t2 FROM {b})"
    return f"(SELECT * EXCLUDE (t0, t1, t2), xor(t2, t2 >> 14) AS h FROM {c})"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"
