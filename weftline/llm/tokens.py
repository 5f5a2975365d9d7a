"""Vectorised bytes, words and n-grams of Arrow string columns, for use inside Spark tasks.

Texts of a batch are handled as one byte buffer with offsets, in slices of bounded size, so that memory does not follow the
batch and no Python loop runs over words. A text longer than a slice makes a slice of its own.

A hash of a stretch of bytes is a difference of prefix sums of ``TABLE[byte] * BASE**i``, divided by ``BASE**start``; it is
the same wherever the stretch stands, in every task and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
TABLE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_B
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept for the slice size, made anew for longer texts."""
    size = max(n, SLICE_BYTES + 1)
    if base not in _powers or len(_powers[base]) < size:
        out = np.full(size, np.uint64(base % (1 << 64)))
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a sequence of 64-bit values, for span_hash."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch [start, end) of the sequence that sums was made from."""
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts])


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows and of the end) of bounded stretches; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8).copy()
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    if texts.null_count:  # what stands under a null is not looked at
        kept = texts.fill_null(b"")
        offsets = np.frombuffer(kept.buffers()[1], np.int64, n + 1, kept.offset * 8).copy()
        data = np.frombuffer(kept.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without bytes of space), and the index of the first word of each row and of the end."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~space[data]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix(TABLE[data]), starts, ends)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from the index of each row's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word sequences within rows, and each one's row. short: a row of 1 to n-1 words counts as one sequence."""
    rows = row_of(first)
    ends = first[1:][rows]
    at = np.arange(len(hashes))
    whole = at + n <= ends
    if short:
        whole |= (at == first[:-1][rows]) & (ends - at < n)
    starts = at[whole]
    return span_hash(prefix(hashes), starts, np.minimum(starts + n, ends[whole])), rows[whole]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
