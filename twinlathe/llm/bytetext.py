"""Words and hashes of UTF-8 text, vectorised over the bytes of an Arrow column.

A column's texts lie one after another in a buffer with offsets. Every function here
works on that buffer, so no Python string is made. Buffers are walked in slices of
about ``SLICE`` bytes (a longer text forms a slice of its own), which bounds memory by
the longest text and not by the batch.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20


def tidy(f: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``f``, a generator over batches, that hands freed memory back to the system at its end.
    Workers are used again, and allocators would keep the most that any operator needed."""

    @functools.wraps(f)
    def run(*args):
        try:
            yield from f(*args)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_WHITE = ~WHITE

ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, SLICE + 1)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(n, base & _MASK, U64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=U64))
        if n > 8 * SLICE:  # only for one huge text: not kept
            return tables[0], tables[1]
        _powers, _inverses = tables
    return _powers, _inverses


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def span_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes."""
    n = len(text)
    powers, inverses = _power_tables(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE_VALUE[text] * powers[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverses[start] + (end - start).astype(U64))


class Words:
    """Words of the texts ``first`` to ``last`` of a column.

    start, end: byte positions in ``text`` (the slice's bytes, A-Z lowered);
    bounds[i]:bounds[i + 1] are the words of row i.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int, kind: np.ndarray = NOT_WHITE):
        base = int(offsets[first])
        self.text = LOWER[data[base : int(offsets[last])]]
        self.rows = last - first
        cut = offsets[first : last + 1] - base
        n = len(self.text)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = kind[self.text]
        edge = np.zeros(n + 1, bool)
        edge[cut] = True
        here, before = inside[1:], inside[:-1]
        self.start = np.flatnonzero(here & (~before | edge))
        self.end = np.flatnonzero(before & (~here | edge))
        self.bounds = np.searchsorted(self.start, cut)
        self.bounds[-1] = len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.text, self.start, self.end)

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the n words from each word on, whether they lie in one text)."""
        total = len(hashes)
        out = np.full(total, n, U64)
        whole = np.zeros(total, bool)
        if total >= n:
            acc = out[: total - n + 1]
            for k in range(n):
                acc = mix(acc * U64(0x9FB21C651E98DF25) + hashes[k : total - n + 1 + k])
            out[: total - n + 1] = acc
            row = np.repeat(np.arange(self.rows), np.diff(self.bounds))
            whole[: total - n + 1] = row[: total - n + 1] == row[n - 1 :]
        return out, whole

    def sequence(self, hashes: np.ndarray, row: int) -> int:
        """Hash of a text's whole word sequence, as ``grams`` would hash it."""
        part = hashes[self.bounds[row] : self.bounds[row + 1]]
        acc = np.array([len(part)], U64)
        for h in part:
            acc = mix(acc * U64(0x9FB21C651E98DF25) + h)
        return int(acc[0])


def binary_column(chunks: list[np.ndarray]) -> pa.Array:
    """One binary value for each array."""
    return pa.array([c.tobytes() for c in chunks], pa.binary())
