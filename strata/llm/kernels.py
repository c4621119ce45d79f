"""Vectorised byte and token kernels: whole Arrow batches in numpy, no loop over characters or words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.RandomState(7).randint(0, 1 << 63, size=256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table only grows."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = 1 << max(16, (n - 1).bit_length())
        got = np.full(size, base, dtype=U64)
        got[0] = 1
        got = _powers[base] = np.cumprod(got, dtype=U64)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of a polynomial hash are as good as any others."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Rabin-Karp: polynomial hashes of values[start:end] for all spans, from running sums. values: 64-bit, or bytes.
    Spans are taken `block` positions at a time, so memory follows the block and the longest span."""
    out = np.empty(len(start), dtype=U64)
    if not len(start):
        return out
    order = None
    if np.any(start[1:] < start[:-1]):
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    i = 0
    while i < len(start):
        lo = int(start[i])
        j = int(np.searchsorted(start, lo + block))
        part = values[lo : int(end[i:j].max())]
        part = _BYTE[part] if part.dtype == np.uint8 else part
        n = len(part)
        run = np.zeros(n + 1, dtype=U64)
        np.cumsum(part * powers(_P, n), out=run[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (run[e] - run[s]) * powers(_PINV, n + 1)[s] + (e - s).astype(U64)
        i = j
    out = mix(out)
    if order is not None:
        back = np.empty_like(out)
        back[order] = out
        return back
    return out


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(pc.cast(column, pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def ints(column) -> tuple[np.ndarray, np.ndarray]:
    """(int64 values, mask of nulls) of an integer column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.cast(column, pa.int64())
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), np.asarray(pc.is_null(column).to_numpy(zero_copy_only=False), bool)


def pieces(off: np.ndarray, limit: int):
    """(first, last) rows of runs with at most `limit` bytes; a longer row is a run of its own, whole."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray, off: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of the words of all rows, and each row's first word (one more at the end).
    Words are maximal runs of bytes that are not `between` words (space, tab, LF, VT, FF, CR); none crosses a row."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~between[buf]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edge = off[(off > 0) & (off < n)]
    start[edge] = solid[edge]
    end[edge - 1] = solid[edge - 1]
    start = np.flatnonzero(start)
    return start, np.flatnonzero(end) + 1, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return spans_hash(buf, start, end)


def window_hashes(values: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each window of `width` consecutive values of one row. first: rows' first values, one more at the end."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    last = np.repeat(first[1:], np.diff(first))
    start = np.flatnonzero(np.arange(n) + width <= last)
    return start, spans_hash(values, start, start + width)


def window_rows(first: np.ndarray, width: int) -> np.ndarray:
    """The row of each window that window_hashes() gives."""
    return np.repeat(np.arange(len(first) - 1), np.maximum(np.diff(first) - width + 1, 0))


def byte_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of `width` bytes, a power of two, by doubling."""
    h, k = _BYTE[buf], 1
    while k < width:
        h = h[:-k] * U64(_P) + (h[k:] ^ (h[k:] >> U64(29)))
        k *= 2
    return mix(h) if len(h) else h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the positions 0..n-1 that lie in any [start, start + width)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts[starts < n], 1)
    np.add.at(step, np.minimum(starts[starts < n] + width, n), -1)
    return np.cumsum(step[:n]) > 0


def runs(mask: np.ndarray) -> int:
    return int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (len(mask) > 0 and bool(mask[0])))


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
