"""Words, lines and their 64-bit hashes over the bytes of many texts at once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _table(seed: int, lower: bool) -> np.ndarray:
    t = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
    if lower:
        t[65:91] = t[97:123]
    return t


_TABLES = {(s, low): _table(s, low) for s in (11, 12) for low in (False, True)}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n; grown by doubling."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(_PIECE + 4096, n)
        out = []
        for b in (_BASE, _INV):
            a = np.ones(size, U)
            done, step = 1, b
            while done < size:
                k = min(done, size - done)
                a[done : done + k] = a[:k] * U(step)
                done, step = done + k, step * step % (1 << 64)
            out.append(a)
        have = _powers[0] = (out[0], out[1])
    return have


def trim() -> None:
    """Give freed memory back to the system; Python workers live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(work: Callable) -> Callable:
    """work(batches), with trim() at the task's end."""

    def inner(batches):
        try:
            yield from work(batches)
        finally:
            trim()

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(29)
    x = x * U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(32)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def pieces(off: np.ndarray, size: int = _PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes of text, one row at least."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 11) -> np.ndarray:
    """A hash of each span's bytes; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, U)
    pw, inv = _power(len(data) + 1)
    t = _TABLES[seed, lower][data]
    t *= pw[: len(data)]
    total = np.zeros(len(data) + 1, U)
    np.cumsum(t, out=total[1:])
    h = (total[ends] - total[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(U) * U(0x2545F4914F6CDD1D))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of other than ASCII white space), and each text's first word; bounds are the texts' offsets into data."""
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def shingles(data: np.ndarray, bounds: np.ndarray, n: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles of lower-cased words, each text's first one, the word hashes and each text's first word. A text of fewer words has its whole sequence as one shingle."""
    starts, ends, first = words(data, bounds)
    h = span_hash(data, starts, ends, lower=True)
    count = np.diff(first)
    have = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    at = np.zeros(len(have) + 1, np.int64)
    np.cumsum(have, out=at[1:])
    place = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], have)
    short = np.repeat(count < n, have)
    padded = np.concatenate([h, np.zeros(n, U)])
    width = np.repeat(np.minimum(count, n), have)
    g = np.zeros(len(place), U)
    for i in range(n):
        w = padded[place + i]
        if i:
            w = np.where(i < width, w, U(0))
        g = mix(g * U(0x9FB21C651E98DF25) + w)
    g = np.where(short, mix(g + width.astype(U)), g)
    return g, at, h, first
