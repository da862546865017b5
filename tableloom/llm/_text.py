"""Vectorised words and shingles of whole texts, for use inside Arrow tasks.

Words are runs of ``[^\\x20\\x09-\\x0D]``; hashes are 64 bits wide and equal on every machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed constants of the hash.
_MUL = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MUL))
_STEP = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets (n + 1); nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offs


def blocks(data: np.ndarray, offs: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes (at least one row each)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False):
    """Words of the rows that ``offs`` delimits in ``data``: starts, ends (byte positions from offs[0]),
    and for each row the index of its first word (n + 1 entries); the bytes; all positions are local."""
    b = data[offs[0] : offs[-1]]
    local = (offs - offs[0]).astype(np.int64)
    if lower:
        b = _LOWER[b]
    if not len(b):
        none = np.zeros(0, np.int64)
        return b, none, none, np.zeros(len(local), np.int64)
    ink = ~_SPACE[b]
    first = np.empty(len(b), bool)
    first[0] = True
    np.logical_not(ink[:-1], out=first[1:])
    cuts = local[(local > 0) & (local < len(b))]
    first[cuts] = True
    last = np.empty(len(b), bool)
    last[-1] = True
    np.logical_not(ink[1:], out=last[:-1])
    last[cuts - 1] = True
    starts = np.flatnonzero(ink & first)
    ends = np.flatnonzero(ink & last) + 1
    return b, starts, ends, np.searchsorted(starts, local)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(b) + 1)
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[b] * power[: len(b)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(_MUL))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` consecutive word hashes (across rows as well: callers cut by row)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * _STEP[0]
    for j in range(1, width):
        total = total + hashes[j : j + n] * _STEP[j]
    return mix(total)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Of a short sequence of words as one shingle."""
    n = len(hashes)
    return mix((hashes * _STEP[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64((n * _BASE) & _MASK))[0]


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """For each row its sorted distinct shingle hashes: runs of ``width`` words; with fewer words the whole
    sequence as one; without words an empty array."""
    b, starts, ends, at = words(data, offs, lower)
    h = word_hashes(b, starts, ends)
    w = windows(h, width)
    for i in range(len(offs) - 1):
        lo, hi = at[i], at[i + 1]
        if hi - lo >= width:
            s = np.sort(w[lo : hi - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif hi > lo:
            yield sequence_hash(h[lo:hi])[None]
        else:
            yield np.zeros(0, np.uint64)
