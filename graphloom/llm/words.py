"""Words and their hashes for a whole Arrow batch at once, in numpy.

A word is a run of bytes other than ASCII white space; A-Z are lower-cased, other bytes stay as
they are. All functions work on the bytes of the column, so no Python string is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWER = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text that are handled together, for temporary arrays of about ten times that.
GROUP_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits: near inputs get unrelated outputs."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins and ends (one more offset than rows)."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def groups(column: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of a column in runs of about ``size`` bytes: first row, bytes, offsets."""
    data, offsets = column_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE, lower: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, its first and end byte, and where each row's words begin (one more than rows).

    A group larger than ``GROUP_BYTES`` is one very long text (and short ones): it is worked off in pieces
    that end at white space, so that only what is returned grows with it.
    """
    found, at = [], 0
    while at < len(data):
        to = min(at + 2 * GROUP_BYTES, len(data))
        while to < len(data):  # the last white space before ``to``, or the first after it
            gap = np.flatnonzero(space[data[at:to]])
            if len(gap):
                to = at + int(gap[-1]) + 1
                break
            to = min(to + GROUP_BYTES, len(data))
        inner = offsets[(offsets > at) & (offsets < to)] - at
        hashes, start, end = _words(data[at:to], np.concatenate([[0], inner, [to - at]]), space, lower)
        found.append((hashes, start + at, end + at))
        at = to
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    hashes, start, end = found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, start, end, np.searchsorted(start, offsets)


def _words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    length = end - start
    first = np.cumsum(length) - length
    inside = np.arange(int(length.sum())) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), _POWER, np.uint64))
    spread = _BYTE[lower[data[solid]]] * power[inside]
    return mix(np.add.reduceat(spread, first) + length.astype(np.uint64)), start, end


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` words in turn: one value for each word position, and whether it lies in one row."""
    total = len(hashes)
    out = np.zeros(total, np.uint64)
    whole = np.zeros(total, dtype=bool)
    if total >= n:
        m = total - n + 1
        for k in range(n):
            out[:m] = out[:m] * _POWER + hashes[k : k + m]
        out[:m] = mix(out[:m] + _U(n))
        ends = np.repeat(rows[1:], np.diff(rows))
        whole = np.arange(total) + n <= ends
    return out, whole


def row_sets(hashes: np.ndarray, rows: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row its distinct shingles, sorted; a row of fewer words is one shingle; none without words."""
    values, _ = shingles(hashes, rows, n)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(values[a : b - n + 1])
        elif b > a:
            short = np.zeros(1, np.uint64)
            for k in range(a, b):
                short = short * _POWER + hashes[k]
            yield mix(short + _U(b - a))
        else:
            yield np.zeros(0, np.uint64)
