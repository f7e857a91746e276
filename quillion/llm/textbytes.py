"""Vectorised word and n-gram work on the raw bytes of Arrow string columns.

Texts of a batch lie one after the other in a single UTF-8 buffer.  All
functions here take that buffer and the row offsets, so that no Python object
is made per row, word or character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 21
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240521))
_BYTE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK // 4)
        with np.errstate(over="ignore"):
            up = np.full(size, _MULT, np.uint64)
            down = np.full(size, _INV, np.uint64)
            up[0] = down[0] = 1
            _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def pieces(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes, or of one longer row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end
        row = end


def lowered(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters (two bytes, first C3)."""
    low = _LOWER[raw]
    if len(raw) > 1:
        after = np.flatnonzero(raw[:-1] == 0xC3) + 1
        b = raw[after]
        low[after[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]] += 0x20
    return low


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, none across a row's end."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    start[edge] |= inside[edge]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[edge - 1] |= inside[edge - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(raw: np.ndarray, offsets: np.ndarray, kind: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """Word bounds: runs without white space, or (kind "alnum") of letters and digits.

    Any byte of a character outside ASCII counts as a letter.
    """
    return runs(~_SPACE[raw] if kind == "space" else _WORD[raw], offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal bytes give equal hashes anywhere."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    n = len(raw)
    step = CHUNK // 4
    with np.errstate(over="ignore"):
        if n <= step:
            up, down = _power(n)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[raw] * up, out=total[1:])
            return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        out = np.empty(len(starts), np.uint64)
        row = 0
        while row < len(starts):
            base = int(starts[row])
            stop = max(row + 1, int(np.searchsorted(ends, base + step, "right")))
            last = int(ends[stop - 1])
            if last - base > step:  # one word longer than a chunk
                up, down = _power(last - base)
            else:
                up, down = _power(step)
            part = raw[base:last]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
            s, e = starts[row:stop] - base, ends[row:stop] - base
            out[row:stop] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            row = stop
        return out


def row_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row that each byte position lies in."""
    return np.searchsorted(offsets, positions, "right") - 1


def string_array(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column from UTF-8 bytes and offsets."""
    whole = pa.Array.from_buffers(
        pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)]
    )
    return whole.cast(pa.string())
