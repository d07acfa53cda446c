"""Token arrays of Arrow batches as flat NumPy arrays, and hashes of their runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Tokens that are worked on at a time, unless one array alone has more.
CHUNK = 1 << 20


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (2 * salt + 1)) & _MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Values, offsets and, if there are any, which values are null, of a list column (a null list has no values)."""
    offsets = np.asarray(column.offsets)
    values = column.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    nulls = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
    if nulls is not None:
        values = values.fill_null(0)
    return values.to_numpy().astype(np.int64, copy=False).view(np.uint64), offsets - offsets[0], nulls


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many values, or of one row."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high
        low = high


def run_hashes(x: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of width values, by doubling: log2(width) passes."""
    part, length, out, done = mixed(x, salt), 1, None, 0
    rest = width
    while rest:
        if rest & 1:
            power = np.uint64(pow(_BASE, done, 1 << 64))
            out = part.copy() if out is None else out[: max(0, len(x) - done - length + 1)] + part[done:] * power
            done += length
        rest >>= 1
        if rest:
            part = part[: max(0, len(part) - length)] + part[length:] * np.uint64(pow(_BASE, length, 1 << 64))
            length *= 2
    return mixed(out[: max(0, len(x) - width + 1)], salt + 1)


def run_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of width values, by doubling."""
    length = 1
    while 2 * length <= width:
        x = np.minimum(x[: max(0, len(x) - length)], x[length:])
        length *= 2
    rest = width - length
    return np.minimum(x[: max(0, len(x) - rest)], x[rest:]) if rest else x


def whole_runs(offsets: np.ndarray, width: int, nulls: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of width values that lie in one list and hold no null; and the list of each start."""
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    if len(row) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    good = row[: len(row) - width + 1] == row[width - 1 :]
    if nulls is not None:
        before = np.concatenate([[0], np.cumsum(nulls)])
        good &= before[width:] == before[:-width]
    at = np.flatnonzero(good)
    return at, row[at]
