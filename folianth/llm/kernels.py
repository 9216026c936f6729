"""Vectorised text kernels over Arrow string columns: bytes in, numpy arrays out, no str per row."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes taken at a time; a longer text is taken alone.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII digits and letters, and every byte of a character beyond ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        step = np.full(max(n, CHUNK + 1), _BASE if which == "up" else _INVERSE, np.uint64)
        step[0] = 1
        _powers[which] = have = np.multiply.accumulate(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, so that any of their bits may be used."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n + 1 offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; each range has a row at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def runs(member: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in ``member``; no run crosses a row border of ``at``."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(len(member) + 1, bool)
    border[at] = True
    before = np.empty(len(member), bool)
    before[0], before[1:] = False, member[:-1]
    after = np.empty(len(member), bool)
    after[-1], after[:-1] = False, member[1:]
    return np.flatnonzero(member & (~before | border[:-1])), np.flatnonzero(member & (~after | border[1:])) + 1


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, by one prefix sum over the whole chunk."""
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power("up", len(low)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", len(low) + 1)[starts])


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of lower-cased rows, and where each row's words begin."""
    starts, ends = runs(IS_WORD[data], at)
    hashes = span_hashes(LOWER[data], starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, at)


def segment_sum(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive borders; an empty segment sums to 0.

    Each segment is added up on its own, so its sum has the same bits whatever stands beside it.
    """
    total = np.zeros((len(borders) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(borders) > 0)
    if len(full):
        total[full] = np.add.reduceat(values, borders[:-1][full], axis=0, dtype=np.float64)
    return total


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` over batches, which after each gives freed memory back to the system: Spark's workers live on, idle ones beside busy ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(batches):
            yield out
            del out
            release()

    return run


def with_columns(batch: pa.RecordBatch, keep: list[str], **more: np.ndarray | pa.Array) -> pa.RecordBatch:
    columns = [batch.column(batch.schema.get_field_index(k)) for k in keep]
    return pa.RecordBatch.from_arrays([*columns, *(v if isinstance(v, pa.Array) else pa.array(v) for v in more.values())], [*keep, *more])
