"""Whole texts of an Arrow batch as flat numpy arrays, for use inside tasks.

White space is the six bytes 0x20 and 0x09-0x0D, so word bounds are found on
UTF-8 bytes without decoding. A batch is cut into chunks by bytes of text
(never within a text), which bounds a task's memory by the chunk size or the
longest single text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, at most ``limit`` bytes of ``column``
    together unless a single row has more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.concatenate(([0], np.cumsum(size))), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and each row's offsets in them; null: empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all else as it is."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each row (one more
    entry than rows)."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space after each, and their starts and ends there."""
    length = ends - starts
    to = np.cumsum(length + 1)
    out = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    solid = ~_SPACE[data]
    out[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = data[solid]
    return out.tobytes(), to - length - 1, to - 1


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers (from 0) for equal words."""
    length = ends - starts
    offsets = np.concatenate(([0], np.cumsum(length)))
    return _ids(data[~_SPACE[data]], offsets)


def line_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal byte ranges; the ranges lie next to each other
    but for single bytes."""
    length = ends - starts
    keep = np.ones(len(data), bool)
    keep[ends[ends < len(data)]] = False
    return _ids(data[keep], np.concatenate(([0], np.cumsum(length))))


def _ids(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    array = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                  [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return array.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for key, base in (("up", _P), ("down", _P_INVERSE)):
            x = np.full(n, base, np.uint64)
            x[:1] = 1
            _POWERS[key] = np.cumprod(x)
    return _POWERS["up"], _POWERS["down"]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same wherever its bytes stand."""
    up, down = _powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])))
    return mixed((total[ends] - total[starts]) * down[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sum of values[lo:hi] for each pair (0 where hi <= lo)."""
    total = np.concatenate((np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return np.where(hi > lo, total[np.maximum(hi, lo)] - total[lo], 0)
