"""Vectorised helpers over many byte strings at once (numpy, used inside tasks)."""

from __future__ import annotations

import numpy as np

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xC2B2AE3D27D4EB4F)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """``(data, offsets)`` of an Arrow string or binary array; nulls are empty.

    ``data`` holds the bytes of all values one after another, without a copy.
    """
    import pyarrow as pa

    if column.type not in (pa.string(), pa.binary(), pa.large_string(), pa.large_binary()):
        column = column.cast(pa.string())
    wide = column.type in (pa.large_string(), pa.large_binary())
    n, lo = len(column), column.offset
    buffers = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[lo : lo + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    if column.null_count:
        sizes = np.diff(offsets) * ~np.asarray(column.is_null())
        if sizes.sum() != offsets[-1] - offsets[0]:  # bytes below a null
            take = ranges(offsets[:-1], sizes)
            return data[take], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch, name: str = "text", limit: int = 1 << 18):
    """Slices of an Arrow batch of about ``limit`` bytes of text (a longer text by itself), to bound memory."""
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(name)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of ``start .. start+size-1`` for each pair, one after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total, dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * M1)


def powers(n: int, m: np.uint64 = M1) -> np.ndarray:
    """1, m, m^2 ... (mod 2^64); m is odd, so each has an inverse."""
    out = np.full(max(n, 1), m, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, m: np.uint64 = M1) -> np.ndarray:
    """A 64-bit hash of each run ``data[start:start+size]``; runs are ascending and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    take = ranges(starts, sizes)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(take), dtype=np.int64) - np.repeat(first, sizes)
    value = (_BYTE[data[take]] if data.dtype == np.uint8 else mix(data[take].astype(np.uint64) + M2)) * powers(int(sizes.max()) + 1, m)[place]
    out = np.zeros(len(starts), np.uint64)
    full = sizes > 0
    out[full] = np.add.reduceat(value, first[full])
    return mix(out + sizes.astype(np.uint64) * M2)


_POINT = mix(np.arange(1 << 16, dtype=np.uint64) + M2)


def cover_hashes(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the runs that begin at ``starts`` and cover all code points."""
    sizes = np.diff(np.append(starts, len(points)))
    value = _POINT[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    value[high] = mix(points[high].astype(np.uint64) + M2)
    place = np.arange(len(points), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
    most = int(sizes.max()) + 1
    tail = sizes.astype(np.uint64) * M2
    return tuple(mix(np.add.reduceat(value * powers(most, m)[place], starts) + tail) for m in (M1, M2))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive 64-bit values; one for each start, ``len - k + 1`` in all."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= M1
        out += values[j : j + n]
    return mix(out)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each ``w`` consecutive values, by doubling."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def window_max(values: np.ndarray, w: int) -> np.ndarray:
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.maximum(out[:-step], out[step:])
        have += step
    return out


def local_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the minimum of some window of ``w`` values (all, at ties).

    For fewer than ``w`` values the one window is all of them.
    """
    if not len(values):
        return np.zeros(0, np.int64)
    w = min(w, len(values))
    low = window_min(values, w)
    # position i is a minimum iff the largest minimum of the windows around it equals it
    edge = np.zeros(w - 1, values.dtype)
    most = window_max(np.concatenate([edge, low, edge]), w)
    return np.flatnonzero(most == values)
