"""Vectorised text kernel: words, rolling hashes and sliding minima over Arrow string batches.

Everything works on the UTF-8 bytes of a slice of documents laid end to end. Words are maximal
runs of bytes outside {space, \\t, \\n, \\v, \\f, \\r}; as these are ASCII, this equals the code point
definition. Hashes are polynomials modulo 2**64 over random byte values, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM_BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTE_VALUES = np.random.default_rng(20_240).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n; kept between calls up to a slice, made anew beyond."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (_BASE, _INVERSE):
        run = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        run[0] = 1
        np.multiply.accumulate(run, out=run)
        made.append(run)
    if n <= 4 * SLICE_BYTES:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a hash depends on all of its input."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c with c[i] = sum of value(data[j]) * base**j over j < i (length n + 1)."""
    up, _ = powers(len(data))
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up, out=c[1:])
    return c


def range_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end), independent of where they stand."""
    _, down = powers(len(c))
    h = (c[ends] - c[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _GRAM_BASE)


def rolling_hash(c: np.ndarray, k: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all k-byte ranges in order of their start, or of those at `starts`."""
    _, down = powers(len(c))
    if starts is not None:
        return mix((c[starts + k] - c[starts]) * down[starts])
    n = len(c) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((c[k:] - c[:n]) * down[:n])


def gram_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive 64-bit values, in order of their start."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= _GRAM_BASE
        h += values[j : j + n]
    return mix(h)


def long_gram_hash(values: np.ndarray, k: int) -> np.ndarray:
    """As gram_hash (other values), by prefix sums: the cost does not depend on k."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(values))
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=c[1:])
    return mix((c[k:] - c[:n]) * down[:n])


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls empty) and the n + 1 bounds of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, bounds, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(bounds, kind)[column.offset : column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each hold at most `limit` bytes, but whole documents."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, bounds = string_bytes(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def words(
    data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words, and the n + 1 word bounds of the documents."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    space = separators[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    before = cut[:-1].copy()
    before[1:] |= space[:-1]
    after = cut[1:].copy()
    after[:-1] |= space[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def owner(bounds: np.ndarray) -> np.ndarray:
    """The index of the document of each element, given the n + 1 bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def steps(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 of each size, end to end."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def inside(bounds: np.ndarray, k: int) -> np.ndarray:
    """Starts of all runs of k elements that stay in one document, in order."""
    total = int(bounds[-1])
    if total < k:
        return np.zeros(0, np.int64)
    ok = np.ones(total, bool)
    for back in range(1, k):
        at = bounds[1:] - back
        ok[at[at >= bounds[:-1]]] = False
    return np.flatnonzero(ok)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` consecutive values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


def anchors(
    hashes: np.ndarray, bounds: np.ndarray, window: int, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed anchors: (k-gram start, first and last window start that it owns), in order.

    Every run of `window` elements inside a document is owned by its k-gram of the lowest hash (the
    leftmost of equal ones), so equal windows have equal anchors at equal offsets, and every window
    is owned by exactly one anchor. `hashes[i]` belongs to the k-gram that starts at element i.
    """
    starts = inside(bounds, window)
    if len(starts) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min(ranked, window - k + 1)[starts]
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], starts[first], starts[last]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
