"""Running affine recurrences y[i] = a[i] * y[i-1] + (1 - a[i]) * v[i] over groups of any size.

Two steps compose to one of the same form, (a2 * a1, a2 * b1 + b2), and composition is associative. So a
stretch of rows is scanned by doubling in numpy, and a group too large for one task is cut into chunks
whose composed maps, one row a chunk, say what enters each chunk from both sides. However long a group
is, it takes one pass for the maps and one for the values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Batches = Iterator[pa.RecordBatch]


def scan(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The composed maps (a, b) of all rows up to each one; `b` is (n, values). Where a is 0, what came
    before is forgotten."""
    a, b = a.copy(), b.copy()
    step = 1
    while step < len(a) and a[step:].any():
        b[step:] += a[step:, None] * b[:-step].copy()
        a[step:] *= a[:-step].copy()
        step *= 2
    return a, b


def decays(gaps: np.ndarray, tau: float) -> np.ndarray:
    """How much of the state before is left after each gap: nothing without time or smoothing."""
    if tau <= 0:
        return np.zeros(len(gaps))
    return np.where(gaps > 0, np.exp(-np.maximum(gaps, 0) / tau), 0.0)


def group_starts(batch: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> np.ndarray:
    """The rows of a sorted batch at which another group begins (0 included)."""
    n = batch.num_rows
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = False
        for key in keys:
            column = batch.column(key)
            if isinstance(column, pa.ChunkedArray):
                column = column.combine_chunks()
            one, two = column.slice(1), column.slice(0, n - 1)
            other = pc.fill_null(pc.not_equal(one, two), False)
            other = pc.or_(other, pc.xor(one.is_null(), two.is_null()))
            new[1:] |= other.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(batches: Batches, keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows of whole groups, where each group begins) of key-sorted batches. Only the group that a batch
    ends with is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        starts = group_starts(batch, keys)
        if held:
            last = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
            joined = len(group_starts(last, keys)) == 1
            if joined and len(starts) == 1:
                held.append(batch)
                continue
        cut = int(starts[-1])
        done = [*held, batch.slice(0, cut)] if cut else held
        if done:
            table = pa.Table.from_batches(done).combine_chunks()
            yield table, group_starts(table, keys)
        held = [batch.slice(cut)]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, group_starts(table, keys)


def kernel(
    keys: Sequence[str], make: Callable[[pa.Table, np.ndarray], pa.RecordBatch]
) -> Callable[[Batches], Batches]:
    """A `mapInArrow` function that gives `make` whole groups only."""

    def run(batches: Batches) -> Batches:
        for table, starts in whole_groups(batches, keys):
            yield make(table, starts)

    return run


def values(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """(rows, names) as doubles; null becomes NaN."""
    return np.column_stack([
        table.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names
    ]) if names else np.zeros((table.num_rows, 0))


def both_ways(
    t: np.ndarray, v: np.ndarray, starts: np.ndarray, tau: float,
    before: tuple[np.ndarray, np.ndarray] | None = None,
    after: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward states of all rows of the groups that begin at `starts`.

    `before` and `after` are, for each group, the time and state of what stands outside it (NaN times:
    nothing).
    """
    n = len(t)
    ends = np.append(starts[1:], n) - 1
    gap = np.zeros(n)
    gap[1:] = t[1:] - t[:-1]

    def run(a: np.ndarray, edge: np.ndarray, outside, far: np.ndarray) -> np.ndarray:
        a[edge] = 0.0
        b = (1 - a)[:, None] * v
        if outside is not None:
            when, state = outside
            known = ~np.isnan(when)
            keep = decays(np.abs(far - when)[known], tau)[:, None]
            b[edge[known]] = keep * state[known] + (1 - keep) * v[edge[known]]
        return a, b

    forward = run(decays(gap, tau), starts, before, t[starts])
    back = np.append(decays(gap, tau)[1:], 0.0)
    a, b = run(back, ends, after, t[ends])
    return scan(*forward)[1], scan(a[::-1], b[::-1])[1][::-1]
