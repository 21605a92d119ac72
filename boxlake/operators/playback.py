"""Playback of tracks: smoothing, as-of lookup and interpolated sampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake import affine, skew

VECTOR = ("cx", "cy", "w", "h")
CHUNK_ROWS = 200_000


def box_vectors(df: DataFrame) -> DataFrame:
    """Adds centre and size of every box."""
    return df.withColumns({
        "cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2,
        "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1"),
    })


SUMMARY = ("first_t", "last_t", "decay")


def _boundary(prefix: str) -> list[str]:
    return [f"{prefix}_{v}" for v in ("t", *VECTOR)]


def _smoothed(rows: DataFrame, keys: list[str], parts: list[str], tau: float, chunked: bool) -> DataFrame:
    """Averaged states of groups that fit into a task; with `chunked`, of chunks of larger ones, whose rows
    carry what enters from both sides."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    whole = [*keys, *parts]

    def make(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        sides = [None, None]
        if chunked:
            first = table.take(pa.array(starts))
            sides = [affine.values(first, _boundary(p)) for p in ("before", "after")]
            sides = [(s[:, 0], s[:, 1:]) for s in sides]
        t = affine.values(table, ["t"])[:, 0]
        forward, backward = affine.both_ways(t, affine.values(table, VECTOR), starts, tau, *sides)
        mean = (forward + backward) / 2
        columns = [table.column(k).combine_chunks() for k in [*keys, "t"]]
        columns += [pa.array(np.ascontiguousarray(mean[:, i])) for i in range(len(VECTOR))]
        return pa.RecordBatch.from_arrays(columns, [*keys, "t", *[f"s_{v}" for v in VECTOR]])

    placed = skew.in_one_task(rows, whole, ["t", *VECTOR])
    fields = [f"`{k}` {kinds[k]}" for k in keys] + ["t double"] + [f"s_{v} double" for v in VECTOR]
    return placed.mapInArrow(affine.kernel(whole, make), ", ".join(fields))


def _chunk_maps(rows: DataFrame, keys: list[str], tau: float) -> DataFrame:
    """One row per (keys, _chunk): its first and last time and vector, how much of a state is left after
    all its steps (`decay`, the same in both directions), and the state it ends with on both sides
    if nothing enters but its own first row."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    whole = [*keys, "_chunk"]
    names = [*SUMMARY] + [f"{p}_{v}" for p in ("first", "last", "on", "back") for v in VECTOR]

    def make(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        t, v = affine.values(table, ["t"])[:, 0], affine.values(table, VECTOR)
        ends = np.append(starts[1:], len(t)) - 1
        forward, backward = affine.both_ways(t, v, starts, tau)
        steps = affine.decays(np.append(0.0, np.diff(t)), tau)
        steps[starts] = 1.0
        left = np.multiply.reduceat(steps, starts)
        numbers = np.column_stack((
            t[starts], t[ends], left, v[starts], v[ends], forward[ends], backward[starts]
        ))
        first = table.take(pa.array(starts))
        columns = [first.column(k).combine_chunks() for k in whole]
        columns += [pa.array(np.ascontiguousarray(numbers[:, i])) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, [*whole, *names])

    placed = skew.in_one_task(rows, whole, ["t", *VECTOR])
    fields = [f"`{k}` {kinds[k]}" for k in whole] + [f"{n} double" for n in names]
    return placed.mapInArrow(affine.kernel(whole, make), ", ".join(fields))


def _entering(maps: DataFrame, keys: list[str], tau: float) -> DataFrame:
    """(keys, _chunk, before_*, after_*): time and state of the rows beside each chunk. The maps of a group,
    one for some hundred thousand rows, are composed in one task."""
    kinds = {f.name: f.dataType.simpleString() for f in maps.schema.fields}
    whole = [*keys, "_chunk"]
    names = [*_boundary("before"), *_boundary("after")]

    def make(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        named = lambda p: affine.values(table, [f"{p}_{v}" for v in VECTOR])
        first_t, last_t, decay = affine.values(table, SUMMARY).T
        n = len(decay)
        begins = np.zeros(n, bool)
        begins[starts] = True
        ends = np.append(begins[1:], True)

        def states(gap, kept, near, on, edge):
            # A chunk: x = keep * y + (1 - keep) * near, then on + kept * (x - near).
            passed = np.where(edge, 0.0, affine.decays(gap, tau)) * kept
            return affine.scan(passed, on - passed[:, None] * near)[1]

        gap = np.append(0.0, first_t[1:] - last_t[:-1])
        out = states(gap, decay, named("first"), named("on"), begins)
        rear = np.append(first_t[1:] - last_t[:-1], 0.0)
        turned = (x[::-1] for x in (rear, decay, named("last"), named("back"), ends))
        back = states(*turned)[::-1]
        sides = np.full((n, 2 * len(VECTOR) + 2), np.nan)
        held = np.flatnonzero(~begins)
        sides[held, : len(VECTOR) + 1] = np.column_stack((last_t[held - 1], out[held - 1]))
        held = np.flatnonzero(~ends)
        sides[held, len(VECTOR) + 1 :] = np.column_stack((first_t[held + 1], back[held + 1]))
        columns = [table.column(k).combine_chunks() for k in whole]
        columns += [pa.array(np.ascontiguousarray(sides[:, i])) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, [*whole, *names])

    placed = skew.in_one_task(maps, keys, ["_chunk"])
    fields = [f"`{k}` {kinds[k]}" for k in whole] + [f"{n} double" for n in names]
    return placed.mapInArrow(affine.kernel(keys, make), ", ".join(fields))


def smooth_tracks(
    observations: DataFrame, keys: Sequence[str], tau: float, chunk_rows: int = CHUNK_ROWS,
    groups: Sequence[str] | None = None,
) -> DataFrame:
    """(keys, t, s_cx, s_cy, s_w, s_h): forward and backward exponential smoothing, averaged.

    `observations` carries t and a box. Rows of one time are taken in the order of their vectors. Groups
    above `chunk_rows` rows are cut into chunks: one pass composes each chunk to a map, the maps of a
    group are composed to what enters its chunks from both sides, and one more pass smooths all
    chunks at once. The number of jobs does not depend on the length of a group. `groups` names some of
    the keys that take less work to count by.
    """
    keys = list(keys)
    rows = box_vectors(observations).select(*keys, F.col("t").cast("double").alias("t"), *VECTOR)
    rows = rows.withColumns({v: F.col(v).cast("double") for v in VECTOR})
    cool, hot = skew.split_hot(rows, groups or keys, chunk_rows)
    result = _smoothed(cool, keys, [], tau, False)
    if hot is None:
        return result
    order = [F.col(c).asc() for c in ("t", *VECTOR)]
    indexed = skew.group_index(hot, keys, order, "_i")
    chunks = skew.checkpointed(indexed.select(
        *rows.columns, F.floor((F.col("_i") - 1) / chunk_rows).cast("long").alias("_chunk")
    ))
    entering = _entering(_chunk_maps(chunks, keys, tau), keys, tau)
    joined = chunks.join(entering, [*keys, "_chunk"])
    return result.unionByName(_smoothed(joined, keys, ["_chunk"], tau, True))


def asof_both(
    probes: DataFrame, observations: DataFrame, keys: Sequence[str], time: str, chunk: str,
    value: Sequence[str],
) -> DataFrame:
    """Probes with `before` (last observation at or before) and `after` (first one after) structs.

    Both sides are stacked and scanned once in time order; for a hot key the scan is cut at `chunk`, so that
    it spreads over its chunks. There is no pairing of probes with observations at all.
    """
    payload = F.struct(time, *value)
    extra = [c for c in probes.columns if c not in (*keys, time, chunk)]
    stacked = observations.select(
        *keys, time, chunk, F.lit(0).alias("_probe"), payload.alias("_obs"),
        *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra],
    ).unionByName(
        probes.select(
            *keys, time, chunk, F.lit(1).alias("_probe"),
            F.lit(None).cast(observations.select(payload.alias("v")).schema["v"].dataType)
            .alias("_obs"),
            *extra,
        )
    )
    # Observations of the same instant sort before the probe.
    order = [time, "_probe"]
    found = F.col("_obs")

    def whole(rows: DataFrame) -> DataFrame:
        return rows.withColumns({
            "before": skew.last_over(found, keys, order),
            "after": skew.last_over(found, keys, [F.col(c).desc() for c in order]),
        })

    def cut(rows: DataFrame) -> DataFrame:
        seen = skew.carried_last(rows, keys, chunk, order, found, "before")
        return skew.carried_next(seen, keys, chunk, order, found, "after")

    both = skew.in_windows(stacked, keys, whole, cut)
    return both.filter(F.col("_probe") == 1).drop("_probe", "_obs")


def _usable(flow: Column) -> Column:
    return F.coalesce(
        (flow.getField("dt") > 0) & (flow.getField("reliability") >= 0.15), F.lit(False)
    )


def sample_playback(
    observations: DataFrame, keys: Sequence[str], chunk: str, step: float, max_gap: float,
    window: float, groups: Sequence[str] | None = None,
) -> DataFrame:
    """Track boxes at every multiple of `step` where the track shows.

    `observations` carries t, confidence, the smoothed vector (s_cx, s_cy, s_w, s_h) and the
    nullable flow structs flow_to_next and flow_from_previous. Between two observations at most
    `max_gap` apart the box is interpolated, with a cubic path when both flows are reliable;
    elsewhere the nearest observation within `window` is moved along its flow. Each observation
    emits only its own sample times, so no join is needed. `groups` names some of the keys that take
    less work to count by.
    """
    fields = ["t", "confidence", "s_cx", "s_cy", "s_w", "s_h", "flow_to_next", "flow_from_previous"]
    here = F.struct(*fields)
    rows = observations.select(*keys, chunk, "t", here.alias("l"))

    def whole(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("t")
        return rows.withColumns({
            "r": F.lead("l").over(order), "_seen": F.lag(F.lit(1)).over(order),
        })

    def cut(rows: DataFrame) -> DataFrame:
        paired = skew.carried_next(rows, keys, chunk, ["t"], F.col("l"), "r")
        return skew.carried_last(paired, keys, chunk, ["t"], F.lit(1), "_seen")

    first = skew.in_windows(rows, groups or keys, whole, cut)
    left, right = F.col("l"), F.col("r")
    gap = right.getField("t") - left.getField("t")
    joined = (gap <= max_gap) & (gap > 0)

    def grid(low: Column, high: Column) -> Column:
        """Sample numbers k with low <= k * step < high."""
        a, b = F.ceil(low / step), F.ceil(high / step) - 1
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.expr("CAST(array() AS ARRAY<BIGINT>)"))

    def upto(low: Column, high: Column) -> Column:
        """Sample numbers k with low <= k * step <= high."""
        a, b = F.ceil(low / step), F.floor(high / step)
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.expr("CAST(array() AS ARRAY<BIGINT>)"))

    lt, rt = left.getField("t"), right.getField("t")
    zero = F.lit(0.0)
    tail = upto(lt, lt + window)
    inside = F.when(joined, grid(lt, rt)).when(
        right.isNull(), tail
    ).otherwise(
        # Too far apart: samples near either end.
        F.array_union(grid(lt, F.least(rt, lt + window + step)),
                      grid(F.greatest(lt, rt - window - step), rt))
    )
    lead_in = F.when(F.col("_seen").isNull(), grid(F.greatest(zero, lt - window - step), lt))
    samples = first.select(
        *keys, "l", "r",
        F.explode(
            F.array_union(
                F.coalesce(inside, F.expr("CAST(array() AS ARRAY<BIGINT>)")),
                F.coalesce(lead_in, F.expr("CAST(array() AS ARRAY<BIGINT>)")),
            )
        ).alias("k"),
    ).withColumn("time", F.col("k") * F.lit(step))
    time = F.col("time")
    before_first = time < lt
    interpolated = joined & ~before_first
    nearest_right = ~before_first & right.isNotNull() & (time - lt > rt - time)
    near = F.when(nearest_right, right).otherwise(left)
    delta = time - near.getField("t")
    near_flow = F.when(delta >= 0, near.getField("flow_to_next")).otherwise(
        near.getField("flow_from_previous")
    )
    pushed = _usable(near_flow) & (F.abs(delta) <= near_flow.getField("dt"))

    amount = F.greatest(zero, F.least(F.lit(1.0), (time - lt) / gap))
    l_flow, r_flow = left.getField("flow_to_next"), right.getField("flow_from_previous")
    curved = _usable(l_flow) & _usable(r_flow)

    def blend(name: str) -> Column:
        return left.getField(name) + (right.getField(name) - left.getField(name)) * amount

    def curve(name: str, axis: str) -> Column:
        a2 = amount * amount
        a3 = a2 * amount
        l_speed = l_flow.getField(axis) / l_flow.getField("dt")
        r_speed = r_flow.getField(axis) / r_flow.getField("dt")
        return (
            (a3 * 2 - a2 * 3 + 1) * left.getField(name)
            + (a3 - a2 * 2 + amount) * l_speed * gap
            + (a2 * 3 - a3 * 2) * right.getField(name)
            + (a3 - a2) * r_speed * gap
        )

    def centre(name: str, axis: str) -> Column:
        moved = near.getField(name) + F.when(
            pushed, near_flow.getField(axis) / near_flow.getField("dt") * delta
        ).otherwise(0.0)
        return F.when(
            interpolated, F.when(curved, curve(name, axis)).otherwise(blend(name))
        ).otherwise(moved)

    def side(name: str) -> Column:
        return F.when(interpolated, blend(name)).otherwise(near.getField(name))

    shown = interpolated | (F.abs(delta) <= window)
    return samples.filter(shown).select(
        *keys, "time",
        F.when(interpolated, blend("confidence")).otherwise(near.getField("confidence"))
        .alias("confidence"),
        centre("s_cx", "dx").alias("cx"), centre("s_cy", "dy").alias("cy"),
        side("s_w").alias("w"), side("s_h").alias("h"),
    )
