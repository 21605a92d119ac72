"""Motion between consecutive grey frames: patch matching per box and flow consensus."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake import skew
from boxlake.sources import images

FLOW_SCHEMA = (
    "video_id BIGINT, frame_idx BIGINT, det_idx BIGINT, dx DOUBLE, dy DOUBLE, dt DOUBLE, "
    "reliability DOUBLE"
)

FLOW_NAMES = ["video_id", "frame_idx", "det_idx", "dx", "dy", "dt", "reliability"]
CORNERS = ("x1", "y1", "x2", "y2")
# One frame in so many is shuffled twice.
CHUNK_FRAMES = 16
BOXES_AT_ONCE = 64
PIXELS_AT_ONCE = 1 << 22


def search_radius(sample_rate: float) -> int:
    return 6 if sample_rate >= 30 else 8 if sample_rate >= 8 else 12


@dataclass(frozen=True)
class FlowOptions:
    grid: int = 4
    patch: int = 2
    search: int = 6
    texture: float = 18.0


def box_flows(
    previous: np.ndarray, current: np.ndarray, boxes: np.ndarray,
    options: FlowOptions = FlowOptions(),
) -> np.ndarray:
    """(dx, dy, reliability) of each box (x1, y1, x2, y2) from one grey frame to the next, all boxes side
    by side; NaN without enough textured patches."""
    if previous.shape != current.shape:
        raise ValueError("Frames must have matching dimensions.")
    return stack_flows(previous[None], current[None], np.zeros(len(boxes), int), boxes, options)


def stack_flows(
    previous: np.ndarray, current: np.ndarray, frame: np.ndarray, boxes: np.ndarray,
    options: FlowOptions = FlowOptions(),
) -> np.ndarray:
    """As `box_flows` for many pairs of frames of one shape (n, height, width); `frame` is the pair of each box."""
    out = np.full((len(boxes), 3), np.nan)
    height, width = previous.shape[1:]
    r, s, n = options.patch, options.search, options.grid
    margin = r + s
    x1, x2 = (np.clip(boxes[:, c], margin, max(margin, width - margin)) for c in (0, 2))
    y1, y2 = (np.clip(boxes[:, c], margin, max(margin, height - margin)) for c in (1, 3))
    own = np.flatnonzero((x2 - x1 >= 2) & (y2 - y1 >= 2))
    steps = (np.arange(n) + 0.5) / n
    for at in range(0, len(own), BOXES_AT_ONCE):
        part = own[at : at + BOXES_AT_ONCE]
        span_x, span_y = (x2 - x1)[part, None], (y2 - y1)[part, None]
        xs = np.floor(x1[part, None] + steps * span_x + 0.5).astype(int)
        ys = np.floor(y1[part, None] + steps * span_y + 0.5).astype(int)
        xs, ys = np.tile(xs, n).ravel(), np.repeat(ys, n, axis=1).ravel()
        moves = _moves(previous, current, np.repeat(frame[part], n * n), xs, ys, options)
        out[part] = _consensus(moves, len(part), options)
    return out


def _moves(previous, current, frame, xs, ys, options: FlowOptions) -> np.ndarray:
    """(points, 2) moves of the patches around the points; NaN where the texture is too weak."""
    r, s = options.patch, options.search

    def squares(frames: np.ndarray, reach: int, at: np.ndarray) -> np.ndarray:
        span = np.arange(-reach, reach + 1)
        return frames[
            frame[at, None, None], (ys[at, None] + span)[:, :, None], (xs[at, None] + span)[:, None, :]
        ].astype(np.int32)

    moves = np.full((len(xs), 2), np.nan)
    patches = squares(previous, r, np.arange(len(xs)))
    rich = np.flatnonzero(patches.std(axis=(1, 2)) >= options.texture)
    if len(rich):
        patches = patches[rich]
        areas = squares(current, r + s, rich)
        windows = np.lib.stride_tricks.sliding_window_view(areas, patches.shape[1:], axis=(1, 2))
        errors = np.abs(windows - patches[:, None, None]).sum(axis=(3, 4))
        best = errors.reshape(len(patches), -1).argmin(axis=1)  # row-major: the first minimum wins
        moves[rich] = np.stack((best % (2 * s + 1) - s, best // (2 * s + 1) - s), axis=1)
    return moves


def _consensus(moves: np.ndarray, boxes: int, options: FlowOptions) -> np.ndarray:
    points = options.grid**2
    moves = moves.reshape(boxes, points, 2)
    found = (~np.isnan(moves[..., 0])).sum(axis=1)
    out = np.full((boxes, 3), np.nan)
    enough = found >= max(2, math.ceil(points * 0.2))
    moves, found = moves[enough], found[enough]
    if len(moves):
        middle = np.nanmedian(moves, axis=1)
        away = moves - middle[:, None]
        spread = np.nanmedian(np.hypot(away[..., 0], away[..., 1]), axis=1)
        reliability = np.clip(1 / (1 + spread) * (found / points), 0, 1)
        out[enough] = np.column_stack((middle, reliability))
    return out


def box_flow(
    previous: np.ndarray, current: np.ndarray, box: tuple, options: FlowOptions = FlowOptions()
) -> tuple[float, float, float] | None:
    """(dx, dy, reliability) of one box, or None without enough textured patches."""
    found = box_flows(previous, current, np.array([box], float), options)[0]
    return None if np.isnan(found[0]) else tuple(found.tolist())


def motion_flow(
    frames: DataFrame, boxes: DataFrame, options: FlowOptions = FlowOptions(),
    chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """Flow from every box's frame to the next one.

    `frames` are pixel blocks with (video_id, frame_idx, t) and dense frame numbers. Pixels are shuffled
    once: a video is cut into chunks of `chunk_frames` frames, and only the last frame of a chunk goes to
    the next one as well. Inside its chunk each frame is held until its successor has come; the boxes
    of a frame follow its successor in the same order, so a task holds two frames and one batch, however
    long a video is and however many boxes a frame has. Pairs of frames of one shape wait until they have
    BOXES_AT_ONCE boxes or PIXELS_AT_ONCE pixels, and are matched side by side.
    """
    chunk = lambda f: F.floor(f / F.lit(chunk_frames)).cast("long")
    number = F.col("frame_idx")
    none = F.lit(None)
    pixels = frames.select(
        "video_id",
        F.explode(F.array_distinct(F.array(chunk(number), chunk(number + 1)))).alias("chunk"),
        number.alias("place"), F.lit(0).alias("kind"), none.cast("long").alias("det_idx"),
        F.col("t").cast("double").alias("t"), *images.BLOCK,
        *[none.cast("double").alias(c) for c in CORNERS],
    )
    wanted = boxes.select(
        "video_id", chunk(number + 1).alias("chunk"), (number + 1).alias("place"), F.lit(1).alias("kind"),
        F.col("det_idx").cast("long"), none.cast("double").alias("t"),
        *[none.cast(pixels.schema[c].dataType).alias(c) for c in images.BLOCK],
        *[F.col(c).cast("double").alias(c) for c in CORNERS],
    )
    keys = ["video_id", "chunk"]
    ordered = skew.in_one_task(pixels.unionByName(wanted), keys, ["place", "kind", "det_idx"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (video, frame, t, grey) of the last two frames
        for batch in batches:
            # Frames are converted at once, all of one shape together.
            greys: dict[int, np.ndarray] = {}
            for rows, stack in images.stacks(batch):
                greys.update(zip(rows.tolist(), images.grey_video(stack), strict=True))
            video, place, kind, t = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("video_id", "place", "kind", "t")
            )
            corners = np.column_stack(
                [batch.column(c).to_numpy(zero_copy_only=False) for c in CORNERS]
            )
            # Runs of rows of one (video, place, kind): a frame, or the boxes before it.
            new = np.ones(batch.num_rows, bool)
            new[1:] = (
                (video[1:] != video[:-1]) | (place[1:] != place[:-1]) | (kind[1:] != kind[:-1])
                | (kind[1:] == 0)
            )
            starts = np.flatnonzero(new)

            def matched(pairs: list[tuple]) -> pa.RecordBatch:
                sizes = [b - a for _, _, a, b in pairs]
                rows = np.concatenate([np.arange(a, b) for _, _, a, b in pairs])
                number = np.repeat(np.arange(len(pairs)), sizes)
                before, after = (np.stack([p[side][3] for p in pairs]) for side in (0, 1))
                flows = stack_flows(before, after, number, corners[rows], options)
                passed = np.array([after[2] - before[2] for before, after, _, _ in pairs])
                good = np.flatnonzero(~np.isnan(flows[:, 0]))
                return pa.RecordBatch.from_arrays([
                    pa.array(video[rows[good]].astype(np.int64)),
                    pa.array(place[rows[good]].astype(np.int64) - 1),
                    batch.column("det_idx").take(pa.array(rows[good])),
                    *[pa.array(flows[good, c]) for c in range(2)],
                    pa.array(passed[number[good]]), pa.array(flows[good, 2]),
                ], names=FLOW_NAMES)

            waiting: list[tuple] = []
            boxes_waiting = 0
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                if kind[a] == 0:
                    held = [*held[-1:], (video[a], place[a], t[a], greys.get(a))]
                    continue
                if len(held) < 2 or not _pair(held, video[a], place[a]):
                    continue
                before, after = held
                if waiting and waiting[0][0][3].shape != before[3].shape:
                    yield matched(waiting)
                    waiting, boxes_waiting = [], 0
                waiting.append((before, after, a, b))
                boxes_waiting += b - a
                if boxes_waiting >= BOXES_AT_ONCE or len(waiting) * before[3].size >= PIXELS_AT_ONCE:
                    yield matched(waiting)
                    waiting, boxes_waiting = [], 0
            if waiting:
                yield matched(waiting)

    return ordered.mapInArrow(run, FLOW_SCHEMA)


def _pair(held: list[tuple], video: int, place: int) -> bool:
    """Whether the held frames are the pair that ends at `place`, both decoded and of one size."""
    (v, f, _, before), (w, g, _, after) = held
    return (
        v == w == video and g == place and f == place - 1 and before is not None
        and after is not None and before.shape == after.shape
    )


def flow_consensus(patches: DataFrame, key: str, grid: int = 4) -> DataFrame:
    """Median motion and reliability per box of (key, dx, dy) textured-patch rows.

    Equal moves are counted first. Integer moves within the search radius have few distinct values,
    so the medians' value maps stay small whatever the group size.
    """
    medians = patches.groupBy(key).agg(
        F.median("dx").alias("dx"), F.median("dy").alias("dy"), F.count(F.lit(1)).alias("points")
    )
    moves = patches.groupBy(key, "dx", "dy").agg(F.count(F.lit(1)).alias("_w"))
    joined = moves.withColumnsRenamed({"dx": "_dx", "dy": "_dy"}).join(medians, key)
    spread = F.hypot(F.col("_dx") - F.col("dx"), F.col("_dy") - F.col("dy"))
    # The weighted median of at most (2 * search + 1)^2 distinct moves.
    consensus = joined.withColumn("_s", spread).groupBy(key).agg(
        F.first("dx").alias("dx"), F.first("dy").alias("dy"), F.first("points").alias("points"),
        F.expr("percentile(_s, 0.5D, _w)").alias("spread"),
    )
    coverage = F.col("points") / F.lit(float(grid * grid))
    enough = F.col("points") >= max(2, math.ceil(grid * grid * 0.2))
    reliability = F.greatest(F.lit(0.0), F.least(F.lit(1.0), coverage / (F.col("spread") + 1)))
    return consensus.filter(enough).select(
        key, "dx", "dy", "points", F.round(reliability, 9).alias("reliability")
    )
