"""Video tracks: sampling plans, sessions, the tracker, persistence, summaries, timelines."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake import skew
from boxlake.functions import geometry as g
from boxlake.functions.classes import display_class
from boxlake.functions.text import clock, percent
from boxlake.sequential import GROUP_LIMIT, fold_sorted

# Selectable sampling rates, per second.
SAMPLE_RATES = (1, 2, 4, 8, 15, 30, 60, 120)
MAX_SAMPLES = 2000
SAMPLES_AT_ONCE = 65_536
MATCH_IOU = 0.3
CROWD_BOXES = 64
CORNERS = ("x1", "y1", "x2", "y2")
FLOW_RELIABILITY = 0.15
TRACK_KEY = ["video_id", "class_name", "start_frame", "start_det"]


def frame_share(frames: Column, share: float) -> Column:
    """At least one frame of a non-empty video."""
    whole = F.greatest(F.lit(0), F.floor(frames))
    return F.when(whole == 0, 0).otherwise(
        F.greatest(F.lit(1), F.ceil(whole * max(0.0, share)))
    ).cast("long")


def sampling_plans(
    videos: DataFrame, enter_confidence: float, max_samples: int = MAX_SAMPLES
) -> DataFrame:
    """One row per (video_id, duration) and feasible rate with all derived settings."""
    rated = videos.select(
        "video_id", "duration",
        F.explode(F.array(*[F.lit(r) for r in SAMPLE_RATES])).alias("rate"),
    ).filter(F.ceil(F.col("duration") * F.col("rate")) <= max_samples)
    enter = max(0.01, min(1.0, enter_confidence))
    samples = F.greatest(F.lit(1), F.ceil(F.col("duration") * F.col("rate")))
    planned = rated.withColumn("samples", samples.cast("long"))
    return planned.select(
        "*",
        frame_share(F.col("samples"), 0.01).alias("patience"),
        F.greatest(F.lit(1), F.ceil(F.col("rate") * F.lit(0.75))).cast("long").alias("max_gap"),
        F.lit(max(0.01, enter * 0.65)).alias("exit_confidence"),
    )


def sample_times(plans: DataFrame) -> DataFrame:
    """Every sampled frame of every plan row: (video_id, rate, frame_idx, t)."""
    frames = plans.select(
        "video_id", "rate", "duration",
        F.explode(F.sequence(F.lit(0), F.col("samples") - 1)).alias("frame_idx"),
    )
    end = F.greatest(F.lit(0.0), F.col("duration") - 0.001)
    return frames.select(
        "video_id", "rate", "frame_idx",
        F.least(end, F.col("frame_idx") / F.col("rate")).alias("t"),
    )


def sample_digests(plans: DataFrame) -> DataFrame:
    """(video_id, rate, frames, first_t, last_t, sum_us): number, extent and sum of whole microseconds of
    the sampled frames of every plan row. Each is computed as in `sample_times`, side by side in arrays of about
    SAMPLES_AT_ONCE numbers; only the digests leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate, duration, samples = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("rate", "duration", "samples")
            )
            end = np.maximum(0.0, duration - 0.001)
            first, last = np.zeros(len(rate)), np.zeros(len(rate))
            total = np.zeros(len(rate), np.int64)
            # Plans are taken together until their samples fill an array.
            filled = np.cumsum(samples) // SAMPLES_AT_ONCE
            cuts = np.flatnonzero(np.diff(filled, prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(rate)], strict=True):
                starts = np.cumsum(samples[a:b]) - samples[a:b]
                frames = np.arange(int(samples[a:b].sum())) - np.repeat(starts, samples[a:b])
                t = np.minimum(
                    np.repeat(end[a:b], samples[a:b]), frames / np.repeat(rate[a:b], samples[a:b])
                )
                first[a:b] = np.minimum.reduceat(t, starts)
                last[a:b] = np.maximum.reduceat(t, starts)
                total[a:b] = np.add.reduceat(np.floor(t * 1e6).astype(np.int64), starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("video_id"), batch.column("rate"), batch.column("samples"),
                 pa.array(first), pa.array(last), pa.array(total)],
                ["video_id", "rate", "frames", "first_t", "last_t", "sum_us"],
            )

    wanted = plans.select(
        F.col("video_id").cast("long"), F.col("rate").cast("int"), F.col("duration").cast("double"),
        F.col("samples").cast("long"),
    )
    return wanted.mapInArrow(
        run, "video_id long, rate int, frames long, first_t double, last_t double, sum_us long"
    )


def with_sessions(observations: DataFrame, max_gap: int, chunk: str = "chunk") -> DataFrame:
    """Adds `session_start`: the frame where the current run of close class frames began.

    No track survives a gap above `max_gap`, so sessions may be tracked independently. Ordinary groups are
    shuffled and sorted once; `chunk` is a column that grows with `frame_idx` and cuts the windows
    of very long videos.
    """
    keys = ["video_id", "class_name"]
    order = ["frame_idx", "det_idx"]
    begins = F.col("_earlier").isNull() | (F.col("frame_idx") - F.col("_earlier") > max_gap)
    begin = F.when(begins, F.col("frame_idx"))

    def whole(rows: DataFrame) -> DataFrame:
        earlier = rows.withColumn("_earlier", skew.last_over(F.col("frame_idx"), keys, order))
        return earlier.withColumn("session_start", skew.last_over(begin, keys, order, inclusive=True))

    def cut(rows: DataFrame) -> DataFrame:
        earlier = skew.carried_last(rows, keys, chunk, order, F.col("frame_idx"), "_earlier")
        return skew.carried_last(earlier, keys, chunk, order, begin, "session_start", inclusive=True)

    return skew.in_windows(observations, keys, whole, cut).drop("_earlier")


def frame_links(
    observations: DataFrame, max_gap: int, chunk: str = "chunk", match_iou: float = MATCH_IOU,
    crowd: int = CROWD_BOXES,
) -> DataFrame:
    """Box pairs of consecutive class frames at most `max_gap` apart with enough overlap.

    The join key holds the frame, so a long video spreads over its frames. Where both frames have more than
    `crowd` boxes, boxes meet in the cells of a grid instead (`_grid_links`), so that the cost follows
    the overlaps and not the product of the boxes.
    """
    if not match_iou > 0:
        raise ValueError("match_iou must be positive")
    keys = ["video_id", "class_name"]
    frames = observations.select(*keys, "frame_idx", chunk).distinct()
    number = F.col("frame_idx")
    before = skew.in_windows(
        frames, keys,
        lambda rows: rows.withColumn("previous_frame", skew.last_over(number, keys, ["frame_idx"])),
        lambda rows: skew.carried_last(rows, keys, chunk, ["frame_idx"], number, "previous_frame"),
        observations,
    ).filter(F.col("frame_idx") - F.col("previous_frame") <= max_gap).drop(chunk)
    left = observations.select(
        *keys, F.col("frame_idx").alias("previous_frame"), F.col("det_idx").alias("previous_det"),
        *[F.col(c).alias(f"p_{c}") for c in CORNERS],
    )
    right = observations.select(*keys, "frame_idx", "det_idx", *CORNERS)

    def linked(paired: DataFrame) -> DataFrame:
        overlap = g.iou(g.Box(*[F.col(f"p_{c}") for c in CORNERS]), g.box())
        return paired.withColumn("iou", overlap).filter(F.col("iou") >= match_iou).select(
            *keys, "previous_frame", "previous_det", "frame_idx", "det_idx", "iou"
        )

    def paired(frames: DataFrame) -> DataFrame:
        return frames.join(right, [*keys, "frame_idx"]).join(left, [*keys, "previous_frame"])

    crowded = skew.hot_groups(observations, [*keys, "frame_idx"], crowd)
    if crowded is None:
        return linked(paired(before))
    names = crowded.select(*keys, "frame_idx")
    both = skew.checkpointed(
        before.join(names, [*keys, "frame_idx"], "left_semi").join(
            names.withColumnRenamed("frame_idx", "previous_frame"), [*keys, "previous_frame"], "left_semi"
        )
    )
    rest = before.join(both.select(*keys, "frame_idx"), [*keys, "frame_idx"], "left_anti")
    pair = [*keys, "previous_frame", "frame_idx"]
    met = _grid_links(
        both.join(left, [*keys, "previous_frame"]), both.join(right, [*keys, "frame_idx"]), pair, match_iou
    )
    return linked(paired(rest)).unionByName(linked(met))


def _grid_links(left: DataFrame, right: DataFrame, keys: list[str], match_iou: float) -> DataFrame:
    """Pairs of left (p_x1, ...) and right (x1, ...) boxes of one key that overlap and whose sides allow
    the IoU, each once.

    Two boxes of that IoU have sides within a factor of 1 / match_iou. So every box enters the grids of its
    own side length, rounded up to a power of two, and of the few next ones, on each axis; in each it
    covers four cells at most. A pair counts in the grid of the larger sides alone, and there in the
    cell of its lower common corner.
    """
    reach = math.ceil(math.log2(1 / match_iou))

    def cells(df: DataFrame, prefix: str) -> DataFrame:
        own = df.filter(
            (F.col(f"{prefix}x2") > F.col(f"{prefix}x1")) & (F.col(f"{prefix}y2") > F.col(f"{prefix}y1"))
        )
        named = prefix or "own_"
        for axis in "xy":
            low, high = F.col(f"{prefix}{axis}1"), F.col(f"{prefix}{axis}2")
            level = F.ceil(F.log2(high - low)).cast("int")
            own = own.withColumn(f"{named}level_{axis}", level).withColumn(
                f"level_{axis}", F.explode(F.sequence(level, level + reach))
            )
            side = F.pow(F.lit(2.0), F.col(f"level_{axis}"))
            own = own.withColumn(
                f"cell_{axis}",
                F.explode(F.sequence(F.floor(low / side).cast("long"), F.floor(high / side).cast("long"))),
            )
        return own

    met = cells(left, "p_").join(
        cells(right, ""), [*keys, "level_x", "level_y", "cell_x", "cell_y"]
    )
    first = F.lit(True)
    for axis in "xy":
        side = F.pow(F.lit(2.0), F.col(f"level_{axis}"))
        corner = F.greatest(F.col(f"p_{axis}1"), F.col(f"{axis}1"))
        first = first & (F.col(f"level_{axis}") == F.greatest(f"p_level_{axis}", f"own_level_{axis}")) & (
            F.col(f"cell_{axis}") == F.floor(corner / side)
        )
    return met.filter(first)


@dataclass
class _Track:
    start_frame: int
    start_det: int
    last_frame: int
    box: tuple[float, float, float, float]
    flow: tuple[float, float] | None
    visible: bool = True
    low_run: int = 0
    segment: int = 0


def _overlap(a: tuple, b: tuple) -> float:
    inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(
        0.0, min(a[3], b[3]) - max(a[1], b[1])
    )
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


@dataclass(frozen=True)
class TrackerOptions:
    """`max_gap` in frame numbers; `patience` in low-confidence observations."""

    max_gap: int
    enter: float = 0.5
    exit: float = 0.325
    patience: int = 2
    match_iou: float = MATCH_IOU


class Tracker:
    """Greedy one-to-one tracking of one (video, class) with enter/exit hysteresis.

    A row is a detection; a frame is decided when the next frame begins, so rows only need to be
    ordered. Live tracks are kept in creation order.
    """

    inputs = (
        "frame_idx", "t", "det_idx", "confidence", "x1", "y1", "x2", "y2", "flow_dx", "flow_dy",
        "flow_reliability",
    )
    outputs = (
        ("frame_idx", "bigint"), ("t", "double"), ("det_idx", "bigint"), ("confidence", "double"),
        ("x1", "double"), ("y1", "double"), ("x2", "double"), ("y2", "double"),
        ("start_frame", "bigint"), ("start_det", "bigint"), ("visible", "boolean"),
        ("segment", "int"),
    )

    def __init__(self, options: TrackerOptions) -> None:
        self.options = options

    def begin(self) -> dict[str, Any]:
        return {"tracks": [], "frame": []}

    def feed(self, state: dict[str, Any], row: tuple) -> list[tuple]:
        done: list[tuple] = []
        if state["frame"] and state["frame"][0][0] != row[0]:
            done = self._decide(state)
        state["frame"].append(row)
        return done

    def finish(self, state: dict[str, Any]) -> list[tuple]:
        return self._decide(state) if state["frame"] else []

    def save(self, state: dict[str, Any]) -> bytes:
        return pickle.dumps(state)

    def load(self, saved: bytes) -> dict[str, Any]:
        return pickle.loads(saved)

    def expire(self, state: dict[str, Any], frame: int) -> None:
        """Forget tracks that cannot match at `frame` any more."""
        state["tracks"] = [
            t for t in state["tracks"] if frame - t.last_frame <= self.options.max_gap
        ]

    def _decide(self, state: dict[str, Any]) -> list[tuple]:
        rows, state["frame"] = state["frame"], []
        frame = rows[0][0]
        self.expire(state, frame)
        tracks: list[_Track] = state["tracks"]
        options = self.options
        pairs = []
        for ti, track in enumerate(tracks):
            box = track.box
            if track.flow is not None:
                dx, dy = track.flow
                box = (box[0] + dx, box[1] + dy, box[2] + dx, box[3] + dy)
            for di, row in enumerate(rows):
                share = _overlap(box, row[4:8])
                if share >= options.match_iou:
                    pairs.append((-share, ti, di))
        pairs.sort()
        owner: dict[int, _Track] = {}
        used: set[int] = set()
        for _, ti, di in pairs:
            if ti in used or di in owner:
                continue
            used.add(ti)
            owner[di] = tracks[ti]
            self._observe(tracks[ti], rows[di])
        result = []
        for di, row in enumerate(rows):
            track = owner.get(di)
            if track is None and row[3] >= options.enter:
                track = _Track(frame, row[2], frame, row[4:8], _usable_flow(row))
                tracks.append(track)
            seen = (None, None, None, None) if track is None else (
                track.start_frame, track.start_det, track.visible, track.segment
            )
            result.append((*row[:8], *seen))
        return result

    def _observe(self, track: _Track, row: tuple) -> None:
        options, confidence = self.options, row[3]
        track.last_frame, track.box = row[0], row[4:8]
        track.low_run = track.low_run + 1 if confidence < options.exit else 0
        if not track.visible and confidence >= options.enter:
            track.visible, track.low_run = True, 0
            track.segment += 1
        elif track.visible and track.low_run > options.patience:
            track.visible = False
        # Motion is only ever measured from visible observations.
        track.flow = _usable_flow(row) if track.visible else None


def _usable_flow(row: tuple) -> tuple[float, float] | None:
    dx, dy, reliability = row[8:11]
    if reliability is None or reliability < FLOW_RELIABILITY:
        return None
    return dx, dy


def assign_tracks(
    observations: DataFrame, options: TrackerOptions, chunk: str = "chunk",
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Observations with track key (start_frame, start_det), `visible` and `segment`.

    Untracked detections keep nulls. Matching never crosses classes, so (video, class) is the unit
    of work; only groups above `group_limit` pay for the session split that cuts them further.
    Columns flow_dx, flow_dy and flow_reliability are optional.
    """
    rows = observations
    for name in ("flow_dx", "flow_dy", "flow_reliability"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
    keys = ["video_id", "class_name"]
    order = ["frame_idx", "det_idx"]
    cool, hot = skew.split_hot(rows, keys, group_limit)
    tracker = Tracker(options)
    result = fold_sorted(cool, keys, order, tracker, group_limit=None)
    if hot is None:
        return result
    sessions = with_sessions(hot, options.max_gap, chunk)
    tracked = fold_sorted(
        sessions, [*keys, "session_start"], order, tracker, group_limit=group_limit
    )
    return result.unionByName(tracked.drop("session_start"))


def number_tracks(tracked: DataFrame) -> DataFrame:
    """One row per track with a dense 1-based `track_id` in creation order of its video."""
    tracks = tracked.filter(F.col("start_frame").isNotNull()).select(*TRACK_KEY).distinct()
    return skew.group_index(
        tracks, ["video_id"],
        [F.col("start_frame").asc(), F.col("start_det").asc(), F.col("class_name").asc()],
        "track_id",
    )


def summarise_tracks(tracked: DataFrame, keys: list[str] = TRACK_KEY) -> DataFrame:
    """Extent, counts, peak and representative time per track; all parts combine map-side."""
    visible = F.coalesce("visible", F.lit(False))
    return tracked.groupBy(*keys).agg(
        F.min("t").alias("start_time"),
        F.max("t").alias("end_time"),
        F.max(F.when(visible, F.col("t"))).alias("visible_end_time"),
        F.count(F.lit(1)).alias("observations"),
        F.count_if(visible).alias("visible_observations"),
        F.max("confidence").alias("max_confidence"),
        F.max_by("t", F.struct(F.col("confidence"), (-F.col("frame_idx")).alias("f"))).alias(
            "representative_time"
        ),
    )


def persistence_threshold(sample_rate: float, samples: int | None = None) -> int:
    return 1 if samples == 1 else max(2, math.ceil(sample_rate * 0.5))


def persistent_tracks(
    tracked: DataFrame, sample_rate: float, keys: list[str] = TRACK_KEY, samples: int | None = None
) -> DataFrame:
    """Summaries of tracks seen visibly often enough."""
    summary = summarise_tracks(tracked, keys)
    return summary.filter(
        F.col("visible_observations") >= persistence_threshold(sample_rate, samples)
    )


def surviving_observations(
    tracked: DataFrame, tracks: DataFrame, keys: list[str] = TRACK_KEY,
    within: list[str] | None = None,
) -> DataFrame:
    """Visible observations of surviving tracks; `within` as in `skew_join`."""
    visible = tracked.filter(F.coalesce("visible", F.lit(True)))
    return skew.skew_join(
        visible, tracks.select(*keys).distinct(), keys, "left_semi", ["frame_idx"], within=within
    )


def timeline(
    tracks: DataFrame, duration: Column, order: list[Column], salt_on: list[str], k: int = 12,
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """The `k` most visible tracks of every video with rail position and text lines."""
    ranking = [F.col("visible_observations").desc(), F.col("max_confidence").desc(), *order]
    best = skew.top_k(tracks, ["video_id"], ranking, k, salt_on)
    shown = display_class(F.col("class_name"), names) if names else display_class(F.col("class_name"))
    start = F.col("start_time") / duration * 100
    width = F.greatest(
        F.lit(0.8), (F.col("visible_end_time") - F.col("start_time")) / duration * 100
    )
    peak = percent(F.col("max_confidence"), 1)
    count = F.col("visible_observations").cast("string")
    span = F.concat(clock(F.col("start_time")), F.lit("–"), clock(F.col("end_time")))
    seen = F.concat(clock(F.col("start_time")), F.lit("–"), clock(F.col("visible_end_time")))
    return best.select(
        "video_id", "class_name", F.col("row_number").cast("long").alias("place"),
        F.round(start, 6).alias("rail_start"), F.round(width, 6).alias("rail_width"),
        F.concat(shown, F.lit(" · "), count, F.lit(" samples")).alias("title"),
        F.concat(span, F.lit(" · peak "), peak).alias("detail"),
        F.concat(shown, F.lit(": "), seen, F.lit(", "), count, F.lit(" samples, peak "), peak,
                 F.lit(".")).alias("summary"),
    )
