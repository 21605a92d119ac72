"""Streaming forms of admission, tracking and review replay.

Each job is a plain DataFrame function from a streaming input to a streaming output; `run_to_table`
drives one into an exactly-once Parquet file sink.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from boxlake import skew
from boxlake.functions import classes as c
from boxlake.operators.replay import Replay
from boxlake.operators.tracking import Tracker, TrackerOptions
from boxlake.sources.detections import ingest_json

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SAVED = StructType([StructField("saved", BinaryType())])


def stream_session(spark: SparkSession) -> SparkSession:
    """A sibling session with the state store the stateful jobs need; the caller's stays as it is."""
    session = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            session.conf.set(name, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return session


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    skew.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, path: str, partition: str | None = None) -> None:
    """Process everything that is available now into Parquet files under `path`/data."""
    writer = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/data")
        .trigger(availableNow=True)
    )
    if partition:
        writer = writer.partitionBy(partition)
    query = writer.start()
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def admit_detections(
    docs: DataFrame, confidence: float, per_class: Mapping[str, float] | None = None
) -> DataFrame:
    """(doc_id, body) JSON documents to detections with `outcome` (kept, below_threshold, rejected).

    Stateless, so it works on batch and streaming inputs alike.
    """
    rows = ingest_json(docs)
    passes = c.passes_threshold(F.col("class_name"), F.col("confidence"), confidence, per_class)
    outcome = (
        F.when(F.col("reject_reason").isNotNull(), "rejected")
        .when(passes, "kept").otherwise("below_threshold")
    )
    return rows.withColumn("outcome", outcome)


_TRACK_INPUT = list(Tracker.inputs)
# Position of event_ms, which the tracker's columns follow.
_TRACK_FIRST = 3
_TRACK_ROW = Row("video_id", "class_name", *[name for name, _ in Tracker.outputs])
_NULLABLE = {"bigint": "Int64", "int": "Int32", "double": "Float64", "boolean": "boolean"}


class _StreamTracker(StatefulProcessor):
    """Buffers one (video, class) until the watermark passes a frame, then tracks it in order."""

    def __init__(self, options: TrackerOptions, frame_ms: float) -> None:
        self.tracker = Tracker(options)
        self.lifetime = int(options.max_gap * frame_ms) + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tracker", _SAVED)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues):
        state, pending, decided, last = self._load()
        # (event_ms, *_TRACK_INPUT); frames up to the last decided watermark are closed.
        pending.extend(r for r in (tuple(row[_TRACK_FIRST:]) for row in rows) if r[0] >= decided)
        watermark = timerValues.getCurrentWatermarkInMs()
        yield from self._advance(key, state, pending, max(decided, watermark), last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state, pending, decided, last = self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        yield from self._advance(key, state, pending, max(decided, watermark), last)

    def close(self) -> None:
        pass

    def _load(self):
        saved = self.state.get()  # one call to the state store, also where nothing is kept
        return (self.tracker.begin(), [], 0, 0) if saved is None else pickle.loads(saved[0])

    def _advance(self, key, state, pending: list, watermark: int, last: int):
        ready = sorted((r for r in pending if r[0] < watermark), key=lambda r: (r[1], r[3]))
        pending = [r for r in pending if r[0] >= watermark]
        done: list[tuple] = []
        for row in ready:
            done.extend(self.tracker.feed(state, row[1:]))
        if ready:
            # Every row of a frame below the watermark has arrived.
            done.extend(self.tracker.finish(state))
            last = ready[-1][0]
        alive = bool(state["tracks"]) and watermark < last + self.lifetime
        if pending:
            self.handle.registerTimer(min(r[0] for r in pending) + 1)
        elif alive:
            # No later frame can match these tracks once the gap has passed; then the key is freed.
            self.handle.registerTimer(last + self.lifetime)
        if pending or alive:
            self.state.update((pickle.dumps((state, pending, watermark, last)),))
        else:
            self.state.clear()
        for row in done:
            yield _TRACK_ROW(*key, *row)


TRACK_OUTPUT = "video_id BIGINT, class_name STRING, " + ", ".join(
    f"{n} {t}" for n, t in Tracker.outputs
)


def track_stream(
    observations: DataFrame, options: TrackerOptions, lateness: str = "10 minutes",
    frame_ms: float = 1.0,
) -> DataFrame:
    """The batch tracker on an unbounded observation stream with an `event_time` column.

    `frame_ms` is the time one frame number stands for; a key is forgotten once no track of it can
    be continued any more.

    Rows later than the watermark are dropped by Spark and show up in the query's
    `numRowsDroppedByWatermark` metric. Frames leave once the watermark passes them.
    """
    rows = observations
    for name in ("flow_dx", "flow_dy", "flow_reliability"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
    timed = rows.withWatermark("event_time", lateness).withColumn(
        "event_ms", F.unix_millis("event_time")
    )
    return (
        timed.select("video_id", "class_name", "event_time", "event_ms", *_TRACK_INPUT)
        .groupBy("video_id", "class_name")
        .transformWithState(
            statefulProcessor=_StreamTracker(options, frame_ms),
            outputStructType=StructType.fromDDL(TRACK_OUTPUT),
            outputMode="Append",
            timeMode="EventTime",
        )
    )


_EDIT = "op STRING, det_id BIGINT, class_name STRING, confidence DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
_PLACE = "expected BIGINT, waiting BIGINT, gap_timer BIGINT, last_ms BIGINT"


class _StreamReview(StatefulProcessor):
    """Applies an image's edits in `seq` order.

    State: the review itself, one small row (the number that comes next, how many edits wait, the running
    timers) and a map of the waiting edits by number, so a batch writes what it brings and not what was
    there before. A gap is waited for until the watermark passes the first edit behind it by `gap_ms`;
    then the missing numbers are skipped. An image without news for `idle_ms` is forgotten.
    """

    def __init__(self, gap_ms: int, idle_ms: int) -> None:
        self.gap_ms, self.idle_ms = gap_ms, idle_ms
        self.replay = Replay()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.review = handle.getValueState("review", _SAVED)
        self.place = handle.getValueState("place", _PLACE)
        self.waiting = handle.getMapState("waiting", "seq BIGINT", _EDIT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        expected, waiting, timer, last = self.place.get() if self.place.exists() else (0, 0, 0, 0)
        review, loaded = None, False
        arrived, refused = [], []
        columns = ["seq", "event_ms", *Replay.inputs[1:]]
        for batch in rows:
            clean = batch[columns].astype(object).where(batch[columns].notna(), None)
            arrived.extend(tuple(r) for r in clean.itertuples(index=False, name=None))
        arrived.sort(key=lambda r: (r[0], r[3] if r[0] < 0 and r[3] is not None else 0))
        for seq, at, *edit in arrived:
            last = max(last, int(at))
            if seq < 0:
                review = self._review() if review is None else review
                self.replay.feed(review, (seq, *edit))
                loaded = True
            elif seq < expected:
                refused.append((seq, "late or repeated"))
            elif self.waiting.containsKey((seq,)):
                refused.append((seq, "repeated"))
            else:
                self.waiting.updateValue((seq,), tuple(edit))
                waiting += 1
                if seq > expected and not timer:
                    timer = last + self.gap_ms
                    self.handle.registerTimer(timer)
        review, expected, waiting, applied = self._apply(review, expected, waiting)
        yield from self._settle(key, review, expected, waiting, timer, last, applied or loaded, refused)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.place.exists():
            return
        now = expiredTimerInfo.getExpiryTimeInMs()
        expected, waiting, timer, last = self.place.get()
        if waiting and now == timer:
            # The gap stays open no longer: go on with the first edit behind it.
            expected = min(seq for (seq,) in self.waiting.keys())
            review, expected, waiting, _ = self._apply(None, expected, waiting)
            timer = 0
            if waiting:
                timer = timerValues.getCurrentWatermarkInMs() + self.gap_ms
                self.handle.registerTimer(timer)
            yield from self._settle(key, review, expected, waiting, timer, last, True, [])
        elif not waiting and now >= last + self.idle_ms:
            self.review.clear()
            self.place.clear()

    def close(self) -> None:
        pass

    def _review(self):
        return self.replay.load(self.review.get()[0]) if self.review.exists() else self.replay.begin()

    def _apply(self, review, expected: int, waiting: int):
        """Feeds the edits that follow without a gap."""
        applied = False
        while waiting and self.waiting.containsKey((expected,)):
            review = self._review() if review is None else review
            self.replay.feed(review, (expected, *self.waiting.getValue((expected,))))
            self.waiting.removeKey((expected,))
            expected, waiting, applied = expected + 1, waiting - 1, True
        return review, expected, waiting, applied

    def _settle(self, key, review, expected, waiting, timer, last, changed, refused):
        if timer and not waiting:
            self.handle.deleteTimer(timer)
            timer = 0
        if not waiting:
            self.handle.registerTimer(last + self.idle_ms)
        self.place.update((expected, waiting, timer, last))
        names = [n for n, _ in Replay.outputs]
        if changed:
            done = self.replay.finish(review)
            self.review.update((self.replay.save(review),))
            frame = pd.DataFrame(done, columns=names)
            frame.insert(0, "image_id", key[0])
            frame.insert(1, "version", expected)
            frame.insert(2, "refused_seq", pd.array([None] * len(done), dtype="Int64"))
            frame.insert(3, "reason", None)
            yield frame
        if refused:
            frame = pd.DataFrame({"image_id": key[0], "version": expected}, index=range(len(refused)))
            frame["refused_seq"] = pd.array([s for s, _ in refused], dtype="Int64")
            frame["reason"] = [r for _, r in refused]
            for name, kind in Replay.outputs:
                frame[name] = pd.array([None] * len(refused), dtype=_NULLABLE.get(kind, "object"))
            yield frame


REVIEW_OUTPUT = "image_id BIGINT, version BIGINT, refused_seq BIGINT, reason STRING, " + ", ".join(
    f"{n} {t}" for n, t in Replay.outputs
)


def review_stream(
    events: DataFrame, lateness: str = "10 minutes", gap: str = "1 hour", idle: str = "7 days"
) -> DataFrame:
    """Review edits to box lists; `version` counts applied edits, the highest one is current.

    `events` carries image_id, event_time, seq (dense from 0; -1 for detections to load) and the replay
    columns. A missing number is waited for up to `gap` of event time. Edits whose number was applied
    or skipped already, and repeated ones, come out beside the boxes with `refused_seq` and `reason`.
    """
    span = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    timed = events.withWatermark("event_time", lateness).withColumn(
        "event_ms", F.unix_millis("event_time")
    )
    return (
        timed.select("image_id", "event_time", "event_ms", *Replay.inputs)
        .groupBy("image_id")
        .transformWithStateInPandas(
            statefulProcessor=_StreamReview(span(gap), span(idle)),
            outputStructType=StructType.fromDDL(REVIEW_OUTPUT),
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def refused_edits(versions: DataFrame) -> DataFrame:
    """(image_id, seq, reason) of the edits that were not applied."""
    return versions.filter("reason IS NOT NULL").select(
        "image_id", F.col("refused_seq").alias("seq"), "reason"
    )


def current_reviews(versions: DataFrame) -> DataFrame:
    """The latest version of every image."""
    boxes = versions.filter("reason IS NULL").drop("reason", "refused_seq")
    last = boxes.groupBy("image_id").agg(F.max("version").alias("version"))
    return skew.skew_join(boxes, last, ["image_id", "version"], "left_semi", ["det_id"])
