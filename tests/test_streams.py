"""Streams must give what the batch operators give."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from boxlake.plans.queries import QUERIES
from boxlake.plans.video import MAX_GAP, _observations
from boxlake.operators import replay, tracking
from boxlake.streaming import jobs


def rows_of(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_stream_tracks_equal_batch(spark, small):
    batch = tracking.assign_tracks(_observations(spark, small), tracking.TrackerOptions(MAX_GAP))
    assert rows_of(QUERIES["stream_tracks"](spark, small), batch.columns) == rows_of(batch, batch.columns)


def test_stream_review_equals_batch(spark, small):
    batch = QUERIES["review_replay"](spark, small)
    assert rows_of(QUERIES["stream_review"](spark, small), batch.columns) == rows_of(batch, batch.columns)


@pytest.mark.parametrize("late", [False, True])
def test_tracks_over_many_micro_batches(spark, tmp_path, late):
    """Files arrive one per micro-batch; frames far behind the watermark are dropped, not misplaced."""
    session = jobs.stream_session(spark)
    schema = (
        "video_id BIGINT, frame_idx BIGINT, t DOUBLE, det_idx BIGINT, class_name STRING, "
        "confidence DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, event_time TIMESTAMP"
    )

    def part(low, high, at):
        session.range(low, high).selectExpr(
            "1L AS video_id", "id AS frame_idx", "id * 1.0D AS t", "0L AS det_idx", "'a' AS class_name",
            "IF(id % 5 = 0, 0.2D, 0.9D) AS confidence", "id * 1.0D AS x1", "0.0D AS y1", "id + 20.0D AS x2",
            "20.0D AS y2", "timestamp_seconds(id + 1000000) AS event_time",
        ).coalesce(1).write.parquet(f"{tmp_path}/in/{at}")

    part(0, 20, "a")
    part(20, 40, "b")
    part(900, 901, "c")
    part(2000, 2001, "d1")
    if late:
        # Frame 10 again, far behind both the watermark and what has been decided.
        part(10, 11, "d2")
    part(5000, 5001, "e")
    stream = (
        session.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    )
    tracked = jobs.track_stream(stream, tracking.TrackerOptions(max_gap=3, patience=0), "60 seconds", frame_ms=1000)
    jobs.run_to_table(tracked, f"{tmp_path}/out")
    found = spark.read.schema(jobs.TRACK_OUTPUT).parquet(f"{tmp_path}/out/data").orderBy("frame_idx").collect()
    frames = [r.frame_idx for r in found]
    assert frames == [*range(40), 900, 2000]
    assert {r.start_frame for r in found if 0 < r.frame_idx < 40} == {1}
    assert found[5].visible is False and found[6].visible and found[6].segment == 1


EDITS = (
    "image_id BIGINT, event_time TIMESTAMP, seq BIGINT, op STRING, det_id BIGINT, class_name STRING, confidence DOUBLE, "
    "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
)


def review_batches(session, folder, batches):
    """Each batch of (image_id, seconds, seq, op, det_id) becomes one file, in order."""
    for number, rows in enumerate(batches):
        full = [
            (image, at, seq, op, det, "a", 0.5 if op == "model" else None, 1.0, 1.0, 9.0 + at % 7, 9.0)
            for image, at, seq, op, det in rows
        ]
        frame = session.createDataFrame(full, EDITS.replace("TIMESTAMP", "BIGINT")).withColumn(
            "event_time", F.timestamp_seconds(F.col("event_time") + 1_700_000_000))
        frame.coalesce(1).write.parquet(f"{folder}/{number:03d}")
        time.sleep(0.02)  # files are taken by their age
    return (
        session.readStream.schema(EDITS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        .parquet(folder)
    )


def test_reviews_with_gaps_repeats_and_late_edits(spark, tmp_path):
    session = jobs.stream_session(spark)
    ops = ["confirm", "remove", "undo", "move", "redo", "add", "restore", "reclass", "undo", "confirm"]
    edit = lambda image, seq, at: (image, at, seq, ops[seq % 10], 1 + seq % 3)
    load = [(image, 0, -1, "model", det) for image in (1, 2, 3, 4) for det in (3, 1, 2)]
    batches = [
        load + [edit(1, 0, 1), edit(2, 0, 1), edit(3, 0, 1)],
        [edit(1, 3, 4), edit(1, 2, 3), edit(2, 1, 2), edit(3, 1, 2)],            # 1 waits for number 1
        [edit(1, 1, 5), edit(1, 3, 5), edit(2, 1, 5), edit(3, 2, 6)],            # it comes; others repeat
        [edit(2, 4, 10), edit(2, 5, 11), edit(2, 4, 12), edit(3, 3, 12)],        # 2 never gets 2 and 3
        [edit(1, 4, 20), edit(3, 4, 20)], [edit(1, 5, 30)],
        [edit(1, 6, 400)], [edit(1, 7, 500)],                                    # the watermark passes the gap
        [edit(2, 2, 510), edit(2, 6, 511), edit(4, 0, 512)],                     # too late; goes on
        [edit(1, 8, 9000)], [edit(1, 9, 20_000)], [edit(1, 10, 20_001)],         # the others fall idle
    ]
    stream = review_batches(session, f"{tmp_path}/in", batches)
    progress = []
    out = jobs.review_stream(stream, "1 second", gap="60 seconds", idle="10000 seconds")
    query = (
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/out/checkpoint")
        .option("path", f"{tmp_path}/out/data").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    progress = [p.stateOperators[0] for p in query.recentProgress if p.stateOperators]
    versions = spark.read.schema(jobs.REVIEW_OUTPUT).parquet(f"{tmp_path}/out/data")
    refused = sorted((r.image_id, r.seq) for r in jobs.refused_edits(versions).collect())
    assert refused == [(1, 3), (2, 1), (2, 2), (2, 4)]
    # The batch replay of what was not refused, repeats included, gives the same boxes.
    rows = [r for b in batches for r in b if (r[0], r[2]) != (2, 2)]
    full = [(i, s, op, d, "a", 0.5 if op == "model" else None, 1.0, 1.0, 9.0 + at % 7, 9.0) for i, at, s, op, d in rows]
    first = {}
    for r in full:
        first.setdefault((r[0], r[1], r[3] if r[1] < 0 else None), r)
    table = spark.createDataFrame(list(first.values()), EDITS.replace("event_time TIMESTAMP, ", ""))
    batch = replay.replay_reviews(table.filter("seq < 0"), table.filter("seq >= 0").drop("confidence"))
    names = batch.columns
    assert rows_of(jobs.current_reviews(versions), names) == rows_of(batch, names)
    # Idle images are forgotten: one image is left, with its review, its place and a timer.
    assert progress[-1].numRowsTotal < max(p.numRowsTotal for p in progress)
    assert progress[-1].numRowsTotal <= 6


def test_batch_replay_applies_a_number_once(spark):
    rows = [(1, -1, "model", 1), (1, 0, "remove", 1), (1, 0, "remove", 1), (1, 1, "undo", None), (1, 1, "undo", None)]
    table = spark.createDataFrame(
        [(*r, "a", 0.5, 1.0, 1.0, 9.0, 9.0) for r in rows], EDITS.replace("event_time TIMESTAMP, ", "")
    )
    found = replay.replay_reviews(table.filter("seq < 0"), table.filter("seq >= 0").drop("confidence")).first()
    assert (found.removed, found.undo_depth) == (False, 0)
