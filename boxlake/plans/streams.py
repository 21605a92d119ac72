"""Streaming queries: each drives the given tables through a stream and reads the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.operators.tracking import TrackerOptions
from boxlake.plans import boxes as box_plans
from boxlake.plans import video as video_plans
from boxlake.plans.fixtures import RELATIONS, TABLE_SCHEMAS, _project, lanes_of
from boxlake.plans.registry import Registry
from boxlake.streaming import jobs

streams = Registry()


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return (
        spark.readStream.schema(TABLE_SCHEMAS[name])
        .option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    )


@streams.add(
    "stream_admission",
    box_plans.INGEST_SQL.replace("reject_reason\n", """reject_reason,
           CASE WHEN variant IN (1, 2) OR class_name = '' OR confidence > 1 OR variant = 6 OR x2 <= x1 THEN 'rejected'
                WHEN confidence >= 0.25::DOUBLE AND confidence >= CASE class_name WHEN 'pipe burst' THEN 0.30::DOUBLE
                     WHEN 'water accumulation' THEN 0.45::DOUBLE WHEN 'water drop' THEN 0.60::DOUBLE ELSE 0.25::DOUBLE END
                THEN 'kept' ELSE 'below_threshold' END AS outcome
""").replace("x1, CASE WHEN variant NOT IN (1, 2) THEN x2 END AS x2,", "x1,"),
    ("detections",),
)
def stream_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _project(stream_table(spark, sf_dir, "lineitem"), RELATIONS["detections"][2])
    admitted = jobs.admit_detections(
        box_plans.detection_documents(rows), 0.25, box_plans.CLASS_THRESHOLDS
    )
    path = jobs.scratch_path(spark, "admission")
    kept = admitted.select(
        "doc_id", "det_idx", "class_name", "confidence", "x1", "reject_reason", "outcome"
    )
    jobs.run_to_table(kept, path, "outcome")
    schema = "doc_id BIGINT, det_idx BIGINT, class_name STRING, confidence DOUBLE, x1 DOUBLE, reject_reason STRING, outcome STRING"
    return spark.read.schema(schema).parquet(f"{path}/data")


@streams.add("stream_tracks")
def stream_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of the event stream; a far-future heartbeat moves the watermark past the last frame."""
    session = jobs.stream_session(spark)
    path = jobs.scratch_path(spark, "tracks")
    events = stream_table(session, sf_dir, "events")
    beat = session.range(1).selectExpr(
        "CAST(-1 AS BIGINT) AS event_id", "TIMESTAMP_NTZ '2100-01-01 00:00:00' AS ts",
        "CAST(-1 AS BIGINT) AS user_id", "'beat' AS event_type", "0.0D AS value", "'' AS props",
    )
    beat.coalesce(1).write.parquet(f"{path}/beat")
    beats = session.readStream.schema(TABLE_SCHEMAS["events"]).parquet(f"{path}/beat")
    rows = _project(lanes_of(events.unionByName(beats)), RELATIONS["observations"][2])
    timed = rows.withColumn(
        "event_time",
        F.timestamp_millis(F.col("frame_idx") + F.lit(1_704_067_200_000)),
    )
    tracked = jobs.track_stream(timed, TrackerOptions(max_gap=video_plans.MAX_GAP))
    jobs.run_to_table(tracked, path)
    return spark.read.schema(jobs.TRACK_OUTPUT).parquet(f"{path}/data").filter("video_id >= 0")


@streams.add("stream_review")
def stream_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = jobs.stream_session(spark)
    path = jobs.scratch_path(spark, "review")
    turns = stream_table(session, sf_dir, "conversations")
    edits = video_plans.review_rows(turns).withColumn(
        "event_time", F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("seq") * 1000)
    )
    jobs.run_to_table(jobs.review_stream(edits), path)
    return jobs.current_reviews(spark.read.schema(jobs.REVIEW_OUTPUT).parquet(f"{path}/data"))
