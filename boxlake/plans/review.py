"""Review queue, status, totals and edit replay queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.operators import dedupe, export, greedy, review
from boxlake.functions import classes as c
from boxlake.plans.boxes import CLASS_THRESHOLDS, _SUPPRESS_RULE, _CLASS_GROUP, greedy_sql
from boxlake.plans.fixtures import derived, images, table
from boxlake.plans.registry import Registry

reviews = Registry()

_SIGNALS_CTE = """
    active AS (
        SELECT *, greatest((x2 - x1) / (y2 - y1), (y2 - y1) / (x2 - x1)) AS ratio,
               (x2 - x1) * (y2 - y1) / (640.0::DOUBLE * 480.0::DOUBLE) AS share
        FROM review_detections WHERE NOT removed),
    scored AS (
        SELECT image_id, max(1 - confidence) AS c,
               max(greatest(CASE WHEN ratio >= 6 THEN 1.0::DOUBLE WHEN ratio >= 4 THEN 0.65::DOUBLE WHEN ratio >= 3 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END,
                   CASE WHEN share < 0.002::DOUBLE THEN 1.0::DOUBLE WHEN share < 0.006::DOUBLE THEN 0.6::DOUBLE WHEN share > 0.8::DOUBLE THEN 0.8::DOUBLE
                        WHEN share > 0.6::DOUBLE THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END)) AS g
        FROM active GROUP BY image_id),
    signals AS (
        SELECT i.image_id, original_index, review_edited, image_approved, analyzed,
               coalesce(c, 1.0::DOUBLE) AS confidence_signal, coalesce(g, 1.0::DOUBLE) AS geometry_signal, c IS NULL AS empty,
               round(coalesce(c, 1.0::DOUBLE) * 0.7::DOUBLE + coalesce(g, 1.0::DOUBLE) * 0.3::DOUBLE, 6) AS uncertainty
        FROM images AS i LEFT JOIN scored AS s ON s.image_id = i.image_id)"""


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "review_detections")


@reviews.add(
    "review_signals",
    f"""
    WITH {_SIGNALS_CTE.strip()}
    SELECT image_id, confidence_signal, geometry_signal, empty, uncertainty,
           CASE WHEN empty AND geometry_signal >= 0.4::DOUBLE THEN 'no detections, unusual box' WHEN empty THEN 'no detections'
                WHEN confidence_signal >= 0.5::DOUBLE AND geometry_signal >= 0.4::DOUBLE THEN 'low confidence, unusual box'
                WHEN confidence_signal >= 0.5::DOUBLE THEN 'low confidence'
                WHEN geometry_signal >= 0.4::DOUBLE THEN 'unusual box' ELSE 'routine' END AS reasons
    FROM signals""",
    ("images", "review_detections"),
)
def review_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = review.review_signals(images(spark, sf_dir), _review(spark, sf_dir))
    return signals.select(
        "image_id", "confidence_signal", "geometry_signal", "empty", "uncertainty", "reasons"
    )


@reviews.add(
    "review_rank",
    f"""
    WITH {_SIGNALS_CTE.strip()}
    SELECT row_number() OVER w AS position, image_id, review_edited, uncertainty,
           lag(image_id) OVER w AS previous_image, lead(image_id) OVER w AS next_image
    FROM signals WHERE analyzed AND NOT image_approved
    WINDOW w AS (ORDER BY review_edited, uncertainty DESC, original_index)""",
    ("images", "review_detections"),
)
def review_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_queue(
        review.review_signals(images(spark, sf_dir), _review(spark, sf_dir))
    )


@reviews.add(
    "review_status",
    """
    WITH n AS (
        SELECT i.image_id, i.image_approved, count(r.det_idx) AS active,
               count(*) FILTER (r.confirmed) AS confirmed
        FROM images AS i LEFT JOIN review_detections AS r ON r.image_id = i.image_id AND NOT r.removed
        GROUP BY i.image_id, i.image_approved)
    SELECT *, active > 0 AND active = confirmed AS all_confirmed,
           CASE WHEN image_approved AND active = 0 THEN 'Approved · no detections'
                WHEN image_approved THEN 'Approved · ' || confirmed || ' of ' || active || ' boxes confirmed'
                WHEN active = 0 THEN 'No active detections · approval needed'
                WHEN active = confirmed THEN 'All ' || active || ' confirmed'
                ELSE confirmed || ' of ' || active || ' confirmed' END AS label
    FROM n""",
    ("images", "review_detections"),
)
def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_status(images(spark, sf_dir), _review(spark, sf_dir))


@reviews.add(
    "review_summary",
    """
    WITH n AS (
        SELECT image_id, det_idx, '{"class":"' || class_name || '","bbox":[' || CAST(x1 AS VARCHAR) || ','
                   || CAST(y1 AS VARCHAR) || ',' || CAST(x2 AS VARCHAR) || ',' || CAST(y2 AS VARCHAR)
                   || '],"source":"' || source || '","confirmed":' || CAST(confirmed AS VARCHAR)
                   || ',"removed":' || CAST(removed AS VARCHAR) || ',"modelConfidence":'
                   || CASE WHEN source = 'model' THEN CAST(confidence + 1 AS VARCHAR) ELSE 'null' END || '}' AS record
        FROM review_detections)
    SELECT i.image_id, image_approved AS approved,
           image_approved AND i.image_id NOT IN (SELECT image_id FROM review_detections WHERE NOT removed) AS approved_empty,
           det_idx, record
    FROM images AS i LEFT JOIN n ON n.image_id = i.image_id""",
    ("images", "review_detections"),
)
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Shifted by one, so that no confidence is printed with an exponent.
    rows = _review(spark, sf_dir).withColumn("confidence", F.col("confidence") + 1)
    return export.review_records(images(spark, sf_dir), rows)


@reviews.add(
    "queue_totals",
    """
    SELECT count(*) AS images, count(*) FILTER (analyzed AND NOT image_approved) AS pending,
           count(*) FILTER (review_edited) AS edited,
           (SELECT count(*) FROM review_detections WHERE NOT removed) AS boxes
    FROM images""",
    ("images", "review_detections"),
)
def queue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.queue_totals(images(spark, sf_dir), _review(spark, sf_dir))


@reviews.add(
    "run_totals",
    """
    WITH r AS (
        SELECT user_id AS run_id, CASE WHEN event_type = 'error' THEN 'failed' END AS error, event_id % 7 AS detections,
               CAST(event_id % 50 AS DOUBLE) / 100 AS a, CAST(event_id % 60 + 10 AS DOUBLE) / 100 AS b,
               CAST(event_id % 70 + 5 AS DOUBLE) / 100 AS c FROM events)
    SELECT run_id, count(*) AS images, count(*) FILTER (error IS NULL) AS done,
           count(*) FILTER (error IS NOT NULL) AS failed,
           CAST(coalesce(sum(detections) FILTER (error IS NULL), 0) AS BIGINT) AS boxes, min(least(a, b, c)) AS effective_confidence
    FROM r GROUP BY run_id""",
)
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "events").selectExpr(
        "user_id AS run_id", "IF(event_type = 'error', 'failed', NULL) AS error",
        "event_id % 7 AS detections", "CAST(event_id % 50 AS DOUBLE) / 100 AS conf_burst",
        "CAST(event_id % 60 + 10 AS DOUBLE) / 100 AS conf_accumulation",
        "CAST(event_id % 70 + 5 AS DOUBLE) / 100 AS conf_drop",
    )
    return review.run_totals(results)


@reviews.add(
    "box_inspection",
    """
    SELECT image_id, det_idx, CASE WHEN removed THEN 'removed' WHEN confirmed THEN 'confirmed'
               WHEN source = 'manual' THEN 'manual' ELSE 'not reviewed' END AS state,
           CAST(CAST(floor(x2 - x1 + 0.5) AS BIGINT) AS VARCHAR) || ' × ' || CAST(CAST(floor(y2 - y1 + 0.5) AS BIGINT) AS VARCHAR) AS size,
           printf('%.1f', round(confidence * 100, 1)) AS confidence_pct,
           printf('%.2f', round(floor(x2 - x1 + 0.5) * floor(y2 - y1 + 0.5) / 307201.0::DOUBLE * 100, 2)) AS image_pct
    FROM (SELECT * REPLACE (confidence + 0.00001::DOUBLE AS confidence) FROM review_detections) AS r""",
    ("review_detections",),
)
def box_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A prime-like area and shifted confidences keep the text away from rounding ties.
    rows = _review(spark, sf_dir).withColumn("confidence", F.col("confidence") + 0.00001)
    return review.box_inspection(rows, F.lit(307201.0), F.lit(1.0))


@reviews.add(
    "class_summary",
    """
    WITH n AS (SELECT image_id, class_name, count(*) AS n FROM detections GROUP BY 1, 2),
    s AS (SELECT image_id, string_agg(class_name || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY class_name) AS summary FROM n GROUP BY 1)
    SELECT image_id, coalesce(summary, 'no detections') AS summary FROM images LEFT JOIN s USING (image_id)""",
    ("images", "detections"),
)
def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.class_summary(derived(spark, sf_dir, "detections"), images(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class thresholds, suppression, then a class summary of every image."""
    rows = derived(spark, sf_dir, "detections").drop("variant", "class_id")
    keep = c.passes_threshold(F.col("class_name"), F.col("confidence"), 0.25, CLASS_THRESHOLDS)
    survivors = greedy.suppress(rows.filter(keep))
    return export.class_summary(survivors, images(spark, sf_dir))


reviews.add(
    "detections_to_summary",
    """
    WITH RECURSIVE strong AS (
        SELECT * FROM detections WHERE confidence >= CASE class_name WHEN 'pipe burst' THEN 0.30::DOUBLE
            WHEN 'water accumulation' THEN 0.45::DOUBLE ELSE 0.60::DOUBLE END), """
    + greedy_sql("strong", _CLASS_GROUP, _SUPPRESS_RULE).strip()[len("WITH RECURSIVE") :]
    + """,
    n AS (SELECT r.image_id, r.class_name, count(*) AS n FROM fold AS f
          JOIN ranked AS r ON r.grp = f.grp AND r.rn = f.rn WHERE f.suppressed_by IS NULL GROUP BY 1, 2),
    s AS (SELECT image_id, string_agg(class_name || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY class_name) AS summary FROM n GROUP BY 1)
    SELECT image_id, coalesce(summary, 'no detections') AS summary FROM images LEFT JOIN s USING (image_id)""",
    ("images", "detections"),
)(flagship)


@reviews.add(
    "latency_summary",
    """
    WITH m AS (SELECT event_id % 7 AS run_id, CASE event_id % 20 WHEN 0 THEN 'cold' WHEN 1 THEN 'warmup' ELSE 'cached' END AS phase,
                      value AS elapsed_ms FROM events)
    SELECT run_id, round(avg(elapsed_ms) FILTER (phase = 'cached'), 6) AS mean_ms, min(elapsed_ms) FILTER (phase = 'cached') AS fastest_ms,
           max(elapsed_ms) FILTER (phase = 'cached') AS slowest_ms, count(*) FILTER (phase = 'cached') AS runs,
           median(elapsed_ms) FILTER (phase = 'cached') AS median_ms, max(elapsed_ms) FILTER (phase = 'cold') AS cold_ms
    FROM m GROUP BY run_id""",
)
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    timings = table(spark, sf_dir, "events").selectExpr(
        "event_id % 7 AS run_id",
        "CASE event_id % 20 WHEN 0 THEN 'cold' WHEN 1 THEN 'warmup' ELSE 'cached' END AS phase",
        "value AS elapsed_ms",
    )
    return dedupe.latency_summary(timings)


_OPS = ("confirm", "toggle", "approve", "move", "toggle", "toggle", "reset", "remove", "approve")
_OP_SQL = "CASE (conv_id + turn * 5) % 9 {} END".format(
    " ".join(f"WHEN {i} THEN '{op}'" for i, op in enumerate(_OPS))
)


@reviews.add(
    "approval_state",
    f"""
    WITH e AS (SELECT conv_id AS image_id, turn AS seq, {_OP_SQL} AS op FROM conversations),
    l AS (SELECT image_id, max(seq) AS last_seq,
                 list_prepend(0, list(CASE op WHEN 'toggle' THEN 1 WHEN 'approve' THEN 2 ELSE 3 END ORDER BY seq)) AS a,
                 list_prepend(0, list(CASE op WHEN 'reset' THEN 3 ELSE 1 END ORDER BY seq)) AS d FROM e GROUP BY image_id)
    SELECT image_id, last_seq,
           list_reduce(a, lambda s, o: CASE o WHEN 1 THEN 1 - s WHEN 2 THEN 1 ELSE 0 END) = 1 AS image_approved,
           list_reduce(d, lambda s, o: CASE o WHEN 3 THEN 0 ELSE 1 END) = 1 AS review_edited
    FROM l""",
)
def approval_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS image_id", "turn AS seq", f"{_OP_SQL} AS op"
    )
    return review.approval_state(events)
