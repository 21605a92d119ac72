"""Detections in and out of JSON, and raw model-output rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake import skew
from boxlake.functions import geometry as g
from boxlake.schemas import DETECTION_JSON


def ingest_json(docs: DataFrame, key: str = "doc_id", body: str = "body", strict: bool = False):
    """One row per detection of each JSON array, with `reject_reason`.

    A body that is not an array yields one rejected row without a position. With `strict` a
    document is good only as a whole: its good rows are rejected too when any row is bad.
    """
    is_array = F.col(body).rlike(r"^\s*\[")
    # Parsed once; the array is then exploded and tested as a plain column.
    parsed = docs.select(key, F.when(is_array, F.from_json(body, DETECTION_JSON)).alias("_d"))
    rows = parsed.select(
        key, F.col("_d").isNull().alias("_bad_doc"), F.posexplode_outer("_d").alias("det_idx", "d")
    ).filter(F.col("det_idx").isNotNull() | F.col("_bad_doc"))
    corners = [F.get("d.bbox", F.lit(i)) for i in range(4)]
    wide = rows.select(
        key, "_bad_doc", F.col("det_idx").cast("long").alias("det_idx"),
        F.col("d.class").alias("class_name"), F.col("d.confidence").alias("confidence"),
        F.size("d.bbox").alias("_n"),
        *[c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)],
    )
    conf = F.col("confidence")
    reason = (
        F.when(F.col("_bad_doc"), "not an array of detections")
        .when(F.col("class_name").isNull() | (F.col("class_name") == ""), "class name missing")
        .when(~g.is_finite(conf) | (conf < 0) | (conf > 1), "confidence not in 0..1")
        .when(~(F.coalesce(F.col("_n"), F.lit(0)) == 4), "bounding box needs four numbers")
        .otherwise(g.invalid_reason(g.box()))
    )
    result = wide.withColumn("reject_reason", reason).drop("_bad_doc", "_n")
    if not strict:
        return result
    bad = result.filter(F.col("reject_reason").isNotNull()).select(key).distinct()
    flagged = skew.skew_join(
        result, bad.withColumn("_bad", F.lit(True)), [key], "left", ["det_idx"]
    )
    whole = F.when(F.col("_bad"), F.coalesce("reject_reason", F.lit("document has a bad row")))
    return flagged.withColumn("reject_reason", whole).drop("_bad")


def detection_records(df: DataFrame) -> DataFrame:
    """(image_id, det_idx, record): one JSON object {class, confidence, bbox} per box.

    In the order of det_idx, between brackets, they are the image's document (`export.write_files`).
    """
    item = F.struct(
        F.col("class_name").alias("class"), "confidence", F.array("x1", "y1", "x2", "y2").alias("bbox")
    )
    return df.select("image_id", "det_idx", F.to_json(item).alias("record"))


def check_anchor_rows(anchors: DataFrame, class_count: int) -> DataFrame:
    """Adds `reject_reason` for raw rows whose score vector has the wrong length."""
    bad = F.coalesce(F.size("scores") != class_count, F.lit(True))
    return anchors.withColumn("reject_reason", F.when(bad, "unexpected output shape"))


def best_class(anchors: DataFrame) -> DataFrame:
    """Arg-max class (lowest index on ties) and its score, centre form to corners."""
    top = F.array_max("scores")
    corners = g.from_centre(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    return anchors.select(
        "image_id",
        F.col("anchor_idx").alias("det_idx"),
        (F.array_position("scores", top) - 1).cast("int").alias("class_id"),
        top.alias("confidence"),
        corners.x1.alias("x1"), corners.y1.alias("y1"),
        corners.x2.alias("x2"), corners.y2.alias("y2"),
    )
