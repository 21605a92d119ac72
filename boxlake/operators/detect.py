"""From raw model rows to detections: decode, map back to pixels, fall back, overlay, hit-test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake import skew
from boxlake.functions import classes as c
from boxlake.functions import geometry as g
from boxlake.operators import greedy
from boxlake.schemas import CLASS_NAMES
from boxlake.sources.detections import best_class, check_anchor_rows

# The class list each model role must carry.
EXPECTED_CLASSES = {"general": CLASS_NAMES, "last": CLASS_NAMES, "specialist": (c.SPECIALIST,)}

# What a caller may select, and the role that serves it.
ROLE_OF_SELECTION = {
    "water_detection": "general",
    "water_detection_last": "last",
    "water_accumulation": "specialist",
}

MAX_PER_IMAGE = 300


def decode_anchors(
    anchors: DataFrame,
    confidence: float,
    names: tuple[str, ...] = CLASS_NAMES,
    iou_threshold: float = 0.4,
    max_per_image: int = MAX_PER_IMAGE,
) -> DataFrame:
    """Raw (cx, cy, w, h, scores) rows to NMS survivors, strongest first, at most 300 per image."""
    threshold = c.check_threshold(confidence)
    shaped = check_anchor_rows(anchors, len(names)).filter(F.col("reject_reason").isNull())
    rows = best_class(shaped).filter(F.col("confidence") >= threshold)
    named = rows.withColumn("class_name", c.class_name_of(F.col("class_id"), names))
    kept = greedy.nms(named, iou_threshold)
    return greedy.strongest_per_image(kept, max_per_image).withColumn(
        "row_number", F.col("row_number").cast("long")
    )


def decode_end_to_end(
    rows: DataFrame,
    confidence: float,
    names: tuple[str, ...] = CLASS_NAMES,
    max_per_image: int = MAX_PER_IMAGE,
) -> DataFrame:
    """Rows already decoded by the model (x1, y1, x2, y2, score, class_id): threshold and cap.

    The cap follows row order, and no NMS is applied.
    """
    threshold = c.check_threshold(confidence)
    kept = rows.filter(F.col("score") >= threshold)
    capped = skew.top_k(
        kept, ["image_id"], [F.col("anchor_idx").asc()], max_per_image, ["anchor_idx"]
    )
    class_id = F.col("class_id").cast("int")
    return capped.select(
        "image_id", F.col("anchor_idx").alias("det_idx"), class_id.alias("class_id"),
        F.coalesce(c.class_name_of(class_id, names), class_id.cast("string")).alias("class_name"),
        F.col("score").alias("confidence"), "x1", "y1", "x2", "y2",
        F.col("row_number").cast("long").alias("row_number"),
    )


def to_original_pixels(rows: DataFrame, model_width: int, model_height: int) -> DataFrame:
    """Model-space boxes to image pixels; `rows` carries the image's width and height."""
    width, height = F.col("width"), F.col("height")
    fit = g.letterbox(width, height, model_width, model_height)
    b = g.undo_letterbox(g.box(), fit, width, height)
    corners = {"x1": b.x1, "y1": b.y1, "x2": b.x2, "y2": b.y2}
    return rows.withColumns({**corners, "confidence": F.round("confidence", 4)})


def ensemble_fallback(general: DataFrame, specialist: DataFrame) -> DataFrame:
    """All general rows, plus specialist rows of images where general saw no accumulation."""
    seen = (
        general.filter(c.folded(F.col("class_name")) == c.ACCUMULATION)
        .select("image_id")
        .distinct()
    )
    extra = skew.skew_join(
        c.specialist_only(specialist), seen, ["image_id"], "left_anti", ["det_idx"]
    )
    return general.withColumn("role", F.lit("general")).unionByName(
        extra.withColumn("role", F.lit("specialist"))
    )


def overlay(rows: DataFrame, width: int, height: int, label_height: int) -> DataFrame:
    """Integer, bounds-safe overlay corners, colour and label of every detection."""
    line_width = max(2, round(max(width, height) / 400))

    def within(value, low, high):
        return F.least(F.greatest(F.bround(value), low), F.lit(float(high)))

    zero = F.lit(0.0)
    start = rows.select(
        "*", within(F.col("x1"), zero, width - 1).alias("_x1"),
        within(F.col("y1"), zero, height - 1).alias("_y1"),
    )
    shown = c.display_class(F.col("class_name"), c.OVERLAY_NAMES)
    share = F.bround(F.col("confidence") * 100).cast("int").cast("string")
    return start.select(
        "image_id", "det_idx",
        F.col("_x1").cast("int").alias("x1"),
        F.col("_y1").cast("int").alias("y1"),
        within(F.col("x2"), F.col("_x1"), width - 1).cast("int").alias("x2"),
        within(F.col("y2"), F.col("_y1"), height - 1).cast("int").alias("y2"),
        F.lit(line_width).alias("line_width"),
        c.class_colour(F.col("class_name")).alias("colour"),
        F.concat(shown, F.lit(" "), share, F.lit("%")).alias("label"),
        F.greatest(zero, F.col("_y1") - label_height).cast("int").alias("label_y"),
    )


def topmost_box(clicks: DataFrame, boxes: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(click_id, image_id, det_idx): the last listed box under each click.

    Clicks are few per image, so boxes are the salted side; the arg-max combines map-side.
    """
    joined = skew.skew_join(
        boxes.select("image_id", "det_idx", "x1", "y1", "x2", "y2"), clicks, ["image_id"],
        "inner", ["det_idx"],
    )
    x, y = F.col("px"), F.col("py")
    inside = (
        (x >= F.col("x1") - tolerance) & (x <= F.col("x2") + tolerance)
        & (y >= F.col("y1") - tolerance) & (y <= F.col("y2") + tolerance)
    )
    return joined.filter(inside).groupBy("click_id", "image_id").agg(
        F.max("det_idx").alias("det_idx")
    )
