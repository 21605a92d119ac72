"""Human review: uncertainty signals, ranking, status, approval state, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake import skew
from boxlake.functions import geometry as g
from boxlake.functions.text import fixed


def active_boxes(review: DataFrame) -> DataFrame:
    return review.filter(~F.col("removed"))


def review_signals(images: DataFrame, review: DataFrame) -> DataFrame:
    """Confidence and geometry uncertainty, score and reasons for every image.

    Boxes are reduced to one row per image before they meet the spine; an image without active
    boxes scores 1 on both signals.
    """
    # The spine's size columns are uniform per image, so geometry needs them before reducing.
    sized = skew.skew_join(
        active_boxes(review), images.select("image_id", "width", "height"), ["image_id"], "inner",
        ["det_idx"],
    )
    shape = F.when(
        (F.col("width") > 0) & (F.col("height") > 0),
        g.shape_uncertainty(g.box(), F.col("width"), F.col("height")),
    ).otherwise(1.0)
    per_image = sized.groupBy("image_id").agg(
        F.max(1 - F.col("confidence")).alias("_c"), F.max(shape).alias("_g")
    )
    joined = images.join(per_image, "image_id", "left")
    confidence = F.coalesce("_c", F.lit(1.0))
    geometry = F.coalesce("_g", F.lit(1.0))
    empty = F.col("_c").isNull()
    first = F.when(empty, "no detections").when(confidence >= 0.5, "low confidence")
    second = F.when(geometry >= 0.4, "unusual box")
    reasons = F.concat_ws(", ", first, second)
    return joined.select(
        *images.columns,
        confidence.alias("confidence_signal"),
        geometry.alias("geometry_signal"),
        empty.alias("empty"),
        F.round(confidence * 0.7 + geometry * 0.3, 6).alias("uncertainty"),
        F.when(reasons == "", "routine").otherwise(reasons).alias("reasons"),
    )


def review_queue(signals: DataFrame) -> DataFrame:
    """Pending images in review order with position, previous and next image.

    The order is global, so positions come from a range sort and neighbours from one regrouping by
    position: no task ever sees the whole queue.
    """
    pending = signals.filter(F.col("analyzed") & ~F.col("image_approved")).select(
        "image_id", "original_index", "review_edited", "uncertainty"
    )
    order = [
        F.col("review_edited").asc(), F.col("uncertainty").desc(),
        F.col("original_index").asc(), F.col("image_id").asc(),
    ]
    placed = skew.global_index(pending, order, "position")
    own = F.struct("image_id", "review_edited", "uncertainty")
    none = F.lit(None)
    votes = F.array(
        F.struct(F.col("position").alias("p"), own.alias("own"),
                 none.cast("long").alias("prev"), none.cast("long").alias("next")),
        F.struct((F.col("position") + 1).alias("p"), none.alias("own"),
                 F.col("image_id").alias("prev"), none.cast("long").alias("next")),
        F.struct((F.col("position") - 1).alias("p"), none.alias("own"),
                 none.cast("long").alias("prev"), F.col("image_id").alias("next")),
    )
    spread = placed.select(F.explode(votes).alias("v")).select("v.*")
    return (
        spread.groupBy("p")
        .agg(F.max("own").alias("own"), F.max("prev").alias("previous_image"),
             F.max("next").alias("next_image"))
        .filter(F.col("own").isNotNull())
        .select(F.col("p").alias("position"), "own.*", "previous_image", "next_image")
    )


def review_status(images: DataFrame, review: DataFrame) -> DataFrame:
    per_image = active_boxes(review).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("_a"), F.count_if("confirmed").alias("_k")
    )
    joined = images.join(per_image, "image_id", "left").select(
        "image_id", "image_approved",
        F.coalesce("_a", F.lit(0)).alias("active"), F.coalesce("_k", F.lit(0)).alias("confirmed"),
    )
    active, confirmed = F.col("active"), F.col("confirmed")
    ratio = F.concat_ws(" of ", confirmed.cast("string"), active.cast("string"))
    label = (
        F.when(F.col("image_approved") & (active == 0), "Approved · no detections")
        .when(F.col("image_approved"), F.concat(F.lit("Approved · "), ratio, F.lit(" boxes confirmed")))
        .when(active == 0, "No active detections · approval needed")
        .when(confirmed == active, F.concat(F.lit("All "), active.cast("string"), F.lit(" confirmed")))
        .otherwise(F.concat(ratio, F.lit(" confirmed")))
    )
    return joined.select(
        "*", ((active > 0) & (confirmed == active)).alias("all_confirmed"), label.alias("label")
    )


def queue_totals(images: DataFrame, review: DataFrame) -> DataFrame:
    """One row: pending images, edited images and boxes that would be exported."""
    spine = images.select(
        F.lit(True).alias("_image"), (F.col("analyzed") & ~F.col("image_approved")).alias("_p"),
        F.col("review_edited").alias("_e"),
    )
    boxes = active_boxes(review).select(
        F.lit(False).alias("_image"), F.lit(False).alias("_p"), F.lit(False).alias("_e")
    )
    return spine.unionByName(boxes).agg(
        F.count_if("_image").alias("images"), F.count_if("_p").alias("pending"),
        F.count_if("_e").alias("edited"), F.count_if(~F.col("_image")).alias("boxes"),
    )


def approval_state(events: DataFrame) -> DataFrame:
    """Last-event-wins state of (image_id, seq, op).

    Approving or toggling marks an image edited; any later edit clears the approval; a reset
    clears everything before it. All reductions are associative and combine before the shuffle.
    """
    toggles = F.col("op") == "toggle"
    approvals = F.col("op") == "approve"
    resets = F.col("op") == "reset"
    # A toggle flips whatever is in force, so state is folded from the last fixed point onwards.
    fixed_point = approvals | resets | ~(toggles | approvals | resets)
    last = events.groupBy("image_id").agg(
        F.max(F.when(fixed_point, F.col("seq"))).alias("_fixed_seq"),
        F.max_by(approvals, F.when(fixed_point, F.col("seq"))).alias("_fixed"),
        F.max(F.when(resets, F.col("seq"))).alias("_reset_seq"),
        F.max("seq").alias("last_seq"),
    )
    later = skew.skew_join(events, last, ["image_id"], "inner", ["seq"])
    counted = later.groupBy("image_id").agg(
        F.first("_fixed").alias("_fixed"),
        F.first("last_seq").alias("last_seq"),
        F.count_if(toggles & (F.col("seq") > F.coalesce("_fixed_seq", F.lit(-1)))).alias("_flips"),
        F.count_if(F.col("seq") > F.coalesce("_reset_seq", F.lit(-1))).alias("_since_reset"),
    )
    start = F.coalesce("_fixed", F.lit(False))
    flipped = F.col("_flips") % 2 == 1
    return counted.select(
        "image_id",
        F.when(flipped, ~start).otherwise(start).alias("image_approved"),
        (F.col("_since_reset") > 0).alias("review_edited"),
        "last_seq",
    )


def annotation_state() -> Column:
    return (
        F.when(F.col("removed"), "removed")
        .when(F.col("confirmed"), "confirmed")
        .when(F.col("source") == "manual", "manual")
        .otherwise("not reviewed")
    )


def box_inspection(review: DataFrame, width: Column, height: Column) -> DataFrame:
    """Inspector line of every box: state, rounded size, confidence and share of the image."""
    box_width = F.floor(F.col("x2") - F.col("x1") + 0.5)
    box_height = F.floor(F.col("y2") - F.col("y1") + 0.5)
    share = F.when(
        width * height > 0, box_width * box_height / (width * height) * 100
    ).otherwise(0.0)
    return review.select(
        "image_id", "det_idx", annotation_state().alias("state"),
        F.concat_ws(" × ", box_width.cast("string"), box_height.cast("string")).alias("size"),
        fixed(F.col("confidence") * 100, 1).alias("confidence_pct"),
        fixed(share, 2).alias("image_pct"),
    )


def run_totals(results: DataFrame) -> DataFrame:
    """One row per run of (run_id, error, detections, class thresholds): done, failed, boxes."""
    failed = F.col("error").isNotNull()
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(~failed).alias("done"),
        F.count_if(failed).alias("failed"),
        F.coalesce(F.sum(F.when(~failed, F.col("detections"))), F.lit(0)).alias("boxes"),
        F.min(F.least("conf_burst", "conf_accumulation", "conf_drop")).alias("effective_confidence"),
    )
