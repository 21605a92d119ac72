"""Dataset audit and repair as relations of violations and changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake import skew
from boxlake.functions import geometry as g
from boxlake.functions.classes import literal_lookup
from boxlake.schemas import CLASS_NAMES, SPLITS

TOLERANCE = 1e-9


def pair_images_and_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Full outer pairing on (split, stem) with `has_image` and `has_label` flags."""
    left = images.select("split", "stem").distinct().withColumn("_i", F.lit(True))
    right = labels.select("split", "stem").distinct().withColumn("_l", F.lit(True))
    paired = left.join(right, ["split", "stem"], "full_outer")
    return paired.select(
        "split", "stem",
        F.coalesce("_i", F.lit(False)).alias("has_image"),
        F.coalesce("_l", F.lit(False)).alias("has_label"),
    )


def annotation_faults(classes: int = len(CLASS_NAMES)) -> dict[str, Column]:
    """One flag column per validity rule of (class_id, cx, cy, w, h)."""
    b = g.from_centre(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    return {
        "class_fault": ~F.col("class_id").between(0, classes - 1),
        "size_fault": ~((F.col("w") > 0) & (F.col("h") > 0)),
        "edge_fault": ~(
            (b.x1 >= -TOLERANCE) & (b.y1 >= -TOLERANCE)
            & (b.x2 <= 1 + TOLERANCE) & (b.y2 <= 1 + TOLERANCE)
        ),
    }


def with_validity(annotations: DataFrame) -> DataFrame:
    faults = annotation_faults()
    flagged = annotations.select("*", *[c.alias(n) for n, c in faults.items()])
    return flagged.withColumn("valid", ~reduce(lambda a, b: a | b, [F.col(n) for n in faults]))


def clamp_annotations(annotations: DataFrame) -> DataFrame:
    """Invalid rows clamped to the unit square; `changed` tells whether any value moved."""
    checked = with_validity(annotations)
    b = g.from_centre(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    left, top = F.greatest(F.lit(0.0), b.x1), F.greatest(F.lit(0.0), b.y1)
    right, bottom = F.least(F.lit(1.0), b.x2), F.least(F.lit(1.0), b.y2)
    repaired = {
        "cx": (left + right) / 2, "cy": (top + bottom) / 2, "w": right - left, "h": bottom - top,
    }
    # Kept as one small expression: a filter on `changed` is pushed down and inlined as it stands.
    moved = reduce(lambda a, b: a | b, [c != F.col(n) for n, c in repaired.items()])
    fixed = checked.select(
        "*", (~F.col("valid") & moved).alias("changed"),
        *[F.when(F.col("valid"), F.col(n)).otherwise(c).alias(f"new_{n}")
          for n, c in repaired.items()],
    )
    return fixed.drop(*annotation_faults())


def split_counts(images: DataFrame, labels: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per split: images, annotations, null images and one count per class.

    Annotations are counted per image before anything is joined, so every join is one row per
    image on both sides.
    """
    names = [f"n_{name.replace(' ', '_')}" for name in CLASS_NAMES]
    per_image = annotations.groupBy("split", "stem").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col("class_id") == i).alias(n) for i, n in enumerate(names)],
    )
    labelled = labels.select("split", "stem").distinct().withColumn("_l", F.lit(True))
    joined = (
        images.select("split", "stem")
        .join(labelled, ["split", "stem"], "left")
        .join(per_image, ["split", "stem"], "left")
    )
    counted = joined.groupBy("split").agg(
        F.count(F.lit(1)).alias("images"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("annotations"),
        F.count_if(F.col("_l") & F.col("_n").isNull()).alias("null_images"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
    )
    # A split without images keeps its row of zeros.
    spine = images.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    whole = spine.join(counted, "split", "left")
    return whole.select("split", *[F.coalesce(n, F.lit(0)).alias(n) for n in counted.columns[1:]])


def exact_duplicate_groups(rows: DataFrame, digest: str, name: str) -> DataFrame:
    """Digests held by more than one row, with their size and first name."""
    return (
        rows.groupBy(digest)
        .agg(F.count(F.lit(1)).alias("copies"), F.min(name).alias("first_name"))
        .filter(F.col("copies") > 1)
    )


def keeper_scores(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images with the five keeper keys; annotations are reduced per image first."""
    valid = with_validity(annotations)
    per_image = valid.groupBy("split", "stem").agg(
        F.count_if("valid").alias("valid_count"),
        F.count(F.lit(1)).alias("total_count"),
        F.sum((F.col("w") * F.col("h")).cast("decimal(28,12)")).alias("total_area"),
    )
    priority = literal_lookup(
        F.col("split"), {s: i for i, s in enumerate(SPLITS)}, F.lit(None).cast("int")
    )
    return images.join(per_image, ["split", "stem"], "left").select(
        *images.columns,
        priority.alias("split_priority"),
        F.coalesce("valid_count", F.lit(0)).alias("valid_count"),
        F.coalesce("total_count", F.lit(0)).alias("total_count"),
        F.coalesce("total_area", F.lit(0).cast("decimal(38,12)")).alias("total_area"),
    )


def duplicate_keepers(scored: DataFrame, digest: str = "digest") -> DataFrame:
    """The best copy of every duplicate group.

    `max` of one struct combines map-side, so a group holding a third of all images costs one
    partial row per task.
    """
    best = F.struct(
        "split_priority", "valid_count", "total_count",
        (-F.col("total_area")).alias("neg_area"), F.col("filename").alias("filename"),
        F.col("split").alias("split"), F.col("stem").alias("stem"),
    )
    grouped = scored.groupBy(digest).agg(
        F.count(F.lit(1)).alias("copies"), F.max(best).alias("k")
    ).filter(F.col("copies") > 1)
    return grouped.select(
        digest, "copies", F.col("k.split").alias("keeper_split"),
        F.col("k.stem").alias("keeper_stem"), F.col("k.filename").alias("keeper"),
        F.col("k.valid_count").alias("valid_count"), F.col("k.total_count").alias("total_count"),
    )


def duplicates_to_remove(scored: DataFrame, digest: str = "digest") -> DataFrame:
    """Every copy that is not its group's keeper."""
    keepers = duplicate_keepers(scored, digest).select(digest, "keeper", "keeper_split")
    joined = skew.skew_join(scored, keepers, [digest], "inner", ["filename"])
    return joined.filter(
        (F.col("filename") != F.col("keeper")) | (F.col("split") != F.col("keeper_split"))
    )


def quarantine_rows(scored: DataFrame, annotations: DataFrame) -> DataFrame:
    """Originals of everything a repair removes or changes, by category."""
    removed = duplicates_to_remove(scored).select(
        F.lit("exact-duplicates").alias("category"), "split", "stem",
        F.lit(None).cast("long").alias("line_no"), F.col("keeper").alias("detail"),
    )
    changed = clamp_annotations(annotations).filter("changed").select(
        F.lit("annotation-originals").alias("category"), "split", "stem", "line_no",
        F.when(F.col("class_id") < len(CLASS_NAMES), "clamped").otherwise(
            "clamped, class out of range"
        ).alias("detail"),
    )
    return removed.unionByName(changed)


def violations(
    images: DataFrame, labels: DataFrame, annotations: DataFrame,
    descriptors: DataFrame | None = None, minimum_side: int = 256,
) -> DataFrame:
    """All audit findings as (severity, rule, split, subject).

    `images` carries split, stem, digest, width, height, format, orientation and decode_error (null
    for a sound image); `labels` split, stem and parse_error (null for a sound file); `descriptors`
    (dataset_id, line) holds missing descriptor lines (`missing_lines`). An image that cannot be
    decoded is reported once and takes part in no later rule; an unparsable label hides its lines.
    """
    pairs = pair_images_and_labels(images, labels)
    unparsed = labels.filter(F.col("parse_error").isNotNull())
    every_image, images = images, images.filter(F.col("decode_error").isNull())

    def finding(df: DataFrame, severity: str, rule: str, subject: str) -> DataFrame:
        return df.select(
            F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), "split",
            F.col(subject).cast("string").alias("subject"),
        )

    smallest = F.least("width", "height")
    # Only annotations of an existing image count; invalid rows are few, so they are cut first.
    present = (
        with_validity(annotations).filter("not valid")
        .join(images.select("split", "stem").distinct(), ["split", "stem"], "left_semi")
        .join(unparsed.select("split", "stem"), ["split", "stem"], "left_anti")
    )
    hidden = unparsed.join(images.select("split", "stem"), ["split", "stem"], "left_semi")
    copies = images.groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min("split").alias("split")
    )
    parts = [
        finding(pairs.filter("has_image and not has_label"), "error", "image has no label", "stem"),
        finding(pairs.filter("has_label and not has_image"), "error", "label has no image", "stem"),
        finding(present, "error", "invalid annotation", "stem"),
        finding(copies.filter("copies > 1"), "error", "exact duplicates remain", "digest"),
        finding(
            every_image.filter(F.col("decode_error").isNotNull()), "error", "image cannot be decoded",
            "stem",
        ),
        finding(
            images.filter(F.coalesce("orientation", F.lit(1)) != 1), "error",
            "EXIF orientation remains", "stem",
        ),
        finding(images.filter(F.col("format") == "MPO"), "error", "image is MPO", "stem"),
        finding(hidden, "error", "label cannot be parsed", "stem"),
        finding(images.filter(smallest < minimum_side), "warning", "low resolution", "stem"),
    ]
    if descriptors is not None:
        datasets = descriptors.select("dataset_id").distinct().withColumn(
            "split", F.lit(None).cast("string")
        )
        parts.append(finding(datasets, "error", "descriptor does not match", "dataset_id"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def audit_report(found: DataFrame) -> DataFrame:
    """Findings per severity, rule and split. A dataset is fine when no error row is left."""
    return found.groupBy("severity", "rule", "split").agg(
        F.count(F.lit(1)).alias("findings"), F.min("subject").alias("first_subject")
    )


def audit_verdict(found: DataFrame) -> DataFrame:
    """One row (ok, errors, warnings): a dataset is fine when no error is left."""
    counted = found.agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    return counted.select((F.col("errors") == 0).alias("ok"), "errors", "warnings")


def missing_lines(descriptors: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(dataset_id, line) of every required descriptor line a dataset lacks."""
    wanted = descriptors.select("dataset_id").distinct().select(
        "dataset_id", F.explode(F.array(*[F.lit(line) for line in required])).alias("line")
    )
    present = descriptors.select("dataset_id", F.explode(F.split("body", "\n")).alias("line"))
    return wanted.join(present.distinct(), ["dataset_id", "line"], "left_anti")


def reconcile_manifest(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """One verdict per manifest artifact (file, size_bytes, sha256, exported_from, pair_file).

    `listing` holds the real files as (file, actual_size, actual_sha256), one row per file. It grows with the
    manifest and its digests do not compress, so it is sorted and merged, however small its files look.
    """
    listing = listing.hint("merge")
    pair = listing.select(
        F.col("file").alias("pair_file"), F.col("actual_sha256").alias("_pair_sha")
    )
    joined = manifest.join(listing, "file", "left").join(pair.hint("merge"), "pair_file", "left")
    verdict = (
        F.when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
               "invalid digest in manifest")
        .when(F.col("actual_size").isNull(), "file is missing")
        .when(F.col("size_bytes") != F.col("actual_size"), "size differs")
        .when(F.col("sha256") != F.col("actual_sha256"), "digest differs")
        .when(
            F.col("exported_from").isNotNull()
            & ~F.coalesce(F.col("exported_from") == F.col("_pair_sha"), F.lit(False)),
            "not paired with its source",
        )
        .otherwise("ok")
    )
    return joined.select("file", verdict.alias("verdict"))
