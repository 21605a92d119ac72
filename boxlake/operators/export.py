"""Dataset export: label texts, review summary, splits, guards, descriptors, manifests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake import skew
from boxlake.functions import geometry as g
from boxlake.functions.classes import class_id_of, display_class
from boxlake.functions.text import fixed, trimmed_decimal
from boxlake.schemas import CLASS_NAMES


def yolo_lines(boxes: DataFrame) -> DataFrame:
    """Boxes with `line`, dropping boxes that are invalid before or after clamping.

    `boxes` carries the image's width and height.
    """
    width, height = F.col("width"), F.col("height")
    b = g.box()
    # A valid box stays valid after clamping exactly when it reaches into the image.
    inside = (b.x1 < width) & (b.x2 > 0) & (b.y1 < height) & (b.y2 > 0)
    valid = boxes.filter(g.invalid_reason(b).isNull() & inside)
    values = g.to_yolo(g.box(), width, height)
    line = F.concat_ws(
        " ", class_id_of(F.col("class_name")).cast("string"), *[fixed(v, 6) for v in values]
    )
    return valid.withColumn("line", line)


def yolo_label_lines(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, det_idx, line): the label lines of every image, one row each.

    An image without a valid box has one row without det_idx and line, so that its empty file is
    written too. Lines in the order of det_idx are the file; no image is ever folded into one row.
    """
    sized = boxes.join(images.select("image_id", "width", "height"), "image_id")
    lines = yolo_lines(sized).select("image_id", "det_idx", "line")
    return images.select("image_id").join(lines, "image_id", "left")


def audit_label_line(class_id: Column, *values: Column) -> Column:
    """`class cx cy w h` with up to 10 decimals and no trailing zeros."""
    return F.concat_ws(" ", class_id.cast("string"), *[trimmed_decimal(v) for v in values])


def review_records(images: DataFrame, review: DataFrame) -> DataFrame:
    """(image_id, approved, approved_empty, det_idx, record JSON): one row per box, and one without
    det_idx and record for an image without boxes."""
    active = review.groupBy("image_id").agg(F.count_if(~F.col("removed")).alias("_active"))
    record = F.struct(
        F.col("class_name").alias("class"), F.array("x1", "y1", "x2", "y2").alias("bbox"),
        "source", "confirmed", "removed",
        F.when(F.col("source") == "model", F.col("confidence")).alias("modelConfidence"),
    )
    records = review.select(
        "image_id", "det_idx", F.to_json(record, {"ignoreNullFields": "false"}).alias("record")
    )
    empty = F.col("image_approved") & (F.coalesce("_active", F.lit(0)) == 0)
    state = images.select("image_id", "image_approved").join(active, "image_id", "left").select(
        "image_id", F.col("image_approved").alias("approved"), empty.alias("approved_empty")
    )
    return state.join(records, "image_id", "left")


def assign_splits(images: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """Adds image_index (1-based in the dataset), dataset_size and train/valid `split`."""
    indexed = skew.group_index(
        images, [dataset], [F.col("original_index"), F.col("image_id")], "image_index",
        "dataset_size",
    )
    i, n = F.col("image_index"), F.col("dataset_size")
    valid = F.when(n >= 5, i % 5 == 0).otherwise((n >= 2) & (i == n))
    return indexed.withColumn("split", F.when(valid, "valid").otherwise("train"))


def export_guard(
    images: DataFrame, boxes: DataFrame, max_images: int = 10_000, max_bytes: int = 536_870_912
) -> DataFrame:
    """One verdict per dataset from counts, bytes and the set of unsupported classes (sorted)."""
    sizes = images.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_images"), F.sum("byte_size").alias("total_bytes")
    )
    strange = boxes.filter(~F.col("class_name").isin(*CLASS_NAMES))
    # Distinct names meet per dataset, so copies of a name never reach the array.
    strange = strange.select("dataset_id", "class_name").distinct().groupBy("dataset_id").agg(
        F.array_sort(F.collect_list("class_name")).alias("_names")
    )
    joined = sizes.join(strange, "dataset_id", "left").select(
        "*", F.coalesce(F.size("_names"), F.lit(0)).cast("long").alias("unsupported"),
        F.coalesce("_names", F.expr("CAST(array() AS ARRAY<STRING>)")).alias("unsupported_classes"),
    )
    verdict = (
        F.when(F.col("n_images") > max_images, "too many images")
        .when(F.col("total_bytes") > max_bytes, "too many bytes")
        .when(F.col("unsupported") > 0, "unsupported classes")
        .otherwise("ok")
    )
    return joined.select(
        "dataset_id", "n_images", "total_bytes", "unsupported", "unsupported_classes",
        verdict.alias("verdict"),
    )


def descriptor_text(dataset_size: Column) -> Column:
    """The dataset descriptor; a single image validates on the training folder."""
    names = "".join(f'  {i}: "{name}"\n' for i, name in enumerate(CLASS_NAMES))
    val = F.when(dataset_size >= 2, "images/valid").otherwise("images/train")
    return F.concat(
        F.lit("path: .\ntrain: images/train\nval: "), val, F.lit("\nnames:\n" + names)
    )


def write_files(
    rows: DataFrame, folder: str, name: str, order: str, text: str, between: str = "\n",
    around: tuple[str, str] = ("", "\n"),
) -> DataFrame:
    """One file per `name` with its texts in the order of `order`, streamed: a file of any size is
    never held in memory. Returns (name, n) of the files.

    A name whose only text is null gives a file of `around` alone, or an empty one if `around` opens
    with nothing. `folder` is any location that the workers share; a file gets its name when complete,
    so a repeated task replaces it.
    """
    opening, closing = around

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        current, stream, count, done = None, None, 0, []

        def close():
            if stream is not None:
                if count or opening:
                    stream.write(closing.encode())
                stream.close()
                store.move(f"{base}/.{current}.{attempt}", f"{base}/{current}")
                done.append((current, count))

        for batch in batches:
            names, texts = (batch.column(i).to_pylist() for i in range(2))
            for key, value in zip(names, texts, strict=True):
                if key != current:
                    close()
                    current, count = key, 0
                    stream = store.open_output_stream(f"{base}/.{key}.{attempt}")
                    stream.write(opening.encode())
                if value is not None:
                    stream.write(((between if count else "") + value).encode())
                    count += 1
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())],
            ["name", "n"],
        )

    named = rows.select(F.col(name).cast("string").alias("name"), F.col(text), F.col(order))
    placed = skew.in_one_task(named, ["name"], [order]).select("name", text)
    return placed.mapInArrow(run, "name string, n long")


def write_manifests(decisions: DataFrame, path: str) -> None:
    """Accepted and rejected candidates as two CSV folders of one decision table."""
    accepted = decisions.filter(F.col("status") == "accepted").drop("status", "reason")
    rejected = decisions.filter(F.col("status") == "rejected").select(
        "category", "title", "reason"
    )
    for name, rows in (("manifest", accepted), ("rejected", rejected)):
        rows.write.mode("errorifexists").option("header", True).csv(f"{path}/{name}")


def class_summary(boxes: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(image_id, summary): `class: n` sorted by class; images without boxes say so.

    Counting per (image, class) first leaves at most one row per class of the vocabulary.
    """
    counts = boxes.groupBy("image_id", "class_name").agg(F.count(F.lit(1)).alias("n"))
    item = F.concat(display_class(F.col("class_name")), F.lit(": "), F.col("n").cast("string"))
    texts = counts.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("class_name", item.alias("item")))).alias("_i")
    ).select(
        "image_id", F.array_join(F.transform("_i", lambda r: r.getField("item")), ", ").alias("summary")
    )
    if images is None:
        return texts
    return images.select("image_id").join(texts, "image_id", "left").select(
        "image_id", F.coalesce("summary", F.lit("no detections")).alias("summary")
    )
