"""Media scans: listings, upload routing, admission rules and header probes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.sources import headers

# Suffixes of an image corpus.
IMAGE_SUFFIXES = ("avif", "bmp", "jpeg", "jpg", "png", "webp")


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of image files below `root`; file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return images_only(files.select("path", "length"))


def images_only(listing: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose suffix is an image suffix; adds split, stem and suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return listing.select(
        "*",
        F.regexp_extract(path, r"([^/]+)/images/[^/]+$", 1).alias("split"),
        F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"),
        suffix.alias("suffix"),
    ).filter(F.col("suffix").isin(*IMAGE_SUFFIXES))


def route_uploads(files: DataFrame) -> DataFrame:
    """One verdict per upload of (upload_id, folder BOOLEAN, mime): images, video or a reason.

    Folders skip what is not an image; other uploads are all images or exactly one video.
    """
    image = F.coalesce(F.col("mime").startswith("image/"), F.lit(False))
    video = F.coalesce(F.col("mime").startswith("video/"), F.lit(False))
    counts = files.groupBy("upload_id").agg(
        F.max("folder").alias("folder"),
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(image).alias("n_images"),
        F.count_if(video).alias("n_videos"),
    )
    n, images, videos = F.col("n_files"), F.col("n_images"), F.col("n_videos")
    verdict = (
        F.when(F.col("folder") & (images == 0), "folder without images")
        .when(F.col("folder"), "images")
        .when((videos > 0) & ((n != 1) | (videos != 1)), "a video must be alone")
        .when(videos > 0, "video")
        .when(images != n, "every file must be an image or video")
        .otherwise("images")
    )
    skipped = F.when(F.col("folder"), n - images).otherwise(F.lit(0)).cast("long")
    return counts.select("upload_id", n, images, videos, skipped.alias("skipped"),
                         verdict.alias("verdict"))


def admission_reason(
    mime: Column, size: Column, width: Column, height: Column,
    max_bytes: int = 20 * 1024 * 1024, max_pixels: int = 25_000_000,
) -> Column:
    """First failing upload rule, cheap rules first; null when admitted.

    Null width or height means the image could not be decoded.
    """
    return (
        F.when(~F.coalesce(mime.startswith("image/"), F.lit(False)), "not an image")
        .when(size > max_bytes, "file too large")
        .when(width.isNull() | height.isNull(), "not a valid image")
        .when(width * height > max_pixels, "too many pixels")
    )


def sniff(data: bytes | None) -> headers.Header:
    """(format, width, height, orientation) read from header bytes; format None if unknown."""
    return headers.probe(headers.of_bytes(data or b""))


PROBE_SCHEMA = "path STRING, format STRING, width INT, height INT, orientation INT, issues STRING"


def header_issues(found: headers.Header, minimum_side: int) -> str:
    if found.format is None or not found.width or not found.height:
        return "cannot decode"
    issues = []
    if found.orientation != 1:
        issues.append("exif orientation")
    if found.format == "MPO":
        issues.append("mpo")
    if min(found.width, found.height) < minimum_side:
        issues.append("low resolution")
    return ",".join(issues)


def _probed(paths: pa.Array, found: list[headers.Header], minimum_side: int) -> list[pa.Array]:
    columns = zip(*found, strict=True) if found else ([],) * 4
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
    return [
        paths, *[pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)],
        pa.array([header_issues(f, minimum_side) for f in found], pa.string()),
    ]


PROBED = ["path", "format", "width", "height", "orientation", "issues"]


def probe_headers(files: DataFrame, minimum_side: int = 256) -> DataFrame:
    """Header facts and issues of (path, content) rows whose contents are there already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sniff(c) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays(_probed(batch.column("path"), found, minimum_side), PROBED)

    return files.select("path", "content").mapInArrow(run, PROBE_SCHEMA)


def probe_files(spark: SparkSession, root: str, minimum_side: int = 256) -> DataFrame:
    """Header facts and issues of the image files below `root`, and the bytes that were read for them.

    Files are opened by the tasks and read by ranges, so a file costs a few kilobytes whatever its size.
    One that cannot be opened cannot be decoded either; Spark lists no files of zero bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, cost = [], []
            for path, size in zip(*(batch.column(c).to_pylist() for c in ("path", "length")), strict=True):
                read = None
                try:
                    store, name = pyarrow.fs.FileSystem.from_uri(store_uri(path))
                    with store.open_input_file(name) as file:
                        read = headers.Blocks(file, size)
                        found.append(headers.probe(read))
                except OSError:
                    found.append(headers.Header())
                cost.append(read.bytes_read if read else 0)
            columns = _probed(batch.column("path"), found, minimum_side)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cost, pa.int64())], [*PROBED, "bytes_read"])

    listed = list_images(spark, root).select("path", "length")
    # The listing packs files by their sizes; opening them costs alike.
    return listed.repartition("path").mapInArrow(run, f"{PROBE_SCHEMA}, bytes_read LONG")


def store_uri(path: str) -> str:
    """A path as Hadoop prints it, as a URI with an authority."""
    scheme, colon, rest = path.partition(":/")
    return path if not colon or rest.startswith("/") else f"{scheme}:///{rest}"
