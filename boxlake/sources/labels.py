"""Label corpora: text lines to annotations, with a reason for every rejected line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"


def read_label_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, line_no, value) of every .txt file below `root`.

    Label files hold a few boxes each, so a file is one row and its lines keep their numbers.
    """
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.txt")
        .text(root, wholetext=True)
    )
    return files.select(
        F.col("_metadata.file_path").alias("path"),
        F.posexplode(F.split(F.ltrim(F.col("value"), F.lit(BOM)), r"\r\n|\n|\r")).alias(
            "line_no", "value"
        ),
    ).withColumn("line_no", (F.col("line_no") + 1).cast("long"))


def parse_label_lines(lines: DataFrame) -> DataFrame:
    """Adds class_id, cx, cy, w, h and `reject_reason`; blank lines are skipped."""
    text = F.trim(F.regexp_replace(F.ltrim(F.col("value"), F.lit(BOM)), r"\s+", " "))
    parsed = (
        lines.withColumn("_text", text)
        .filter(F.col("_text") != "")
        .withColumn("_f", F.split("_text", " "))
    )
    number = [F.get("_f", F.lit(i)) for i in range(5)]
    values = parsed.select(
        "*",
        number[0].try_cast("int").alias("class_id"),
        *[number[i + 1].try_cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"))],
    )
    missing = F.lit(False)
    for name in ("class_id", "cx", "cy", "w", "h"):
        missing = missing | F.col(name).isNull()
    reason = F.when(F.size("_f") != 5, "must contain five fields").when(
        missing, "contains a non-numeric value"
    )
    return values.withColumn("reject_reason", reason).drop("_text", "_f", "value")


def with_path_parts(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds split, stem and the paired label path of `<split>/images/<stem>.<suffix>`."""
    pattern = r"([^/]+)/(?:images|labels)/([^/]+?)(\.[^./]*)?$"
    split = F.regexp_extract(path, pattern, 1)
    stem = F.regexp_extract(path, pattern, 2)
    base = F.regexp_replace(path, r"[^/]+/(?:images|labels)/[^/]+$", "")
    return df.select(
        "*",
        split.alias("split"),
        stem.alias("stem"),
        F.concat(base, split, F.lit("/labels/"), stem, F.lit(".txt")).alias("label_path"),
    )
