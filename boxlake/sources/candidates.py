"""Candidate metadata: nested page records to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake import skew
from boxlake.functions.text import clean_html, unescape
from boxlake.schemas import PAGE_JSON


def _either(first: Column, second: Column) -> Column:
    return F.coalesce(F.nullif(first, F.lit("")), second)


def flatten_pages(pages: DataFrame, sources: DataFrame | None = None, body: str = "body"):
    """Flat candidates of JSON page records; pages that are missing or without image are skipped.

    `sources` is an optional (title, seq, source_category) table; the last entry of a title wins.
    """
    page = pages.withColumn("p", F.from_json(body, PAGE_JSON)).drop(body)
    info = F.get("p.imageinfo", F.lit(0))
    page = page.withColumn("i", info).filter(
        F.col("i").isNotNull() & ~F.coalesce("p.missing", F.lit(False))
    )

    def meta(name: str) -> Column:
        return clean_html(F.try_element_at("i.extmetadata", F.lit(name)).getField("value"))

    def text(field: str) -> Column:
        return F.coalesce(F.col(f"i.{field}"), F.lit(""))

    flat = page.select(
        *[c for c in pages.columns if c != body],
        F.col("p.pageid").alias("page_id"),
        F.col("p.title").alias("title"),
        F.col("i.mime").alias("mime"),
        text("descriptionurl").alias("page_url"),
        text("url").alias("original_url"),
        _either(F.col("i.thumburl"), text("url")).alias("download_url"),
        _either(meta("Artist"), meta("Credit")).alias("author"),
        _either(meta("LicenseShortName"), meta("UsageTerms")).alias("license_name"),
        meta("LicenseUrl").alias("license_url"),
        meta("ImageDescription").alias("description"),
        meta("ObjectName").alias("object_name"),
    )
    if sources is None:
        return flat.withColumn("source_category", F.lit(""))
    last = sources.groupBy("title").agg(F.max_by("source_category", "seq").alias("source_category"))
    joined = skew.skew_join(flat, last, ["title"], "left", ["page_id"])
    return joined.withColumn("source_category", F.coalesce("source_category", F.lit("")))


def search_text(title: Column, tags: Column) -> Column:
    """Lower-case title and tag names of a search result (an array of structs with `name`)."""
    names = F.array_join(F.transform(tags, lambda t: F.coalesce(t.getField("name"), F.lit(""))), " ")
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(names, F.lit("")))
    return F.lower(unescape(joined))
