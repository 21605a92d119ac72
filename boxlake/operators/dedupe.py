"""Exact de-duplication and order statistics that combine before every shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake import skew


def content_digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The earliest row of every key. `min` of one struct, so copies combine map-side."""
    payload = [c for c in df.columns if c not in keys]
    rest = [c for c in payload if c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    grouped = df.groupBy(*keys).agg(first)
    return grouped.select(*[c if c in keys else F.col(f"_first.{c}") for c in df.columns])


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, bin_width: float = 1.0
) -> DataFrame:
    """(keys, n, median) without holding a group in memory.

    Equal values are counted first; a running count cut at `bin_width`-wide bins then locates the
    middle one or two values.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_bin", F.floor(F.col(value) / bin_width)
    )
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    running = skew.carried_sum(counts, keys, "_bin", [value], F.col("_n"), "_upto")
    placed = skew.skew_join(running, totals, keys, "inner", [value])
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    found = placed.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.min(F.when(F.col("_upto") >= lower, F.col(value))).alias("_low"),
        F.min(F.when(F.col("_upto") >= upper, F.col(value))).alias("_high"),
    )
    return found.select(*keys, "n", ((F.col("_low") + F.col("_high")) / 2).alias("median"))


def latency_summary(timings: DataFrame) -> DataFrame:
    """Cold time and cached mean, median, fastest and slowest of (run_id, phase, elapsed_ms)."""
    cached = timings.filter(F.col("phase") == "cached")
    cold = timings.filter(F.col("phase") == "cold").groupBy("run_id").agg(
        F.max("elapsed_ms").alias("cold_ms")
    )
    stats = cached.groupBy("run_id").agg(
        F.round(F.avg("elapsed_ms"), 6).alias("mean_ms"),
        F.min("elapsed_ms").alias("fastest_ms"), F.max("elapsed_ms").alias("slowest_ms"),
    )
    middle = exact_median(cached, ["run_id"], "elapsed_ms").withColumnsRenamed(
        {"n": "runs", "median": "median_ms"}
    )
    return stats.join(middle, "run_id").join(cold, "run_id", "left")
