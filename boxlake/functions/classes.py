"""Class names: canonical form, display form, per-class thresholds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.schemas import CLASS_NAMES

# Model label -> public label.
CLASS_ALIASES = {"dripping water": "water drop"}
# Stored label -> label shown in summaries, and in drawn overlays.
DISPLAY_NAMES = {"water damage": "water accumulation"}
OVERLAY_NAMES = {"water damage": "water leaking"}
# Overlay colours.
CLASS_COLOURS = {
    "pipe burst": "#fb7185",
    "water accumulation": "#facc15",
    "water drop": "#38bdf8",
    "water damage": "#facc15",
}
DEFAULT_COLOUR = "#a78bfa"

ACCUMULATION = "water accumulation"
SPECIALIST = "water damage"


def literal_lookup(key: Column, values: Mapping[str, object], default: Column) -> Column:
    """A small fixed map as a CASE chain, so it needs no join."""
    chain = None
    for name, value in values.items():
        chain = (F if chain is None else chain).when(key == name, F.lit(value))
    return default if chain is None else chain.otherwise(default)


def folded(name: Column) -> Column:
    """Lower case, underscores as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(name, "_", " ")), r"\s+", " "))


def canonical_class(name: Column, aliases: Mapping[str, str] = CLASS_ALIASES) -> Column:
    plain = folded(name)
    return literal_lookup(plain, aliases, plain)


def display_class(name: Column, names: Mapping[str, str] = DISPLAY_NAMES) -> Column:
    return literal_lookup(F.lower(F.trim(name)), names, name)


def class_colour(name: Column) -> Column:
    return literal_lookup(F.lower(F.trim(name)), CLASS_COLOURS, F.lit(DEFAULT_COLOUR))


def class_name_of(class_id: Column, names: tuple[str, ...] = CLASS_NAMES) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), class_id)


def class_id_of(name: Column, names: tuple[str, ...] = CLASS_NAMES) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), name), F.lit(0)) - 1


def check_threshold(value: float, label: str = "Confidence") -> float:
    """Thresholds are checked before a plan is built; NaN fails."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0.0 <= value <= 1.0:
        raise ValueError(f"{label} must be between 0.0 and 1.0.")
    return float(value)


def clamped_threshold(value: float) -> float:
    """The forgiving variant: non-finite becomes 0, the rest is clamped."""
    number = float(value)
    if number != number or number in (float("inf"), float("-inf")):
        return 0.0
    return min(1.0, max(0.0, number))


def passes_threshold(
    name: Column, confidence: Column, overall: float, per_class: Mapping[str, float | None] | None
) -> Column:
    """Global threshold, then a per-class one; an incomplete per-class set is ignored."""
    overall = check_threshold(overall)
    if per_class is None or any(v is None for v in per_class.values()):
        return confidence >= overall
    checked = {n: check_threshold(v, n) for n, v in per_class.items()}
    return (confidence >= overall) & (
        confidence >= literal_lookup(name, checked, F.lit(overall))
    )


def specialist_only(df: DataFrame) -> DataFrame:
    """Rows of the specialist class, renamed to the accumulation class."""
    kept = df.filter(canonical_class(F.col("class_name")) == SPECIALIST)
    return kept.withColumn("class_name", F.lit(ACCUMULATION))


def class_map_report(
    classes: DataFrame, expected: Mapping[str, tuple[str, ...]], key: str = "role"
) -> DataFrame:
    """One verdict per `key` for a (key, role, idx STRING, name STRING) class table.

    Aggregates only: count, distinct count, bounds and mismatches combine before the shuffle.
    """
    index = F.when(F.col("idx").rlike(r"^\d+$"), F.col("idx").cast("int"))
    wanted = F.create_map(
        *[
            part
            for role, names in expected.items()
            for i, name in enumerate(names)
            for part in (F.lit(f"{role}/{i}"), F.lit(name))
        ]
    )
    sizes = literal_lookup(F.col("role"), {r: len(n) for r, n in expected.items()}, F.lit(None))
    prepared = classes.select(
        F.col(key).alias("_key"), "role", index.alias("i"), "name"
    ).withColumn(
        "wanted", F.try_element_at(wanted, F.concat_ws("/", "role", F.col("i").cast("string")))
    )
    checked = prepared.groupBy("_key", "role").agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.count_if(F.col("i").isNull()).alias("bad_index"),
        F.count_distinct("i").alias("distinct_index"),
        F.max("i").alias("top_index"),
        F.count_if(F.col("name").isNull() | (F.trim("name") == "")).alias("empty_name"),
        F.count_if(
            ~F.coalesce(canonical_class(F.col("name")) == F.col("wanted"), F.lit(False))
        ).alias("mismatch"),
    )
    n = F.col("n_classes")
    reason = (
        F.when(F.col("bad_index") > 0, "class indices must be integers")
        .when(F.col("distinct_index") != n, "class indices must be unique")
        .when(F.col("empty_name") > 0, "class names must be non-empty")
        .when(F.col("top_index") != n - 1, "class indices must be contiguous from zero")
        .when(sizes.isNull(), "unknown role")
        .when((F.col("mismatch") > 0) | (n != sizes), "classes differ from the role")
        .otherwise("ok")
    )
    return checked.select(F.col("_key").alias(key), n, reason.alias("verdict"))
