"""Greedy, order-dependent box selection: suppression and NMS.

A box is kept unless a better *kept* box suppresses it, so the result depends on order and a plain
anti-join would be wrong. Groups up to `group_limit` boxes are folded inside the JVM. Larger groups
(a hot image) go through exact rounds: the best `group_limit` undecided boxes of each hot group are
folded, then every remaining box is tested against the newly kept ones in salted, bounded blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake import skew
from boxlake.functions import geometry as g

GROUP_LIMIT = 512
BLOCK_ROWS = 200_000


@dataclass(frozen=True)
class Rule:
    """When does a kept box suppress a worse one?

    `iou_from`: IoU at or above it. `iou_over`: IoU strictly above it. `contained_from`: the kept
    box has strictly higher confidence and covers this share of the smaller box.
    """

    iou_from: float | None = None
    iou_over: float | None = None
    contained_from: float | None = None

    def __post_init__(self) -> None:
        # Boxes that do not overlap never suppress each other, which the fold relies on.
        starts = [t for t in (self.iou_from, self.contained_from) if t is not None]
        if any(t <= 0 for t in starts) or (self.iou_over is not None and self.iou_over < 0):
            raise ValueError("Suppression thresholds must be positive.")

    def column(self, kept: Column, candidate: Column) -> Column:
        """The rule for two structs with corners, `confidence` and `area`.

        The cheap overlap test comes first and short-circuits; behind it every denominator is
        positive, so the ratios need no guard.
        """
        a, b = g.field_box(kept), g.field_box(candidate)
        overlap = (a.x1 < b.x2) & (b.x1 < a.x2) & (a.y1 < b.y2) & (b.y1 < a.y2)
        inter = (F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * (
            F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
        )
        kept_area, area = kept.getField("area"), candidate.getField("area")
        tests = []
        if self.iou_from is not None:
            tests.append(inter / (kept_area + area - inter) >= self.iou_from)
        if self.iou_over is not None:
            tests.append(inter / (kept_area + area - inter) > self.iou_over)
        if self.contained_from is not None:
            stronger = kept.getField("confidence") > candidate.getField("confidence")
            tests.append(stronger & (inter / F.least(kept_area, area) >= self.contained_from))
        return overlap & reduce(lambda x, y: x | y, tests)

    def mask(self, kept: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The same rule for one kept (conf, x1, y1, x2, y2) against many rows."""
        conf, x1, y1, x2, y2 = kept
        inter = np.maximum(
            0.0, np.minimum(x2, rows[:, 3]) - np.maximum(x1, rows[:, 1])
        ) * np.maximum(0.0, np.minimum(y2, rows[:, 4]) - np.maximum(y1, rows[:, 2]))
        kept_area = max(0.0, x2 - x1) * max(0.0, y2 - y1)
        areas = np.maximum(0.0, rows[:, 3] - rows[:, 1]) * np.maximum(
            0.0, rows[:, 4] - rows[:, 2]
        )
        union = kept_area + areas - inter
        overlap = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
        result = np.zeros(len(rows), dtype=bool)
        if self.iou_from is not None:
            result |= overlap >= self.iou_from
        if self.iou_over is not None:
            result |= overlap > self.iou_over
        if self.contained_from is not None:
            smaller = np.minimum(kept_area, areas)
            share = np.divide(inter, smaller, out=np.zeros_like(inter), where=smaller > 0)
            result |= (conf > rows[:, 0]) & (share >= self.contained_from)
        return result


# The service suppression rule, the viewer's containment-only rule, and NMS.
SUPPRESSION = Rule(iou_from=0.4, contained_from=0.95)
CONTAINMENT_ONLY = Rule(contained_from=0.95)
NMS = Rule(iou_over=0.4)


_FIELDS = ["confidence", "x1", "y1", "x2", "y2"]


def _link_type(link: bool) -> str:
    corners = ", ".join(f"{f}: DOUBLE" for f in _FIELDS[1:])
    return f"STRUCT<idx: BIGINT, {corners}>" if link else "BOOLEAN"


def _fold(
    df: DataFrame, keys: Sequence[str], order_key: str, rule: Rule, link: bool = True
) -> DataFrame:
    """Every row of (bounded) groups plus `suppressed_by`, null for kept rows.

    With `link` it is the first suppressor, as a struct of `idx` and corners; without, it is true,
    which lets the test stop at any suppressor.
    """
    payload = [c for c in df.columns if c not in keys]
    ranked = df.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.col("confidence")).alias("_rank"),
                    F.col(order_key).alias("_order"),
                    *[F.col(c) for c in _FIELDS],
                    g.area(g.box()).alias("area"),
                    F.struct(*[F.col(c) for c in payload]).alias("_row"),
                )
            )
        ).alias("_boxes")
    )
    entry_fields = ["_order", *_FIELDS, "area"]
    kept_type = "ARRAY<STRUCT<_order: BIGINT, " + ", ".join(
        f"{f}: DOUBLE" for f in entry_fields[1:]
    ) + ">>"
    start = F.struct(
        F.expr(f"CAST(array() AS {kept_type})").alias("kept"),
        F.expr(f"CAST(array() AS ARRAY<{_link_type(link)}>)").alias("by"),
    )

    def step(state: Column, row: Column) -> Column:
        kept = state.getField("kept")
        entry = F.struct(*[row.getField(f).alias(f) for f in entry_fields])
        if link:
            hits = F.filter(kept, lambda k: rule.column(k, row))
            first = F.get(hits, F.lit(0))
            named = [first.getField("_order").alias("idx"), *[
                first.getField(f).alias(f) for f in _FIELDS[1:]
            ]]
            hit = F.when(first.isNotNull(), F.struct(*named))
        else:
            hit = F.when(F.exists(kept, lambda k: rule.column(k, row)), True)
        # The verdict is bound once and used for both lists.
        return F.get(
            F.transform(
                F.array(hit),
                lambda h: F.struct(
                    F.when(h.isNull(), F.array_append(kept, entry)).otherwise(kept).alias("kept"),
                    F.array_append(state.getField("by"), h).alias("by"),
                ),
            ),
            F.lit(0),
        )

    # A group of one box needs no fold.
    folded = ranked.withColumn(
        "_by",
        F.when(F.size("_boxes") == 1, F.array(F.lit(None).cast(_link_type(link)))).otherwise(
            F.aggregate("_boxes", start, step, lambda s: s.getField("by"))
        ),
    )
    paired = folded.select(
        *keys, F.explode(F.arrays_zip(F.col("_boxes"), F.col("_by"))).alias("_pair")
    )
    return paired.select(
        *keys,
        *[F.col(f"_pair._boxes._row.{c}").alias(c) for c in payload],
        F.col("_pair._by").alias("suppressed_by"),
    )


_LINK = ["_by_idx", "_by_x1", "_by_y1", "_by_x2", "_by_y2"]


def _block_filter(rule: Rule, columns: list[str], order_key: str):
    """Cogroup kernel: a bounded block of undecided boxes against bounded newly kept boxes."""

    def run(block: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        if block.empty:
            return pd.DataFrame(columns=[*columns, *_LINK])
        rows = block[_FIELDS].to_numpy(dtype=float)
        kept = kept.sort_values(["confidence", order_key], ascending=[False, True])
        entries = kept[_FIELDS].to_numpy(dtype=float)
        owner = np.full(len(block), -1)
        undecided = np.arange(len(block))
        for place, entry in enumerate(entries):
            if not len(undecided):
                break
            hit = rule.mask(entry, rows[undecided])
            owner[undecided[hit]] = place
            undecided = undecided[~hit]
        free = owner < 0
        result = block[columns].copy()
        # Built from integers and a mask: a detour over floats would corrupt large keys.
        result["_by_idx"] = pd.arrays.IntegerArray(
            kept[order_key].to_numpy(dtype=np.int64)[owner], free
        )
        for i, name in enumerate(_LINK[1:], start=1):
            result[name] = np.where(free, np.nan, entries[owner, i])
        return result

    return run


def _fresh(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, so two branches of one plan can be cogrouped."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _rounds(
    hot: DataFrame, keys: Sequence[str], order_key: str, rule: Rule, chunk: int, link: bool
) -> DataFrame:
    """Exact greedy for groups of any size, `chunk` certain decisions per group and round."""
    order = [F.col("confidence").desc(), F.col(order_key).asc()]
    remaining = skew.checkpointed(hot)
    rows = remaining.count()
    decided: list[DataFrame] = []
    while rows > 0:
        best = skew.checkpointed(
            _fold(
                skew.top_k(remaining, keys, order, chunk, [order_key]).drop("row_number"),
                keys, order_key, rule, link,
            )
        )
        decided.append(best)
        kept = best.filter(F.col("suppressed_by").isNull()).select(
            *keys, order_key, "confidence", "x1", "y1", "x2", "y2"
        )
        # Rows ranked after the best chunk, spread over blocks of bounded size.
        last = best.groupBy(*keys).agg(
            F.min(F.struct("confidence", (-F.col(order_key)).alias("_neg"))).alias("_last")
        )
        # Blocks are counted per group: a group below BLOCK_ROWS has one and copies nothing.
        sizes = remaining.groupBy(*keys).agg(
            F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_salts")
        )
        state = skew.sized_broadcast(last.join(sizes, list(keys)))
        behind = (
            remaining.join(state, list(keys))
            .filter(F.struct("confidence", (-F.col(order_key)).alias("_neg")) < F.col("_last"))
            .withColumn("_salt", F.pmod(F.xxhash64(order_key), F.col("_salts")).cast("int"))
            .drop("_last", "_salts")
        )
        spread = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
        kept = kept.join(skew.sized_broadcast(sizes), list(keys)).withColumn("_salt", spread).drop(
            "_salts"
        )
        schema = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in hot.schema.fields
        ) + ", " + ", ".join(f"{n} {'bigint' if n == '_by_idx' else 'double'}" for n in _LINK)
        tested = skew.checkpointed(
            behind.groupBy(*keys, "_salt")
            .cogroup(_fresh(kept).groupBy(*keys, "_salt"))
            .applyInPandas(_block_filter(rule, hot.columns, order_key), schema)
        )
        by = F.struct(
            F.col("_by_idx").alias("idx"), *[F.col(f"_by_{f}").alias(f) for f in _FIELDS[1:]]
        ) if link else F.lit(True)
        dropped = tested.filter(F.col("_by_idx").isNotNull())
        decided.append(dropped.select(*hot.columns, by.alias("suppressed_by")))
        remaining = tested.filter(F.col("_by_idx").isNull()).select(*hot.columns)
        rows = remaining.count()
    result = decided[0]
    for part in decided[1:]:
        result = result.unionByName(part)
    return result


def greedy_links(
    df: DataFrame,
    keys: Sequence[str],
    rule: Rule,
    order_key: str = "det_idx",
    group_limit: int | None = GROUP_LIMIT,
    link: bool = True,
) -> DataFrame:
    """All rows plus `suppressed_by` (null for kept rows; see `_fold` for `link`).

    Boxes of a group are visited by confidence descending, then `order_key` ascending, which must
    be unique in the group. `group_limit=None` skips the count of hot groups, for input whose groups
    are known to be small (for instance boxes already capped per image).
    """
    cool, hot = (df, None) if group_limit is None else skew.split_hot(df, keys, group_limit)
    result = _fold(cool, keys, order_key, rule, link)
    if hot is None:
        return result
    return result.unionByName(_rounds(hot, keys, order_key, rule, group_limit, link))


def suppress(
    df: DataFrame, rule: Rule = SUPPRESSION, image_key: str = "image_id", **options
) -> DataFrame:
    """Boxes that survive same-class suppression."""
    links = greedy_links(df, [image_key, "class_name"], rule, link=False, **options)
    return links.filter(F.col("suppressed_by").isNull()).drop("suppressed_by")


def nms(
    df: DataFrame,
    iou_threshold: float = 0.4,
    class_agnostic: bool = False,
    image_key: str = "image_id",
    class_key: str = "class_name",
    **options,
) -> DataFrame:
    """Non-maximum suppression per class, or across classes when `class_agnostic`."""
    keys = [image_key] if class_agnostic else [image_key, class_key]
    links = greedy_links(df, keys, Rule(iou_over=iou_threshold), link=False, **options)
    return links.filter(F.col("suppressed_by").isNull()).drop("suppressed_by")


def strongest_per_image(
    df: DataFrame, k: int = 300, image_key: str = "image_id", order_key: str = "det_idx"
) -> DataFrame:
    """The `k` highest-confidence boxes of each image, with their 1-based `row_number`."""
    order = [F.col("confidence").desc(), F.col(order_key).asc()]
    return skew.top_k(df, [image_key], order, k, [order_key])


def suppression_pairs(df: DataFrame, rule: Rule = SUPPRESSION, **options) -> DataFrame:
    """Each dropped box with the kept box that suppressed it and how much they overlap.

    Output is linear in the input: overlaps are only ever measured against kept boxes, and the
    suppressor's corners travel with the verdict, so nothing is joined back.
    """
    links = greedy_links(df, ["image_id", "class_name"], rule, **options)
    by = F.col("suppressed_by")
    kept = g.field_box(by)
    return links.filter(by.isNotNull()).select(
        "image_id", "class_name", "det_idx", by.getField("idx").alias("suppressed_by"),
        F.round(g.iou(kept, g.box()), 6).alias("iou"),
        F.round(g.containment(kept, g.box()), 6).alias("containment"),
    )
