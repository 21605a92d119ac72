"""Box geometry as Column expressions over flat corner columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Four corner columns in pixels."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "") -> Box:
    """Corner columns named x1, y1, x2, y2 (optionally `alias.`-prefixed)."""
    return Box(*[F.col(f"{prefix}{name}") for name in ("x1", "y1", "x2", "y2")])


def field_box(row: Column) -> Box:
    """Corner fields of a struct column or lambda variable."""
    return Box(*[row.getField(name) for name in ("x1", "y1", "x2", "y2")])


def zero_floor(value: Column) -> Column:
    return F.greatest(F.lit(0.0), value)


def area(b: Box) -> Column:
    return zero_floor(b.x2 - b.x1) * zero_floor(b.y2 - b.y1)


def intersection(a: Box, b: Box) -> Column:
    return zero_floor(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * zero_floor(
        F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    )


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def containment(a: Box, b: Box) -> Column:
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, intersection(a, b) / smaller).otherwise(F.lit(0.0))


def is_finite(value: Column) -> Column:
    infinite = (value == F.lit(float("inf"))) | (value == F.lit(float("-inf")))
    return value.isNotNull() & ~F.isnan(value) & ~infinite


def invalid_reason(b: Box) -> Column:
    """Null for a valid box, else the first rule it breaks."""
    finite = is_finite(b.x1) & is_finite(b.y1) & is_finite(b.x2) & is_finite(b.y2)
    return F.when(~finite, "not finite").when(
        (b.x2 <= b.x1) | (b.y2 <= b.y1), "right/bottom must exceed left/top"
    )


def clamp(b: Box, width: Column, height: Column) -> Box:
    return Box(
        zero_floor(F.least(width, b.x1)),
        zero_floor(F.least(height, b.y1)),
        zero_floor(F.least(width, b.x2)),
        zero_floor(F.least(height, b.y2)),
    )


def to_yolo(b: Box, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Clamped, normalised (cx, cy, w, h)."""
    c = clamp(b, width, height)
    return (
        (c.x1 + c.x2) / 2 / width,
        (c.y1 + c.y2) / 2 / height,
        (c.x2 - c.x1) / width,
        (c.y2 - c.y1) / height,
    )


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


@dataclass(frozen=True)
class Letterbox:
    scale: Column
    left: Column
    top: Column


def letterbox(width: Column, height: Column, model_width: int, model_height: int) -> Letterbox:
    """Scale and padding used to fit an image into the model input; integers round half-even."""
    scale = F.least(F.lit(float(model_width)) / width, F.lit(float(model_height)) / height)
    pad_x = F.lit(float(model_width)) - F.bround(width * scale)
    pad_y = F.lit(float(model_height)) - F.bround(height * scale)
    return Letterbox(scale, F.bround(pad_x / 2 - 0.1), F.bround(pad_y / 2 - 0.1))


def undo_letterbox(b: Box, fit: Letterbox, width: Column, height: Column) -> Box:
    """Model-space box back to original pixels, clamped and rounded to 2 digits."""
    moved = Box(
        (b.x1 - fit.left) / fit.scale,
        (b.y1 - fit.top) / fit.scale,
        (b.x2 - fit.left) / fit.scale,
        (b.y2 - fit.top) / fit.scale,
    )
    c = clamp(moved, width, height)
    return Box(*[F.round(v, 2) for v in (c.x1, c.y1, c.x2, c.y2)])


def fit_within(width: Column, height: Column, maximum: float) -> tuple[Column, Column]:
    """Size after shrinking (never growing) to a maximum side; halves round up, at least 1."""
    scale = F.least(F.lit(1.0), F.lit(float(maximum)) / F.greatest(width, height))
    return tuple(
        F.greatest(F.lit(1.0), F.floor(side * scale + 0.5).cast("double"))
        for side in (width, height)
    )


def contain_rect(
    outer_width: Column, outer_height: Column, width: Column, height: Column
) -> tuple[Column, Column, Column, Column]:
    """(left, top, width, height) of content centred inside a container at its largest fit."""
    scale = F.least(outer_width / width, outer_height / height)
    fitted_width, fitted_height = width * scale, height * scale
    return (
        (outer_width - fitted_width) / 2,
        (outer_height - fitted_height) / 2,
        fitted_width,
        fitted_height,
    )


def shape_uncertainty(b: Box, width: Column, height: Column) -> Column:
    """How unusual one box looks: elongated, tiny or nearly full-frame."""
    box_width, box_height = b.x2 - b.x1, b.y2 - b.y1
    ratio = F.greatest(box_width / box_height, box_height / box_width)
    share = box_width * box_height / (width * height)
    elongated = (
        F.when(ratio >= 6, 1.0).when(ratio >= 4, 0.65).when(ratio >= 3, 0.3).otherwise(0.0)
    )
    sized = (
        F.when(share < 0.002, 1.0)
        .when(share < 0.006, 0.6)
        .when(share > 0.8, 0.8)
        .when(share > 0.6, 0.4)
        .otherwise(0.0)
    )
    return F.greatest(elongated, sized)


def edit_box(
    b: Box, mode: Column, dx: Column, dy: Column, width: Column, height: Column,
    minimum: float = 4.0,
) -> Box:
    """Move the box, or drag the sides whose letters (n, e, s, w) appear in `mode`.

    A moved box stays inside the image; a dragged side keeps the box at least `minimum` wide.
    """
    move = mode == "move"
    moved_x = zero_floor(F.least(width - (b.x2 - b.x1), b.x1 + dx))
    moved_y = zero_floor(F.least(height - (b.y2 - b.y1), b.y1 + dy))
    x1 = F.when(
        mode.contains("w"), zero_floor(F.least(b.x2 - minimum, b.x1 + dx))
    ).otherwise(b.x1)
    x2 = F.when(
        mode.contains("e"), F.least(width, F.greatest(x1 + minimum, b.x2 + dx))
    ).otherwise(b.x2)
    y1 = F.when(
        mode.contains("n"), zero_floor(F.least(b.y2 - minimum, b.y1 + dy))
    ).otherwise(b.y1)
    y2 = F.when(
        mode.contains("s"), F.least(height, F.greatest(y1 + minimum, b.y2 + dy))
    ).otherwise(b.y2)
    return Box(
        F.when(move, moved_x).otherwise(x1),
        F.when(move, moved_y).otherwise(y1),
        F.when(move, moved_x + (b.x2 - b.x1)).otherwise(x2),
        F.when(move, moved_y + (b.y2 - b.y1)).otherwise(y2),
    )
