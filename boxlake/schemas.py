"""Explicit schemas; nothing in this package infers one."""

from __future__ import annotations

DETECTION = (
    "image_id BIGINT, det_idx BIGINT, class_name STRING, confidence DOUBLE, "
    "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
)

DETECTION_JSON = "ARRAY<STRUCT<class: STRING, confidence: DOUBLE, bbox: ARRAY<DOUBLE>>>"

OBSERVATION = (
    "video_id BIGINT, frame_idx BIGINT, t DOUBLE, det_idx BIGINT, class_name STRING, "
    "confidence DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
)

FLOW = "STRUCT<dx: DOUBLE, dy: DOUBLE, dt: DOUBLE, reliability: DOUBLE>"

PAGE_JSON = (
    "STRUCT<pageid: BIGINT, title: STRING, missing: BOOLEAN, imageinfo: ARRAY<STRUCT<"
    "url: STRING, thumburl: STRING, descriptionurl: STRING, mime: STRING, "
    "width: INT, height: INT, extmetadata: MAP<STRING, STRUCT<value: STRING>>>>>"
)

# The three dataset classes in index order.
CLASS_NAMES = ("pipe burst", "water accumulation", "water drop")

# Dataset splits in keeper-priority order, lowest first.
SPLITS = ("train", "valid", "test")
