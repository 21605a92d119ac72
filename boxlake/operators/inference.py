"""Batch detection: run a caller's predictor over an image relation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.functions import classes as c
from boxlake.operators.detect import EXPECTED_CLASSES, ROLE_OF_SELECTION

# A predictor maps one image row (a namedtuple) and a confidence to (class, confidence, box) rows.
Predictor = Callable[[object, float], Sequence[tuple[str, float, Sequence[float]]]]

DETECT_SCHEMA = (
    "image_id BIGINT, det_idx BIGINT, class_name STRING, confidence DOUBLE, x1 DOUBLE, y1 DOUBLE, "
    "x2 DOUBLE, y2 DOUBLE, error STRING"
)


def detect_images(
    images: DataFrame, factory: Callable[[str], Predictor], confidence: float,
    selection: str = "water_detection",
) -> DataFrame:
    """Detections of every image; an image that fails becomes one row with `error`.

    `factory(role)` is called once per worker task, not per image; a predictor may carry
    `class_names`, which must then equal the role's list. The specialist role only keeps its own
    class, renamed to the accumulation class.
    """
    if selection not in ROLE_OF_SELECTION:
        raise ValueError(f"Unknown model selection: {selection}")
    role = ROLE_OF_SELECTION[selection]
    threshold = c.check_threshold(confidence)
    expected = EXPECTED_CLASSES[role]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = factory(role)
        names = getattr(predict, "class_names", None)
        if names is not None and tuple(names) != expected:
            raise ValueError(f"Loaded {role} classes must be {list(expected)}, got {list(names)}.")
        for batch in batches:
            rows: list[tuple] = []
            for image in batch.itertuples(index=False):
                try:
                    found = [
                        (image.image_id, i, name, round(float(conf), 4), *map(float, box), None)
                        for i, (name, conf, box) in enumerate(predict(image, threshold))
                    ]
                except Exception as error:  # noqa: BLE001 - one image must not stop the batch
                    found = [(image.image_id, None, None, None, None, None, None, None, str(error))]
                rows.extend(found)
            frame = pd.DataFrame(rows, columns=[
                "image_id", "det_idx", "class_name", "confidence", "x1", "y1", "x2", "y2", "error"
            ])
            yield frame.astype({"image_id": "int64", "det_idx": "Int64"})

    detected = images.mapInPandas(run, DETECT_SCHEMA)
    if role != "specialist":
        return detected
    failed = detected.filter(F.col("error").isNotNull())
    return c.specialist_only(detected.filter(F.col("error").isNull())).unionByName(failed)
