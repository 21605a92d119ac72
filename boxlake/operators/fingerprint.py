"""Perceptual fingerprints: difference hashes of grey images as arrays of 48-bit words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.sources import images

WORD_BITS = 48
FINGERPRINT_SCHEMA = "id BIGINT, words ARRAY<BIGINT>"


@lru_cache(maxsize=32)
def _resample_weights(source: int, target: int, lobes: float = 3.0) -> np.ndarray:
    """(target, source) row-normalised windowed-sinc weights, widened when shrinking."""
    scale = source / target
    stretch = max(scale, 1.0)
    centres = (np.arange(target) + 0.5) * scale
    offsets = (np.arange(source)[None, :] + 0.5 - centres[:, None]) / stretch
    weights = np.where(np.abs(offsets) < lobes, np.sinc(offsets) * np.sinc(offsets / lobes), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resize_grey(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Grey images (..., rows, columns) to (..., height, width), rounded to bytes after each direction."""
    rows, columns = pixels.shape[-2:]
    across = pixels.astype(float) @ _resample_weights(columns, width).T
    across = np.clip(np.floor(across + 0.5), 0, 255)
    down = _resample_weights(rows, height) @ across
    return np.clip(np.floor(down + 0.5), 0, 255)


def difference_words(pixels: np.ndarray, size: int = 12) -> np.ndarray:
    """Row-major left > right bits of shrunken grey images (n, rows, columns), most significant first, as
    (n, words)."""
    small = resize_grey(pixels, size + 1, size)
    bits = (small[..., :-1] > small[..., 1:]).reshape(len(pixels), -1)
    pad = -bits.shape[1] % WORD_BITS
    grouped = np.pad(bits, ((0, 0), (pad, 0))).reshape(len(pixels), -1, WORD_BITS)
    powers = 1 << np.arange(WORD_BITS - 1, -1, -1, dtype=np.int64)
    return grouped @ powers


def fingerprints(blocks: DataFrame, size: int = 12) -> DataFrame:
    """Words of every (id, width, height, channels, data) pixel block; null without pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [None] * batch.num_rows
            for rows, pixels in images.stacks(batch):
                found = difference_words(images.grey_print(pixels), size).tolist()
                for row, own in zip(rows.tolist(), found, strict=True):
                    words[row] = own
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(words, pa.list_(pa.int64()))], ["id", "words"]
            )

    return blocks.select(F.col("id").cast("long").alias("id"), *images.BLOCK).mapInArrow(
        run, FINGERPRINT_SCHEMA
    )


def band_layout(total_bits: int, bands: int) -> list[tuple[int, int]]:
    """(first bit, length) of `bands` nearly equal runs covering all bits."""
    edges = [math.ceil(i * total_bits / bands) for i in range(bands + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]
