"""Decoded images: files to pixel blocks and back.

A pixel block is a row of (width, height, channels, data): `data` holds the rows of the image from the top,
interleaved as blue, green, red (and alpha), or one grey byte a pixel, as Spark's `image` source gives
them. `stacks` turns the blocks of an Arrow batch into arrays without copying pixel by pixel; images of
one shape share one array, so that everything after it is vectorised over images.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = ("width", "height", "channels", "data")


def read_images(spark: SparkSession, root: str, drop_invalid: bool = False) -> DataFrame:
    """(path, name, width, height, channels, data) of the image files below `root`, decoded by Spark.

    Files that cannot be decoded are dropped, or kept with null sizes and data.
    """
    files = spark.read.format("image").option("recursiveFileLookup", True).option(
        "dropInvalid", drop_invalid
    ).load(root).select("image.*")
    known = lambda c: F.when(F.col("nChannels") > 0, F.col(c))
    return files.select(
        F.col("origin").alias("path"), F.regexp_extract("origin", r"([^/]+?)(\.[^./]*)?$", 1).alias("name"),
        known("width").alias("width"), known("height").alias("height"),
        known("nChannels").alias("channels"), known("data").alias("data"),
    )


def stacks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, pixels of shape (n, height, width, channels)) for each shape among the blocks of a batch.

    Rows without pixels, or whose sizes do not fit their data, are in no stack.
    """
    width, height, channels = (
        batch.column(c).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for c in BLOCK[:3]
    )
    column = batch.column("data")
    if pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    column = column.fill_null(b"")
    _, bounds, data = column.buffers()
    if len(column) == 0 or data is None:
        return
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)
    size = width * height * channels
    fits = np.flatnonzero((size > 0) & (np.diff(bounds) == size))
    shapes = np.stack((height, width, channels), axis=1)[fits]
    unique, which = np.unique(shapes, axis=0, return_inverse=True)
    for number, shape in enumerate(unique):
        rows = fits[which.ravel() == number]
        places = bounds[rows][:, None] + np.arange(int(shape.prod()))
        yield rows, data[places].reshape(len(rows), *shape)


def grey_video(pixels: np.ndarray) -> np.ndarray:
    """Grey bytes of pixel stacks as for video frames: weighted colours, rounded half up."""
    if pixels.shape[-1] == 1:
        return pixels[..., 0]
    blue, green, red = (pixels[..., c].astype(float) for c in range(3))
    return np.floor(red * 0.299 + green * 0.587 + blue * 0.114 + 0.5).astype(np.uint8)


def grey_print(pixels: np.ndarray) -> np.ndarray:
    """Grey bytes of pixel stacks as for fingerprints: weights in 65,536ths, rounded half up."""
    if pixels.shape[-1] == 1:
        return pixels[..., 0]
    blue, green, red = (pixels[..., c].astype(np.int64) for c in range(3))
    # The weights of the grey conversion that fingerprints are compared with.
    return ((red * 19595 + green * 38470 + blue * 7471 + 32768) >> 16).astype(np.uint8)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_bytes(pixels: np.ndarray) -> bytes:
    """A PNG file of (height, width, channels) pixels in block order."""
    height, width, channels = pixels.shape
    ordered = pixels if channels == 1 else pixels[..., [2, 1, 0, *range(3, channels)]]
    lines = np.zeros((height, 1 + width * channels), np.uint8)
    lines[:, 1:] = ordered.reshape(height, -1)
    colour = {1: 0, 3: 2, 4: 6}[channels]
    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", header) + _chunk(
        b"IDAT", zlib.compress(lines.tobytes())
    ) + _chunk(b"IEND", b"")


def bmp_bytes(pixels: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP file of (height, width, 3) pixels in block order."""
    height, width, _ = pixels.shape
    stride = -(-width * 3 // 4) * 4
    lines = np.zeros((height, stride), np.uint8)
    lines[:, : width * 3] = pixels[::-1].reshape(height, -1)
    head = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, lines.size, 2835, 2835, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + lines.size, 0, 0, 54) + head + lines.tobytes()


ENCODERS = {"png": png_bytes, "bmp": bmp_bytes}


def write_images(blocks: DataFrame, folder: str) -> DataFrame:
    """One file for each (name, format, width, height, channels, data) row; returns (name, size, bytes).

    `folder` is any location that the workers share; a file gets its name when it is complete. Rows
    without pixels write nothing and come back with null bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            names, kinds = batch.column("name").to_pylist(), batch.column("format").to_pylist()
            sizes = [None] * batch.num_rows
            for rows, pixels in stacks(batch):
                for row, image in zip(rows.tolist(), pixels, strict=True):
                    body = ENCODERS[kinds[row]](image)
                    name = f"{names[row]}.{kinds[row]}"
                    with store.open_output_stream(f"{base}/.{name}.{attempt}") as stream:
                        stream.write(body)
                    store.move(f"{base}/.{name}.{attempt}", f"{base}/{name}")
                    sizes[row] = len(body)
            yield pa.RecordBatch.from_arrays(
                [batch.column("name"), pa.array(sizes, pa.int64())], ["name", "bytes"]
            )

    return blocks.select("name", "format", *BLOCK).mapInArrow(run, "name string, bytes long")
