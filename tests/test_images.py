"""Image files to pixels: decoding, fingerprints and motion against plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxlake.operators import fingerprint, motion
from boxlake.sources import images

BLOCKS = "name string, format string, width int, height int, channels int, data binary"


def plain_grey(pixels):
    """Fingerprint grey, pixel by pixel."""
    h, w, c = pixels.shape
    out = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            p = [int(v) for v in pixels[y, x]]
            out[y, x] = p[0] if c == 1 else (p[2] * 19595 + p[1] * 38470 + p[0] * 7471 + 32768) >> 16
    return out


def plain_reduced(line, target):
    """One line of numbers shrunk by a windowed sinc, rounded to bytes."""
    scale = len(line) / target
    wide = max(scale, 1.0)
    out = []
    for i in range(target):
        total = weight = 0.0
        for j, v in enumerate(line):
            d = (j + 0.5 - (i + 0.5) * scale) / wide
            if abs(d) < 3:
                sinc = lambda z: 1.0 if z == 0 else math.sin(math.pi * z) / (math.pi * z)
                w = sinc(d) * sinc(d / 3)
                total, weight = total + w * v, weight + w
        out.append(min(255, max(0, math.floor(total / weight + 0.5))))
    return out


def plain_words(pixels):
    grey = plain_grey(pixels)
    across = np.array([plain_reduced(row, 13) for row in grey.tolist()])
    small = np.array([plain_reduced(col, 12) for col in across.T.tolist()]).T
    value = 0
    for row in small.tolist():
        for a, b in zip(row[:-1], row[1:]):
            value = value << 1 | (a > b)
    return [value >> 96, value >> 48 & (1 << 48) - 1, value & (1 << 48) - 1]


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(6)
    shapes = [(24, 30, 3), (24, 30, 3), (12, 13, 1), (12, 13, 3), (40, 17, 1), (7, 9, 3), (20, 20, 4), (1, 1, 3)]
    out = {}
    for i, shape in enumerate(shapes):
        flat = rng.integers(0, 256, shape).astype(np.uint8)
        if shape[-1] == 4:
            flat[..., 3] = 255  # opaque, as decoders disagree about colours below full opacity
        out[f"p{i}"] = flat
    return out


def block_rows(spark, pictures):
    rows = [
        (n, "bmp" if n in ("p1", "p5") else "png", p.shape[1], p.shape[0], p.shape[2], bytearray(p.tobytes()))
        for n, p in pictures.items()
    ]
    rows += [("none", "png", None, None, None, None), ("torn", "png", 5, 5, 3, bytearray(b"abc"))]
    return spark.createDataFrame(rows, BLOCKS).repartition(3)


def test_files_are_decoded_and_fingerprinted(spark, pictures, tmp_path):
    folder = f"file://{tmp_path}/deep/files"
    sizes = {r.name: r.bytes for r in images.write_images(block_rows(spark, pictures), folder).collect()}
    assert sizes["none"] is None and sizes["torn"] is None and all(sizes[n] for n in pictures)
    (tmp_path / "deep" / "files" / "broken.png").write_bytes(b"\x89PNG not really")
    jpeg = spark._jvm.java.awt.image.BufferedImage(16, 24, 5)
    for y in range(24):
        for x in range(16):
            jpeg.setRGB(x, y, 0x204060 if x < 8 else 0xC0A080)
    target = tmp_path / "deep" / "photo.jpg"
    assert spark._jvm.javax.imageio.ImageIO.write(jpeg, "jpg", spark._jvm.java.io.File(str(target)))

    found = {r.name: r for r in images.read_images(spark, f"file://{tmp_path}/deep").collect()}
    assert set(found) == {*pictures, "broken", "photo"}
    assert found["broken"].width is None and found["broken"].data is None
    for name, pixels in pictures.items():
        r = found[name]
        assert (r.height, r.width, r.channels) == pixels.shape
        assert np.array_equal(np.frombuffer(r.data, np.uint8).reshape(pixels.shape), pixels)
    photo = found["photo"]
    decoded = np.frombuffer(photo.data, np.uint8).reshape(photo.height, photo.width, photo.channels)
    assert abs(int(decoded[0, 0, 0]) - 0x60) < 16 and abs(int(decoded[0, 15, 2]) - 0xC0) < 16

    names = sorted(found)
    numbered = images.read_images(spark, f"file://{tmp_path}/deep").withColumn(
        "id", F.array_position(F.array(*map(F.lit, names)), F.col("name"))
    )
    words = {names[r.id - 1]: r.words for r in fingerprint.fingerprints(numbered).collect()}
    assert words["broken"] is None
    for name, pixels in {**pictures, "photo": decoded}.items():
        assert words[name] == plain_words(pixels), name
    assert images.read_images(spark, f"file://{tmp_path}/deep", drop_invalid=True).count() == len(found) - 1


def test_no_images(spark):
    empty = spark.createDataFrame([], f"id long, {BLOCKS}")
    assert fingerprint.fingerprints(empty).count() == 0
    assert images.write_images(empty, "file:///tmp").count() == 0
    assert list(images.stacks(pa.RecordBatch.from_arrays(
        [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.binary())], list(images.BLOCK)
    ))) == []


def plain_flow(before, after, box, o):
    h, w = before.shape
    m = o.patch + o.search
    x1, x2 = (max(m, min(w - m, v)) for v in (box[0], box[2]))
    y1, y2 = (max(m, min(h - m, v)) for v in (box[1], box[3]))
    if x2 - x1 < 2 or y2 - y1 < 2:
        return None
    moves = []
    for gy in range(o.grid):
        for gx in range(o.grid):
            x = math.floor(x1 + (gx + 0.5) / o.grid * (x2 - x1) + 0.5)
            y = math.floor(y1 + (gy + 0.5) / o.grid * (y2 - y1) + 0.5)
            patch = before[y - o.patch : y + o.patch + 1, x - o.patch : x + o.patch + 1].astype(int)
            if patch.std() < o.texture:
                continue
            best = min(
                (int(np.abs(after[y + dy - o.patch : y + dy + o.patch + 1,
                                  x + dx - o.patch : x + dx + o.patch + 1].astype(int) - patch).sum()), dy, dx)
                for dy in range(-o.search, o.search + 1) for dx in range(-o.search, o.search + 1)
            )
            moves.append((best[2], best[1]))
    if len(moves) < max(2, math.ceil(o.grid**2 * 0.2)):
        return None
    dx, dy = (float(np.median([m[i] for m in moves])) for i in range(2))
    spread = float(np.median([math.hypot(a - dx, b - dy) for a, b in moves]))
    return dx, dy, max(0.0, min(1.0, len(moves) / o.grid**2 / (1 + spread)))


@pytest.mark.parametrize("chunk", [1, 2, 16])
def test_motion_of_decoded_frames(spark, tmp_path, chunk):
    rng = np.random.default_rng(8)
    frames, rows = {}, []
    for video in range(3):
        scene = rng.integers(0, 256, (40, 60, 3)).astype(np.uint8)
        scene[:20, :20] = 128  # a flat corner without texture
        for f in range(5 + video):
            if (video, f) != (1, 3):  # a missing frame breaks two pairs
                frames[video, f] = np.roll(scene, (f * video, 2 * f), axis=(0, 1))
                p = frames[video, f]
                rows.append((f"{video}-{f}", "png", 60, 40, 3, bytearray(p.tobytes())))
    images.write_images(spark.createDataFrame(rows, BLOCKS), f"file://{tmp_path}/frames").count()
    number = F.split("name", "-")
    read = images.read_images(spark, f"file://{tmp_path}/frames").withColumns({
        "video_id": number[0].cast("long"), "frame_idx": number[1].cast("long"),
    }).withColumn("t", F.col("frame_idx") * 0.5)
    corners = [(5.0, 6.0, 50.0, 33.0), (0.0, 0.0, 18.0, 18.0), (30.0, 10.0, 31.0, 11.0), (-9.0, -9.0, 90.0, 90.0)]
    wanted = [(v, f, d, *c) for v, f in frames for d, c in enumerate(corners)]
    boxes = spark.createDataFrame(
        wanted, "video_id long, frame_idx long, det_idx int, x1 double, y1 double, x2 double, y2 double"
    ).repartition(4)
    options = motion.FlowOptions(patch=1, search=3)
    got = {
        (r.video_id, r.frame_idx, r.det_idx): (r.dx, r.dy, r.reliability, r.dt)
        for r in motion.motion_flow(read, boxes, options, chunk_frames=chunk).collect()
    }
    want = {}
    for v, f, d, *box in wanted:
        if (v, f + 1) in frames:
            before, after = (images.grey_video(frames[v, g][None])[0] for g in (f, f + 1))
            flow = plain_flow(before, after, box, options)
            if flow is not None:
                want[v, f, d] = (*flow, 0.5)
    assert set(got) == set(want) and len(want) > 20
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_pixels_are_shuffled_once(spark):
    frames = spark.range(0, 64).selectExpr(
        "0L AS video_id", "id AS frame_idx", "id * 0.1D AS t", "50 AS width", "40 AS height", "1 AS channels",
        "unhex(repeat(sha2(CAST(id AS STRING), 256), 63)) AS noise",
    ).withColumn("data", F.expr("substring(noise, 1, 2000)")).drop("noise")
    boxes = frames.selectExpr("video_id", "frame_idx", "0 AS det_idx", "9.0D AS x1", "9.0D AS y1", "30.0D AS x2", "30.0D AS y2")
    seen = []

    def pixels(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(v or b"") for v in batch.column(0).to_pylist())])], ["n"])

    plan = motion.motion_flow(frames, boxes)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    chunk = F.array_distinct(F.array(F.floor(F.col("frame_idx") / 16), F.floor((F.col("frame_idx") + 1) / 16)))
    sent = frames.withColumn("c", F.explode(chunk)).select("data").mapInArrow(pixels, "n long").agg(F.sum("n")).first()[0]
    seen.append(sent)
    assert seen[0] <= 1.1 * 64 * 2000
