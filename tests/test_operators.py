"""Cases of single operators, randomised checks against small models, and hot-path equality."""

from __future__ import annotations

import html
import html.entities
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from boxlake import skew
from boxlake.functions import classes as c
from boxlake.functions import text as t
from boxlake.operators import (
    audit, curate, detect, export, fingerprint, greedy, inference, motion, neardup, playback, replay,
    review, tracking,
)
from boxlake.sources import detections as det_source
from boxlake.sources import images as image_files
from boxlake.sources import labels, media


def boxes(spark, rows):
    return spark.createDataFrame(
        [(1, i, name, float(conf), *map(float, box)) for i, (name, conf, box) in enumerate(rows)],
        "image_id long, det_idx long, class_name string, confidence double, "
        "x1 double, y1 double, x2 double, y2 double",
    )


SUPPRESSION_CASES = {
    "overlap": ([("a", 0.9, (0, 0, 10, 10)), ("a", 0.8, (0, 0, 10, 7))], [0]),
    "small inside": ([("a", 0.9, (0, 0, 100, 100)), ("a", 0.8, (10, 10, 20, 20))], [0]),
    "large around": ([("a", 0.8, (0, 0, 100, 100)), ("a", 0.9, (10, 10, 20, 20))], [1]),
    "partial": ([("a", 0.9, (0, 0, 10, 10)), ("a", 0.8, (8, 8, 18, 18))], [0, 1]),
    "other class": ([("a", 0.9, (0, 0, 10, 10)), ("b", 0.8, (0, 0, 10, 10))], [0, 1]),
    "equal confidence": ([("a", 0.8, (0, 0, 100, 100)), ("a", 0.8, (10, 10, 20, 20))], [0, 1]),
    "dropped box cannot drop": (
        [("a", 0.9, (0, 0, 10, 10)), ("a", 0.8, (0, 4, 10, 14)), ("a", 0.7, (0, 8, 10, 18))],
        [0, 2],
    ),
}


@pytest.mark.parametrize("case", SUPPRESSION_CASES)
def test_suppression_cases(spark, case):
    rows, kept = SUPPRESSION_CASES[case]
    found = greedy.suppress(boxes(spark, rows)).collect()
    assert sorted(r.det_idx for r in found) == kept


def test_iou_boundary_differs_between_nms_and_suppression(spark):
    rows = boxes(spark, [("a", 0.9, (0, 0, 10, 10)), ("a", 0.8, (0, 0, 10, 4))])
    assert greedy.nms(rows, 0.4).count() == 2
    assert greedy.suppress(rows, greedy.Rule(iou_from=0.4)).count() == 1
    assert greedy.suppress(rows, greedy.CONTAINMENT_ONLY).count() == 1


def reference_greedy(rows, rule):
    kept = []
    for conf, idx, *box in sorted(rows, key=lambda r: (-r[0], r[1])):
        entry = np.array([conf, *box], dtype=float)
        if not any(rule.mask(np.array([k[0], *k[2:]], float), entry[None])[0] for k in kept):
            kept.append((conf, idx, *box))
    return sorted(k[1] for k in kept)


@pytest.mark.parametrize("limit", [512, 20])
@pytest.mark.parametrize("rule", [greedy.SUPPRESSION, greedy.CONTAINMENT_ONLY, greedy.NMS])
def test_greedy_matches_model_in_both_paths(spark, rule, limit):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        x, y = rng.randrange(200), rng.randrange(200)
        rows.append(("a", rng.randrange(40) / 40, (x, y, x + rng.randrange(5, 80), y + rng.randrange(5, 80))))
    expected = reference_greedy([(r[1], i, *r[2]) for i, r in enumerate(rows)], rule)
    found = greedy.suppress(boxes(spark, rows), rule, group_limit=limit)
    assert sorted(r.det_idx for r in found.collect()) == expected


def test_greedy_rounds_over_many_groups_copy_little(spark, monkeypatch):
    """Blocks are counted per group: many groups just above the limit stay one block each."""
    monkeypatch.setattr(greedy, "BLOCK_ROWS", 50)
    rng = random.Random(6)
    groups = {g: [] for g in range(20)}
    for g, rows in groups.items():
        for _ in range(70 if g else 260):
            x, y = rng.randrange(300), rng.randrange(300)
            rows.append((rng.randrange(90) / 90, (x, y, x + rng.randrange(5, 60), y + rng.randrange(5, 60))))
    frame = spark.createDataFrame(
        [(g, i, "a", float(conf), *map(float, box))
         for g, rows in groups.items() for i, (conf, box) in enumerate(rows)],
        "image_id long, det_idx long, class_name string, confidence double, "
        "x1 double, y1 double, x2 double, y2 double",
    )
    copies = []
    broadcast = skew.sized_broadcast

    def counted(df, *args):
        if "_salts" in df.columns:
            copies.append(df.agg(F.max("_salts"), F.sum("_salts"), F.count("*")).first())
        return broadcast(df, *args)

    monkeypatch.setattr(skew, "sized_broadcast", counted)
    found = greedy.suppress(frame, greedy.SUPPRESSION, group_limit=60).collect()
    for g, rows in groups.items():
        expected = reference_greedy([(conf, i, *box) for i, (conf, box) in enumerate(rows)], greedy.SUPPRESSION)
        assert sorted(r.det_idx for r in found if r.image_id == g) == expected
    assert copies and all(most <= 6 and total <= 2 * n + 5 for most, total, n in copies)


def test_one_export_shape_for_images_of_any_size(spark, tmp_path):
    images = spark.createDataFrame(
        [(1, 600.0, 450.0, True), (2, 600.0, 450.0, True), (3, 600.0, 450.0, False)],
        "image_id long, width double, height double, image_approved boolean",
    )
    found = spark.range(5_000).selectExpr(
        "1L AS image_id", "id AS det_idx", "'water drop' AS class_name", "0.5D AS confidence",
        "CAST(id % 500 AS DOUBLE) AS x1", "1.0D AS y1", "CAST(id % 500 + 20 AS DOUBLE) AS x2", "9.0D AS y2",
        "'model' AS source", "true AS confirmed", "false AS removed",
    ).unionByName(spark.createDataFrame(
        [(2, 0, "pipe burst", 0.5, 1.0, 1.0, 5.0, 5.0, "model", False, False)],
        "image_id long, det_idx long, class_name string, confidence double, x1 double, y1 double, "
        "x2 double, y2 double, source string, confirmed boolean, removed boolean",
    ))
    lines = export.yolo_label_lines(images, found.drop("source", "confirmed", "removed"))
    assert lines.count() == 5_002 and lines.filter("line IS NULL").count() == 1
    done = export.write_files(lines, f"file://{tmp_path}/labels", "image_id", "det_idx", "line").collect()
    assert {r.name: r.n for r in done} == {"1": 5_000, "2": 1, "3": 0}
    ordered = [r.line for r in lines.filter("image_id = 1").orderBy("det_idx").collect()]
    assert (tmp_path / "labels" / "1").read_text() == "\n".join(ordered) + "\n"
    assert (tmp_path / "labels" / "3").read_text() == ""

    records = det_source.detection_records(found)
    export.write_files(
        records, f"file://{tmp_path}/json", "image_id", "det_idx", "record", ",", ("[", "]")
    ).collect()
    assert len(json.loads((tmp_path / "json" / "1").read_text())) == 5_000
    assert json.loads((tmp_path / "json" / "2").read_text())[0]["class"] == "pipe burst"

    kept = export.review_records(images, found).collect()
    assert len(kept) == 5_002
    assert [(r.approved, r.approved_empty, r.record) for r in kept if r.image_id == 3] == [(False, False, None)]


def test_decode_keeps_two_of_ten_anchors(spark):
    scores = [[0.0, 0.0, 0.0] for _ in range(10)]
    scores[0][0], scores[1][0], scores[2][2] = 0.9, 0.8, 0.7
    centres = [(100, 100), (101, 101), (300, 300), *[(0, 0)] * 7]
    size = [(40, 40), (40, 40), (20, 20), *[(1, 1)] * 7]
    rows = [
        (1, i, float(cx), float(cy), float(w), float(h), s)
        for i, ((cx, cy), (w, h), s) in enumerate(zip(centres, size, scores, strict=True))
    ]
    schema = "image_id long, anchor_idx long, cx double, cy double, w double, h double, scores array<double>"
    anchors = spark.createDataFrame([*rows, (1, 10, 0.0, 0.0, 1.0, 1.0, [0.9])], schema)
    found = detect.decode_anchors(anchors, 0.25).orderBy("row_number").collect()
    assert [(r.class_name, r.confidence, r.x1, r.y2) for r in found] == [
        ("pipe burst", 0.9, 80.0, 120.0), ("water drop", 0.7, 290.0, 310.0),
    ]
    checked = det_source.check_anchor_rows(anchors, 3)
    assert checked.filter("reject_reason is not null").count() == 1


def test_end_to_end_rows_keep_order_and_cap(spark):
    rows = [(1, i, 0.0, 0.0, 1.0, 1.0, 0.3 + i / 100, float(i % 4)) for i in range(9)]
    df = spark.createDataFrame(
        rows, "image_id long, anchor_idx long, x1 double, y1 double, x2 double, y2 double, score double, class_id double"
    )
    found = detect.decode_end_to_end(df, 0.32, max_per_image=3).orderBy("row_number").collect()
    assert [(r.det_idx, r.class_name) for r in found] == [(2, "water drop"), (3, "3"), (4, "pipe burst")]


def test_thresholds(spark):
    df = boxes(spark, [("pipe burst", 0.4, (0, 0, 1, 1)), ("other", 0.3, (0, 0, 1, 1))])
    keep = lambda per: df.filter(
        c.passes_threshold(F.col("class_name"), F.col("confidence"), 0.25, per)
    ).count()
    assert keep({"pipe burst": 0.5}) == 1
    assert keep({"pipe burst": 0.5, "water drop": None}) == 2
    for bad in (float("nan"), -0.1, 1.1, "x", True):
        with pytest.raises(ValueError):
            c.check_threshold(bad)
    assert [c.clamped_threshold(v) for v in (float("nan"), float("inf"), -1, 0.4, 9)] == [0, 0, 0, 0.4, 1]


def test_class_maps(spark):
    rows = [
        ("general", "0", "Pipe_Burst"), ("general", "1", "water  accumulation"),
        ("general", "2", "dripping water"), ("specialist", "1", "water damage"),
        ("last", "0", "pipe burst"), ("last", "0", "water drop"),
        ("odd", "x", "a"),
    ]
    report = c.class_map_report(
        spark.createDataFrame(rows, "role string, idx string, name string"), detect.EXPECTED_CLASSES
    )
    verdicts = {r.role: r.verdict for r in report.collect()}
    assert verdicts == {
        "general": "ok", "specialist": "class indices must be contiguous from zero",
        "last": "class indices must be unique", "odd": "class indices must be integers",
    }


def test_annotation_overflow_is_clamped(spark):
    df = spark.createDataFrame(
        [("train", "s", 1, 1, 0.75, 0.8, 0.5, 0.41)],
        "split string, stem string, line_no long, class_id int, cx double, cy double, w double, h double",
    )
    row = audit.clamp_annotations(df).first()
    assert row.changed and not row.valid
    assert row.new_cx - row.new_w / 2 == pytest.approx(0.5)
    assert row.new_cy + row.new_h / 2 == pytest.approx(1.0)


def test_label_files(spark, tmp_path):
    folder = tmp_path / "train" / "labels"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_bytes(b"\xef\xbb\xbf0 .5 .5 .2 .2\r\n\r\n1 0.1 0.1 0.1\n")
    (folder / "b.txt").write_text("two 1 1 1 1")
    (folder / "c.jpg").write_text("not a label")
    parsed = labels.parse_label_lines(labels.read_label_lines(spark, str(tmp_path)))
    rows = labels.with_path_parts(parsed).orderBy("stem", "line_no").collect()
    assert [(r.split, r.stem, r.line_no, r.class_id, r.reject_reason) for r in rows] == [
        ("train", "a", 1, 0, None), ("train", "a", 3, 1, "must contain five fields"),
        ("train", "b", 1, None, "contains a non-numeric value"),
    ]
    assert rows[0].label_path.endswith("/train/labels/a.txt")


def test_listing_prunes_content(spark, tmp_path):
    folder = tmp_path / "valid" / "images"
    folder.mkdir(parents=True)
    (folder / "x.y.JPG").write_bytes(b"123")
    (folder / "z.txt").write_bytes(b"1")
    listing = media.list_images(spark, str(tmp_path))
    assert "content" not in listing.columns
    assert [(r.split, r.stem, r.suffix, r.length) for r in listing.collect()] == [("valid", "x.y", "jpg", 3)]


def test_strict_json_rejects_the_whole_document(spark):
    good = '{"class":"a","confidence":0.5,"bbox":[0,0,1,1]}'
    bad = '{"class":"a","confidence":0.5,"bbox":[0,0,1]}'
    docs = spark.createDataFrame([(1, f"[{good},{bad}]"), (2, f"[{good}]"), (3, "[]")], "doc_id long, body string")
    loose = det_source.ingest_json(docs).filter("reject_reason is null")
    strict = det_source.ingest_json(docs, strict=True).filter("reject_reason is null")
    assert sorted(r.doc_id for r in loose.collect()) == [1, 2]
    assert [r.doc_id for r in strict.collect()] == [2]


def test_html_is_cleaned_like_the_standard_library(spark):
    rng = random.Random(5)
    texts = [None, "", "&", "&&", "a & b", "&;", "&#;", "&#x;", "&#xg;", "<b>&lt;i&gt;</b>", "&amp;amp;lt;", "&ampx &ltx",
             "&notit; &notin; &notinx; &NotEqualTilde; &nosuchname; &frac12x &Ccedil &yacutes", "x&thinsp;&emsp;y \x1c z"]
    for name in html.entities.html5:
        texts += [f"x&{name}y", f"&{name}", f"&{name.rstrip(';')}", f"&{name.rstrip(';')}1 &{name[:3]}"]
    for n in (*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFD,
              0x10FFFF, 0x110000, 10**12, 10**30):
        texts += [f"a&#{n};b", f"a&#{n} b", f"a&#x{n:x};b", f"a&#X{n:06X}b", f"&#000{n};"]
    alphabet = ["&", ";", "#", "x", "amp", "lt", "not", "in", "eacute", "1", "2", " ", "<", ">", "é", "Acirc", "\n", "\t"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(3_000)]

    def plain(text):
        untagged = re.sub(r"<[^>]+>", " ", html.unescape(text or ""))
        return re.sub(r"\s+", " ", untagged).strip()

    rows = spark.createDataFrame(list(enumerate(texts)), "i long, v string").repartition(4)
    for r in rows.select("i", t.clean_html(F.col("v")).alias("c")).collect():
        assert r.c == plain(texts[r.i]), texts[r.i]


def test_text_helpers(spark):
    df = spark.createDataFrame([("&lt;b&gt;A &eacute;&amp;nbsp;<i>x</i>",)], "v string")
    row = df.select(
        t.clean_html(F.col("v")).alias("full"),
        t.trimmed_decimal(F.lit(0.25)).alias("d"), t.trimmed_decimal(F.lit(10.0)).alias("ten"),
        t.clock(F.lit(75.9)).alias("clock"), t.percent(F.lit(0.1234), 1).alias("p"),
        t.label_filename(F.lit(".hidden")).alias("h"), t.label_filename(F.lit("a.b.png")).alias("ab"),
    ).first()
    assert row.full == "A é&nbsp; x"
    assert (row.d, row.ten, row.clock, row.p) == ("0.25", "10", "1:15", "12.3%")
    assert (row.h, row.ab) == (".hidden.txt", "a.b.txt")
    names = ["beta.jpg", "alpha.jpg", "10.jpg", "2.jpg", "1.jpg", "img-010.jpg", "IMG-9.jpg"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    ordered = rows.orderBy(t.starts_with_number(F.col("n")).desc(), t.natural_key(F.col("n")))
    assert [r.n for r in ordered.collect()] == [
        "1.jpg", "2.jpg", "10.jpg", "alpha.jpg", "beta.jpg", "IMG-9.jpg", "img-010.jpg",
    ]


def test_positions_are_dense_with_hot_groups(spark):
    df = spark.range(5000).selectExpr("IF(id % 3 = 0, 0, id % 7) AS g", "id", "(id * 7919) % 5003 AS v")
    order = [F.col("v").asc(), F.col("id").asc()]
    placed = skew.group_index(df, ["g"], order, "i", "n").collect()
    groups: dict[int, list] = {}
    for r in placed:
        groups.setdefault(r.g, []).append(r)
    for rows in groups.values():
        rows.sort(key=lambda r: (r.v, r.id))
        assert [r.i for r in rows] == list(range(1, len(rows) + 1))
        assert {r.n for r in rows} == {len(rows)}
    overall = sorted(skew.global_index(df, order, "i").collect(), key=lambda r: (r.v, r.id))
    assert [r.i for r in overall] == list(range(1, 5001))
    parts = skew.with_part(df, ["g"], order, 100).groupBy("g", "part_no").count()
    assert parts.agg(F.max("count")).first()[0] <= 1000
    assert parts.filter("g = 0").agg(F.max("count")).first()[0] == 100


def test_large_k_matches_small_k_plan(spark):
    df = spark.range(4000).selectExpr("id % 2 AS g", "id")
    wide = skew.top_k(df, ["g"], [F.col("id").desc()], 1500, ["id"])
    assert wide.count() == 3000 and wide.agg(F.min("id")).first()[0] == 1000


def words_of(value: int) -> list[int]:
    mask = (1 << 48) - 1
    return [(value >> 96) & mask, (value >> 48) & mask, value & mask]


@pytest.mark.parametrize("bucket", [2000, 3])
def test_near_duplicates_match_brute_force(spark, bucket):
    rng = random.Random(11)
    # Mostly-zero hashes share band values, which crowds their buckets.
    known = [rng.getrandbits(144) if i % 3 else rng.getrandbits(144) & rng.getrandbits(144) & 0xFFFF for i in range(120)]
    candidates = []
    for i in range(150):
        base = known[rng.randrange(len(known))]
        for bit in rng.sample(range(144), rng.randrange(9)):
            base ^= 1 << bit
        candidates.append(base)
    expected = {i for i, v in enumerate(candidates) if any((v ^ k).bit_count() <= 5 for k in known)}
    schema = "id long, words array<bigint>"
    left = spark.createDataFrame([(i, words_of(v)) for i, v in enumerate(candidates)], schema)
    right = spark.createDataFrame([(i, words_of(v)) for i, v in enumerate(known)], schema)
    flagged = neardup.flag_near_duplicates(left, right, 3, 48, bucket_limit=bucket)
    assert {r.id for r in flagged.collect() if r.near_duplicate} == expected
    assert flagged.count() == len(candidates)


@pytest.mark.parametrize("varying", [3, 24])
def test_near_duplicates_on_half_constant_hashes(spark, varying):
    """Constant bits make no bands: candidates do not all meet all known rows."""
    rng = random.Random(12)
    live = sorted(rng.sample(range(64), varying))
    value = lambda: sum(1 << b for b in live if rng.random() < 0.5) - (1 << 63 if 63 in live else 0)
    known, candidates = [value() for _ in range(150)], [value() for _ in range(150)]
    near = {i for i, v in enumerate(candidates) if any(((v ^ k) % (1 << 64)).bit_count() <= 5 for k in known)}
    left = spark.createDataFrame([(i, [v]) for i, v in enumerate(candidates)], "id long, words array<bigint>")
    right = spark.createDataFrame([(i, [v]) for i, v in enumerate(known)], "id long, words array<bigint>")
    flagged = neardup.flag_near_duplicates(left, right, 1, 64)
    assert {r.id for r in flagged.collect() if r.near_duplicate} == near
    bits = neardup.informative_bits(left.union(right), 1, 64)
    assert bits == live
    if varying > 5:
        layout = neardup._split(bits, 6)
        met = neardup._banded(left, layout, 64).join(
            neardup._banded(right, layout, 64).withColumnRenamed("words", "other"), ["band", "value"]
        )
        assert met.count() < 100 * len(candidates)


def test_open_quota_with_tiny_chunks(spark):
    rng = random.Random(3)
    rows = [
        Row(id=i, category="ab"[i % 2], words=[rng.getrandbits(10)], order_key=f"{rng.randrange(10**6):07d}-{i:03d}",
            too_small=i % 9 == 0, known_duplicate=i % 13 == 0)
        for i in range(160)
    ]
    targets = {"a": 5, "b": 40}
    accepted, fates = [], {}
    for cat, target in targets.items():
        taken = 0
        for r in sorted((r for r in rows if r.category == cat), key=lambda r: r.order_key):
            if taken == target:
                break
            if r.too_small or r.known_duplicate or any((r.words[0] ^ w).bit_count() <= 2 for w in accepted):
                fates[r.id] = "rejected"
            else:
                accepted.append(r.words[0])
                fates[r.id] = "accepted"
                taken += 1
    df = spark.createDataFrame(rows, "id long, category string, words array<bigint>, order_key string, too_small boolean, known_duplicate boolean")
    found = curate.quota_select_open(df, targets, words=1, limit=2, chunk=4)
    assert {r.id: r.status for r in found.collect()} == fates


def test_difference_hash():
    flat = np.full((40, 60), 90, np.uint8)
    falling = np.tile(np.linspace(250, 5, 130).astype(np.uint8), (60, 1))
    moved = np.roll(falling, 1, axis=0)
    assert fingerprint.difference_words(flat[None]).tolist() == [[0, 0, 0]]
    words, same = fingerprint.difference_words(np.stack((falling, moved))).tolist()
    assert sum(w.bit_count() for w in words) == 144 and words == same
    bgr = np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0], [9, 200, 31]]], np.uint8)
    assert image_files.grey_video(bgr).tolist() == [[76, 150, 29, 128]]
    assert image_files.grey_print(bgr).tolist() == [[76, 150, 29, 128]]


def test_box_flow_finds_a_known_shift():
    rng = np.random.default_rng(2)
    before = rng.integers(0, 255, (20, 24)).astype(np.uint8)
    after = np.roll(before, 2, axis=1)
    dx, dy, reliability = motion.box_flow(before, after, (6, 5, 18, 15), motion.FlowOptions(4, 1, 4, 8))
    assert abs(dx - 2) < 0.5 and abs(dy) < 0.5 and reliability > 0.4
    assert motion.box_flow(before * 0, after * 0, (6, 5, 18, 15)) is None
    with pytest.raises(ValueError):
        motion.box_flow(before, after[:10], (1, 1, 5, 5))


def observation_rows(spark, rows):
    return spark.createDataFrame(
        [(1, f, f * 0.25, d, n, float(cf), *map(float, b), f // 4) for f, d, n, cf, b in rows],
        "video_id long, frame_idx long, t double, det_idx long, class_name string, confidence double, "
        "x1 double, y1 double, x2 double, y2 double, chunk long",
    )


def test_patience_hides_a_weak_track(spark):
    rows = [(i, 0, "a", cf, (0, 0, 10, 10)) for i, cf in enumerate((0.8, 0.2, 0.2, 0.2, 0.6))]
    options = tracking.TrackerOptions(max_gap=2, enter=0.5, exit=0.3, patience=2)
    found = tracking.assign_tracks(observation_rows(spark, rows), options).orderBy("frame_idx").collect()
    assert [r.visible for r in found] == [True, True, True, False, True]
    assert [r.segment for r in found] == [0, 0, 0, 0, 1]


def test_one_to_one_matching_prefers_overlap(spark):
    rows = [
        (0, 0, "a", 0.9, (0, 0, 10, 10)), (0, 1, "a", 0.9, (6, 0, 16, 10)),
        (1, 0, "a", 0.9, (5, 0, 15, 10)), (1, 1, "a", 0.4, (1, 0, 11, 10)), (9, 0, "a", 0.9, (5, 0, 15, 10)),
        (9, 1, "a", 0.3, (90, 0, 99, 10)),
    ]
    options = tracking.TrackerOptions(max_gap=3)
    found = tracking.assign_tracks(observation_rows(spark, rows), options)
    by = {(r.frame_idx, r.det_idx): (r.start_frame, r.start_det) for r in found.collect()}
    assert by[1, 0] == (0, 1) and by[1, 1] == (0, 0)
    assert by[9, 0] == (9, 0) and by[9, 1] == (None, None)
    ids = {(r.start_frame, r.start_det): r.track_id for r in tracking.number_tracks(found).collect()}
    assert ids == {(0, 0): 1, (0, 1): 2, (9, 0): 3}


def random_observations(spark, frames=240):
    rng = random.Random(7)
    rows = []
    for frame in range(frames):
        if rng.random() < 0.06:
            continue
        for det in range(rng.randrange(3)):
            x = frame // 3 + 40 * det + rng.randrange(6)
            rows.append((frame, det, "ab"[det % 2], rng.random(), (x, 0, x + 30, 30)))
    return observation_rows(spark, rows)


def test_tracker_rounds_and_sessions_equal_one_pass(spark):
    rows = random_observations(spark)
    options = tracking.TrackerOptions(max_gap=2)
    whole = tracking.assign_tracks(rows, options)
    cut = tracking.assign_tracks(rows, options, group_limit=15)
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.select(*whole.columns).collect()))


def plain_smoothed(rows, tau):
    """[(t, vector)] in order: the two folds, averaged."""
    def fold(rows):
        out = []
        for t, v in rows:
            if out:
                gap = abs(t - out[-1][0])
                alpha = 1.0 if tau <= 0 or gap <= 0 else 1 - math.exp(-gap / tau)
                v = [p + (x - p) * alpha for p, x in zip(out[-1][1], v)]
            out.append((t, v))
        return [v for _, v in out]

    return [
        [(x + y) / 2 for x, y in zip(a, b)] for a, b in zip(fold(rows), fold(rows[::-1])[::-1])
    ]


@pytest.mark.parametrize("tau", [0.5, 40.0, 0.0])
def test_groups_of_any_length_smooth_like_a_fold(spark, tau):
    rows = random_observations(spark)  # several rows at one time
    rows = rows.union(rows.withColumn("class_name", F.lit("c")).limit(1))
    rows = rows.withColumn("class_name", F.when(F.col("det_idx") < 1, F.col("class_name")))
    keys = ["video_id", "class_name"]
    groups = {}
    for r in playback.box_vectors(rows).collect():
        groups.setdefault(r.class_name, []).append((r.t, [r.cx, r.cy, r.w, r.h]))
    want = [(str(name), t, *v) for name, own in groups.items()
            for (t, _), v in zip(sorted(own), plain_smoothed(sorted(own), tau))]
    assert len(want) > 200
    for limit in (playback.CHUNK_ROWS, 30, 1):
        found = playback.smooth_tracks(rows, keys, tau, chunk_rows=limit).drop("video_id").collect()
        got = [(str(r[0]), *r[1:]) for r in found]
        for g, w in zip(sorted(got), sorted(want), strict=True):
            assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], rel=1e-9, abs=1e-9)


def test_a_long_track_takes_as_many_jobs_as_a_short_one(spark):
    def jobs(n, chunk_rows):
        rows = spark.range(n).selectExpr("1L AS k", "id * 0.1D AS t", "id % 7 + 0.0D AS x1", "0.0D AS y1",
                                         "id % 7 + 9.0D AS x2", "5.0D AS y2")
        group = f"smooth-{n}-{chunk_rows}"
        spark.sparkContext.setJobGroup(group, group)
        first = playback.smooth_tracks(rows, ["k"], 3.0, chunk_rows).agg(F.sum("s_cx")).first()[0]
        count = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("", "")
        return count, first

    # 500,000 rows in 5 chunks and in 5,000.
    few, a = jobs(500_000, 100_000)
    many, b = jobs(500_000, 100)
    whole, c = jobs(500_000, 1_000_000)
    assert many <= few + 2 and a == pytest.approx(c, rel=1e-12) and b == pytest.approx(c, rel=1e-12)


def test_playback_interpolates_two_tracks_and_respects_gaps(spark):
    none = "CAST(NULL AS STRUCT<dx: DOUBLE, dy: DOUBLE, dt: DOUBLE, reliability: DOUBLE>)"
    rows = spark.createDataFrame(
        [(1, 0.0, 0.8, 5.0), (1, 1.0, 0.6, 15.0), (2, 0.0, 0.9, 100.0), (2, 1.0, 0.9, 90.0)],
        "track long, t double, confidence double, s_cx double",
    ).selectExpr("*", "0.0D AS s_cy", "10.0D AS s_w", "10.0D AS s_h", "0L AS chunk",
                 f"{none} AS flow_to_next", f"{none} AS flow_from_previous")
    shown = playback.sample_playback(rows, ["track"], "chunk", 0.5, max_gap=1.1, window=0.2)
    middle = {r.track: (r.cx, r.confidence) for r in shown.collect() if r.time == 0.5}
    assert middle[1] == (10.0, pytest.approx(0.7)) and middle[2] == (95.0, 0.9)
    gap = playback.sample_playback(rows, ["track"], "chunk", 0.5, max_gap=0.2, window=0.2)
    assert 0.5 not in {r.time for r in gap.collect()}


def test_reset_empties_a_review_and_unknown_operations_are_listed(spark):
    state = replay.ReviewState()
    replay.apply_event(state, "model", 1, (0.0, 0.0, 5.0, 5.0), "a", 0.5)
    replay.apply_event(state, "confirm", 1, None, None)
    replay.apply_event(state, "approve", None, None, None)
    replay.apply_event(state, "sparkle", 1, None, None)
    assert state.boxes[0].confirmed and state.approved and state.past
    replay.apply_event(state, "reset", None, None, None)
    assert (state.boxes, state.past, state.edited, state.approved) == ((), [], False, False)
    replay.apply_event(state, "model", 7, (0.0, 0.0, 5.0, 5.0), "b", 0.5)
    assert [row[0] for row in replay.Replay().finish(state)] == [7]
    events = spark.createDataFrame([("confirm",), ("sparkle",), (None,)], "op string")
    assert replay.unknown_events(events).count() == 2


def test_open_quota_of_nothing_is_empty(spark):
    rows = spark.createDataFrame(
        [(1, "a", "k", [0], False, False)],
        "id long, category string, order_key string, words array<long>, too_small boolean, "
        "known_duplicate boolean",
    )
    assert curate.quota_select_open(rows, {"a": 0}, words=1).collect() == []
    assert curate.quota_select_open(rows, {}, words=1).collect() == []


def test_undo_and_redo(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    state = replay.ReviewState()
    replay.apply_event(state, "model", 4, box, "a", 0.7)
    replay.apply_event(state, "remove", 4, None, None)
    assert state.boxes[0].removed and state.edited
    replay.apply_event(state, "undo", None, None, None)
    assert not state.boxes[0].removed
    replay.apply_event(state, "redo", None, None, None)
    assert state.boxes[0].removed
    replay.apply_event(state, "add", None, box, "b")
    assert state.boxes[-1].det_id == 5 and state.boxes[-1].source == "manual" and not state.future
    replay.apply_event(state, "approve", None, None, None)
    replay.apply_event(state, "confirm", 5, None, None)
    assert not state.approved
    for _ in range(150):
        replay.apply_event(state, "confirm", 5, None, None)
    assert len(state.past) == replay.HISTORY_LIMIT


def test_replay_rounds_equal_one_pass(spark, small):
    from boxlake.plans.fixtures import table
    from boxlake.plans.video import review_rows

    rows = review_rows(table(spark, small, "conversations").withColumn("conv_id", F.col("conv_id") % 2)
                       .withColumn("turn", F.expr("row_number() over (partition by conv_id order by turn, text) - 1").cast("long")))
    loads, edits = rows.filter("op = 'model'"), rows.filter("op <> 'model'").drop("confidence")
    one = sorted(map(str, replay.replay_reviews(loads, edits).collect()))
    many = sorted(map(str, replay.replay_reviews(loads, edits, group_limit=9).collect()))
    assert one == many and len(one) > 50


def test_crowded_frames_link_like_all_pairs(spark):
    rng = random.Random(12)
    rows = []
    for frame in range(4):
        for det in range(150 if frame != 2 else 9):
            w, h = 2 ** rng.uniform(-2, 7), 2 ** rng.uniform(-2, 7)
            x, y = rng.uniform(-90, 90), rng.uniform(-90, 90)
            if det % 10 == 0:
                x, y, w, h = 8.0, -16.0, 64.0, 32.0  # equal boxes on cell borders
            if det % 37 == 1:
                w = 0.0
            rows.append((frame, det, "ab"[det % 2], 0.9, (x, y, x + w, y + h)))
    observed = observation_rows(spark, rows)
    for share in (0.3, 0.05, 0.9):
        found = {
            crowd: tracking.frame_links(observed, 1, match_iou=share, crowd=crowd).drop("video_id").collect()
            for crowd in (10**6, 20, 0)
        }
        whole = sorted(found[10**6])
        assert len(whole) > 100 and len(set(r[1:5] for r in whole)) < len(whole) + 1
        assert sorted(found[20]) == whole and sorted(found[0]) == whole
    with pytest.raises(ValueError):
        tracking.frame_links(observed, 1, match_iou=0.0)


def test_a_frame_of_a_hundred_thousand_boxes(spark):
    boxes = spark.range(100_000).crossJoin(spark.range(2).withColumnRenamed("id", "frame_idx")).selectExpr(
        "1L AS video_id", "'a' AS class_name", "frame_idx", "id AS det_idx", "0L AS chunk",
        "(id % 400) * 10.0D + frame_idx AS x1", "(id div 400) * 10.0D AS y1",
        "(id % 400) * 10.0D + frame_idx + 9 AS x2", "(id div 400) * 10.0D + 9 AS y2",
    )
    links = tracking.frame_links(boxes, 1)
    assert links.agg(F.count("*"), F.min("iou"), F.count_if(F.expr("previous_det = det_idx"))).first()[:] == (
        100_000, pytest.approx(72 / 90), 100_000
    )


def test_review_order_of_three(spark):
    images = spark.createDataFrame(
        [(1, 0, False, False, True), (2, 1, False, False, True), (3, 2, True, False, True), (4, 3, False, True, True)],
        "image_id long, original_index long, review_edited boolean, image_approved boolean, analyzed boolean",
    ).selectExpr("*", "100.0D AS width", "100.0D AS height")
    det = spark.createDataFrame(
        [(1, 0, 0.9), (2, 0, 0.3), (3, 0, 0.1), (4, 0, 0.1)], "image_id long, det_idx long, confidence double"
    ).selectExpr("*", "10.0D AS x1", "10.0D AS y1", "40.0D AS x2", "40.0D AS y2", "false AS removed")
    queue = review.review_queue(review.review_signals(images, det)).orderBy("position").collect()
    assert [r.image_id for r in queue] == [2, 1, 3]
    assert [(r.previous_image, r.next_image) for r in queue] == [(None, 1), (2, 3), (1, None)]


def test_batch_detection_keeps_failures_as_rows(spark):
    def factory(role):
        def predict(image, confidence):
            if image.image_id == 2:
                raise OSError("broken")
            return [("Water_Damage", 0.91237, (0, 0, 5, 5)), ("other", 0.9, (0, 0, 5, 5))]

        return predict

    images = spark.createDataFrame([(1,), (2,)], "image_id long")
    rows = inference.detect_images(images, factory, 0.5, "water_accumulation").collect()
    assert {(r.image_id, r.class_name, r.confidence, r.error) for r in rows} == {
        (1, "water accumulation", 0.9124, None), (2, None, None, "broken"),
    }
    with pytest.raises(ValueError):
        inference.detect_images(images, factory, 0.5, "nope")
