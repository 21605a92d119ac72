"""Geometry, classes, thresholds, suppression and decoding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake import skew
from boxlake.functions import classes as c
from boxlake.functions import geometry as g
from boxlake.operators import detect, greedy
from boxlake.plans.fixtures import derived, table
from boxlake.plans.registry import Registry
from boxlake.sources import detections as det_source

boxes = Registry()

# The per-class thresholds of the fixture.
CLASS_THRESHOLDS = {"pipe burst": 0.30, "water accumulation": 0.45, "water drop": 0.60}


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "detections")


@boxes.add(
    "box_geometry",
    """
    SELECT image_id, det_idx,
           greatest(0, x2 - x1) * greatest(0, y2 - y1) AS area,
           x1 / 600 AS left_share, (x1 + x2) / 2 AS centre_x, (y1 + y2) / 2 AS centre_y
    FROM detections""",
    ("detections",),
)
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = g.box()
    return _detections(spark, sf_dir).select(
        "image_id", "det_idx", g.area(b).alias("area"), (b.x1 / 600).alias("left_share"),
        ((b.x1 + b.x2) / 2).alias("centre_x"), ((b.y1 + b.y2) / 2).alias("centre_y"),
    )


@boxes.add(
    "box_validity",
    """
    WITH odd AS (
        SELECT image_id, det_idx, x1,
               CASE WHEN variant = 5 THEN CAST('NaN' AS DOUBLE)
                    WHEN variant = 6 THEN CAST('Infinity' AS DOUBLE) ELSE y1 END AS y1,
               CASE WHEN variant = 7 THEN x1 - 1 WHEN variant = 8 THEN x1 ELSE x2 END AS x2, y2
        FROM detections)
    SELECT image_id, det_idx,
           CASE WHEN isnan(y1) OR isinf(y1) THEN 'not finite'
                WHEN x2 <= x1 OR y2 <= y1 THEN 'right/bottom must exceed left/top' END AS reason
    FROM odd""",
    ("detections",),
)
def box_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = _detections(spark, sf_dir).select(
        "image_id", "det_idx", "x1",
        F.when(F.col("variant") == 5, F.lit(float("nan")))
        .when(F.col("variant") == 6, F.lit(float("inf"))).otherwise(F.col("y1")).alias("y1"),
        F.when(F.col("variant") == 7, F.col("x1") - 1)
        .when(F.col("variant") == 8, F.col("x1")).otherwise(F.col("x2")).alias("x2"),
        "y2",
    )
    return odd.select("image_id", "det_idx", g.invalid_reason(g.box()).alias("reason"))


@boxes.add(
    "box_clamp",
    """
    WITH c AS (
        SELECT image_id, det_idx, greatest(0, least(320, x1)) AS x1, greatest(0, least(240, y1)) AS y1,
               greatest(0, least(320, x2)) AS x2, greatest(0, least(240, y2)) AS y2
        FROM detections)
    SELECT *, x2 <= x1 OR y2 <= y1 AS collapsed FROM c""",
    ("detections",),
)
def box_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = g.clamp(g.box(), F.lit(320.0), F.lit(240.0))
    return _detections(spark, sf_dir).select(
        "image_id", "det_idx", b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"),
        b.y2.alias("y2"), g.invalid_reason(b).isNotNull().alias("collapsed"),
    )


@boxes.add(
    "box_to_yolo",
    """
    WITH c AS (
        SELECT image_id, det_idx, greatest(0, least(600, x1)) AS x1, greatest(0, least(450, y1)) AS y1,
               greatest(0, least(600, x2)) AS x2, greatest(0, least(450, y2)) AS y2
        FROM detections)
    SELECT image_id, det_idx, (x1 + x2) / 2 / 600 AS cx, (y1 + y2) / 2 / 450 AS cy,
           (x2 - x1) / 600 AS w, (y2 - y1) / 450 AS h
    FROM c""",
    ("detections",),
)
def box_to_yolo(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = g.to_yolo(g.box(), F.lit(600.0), F.lit(450.0))
    return _detections(spark, sf_dir).select(
        "image_id", "det_idx",
        *[v.alias(n) for v, n in zip(values, ("cx", "cy", "w", "h"), strict=True)],
    )


@boxes.add(
    "unletterbox",
    """
    WITH sized AS (
        SELECT * REPLACE (x1 + 1 / 3.0::DOUBLE AS x1, y1 + 1 / 3.0::DOUBLE AS y1,
                          x2 + 1 / 3.0::DOUBLE AS x2, y2 + 1 / 3.0::DOUBLE AS y2),
               CAST(400 + image_id % 300 * 3 AS DOUBLE) AS width,
               CAST(301 + image_id % 233 * 3 AS DOUBLE) AS height FROM detections),
    fit AS (SELECT *, least(640.0::DOUBLE / width, 640.0::DOUBLE / height) AS scale FROM sized),
    padded AS (
        SELECT *, round_even((640.0::DOUBLE - round_even(width * scale, 0)) / 2 - 0.1::DOUBLE, 0) AS px,
               round_even((640.0::DOUBLE - round_even(height * scale, 0)) / 2 - 0.1::DOUBLE, 0) AS py
        FROM fit)
    SELECT image_id, det_idx,
           round(greatest(0, least(width, (x1 - px) / scale)), 2) AS x1,
           round(greatest(0, least(height, (y1 - py) / scale)), 2) AS y1,
           round(greatest(0, least(width, (x2 - px) / scale)), 2) AS x2,
           round(greatest(0, least(height, (y2 - py) / scale)), 2) AS y2
    FROM padded""",
    ("detections",),
)
def unletterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Thirds of a pixel and sizes that are no multiple of three keep every coordinate away from a
    # 2-digit rounding tie, where engines are free to differ.
    third = F.lit(1 / 3.0)
    sized = _detections(spark, sf_dir).withColumns({
        **{n: F.col(n) + third for n in ("x1", "y1", "x2", "y2")},
        "width": (400 + F.col("image_id") % 300 * 3).cast("double"),
        "height": (301 + F.col("image_id") % 233 * 3).cast("double"),
    })
    return detect.to_original_pixels(sized, 640, 640).select(
        "image_id", "det_idx", "x1", "y1", "x2", "y2"
    )


@boxes.add(
    "box_rescale",
    """
    WITH sized AS (
        SELECT *, CAST(200 + image_id % 3000 AS DOUBLE) AS width,
               CAST(150 + image_id % 2000 AS DOUBLE) AS height FROM detections),
    fit AS (SELECT *, least(1.0::DOUBLE, 1200.0::DOUBLE / greatest(width, height)) AS scale FROM sized),
    small AS (
        SELECT *, greatest(1, floor(width * scale + 0.5::DOUBLE)) AS canvas_width,
               greatest(1, floor(height * scale + 0.5::DOUBLE)) AS canvas_height FROM fit)
    SELECT image_id, det_idx, canvas_width, canvas_height,
           x1 * (width / canvas_width) AS x1, y1 * (height / canvas_height) AS y1,
           x2 * (width / canvas_width) AS x2, y2 * (height / canvas_height) AS y2
    FROM small""",
    ("detections",),
)
def box_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _detections(spark, sf_dir).select(
        "*", (200 + F.col("image_id") % 3000).cast("double").alias("width"),
        (150 + F.col("image_id") % 2000).cast("double").alias("height"),
    )
    canvas_width, canvas_height = g.fit_within(F.col("width"), F.col("height"), 1200.0)
    fitted = sized.select(
        "*", canvas_width.alias("canvas_width"), canvas_height.alias("canvas_height")
    )
    scale_x = F.col("width") / F.col("canvas_width")
    scale_y = F.col("height") / F.col("canvas_height")
    return fitted.select(
        "image_id", "det_idx", "canvas_width", "canvas_height",
        (F.col("x1") * scale_x).alias("x1"), (F.col("y1") * scale_y).alias("y1"),
        (F.col("x2") * scale_x).alias("x2"), (F.col("y2") * scale_y).alias("y2"),
    )


@boxes.add(
    "contain_rect",
    """
    WITH s AS (
        SELECT image_id, det_idx, x2 - x1 AS w, y2 - y1 AS h,
               least(640.0::DOUBLE / (x2 - x1), 480.0::DOUBLE / (y2 - y1)) AS scale FROM detections)
    SELECT image_id, det_idx, (640.0::DOUBLE - w * scale) / 2 AS rect_left,
           (480.0::DOUBLE - h * scale) / 2 AS rect_top,
           w * scale AS rect_width, h * scale AS rect_height
    FROM s""",
    ("detections",),
)
def contain_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = g.box()
    rect = g.contain_rect(F.lit(640.0), F.lit(480.0), b.x2 - b.x1, b.y2 - b.y1)
    names = ("rect_left", "rect_top", "rect_width", "rect_height")
    return _detections(spark, sf_dir).select(
        "image_id", "det_idx", *[v.alias(n) for v, n in zip(rect, names, strict=True)]
    )


@boxes.add(
    "class_canonical",
    r"""
    WITH raw AS (
        SELECT p_partkey, ' ' || upper(p_type) || '__' || replace(p_name, ' ', '   ') || ' ' AS name
        FROM part
        UNION ALL SELECT p_partkey + 1000000000, ' Dripping_ Water ' FROM part WHERE p_partkey % 7 = 0),
    folded AS (
        SELECT p_partkey, trim(regexp_replace(lower(replace(name, '_', ' ')), '\s+', ' ', 'g')) AS name
        FROM raw)
    SELECT p_partkey, CASE name WHEN 'dripping water' THEN 'water drop' ELSE name END AS class_name
    FROM folded""",
)
def class_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "inline(array_compact(array("
        "named_struct('k', 0L, 'name', concat(' ', upper(p_type), '__', "
        "replace(p_name, ' ', '   '), ' ')), "
        "IF(p_partkey % 7 = 0, named_struct('k', 1000000000L, 'name', ' Dripping_ Water '), NULL))))",
    )
    return raw.select(
        (F.col("p_partkey") + F.col("k")).alias("p_partkey"),
        c.canonical_class(F.col("name")).alias("class_name"),
    )


@boxes.add(
    "overlay_geometry",
    """
    WITH r AS (
        SELECT image_id, det_idx, variant, class_name, confidence,
               CASE WHEN variant = 3 THEN 'Water Damage' WHEN variant = 4 THEN 'mould'
                    ELSE class_name END AS shown,
               least(greatest(round_even(x1 / 2, 0), 0), 319) AS x1,
               least(greatest(round_even(y1 / 2, 0), 0), 239) AS y1,
               round_even(x2 / 2, 0) AS rx2, round_even(y2 / 2, 0) AS ry2 FROM detections)
    SELECT image_id, det_idx, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1,
           CAST(least(greatest(rx2, x1), 319) AS INTEGER) AS x2,
           CAST(least(greatest(ry2, y1), 239) AS INTEGER) AS y2,
           2 AS line_width,
           CASE lower(trim(shown)) WHEN 'pipe burst' THEN '#fb7185'
                WHEN 'water accumulation' THEN '#facc15' WHEN 'water drop' THEN '#38bdf8'
                WHEN 'water damage' THEN '#facc15' ELSE '#a78bfa' END AS colour,
           CASE lower(trim(shown)) WHEN 'water damage' THEN 'water leaking' ELSE shown END || ' '
               || CAST(CAST(round_even(confidence * 100, 0) AS INTEGER) AS VARCHAR) || '%' AS label,
           CAST(greatest(0, y1 - 17) AS INTEGER) AS label_y
    FROM r""",
    ("detections",),
)
def overlay_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = _detections(spark, sf_dir).select(
        "image_id", "det_idx", "confidence",
        F.when(F.col("variant") == 3, "Water Damage").when(F.col("variant") == 4, "mould")
        .otherwise(F.col("class_name")).alias("class_name"),
        *[(F.col(n) / 2).alias(n) for n in ("x1", "y1", "x2", "y2")],
    )
    return detect.overlay(half, 320, 240, label_height=17)


@boxes.add(
    "box_edit",
    """
    WITH e AS (
        SELECT image_id, det_idx, x1, y1, x2, y2,
               CASE variant % 9 WHEN 0 THEN 'move' WHEN 1 THEN 'n' WHEN 2 THEN 's' WHEN 3 THEN 'e'
                    WHEN 4 THEN 'w' WHEN 5 THEN 'ne' WHEN 6 THEN 'nw' WHEN 7 THEN 'se' ELSE 'sw' END AS mode,
               CAST(image_id % 301 AS DOUBLE) - 150 AS dx,
               CAST(image_id % 201 AS DOUBLE) - 100 AS dy FROM detections),
    s AS (
        SELECT *, CASE WHEN mode <> 'move' AND contains(mode, 'w')
                       THEN greatest(0, least(x2 - 4, x1 + dx)) ELSE x1 END AS nx1,
               CASE WHEN mode <> 'move' AND contains(mode, 'n')
                       THEN greatest(0, least(y2 - 4, y1 + dy)) ELSE y1 END AS ny1 FROM e)
    SELECT image_id, det_idx, mode,
           CASE WHEN mode = 'move' THEN greatest(0, least(640 - (x2 - x1), x1 + dx)) ELSE nx1 END AS x1,
           CASE WHEN mode = 'move' THEN greatest(0, least(480 - (y2 - y1), y1 + dy)) ELSE ny1 END AS y1,
           CASE WHEN mode = 'move' THEN greatest(0, least(640 - (x2 - x1), x1 + dx)) + (x2 - x1)
                WHEN contains(mode, 'e') THEN least(640, greatest(nx1 + 4, x2 + dx)) ELSE x2 END AS x2,
           CASE WHEN mode = 'move' THEN greatest(0, least(480 - (y2 - y1), y1 + dy)) + (y2 - y1)
                WHEN contains(mode, 's') THEN least(480, greatest(ny1 + 4, y2 + dy)) ELSE y2 END AS y2
    FROM s""",
    ("detections",),
)
def box_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = F.array(*[F.lit(m) for m in ("move", "n", "s", "e", "w", "ne", "nw", "se", "sw")])
    edits = _detections(spark, sf_dir).select(
        "*", F.get(modes, F.col("variant") % 9).alias("mode"),
        ((F.col("image_id") % 301).cast("double") - 150).alias("dx"),
        ((F.col("image_id") % 201).cast("double") - 100).alias("dy"),
    )
    b = g.edit_box(
        g.box(), F.col("mode"), F.col("dx"), F.col("dy"), F.lit(640.0), F.lit(480.0)
    )
    return edits.select(
        "image_id", "det_idx", "mode", b.x1.alias("x1"), b.y1.alias("y1"),
        b.x2.alias("x2"), b.y2.alias("y2"),
    )


@boxes.add(
    "class_threshold",
    """
    SELECT image_id, det_idx, class_name, confidence FROM detections
    WHERE confidence >= 0.25::DOUBLE AND confidence >= CASE class_name
        WHEN 'pipe burst' THEN 0.30::DOUBLE WHEN 'water accumulation' THEN 0.45::DOUBLE
        WHEN 'water drop' THEN 0.60::DOUBLE ELSE 0.25::DOUBLE END""",
    ("detections",),
)
def class_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = c.passes_threshold(F.col("class_name"), F.col("confidence"), 0.25, CLASS_THRESHOLDS)
    return _detections(spark, sf_dir).filter(keep).select(
        "image_id", "det_idx", "class_name", "confidence"
    )


@boxes.add(
    "role_select",
    """
    SELECT image_id, det_idx, 'water accumulation' AS class_name, confidence FROM detections
    WHERE variant % 4 IN (0, 1)""",
    ("detections",),
)
def role_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _detections(spark, sf_dir).withColumn(
        "class_name",
        F.when(F.col("variant") % 4 == 0, "Water_Damage ")
        .when(F.col("variant") % 4 == 1, "water  damage").otherwise(F.col("class_name")),
    )
    return c.specialist_only(named).select("image_id", "det_idx", "class_name", "confidence")


@boxes.add(
    "class_map_check",
    """
    WITH names AS (
        SELECT s_suppkey, role, idx, CASE WHEN s_suppkey % 9 = 4 AND idx = '1' THEN ''
                    WHEN s_suppkey % 9 = 5 AND idx = '2' THEN 'Dripping_Water'
                    WHEN s_suppkey % 9 = 6 AND idx = '0' THEN 'mould' ELSE name END AS name
        FROM supplier, (VALUES ('general', '0', 'pipe burst'), ('general', '1', 'water accumulation'),
                               ('general', '2', 'water drop'), ('specialist', '0', 'water damage'))
             AS m(role, idx, name)),
    maps AS (
        SELECT role || '#' || CAST(s_suppkey AS VARCHAR) AS map_id, role, s_suppkey,
               CASE WHEN s_suppkey % 9 = 7 AND idx = '2' THEN '3' WHEN s_suppkey % 9 = 8 AND idx = '1'
                    THEN 'one' WHEN s_suppkey % 9 = 3 AND idx = '2' THEN '1' ELSE idx END AS idx, name
        FROM names)
    SELECT map_id, count(*) AS n_classes,
           CASE WHEN bool_or(idx = 'one') THEN 'class indices must be integers'
                WHEN count(DISTINCT idx) <> count(*) THEN 'class indices must be unique'
                WHEN bool_or(name = '') THEN 'class names must be non-empty'
                WHEN bool_or(idx = '3') THEN 'class indices must be contiguous from zero'
                WHEN bool_or(name = 'mould') THEN 'classes differ from the role'
                ELSE 'ok' END AS verdict
    FROM maps GROUP BY map_id""",
)
def class_map_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(
        f"struct('{role}' AS role, '{i}' AS idx, '{name}' AS name)"
        for role, names in detect.EXPECTED_CLASSES.items()
        if role != "last"
        for i, name in enumerate(names)
    )
    base = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"inline(array({rows}))")
    kind, idx = F.col("s_suppkey") % 9, F.col("idx")
    maps = base.select(
        F.concat_ws("#", "role", F.col("s_suppkey").cast("string")).alias("map_id"),
        "role",
        F.when((kind == 7) & (idx == "2"), "3").when((kind == 8) & (idx == "1"), "one")
        .when((kind == 3) & (idx == "2"), "1").otherwise(idx).alias("idx"),
        F.when((kind == 4) & (idx == "1"), "").when((kind == 5) & (idx == "2"), "Dripping_Water")
        .when((kind == 6) & (idx == "0"), "mould").otherwise(F.col("name")).alias("name"),
    )
    return c.class_map_report(maps, detect.EXPECTED_CLASSES, key="map_id")


_GREEDY = """
    WITH RECURSIVE ranked AS (
        SELECT {group} AS grp, det_idx, class_name, image_id, confidence, x1, y1, x2, y2,
               row_number() OVER (PARTITION BY {group} ORDER BY confidence DESC, det_idx) AS rn
        FROM {source}),
    fold AS (
        SELECT grp, rn, det_idx, CAST(NULL AS BIGINT) AS suppressed_by,
               [{{'i': det_idx, 'c': confidence, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept
        FROM ranked WHERE rn = 1
        UNION ALL
        SELECT grp, rn, det_idx, hit,
               CASE WHEN hit IS NULL THEN list_append(kept,
                   {{'i': det_idx, 'c': confidence, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) ELSE kept END
        FROM (
            SELECT r.*, f.kept, list_filter(f.kept, lambda k: {rule})[1].i AS hit
            FROM fold AS f JOIN ranked AS r ON r.grp = f.grp AND r.rn = f.rn + 1) AS s)"""

_INTER = (
    "(greatest(0, least(k.x2, r.x2) - greatest(k.x1, r.x1)) "
    "* greatest(0, least(k.y2, r.y2) - greatest(k.y1, r.y1)))"
)
_AREA_K = "((k.x2 - k.x1) * (k.y2 - k.y1))"
_AREA_R = "((r.x2 - r.x1) * (r.y2 - r.y1))"
_IOU = f"({_INTER} / ({_AREA_K} + {_AREA_R} - {_INTER}))"
_SUPPRESS_RULE = (
    f"{_IOU} >= 0.4::DOUBLE OR (k.c > r.confidence AND "
    f"{_INTER} / least({_AREA_K}, {_AREA_R}) >= 0.95::DOUBLE)"
)
_CLASS_GROUP = "image_id * 3 + class_id"


def greedy_sql(source: str, group: str, rule: str) -> str:
    return _GREEDY.format(source=source, group=group, rule=rule)


@boxes.add(
    "suppress_contained",
    greedy_sql("detections", _CLASS_GROUP, _SUPPRESS_RULE)
    + """
    SELECT r.image_id, r.det_idx, r.class_name, r.confidence FROM fold AS f
    JOIN ranked AS r ON r.grp = f.grp AND r.rn = f.rn WHERE f.suppressed_by IS NULL""",
    ("detections",),
)
def suppress_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _detections(spark, sf_dir).drop("variant", "class_id")
    return greedy.suppress(rows).select("image_id", "det_idx", "class_name", "confidence")


@boxes.add(
    "box_overlap_join",
    greedy_sql("detections", _CLASS_GROUP, _SUPPRESS_RULE)
    + f"""
    SELECT r.image_id, r.class_name, r.det_idx, f.suppressed_by,
           round({_IOU}, 6) AS iou, round({_INTER} / least({_AREA_K}, {_AREA_R}), 6) AS containment
    FROM fold AS f JOIN ranked AS r ON r.grp = f.grp AND r.rn = f.rn
    JOIN ranked AS k ON k.grp = f.grp AND k.det_idx = f.suppressed_by""",
    ("detections",),
)
def box_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.suppression_pairs(_detections(spark, sf_dir).drop("variant", "class_id"))


@boxes.add(
    "nms",
    greedy_sql("detections", "image_id", f"{_IOU} > 0.4::DOUBLE")
    + """
    SELECT r.image_id, r.det_idx, r.class_name, r.confidence FROM fold AS f
    JOIN ranked AS r ON r.grp = f.grp AND r.rn = f.rn WHERE f.suppressed_by IS NULL""",
    ("detections",),
)
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _detections(spark, sf_dir).drop("variant", "class_id")
    return greedy.nms(rows, 0.4, class_agnostic=True).select(
        "image_id", "det_idx", "class_name", "confidence"
    )


@boxes.add(
    "topk_per_image",
    """
    SELECT image_id, det_idx, class_name, confidence, row_number
    FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, det_idx)
                 AS row_number FROM detections) AS r
    WHERE row_number <= 5""",
    ("detections",),
)
def topk_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.strongest_per_image(_detections(spark, sf_dir), 5).select(
        "image_id", "det_idx", "class_name", "confidence",
        F.col("row_number").cast("long").alias("row_number"),
    )


@boxes.add(
    "decode_outputs",
    """
    WITH RECURSIVE decoded AS (
        SELECT image_id, det_idx, CAST((class_id + shift) % 3 AS INTEGER) AS class_id,
               CASE (class_id + shift) % 3 WHEN 0 THEN 'pipe burst' WHEN 1 THEN 'water accumulation'
                    ELSE 'water drop' END AS class_name,
               best AS confidence, x1, y1, x2, y2
        FROM (SELECT *, greatest(confidence, (1 - confidence) * 0.9::DOUBLE) AS best,
                     CASE WHEN confidence = (1 - confidence) * 0.9::DOUBLE THEN
                               CASE WHEN class_id = 2 THEN 1 ELSE 0 END
                          WHEN confidence > (1 - confidence) * 0.9::DOUBLE THEN 0 ELSE 1 END AS shift
              FROM detections) AS s
        WHERE best >= 0.6::DOUBLE), """
    + greedy_sql("decoded", _CLASS_GROUP, f"{_IOU} > 0.4::DOUBLE").strip()[len("WITH RECURSIVE") :]
    + """
    SELECT image_id, det_idx, class_name, confidence, row_number FROM (
        SELECT r.image_id, r.det_idx, r.class_name, r.confidence,
               row_number() OVER (PARTITION BY r.image_id ORDER BY r.confidence DESC, r.det_idx) AS row_number
        FROM fold AS f JOIN ranked AS r ON r.grp = f.grp AND r.rn = f.rn
        WHERE f.suppressed_by IS NULL) AS s
    WHERE row_number <= 300""",
    ("detections",),
)
def decode_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.col("confidence")
    other, third = (1 - conf) * 0.9, conf * 0.5
    rotated = (
        F.when(F.col("class_id") == 0, F.array(conf, other, third))
        .when(F.col("class_id") == 1, F.array(third, conf, other))
        .otherwise(F.array(other, third, conf))
    )
    b = g.box()
    anchors = _detections(spark, sf_dir).select(
        "image_id", F.col("det_idx").alias("anchor_idx"),
        ((b.x1 + b.x2) / 2).alias("cx"), ((b.y1 + b.y2) / 2).alias("cy"),
        (b.x2 - b.x1).alias("w"), (b.y2 - b.y1).alias("h"), rotated.alias("scores"),
    )
    return detect.decode_anchors(anchors, 0.6).select(
        "image_id", "det_idx", "class_name", "confidence", "row_number"
    )


@boxes.add(
    "ensemble_fallback",
    """
    WITH general AS (SELECT * FROM detections WHERE variant % 2 = 0),
    has AS (SELECT DISTINCT image_id FROM general WHERE class_name = 'water accumulation')
    SELECT image_id, det_idx, 'general' AS role, class_name, confidence FROM general
    UNION ALL
    SELECT image_id, det_idx, 'specialist', 'water accumulation', confidence FROM detections
    WHERE variant % 2 = 1 AND image_id NOT IN (SELECT image_id FROM has)""",
    ("detections",),
)
def ensemble_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _detections(spark, sf_dir)
    general = rows.filter("variant % 2 = 0")
    specialist = rows.filter("variant % 2 = 1").withColumn("class_name", F.lit("Water_damage"))
    return detect.ensemble_fallback(general, specialist).select(
        "image_id", "det_idx", "role", "class_name", "confidence"
    )


@boxes.add(
    "point_in_box",
    """
    WITH clicks AS (SELECT o_orderkey // 4 AS image_id, o_orderkey AS click_id,
                           CAST((o_orderkey * 61) % 640 AS DOUBLE) AS px,
                           CAST((o_orderkey * 97) % 480 AS DOUBLE) AS py FROM orders)
    SELECT c.click_id, c.image_id, max(r.det_idx) AS det_idx FROM clicks AS c
    JOIN review_detections AS r ON r.image_id = c.image_id
     AND px >= x1 - 2 AND px <= x2 + 2 AND py >= y1 - 2 AND py <= y2 + 2
    WHERE NOT r.removed GROUP BY c.click_id, c.image_id""",
    ("review_detections",),
)
def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey div 4 AS image_id", "o_orderkey AS click_id",
        "CAST((o_orderkey * 61) % 640 AS DOUBLE) AS px",
        "CAST((o_orderkey * 97) % 480 AS DOUBLE) AS py",
    )
    shown = derived(spark, sf_dir, "review_detections").filter(~F.col("removed"))
    return detect.topmost_box(clicks, shown, tolerance=2.0)


@boxes.add(
    "detection_json_out",
    """
    SELECT image_id, det_idx, '{"class":"' || class_name || '","confidence":'
               || CAST(confidence + 1 AS VARCHAR) || ',"bbox":[' || CAST(x1 AS VARCHAR) || ','
               || CAST(y1 AS VARCHAR) || ',' || CAST(x2 AS VARCHAR) || ',' || CAST(y2 AS VARCHAR) || ']}' AS record
    FROM detections""",
    ("detections",),
)
def detection_json_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Shifted by one, so that no confidence is printed with an exponent.
    rows = _detections(spark, sf_dir).withColumn("confidence", F.col("confidence") + 1)
    return det_source.detection_records(rows)


INGEST_SQL = """
    WITH two AS (
        SELECT det_idx AS doc_id, variant, CAST(n AS BIGINT) AS det_idx,
               CASE WHEN variant = 3 AND n = 1 THEN '' ELSE class_name END AS class_name,
               CASE WHEN variant = 4 AND n = 0 THEN confidence + 1.5 ELSE confidence END AS confidence,
               x1 + n * 10 AS x1, y1, CASE WHEN variant = 5 THEN x1 - 5 ELSE x2 + n * 10 END AS x2,
               y2
        FROM detections, (VALUES (0), (1)) AS v(n))
    SELECT doc_id, CASE WHEN variant IN (1, 2) THEN NULL ELSE det_idx END AS det_idx,
           CASE WHEN variant NOT IN (1, 2) THEN class_name END AS class_name,
           CASE WHEN variant NOT IN (1, 2) THEN confidence END AS confidence,
           CASE WHEN variant NOT IN (1, 2) THEN x1 END AS x1, CASE WHEN variant NOT IN (1, 2) THEN x2 END AS x2,
           CASE WHEN variant IN (1, 2) THEN 'not an array of detections'
                WHEN class_name = '' THEN 'class name missing'
                WHEN confidence > 1 THEN 'confidence not in 0..1'
                WHEN variant = 6 THEN 'bounding box needs four numbers'
                WHEN x2 <= x1 THEN 'right/bottom must exceed left/top' END AS reject_reason
    FROM two WHERE variant NOT IN (1, 2) OR det_idx = 0"""


def detection_documents(rows: DataFrame) -> DataFrame:
    """Two detections per row as a JSON body, broken in the ways the ingest must catch."""

    def item(n: int) -> str:
        name = "IF(variant = 3, '', class_name)" if n == 1 else "class_name"
        conf = "IF(variant = 4, confidence + 1.5D, confidence)" if n == 0 else "confidence"
        corners = ", ".join(
            [f"x1 + {n * 10}", "y1", f"IF(variant = 5, x1 - 5, x2 + {n * 10})", "y2"]
        )
        bbox = f"IF(variant = 6, slice(array({corners}), 1, 3), array({corners}))"
        return f"named_struct('class', {name}, 'confidence', {conf}, 'bbox', {bbox})"

    return rows.selectExpr(
        "det_idx AS doc_id",
        f"CASE WHEN variant = 1 THEN to_json({item(0)}) WHEN variant = 2 THEN 'oops' "
        f"ELSE to_json(array({item(0)}, {item(1)})) END AS body",
    )


@boxes.add("detection_json_ingest", INGEST_SQL, ("detections",))
def detection_json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det_source.ingest_json(detection_documents(_detections(spark, sf_dir)))
    return rows.select(
        "doc_id", "det_idx", "class_name", "confidence", "x1", "x2", "reject_reason"
    )


@boxes.add(
    "decode_end_to_end",
    """
    SELECT image_id, det_idx, class_id, CASE class_id WHEN 0 THEN 'pipe burst' WHEN 1 THEN 'water accumulation'
           WHEN 2 THEN 'water drop' ELSE CAST(class_id AS VARCHAR) END AS class_name, confidence, x1, y1, x2, y2, row_number
    FROM (SELECT image_id, det_idx, CAST(class_id + CASE WHEN variant = 5 THEN 2 ELSE 0 END AS INTEGER) AS class_id, confidence, x1, y1, x2, y2,
                 row_number() OVER (PARTITION BY image_id ORDER BY det_idx) AS row_number
          FROM detections WHERE confidence >= 0.25::DOUBLE) AS r
    WHERE row_number <= 10""",
    ("detections",),
)
def decode_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model rows of six columns (corners, score, class): the first ten of each image in row order."""
    rows = _detections(spark, sf_dir).select(
        "image_id", F.col("det_idx").alias("anchor_idx"), "x1", "y1", "x2", "y2",
        F.col("confidence").alias("score"),
        (F.col("class_id") + F.when(F.col("variant") == 5, 2.0).otherwise(0.0)).alias("class_id"),
    )
    return detect.decode_end_to_end(rows, 0.25, max_per_image=10)
