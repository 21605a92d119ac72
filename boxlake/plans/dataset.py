"""Label corpora, media, audit, repair and export queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake import skew
from boxlake.functions import text as t
from boxlake.operators import audit, dedupe, export, quarantine
from boxlake.plans.fixtures import derived, images, table
from boxlake.plans.registry import Registry
from boxlake.schemas import CLASS_NAMES
from boxlake.sources import labels as label_source
from boxlake.sources import media

dataset = Registry()

_SPLIT = (
    "CASE WHEN image_id % 10 < 8 THEN 'train' WHEN image_id % 10 = 8 THEN 'valid' ELSE 'test' END"
)
_SIDE = "CASE WHEN image_id % 53 = 0 THEN CAST(200 AS DOUBLE) ELSE width END"
_CONTENT = (
    "CASE WHEN image_id % 4 = 0 THEN concat('g', CAST(image_id // 16 AS VARCHAR(20))) "
    "ELSE concat('u', CAST(image_id AS VARCHAR(20))) END"
)
_FACTS = (
    "CASE WHEN image_id % 41 = 7 THEN 6 WHEN image_id % 41 <> 8 THEN 1 END AS orientation, "
    "CASE WHEN image_id % 43 = 5 THEN 'MPO' ELSE 'JPEG' END AS format, "
    "CASE WHEN image_id % 53 = 11 THEN 'truncated file' END AS decode_error"
)
_PARSE = "CASE WHEN image_id % 47 = 9 THEN 'must contain five fields' END AS parse_error"
_AUDIT_CTE = f"""
    audit_images AS (
        SELECT image_id, {_SPLIT} AS split, concat('img-', CAST(image_id AS VARCHAR)) AS stem, filename,
               {_SIDE} AS width, height, sha256({_CONTENT}) AS digest, {_FACTS}
        FROM images WHERE image_id % 97 <> 0),
    audit_labels AS (
        SELECT image_id, {_SPLIT} AS split, concat('img-', CAST(image_id AS VARCHAR)) AS stem, {_PARSE} FROM images WHERE image_id % 89 <> 0),
    boxes AS (SELECT * FROM annotations WHERE image_id % 89 <> 0 AND image_id % 31 <> 0),
    checked AS (
        SELECT *, NOT (class_id BETWEEN 0 AND 2) AS class_fault, NOT (w > 0 AND h > 0) AS size_fault,
               NOT (cx - w / 2 >= -1e-9 AND cy - h / 2 >= -1e-9
                    AND cx + w / 2 <= 1 + 1e-9 AND cy + h / 2 <= 1 + 1e-9) AS edge_fault
        FROM boxes),
    valid_boxes AS (SELECT *, NOT (class_fault OR size_fault OR edge_fault) AS valid FROM checked)"""
_SCORED_CTE = _AUDIT_CTE + """,
    per_image AS (
        SELECT split, stem, count(*) FILTER (valid) AS valid_count, count(*) AS total_count,
               sum(CAST(w * h AS DECIMAL(28, 12))) AS total_area FROM valid_boxes GROUP BY split, stem),
    scored AS (
        SELECT i.*, CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END AS split_priority,
               coalesce(valid_count, 0) AS valid_count, coalesce(total_count, 0) AS total_count,
               coalesce(total_area, 0) AS total_area
        FROM audit_images AS i LEFT JOIN per_image USING (split, stem)),
    placed AS (
        SELECT *, count(*) OVER (PARTITION BY digest) AS copies,
               row_number() OVER (PARTITION BY digest ORDER BY split_priority DESC, valid_count DESC,
                   total_count DESC, total_area, filename DESC, split DESC, stem DESC) AS place
        FROM scored)"""


def _audit_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = _CONTENT.replace("//", " div ")
    return images(spark, sf_dir).filter("image_id % 97 <> 0").selectExpr(
        "image_id", f"{_SPLIT} AS split", "concat('img-', CAST(image_id AS STRING)) AS stem",
        "filename", f"{_SIDE} AS width", "height", f"sha2({content}, 256) AS digest",
        *_FACTS.split(", "),
    )


def _audit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).filter("image_id % 89 <> 0").selectExpr(
        "image_id", f"{_SPLIT} AS split", "concat('img-', CAST(image_id AS STRING)) AS stem", _PARSE,
    )


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "annotations")
    return rows.filter("image_id % 89 <> 0 AND image_id % 31 <> 0")


@dataset.add(
    "label_parse",
    """
    WITH p AS (
        SELECT l_orderkey // 4 AS image_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
               (l_partkey * 3 + l_suppkey * 5 + l_linenumber) % 24 AS variant FROM lineitem)
    SELECT concat('dataset/train/labels/img-', CAST(image_id AS VARCHAR), '.txt') AS path,
           (((l_orderkey % 4) * 8 + l_linenumber) * 1073741824 + l_partkey) * 16777216 + l_suppkey AS line_no,
           CASE WHEN variant <> 7 THEN CAST((l_partkey + l_linenumber) % 3 AS INTEGER) END AS class_id,
           CASE WHEN variant = 8 THEN NULL ELSE CAST(concat('0.', lpad(CAST((l_partkey * 37) % 10000 AS VARCHAR), 4, '0')) AS DOUBLE) END AS cx,
           CAST(concat('0.', lpad(CAST((l_suppkey * 53) % 10000 AS VARCHAR), 4, '0')) AS DOUBLE) AS cy,
           CAST(concat('0.', lpad(CAST((l_partkey * 7) % 10000 AS VARCHAR), 4, '0')) AS DOUBLE) AS w,
           CASE WHEN variant = 5 THEN NULL ELSE CAST(concat('0.', lpad(CAST((l_suppkey * 11) % 10000 AS VARCHAR), 4, '0')) AS DOUBLE) END AS h,
           CASE WHEN variant IN (5, 6) THEN 'must contain five fields'
                WHEN variant IN (7, 8) THEN 'contains a non-numeric value' END AS reject_reason
    FROM p WHERE variant <> 9""",
)
def label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    def number(expression: str) -> str:
        return f"concat('0.', lpad(CAST({expression} % 10000 AS STRING), 4, '0'))"

    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "(l_partkey * 3 + l_suppkey * 5 + l_linenumber) % 24 AS variant",
    ).selectExpr(
        "concat('dataset/train/labels/img-', CAST(l_orderkey div 4 AS STRING), '.txt') AS path",
        "(((l_orderkey % 4) * 8 + l_linenumber) * 1073741824 + l_partkey) * 16777216 + l_suppkey AS line_no",
        "CASE variant WHEN 9 THEN '   ' ELSE concat("
        "IF(variant = 10, '\\ufeff', ''), "
        "IF(variant = 7, 'x', CAST((l_partkey + l_linenumber) % 3 AS STRING)), ' ', "
        f"IF(variant = 8, 'wide', {number('(l_partkey * 37)')}), IF(variant = 11, '\\t  ', ' '), "
        f"{number('(l_suppkey * 53)')}, ' ', {number('(l_partkey * 7)')}, "
        f"IF(variant = 5, '', concat(' ', {number('(l_suppkey * 11)')})), "
        "IF(variant = 6, ' 1', IF(variant = 12, '  ', ''))) END AS value",
    )
    return label_source.parse_label_lines(lines)


_SUFFIX = "CASE image_id % 9 {} END".format(
    " ".join(
        f"WHEN {i} THEN '{s}'"
        for i, s in enumerate(("jpg", "PNG", "webp", "txt", "bmp", "avif", "gif", "jpeg"))
    )
    + " ELSE 'tiff'"
)


@dataset.add(
    "media_listing",
    f"""
    SELECT concat('dataset/', {_SPLIT}, '/images/img.', CAST(image_id AS VARCHAR), '.', {_SUFFIX}) AS path,
           {_SPLIT} AS split, concat('img.', CAST(image_id AS VARCHAR)) AS stem,
           lower({_SUFFIX}) AS suffix,
           concat('dataset/', {_SPLIT}, '/labels/img.', CAST(image_id AS VARCHAR), '.txt') AS label_path
    FROM images WHERE image_id % 9 NOT IN (3, 6, 8)""",
    ("images",),
)
def media_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = images(spark, sf_dir).selectExpr(
        f"concat('dataset/', {_SPLIT}, '/images/img.', CAST(image_id AS STRING), '.', {_SUFFIX}) AS path"
    )
    kept = media.images_only(listing).select("path", "suffix")
    return label_source.with_path_parts(kept).select(
        "path", "split", "stem", "suffix", "label_path"
    )


# Kind, format and orientation of the derived header files.
_PROBE_KINDS = (
    ("PNG", 1), ("JPEG", 1), ("JPEG", 6), ("MPO", 1), ("BMP", 1), (None, 1), ("WEBP", 1), ("WEBP", 1), ("WEBP", 3),
    ("AVIF", 1), ("AVIF", 8), ("AVIF", 7),
)


def _probe_cases(values: list[str]) -> str:
    return "CASE kind " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_PROBE_SQL = f"""
    WITH i AS (SELECT image_id, CASE WHEN image_id % 53 = 0 THEN 200 ELSE 640 END AS w,
                      CAST(300 + image_id % 200 AS INTEGER) AS h, image_id % {len(_PROBE_KINDS)} AS kind FROM images),
    k AS (SELECT *, {_probe_cases([f"'{f}'" if f else "NULL" for f, _ in _PROBE_KINDS])} AS format,
                 {_probe_cases([str(o) for _, o in _PROBE_KINDS])} AS orientation FROM i)
    SELECT CAST(image_id AS VARCHAR) AS path, format, CASE WHEN kind <> 5 THEN w END AS width,
           CASE WHEN kind <> 5 THEN h END AS height, orientation,
           concat_ws(',', CASE WHEN kind = 5 THEN 'cannot decode' END, CASE WHEN orientation <> 1 THEN 'exif orientation' END,
               CASE WHEN format = 'MPO' THEN 'mpo' END, CASE WHEN kind <> 5 AND w < 256 THEN 'low resolution' END) AS issues
    FROM k"""


@dataset.add("media_probe", _PROBE_SQL, ("images",))
def media_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of every format, put together from the sizes of the images."""

    def big(value: str, size: int) -> str:
        return f"lpad(hex({value}), {2 * size}, '0')"

    def little(value: str, size: int) -> str:
        digits = big(value, size)
        return "concat(" + ", ".join(f"substr({digits}, {2 * i - 1}, 2)" for i in range(size, 0, -1)) + ")"

    def joined(*parts: str) -> str:
        return f"concat({', '.join(p if '(' in p else repr(p) for p in parts)})"

    def tiff(orientation: int) -> str:
        return "4D4D002A00000008" + "0001" + f"01120003000000010{orientation:03X}0000" + "00000000"

    frame = joined("FFC0000B08", big("height", 2), big("width", 2), "01011100FFDA")
    exif = "FFE10022457869660000" + tiff(6)
    riff = lambda size: joined("52494646", little(f"{size}L", 4), "57454250")
    lossless = little("(width - 1) + (height - 1) * 16384L", 4)

    def avif(transforms: str, count: int, linked: str) -> str:
        """ftyp, then meta with pitm and iprp (ipco: ispe and transforms; ipma of item 1)."""
        ispe = joined("0000001469737065" + "00000000", big("width", 4), big("height", 4))
        ipco, ipma = 8 + 20 + len(transforms) // 2, 8 + 8 + 3 + count
        iprp = 8 + ipco + ipma
        return joined(
            "0000001C66747970617669660000000061766966" + "6D696631" + "6D696166",
            big(f"{12 + 14 + iprp}L", 4), "6D65746100000000", "0000000E7069746D000000000001",
            big(f"{iprp}L", 4), "69707270", big(f"{ipco}L", 4), "6970636F", ispe, transforms or "",
            big(f"{ipma}L", 4), "69706D610000000000000001" + f"0001{count:02X}{linked}",
        )

    irot, imir = "0000000969726F7401", "00000009696D697201"
    contents = [
        joined("89504E470D0A1A0A0000000D49484452", big("width", 4), big("height", 4)),
        joined("FFD8", frame), joined(f"FFD8{exif}", frame), joined("FFD8FFE200064D504600", frame),
        joined("424D" + "00" * 16, little("width", 4), little("height", 4)), "'00FF'",
        joined(riff(22), "56503820", little("10L", 4), "0000009D012A", little("width", 2), little("height", 2)),
        joined(riff(18), "5650384C", little("5L", 4), "2F", lossless, "00"),
        joined(riff(56), "56503858", little("10L", 4), "08000000", little("width - 1", 3), little("height - 1", 3),
               "45584946", little("26L", 4), tiff(3)),
        avif("", 1, "01"), avif(irot, 2, "0182"), avif(irot + imir, 3, "018283"),
    ]
    files = images(spark, sf_dir).selectExpr(
        "CAST(image_id AS STRING) AS path", f"image_id % {len(_PROBE_KINDS)} AS kind",
        "IF(image_id % 53 = 0, 200L, 640L) AS width", "300 + image_id % 200 AS height",
    ).selectExpr("path", f"unhex({_probe_cases(contents)}) AS content")
    return media.probe_headers(files)


@dataset.add(
    "media_routing",
    """
    WITH files AS (
        SELECT user_id AS upload_id, user_id % 4 = 0 AS folder,
               CASE WHEN user_id % 4 IN (1, 2) AND event_type <> 'purchase' THEN 'image/jpeg'
                    WHEN event_type = 'view' THEN 'image/jpeg' WHEN event_type = 'click' THEN 'image/png'
                    WHEN event_type = 'purchase' THEN 'video/mp4'
                    WHEN event_type = 'signup' THEN 'application/pdf' END AS mime
        FROM events
        UNION ALL
        SELECT event_id + 1000000000, false, 'video/webm' FROM events WHERE event_type = 'error'),
    n AS (
        SELECT upload_id, bool_or(folder) AS folder, count(*) AS n_files,
               count(*) FILTER (mime LIKE 'image/%') AS n_images,
               count(*) FILTER (mime LIKE 'video/%') AS n_videos
        FROM files GROUP BY upload_id)
    SELECT upload_id, n_files, n_images, n_videos,
           CASE WHEN folder THEN n_files - n_images ELSE 0 END AS skipped,
           CASE WHEN folder AND n_images = 0 THEN 'folder without images' WHEN folder THEN 'images'
                WHEN n_videos > 0 AND (n_files <> 1 OR n_videos <> 1) THEN 'a video must be alone'
                WHEN n_videos > 0 THEN 'video'
                WHEN n_images <> n_files THEN 'every file must be an image or video'
                ELSE 'images' END AS verdict
    FROM n""",
)
def media_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    uploads = events.selectExpr(
        "user_id AS upload_id", "user_id % 4 = 0 AS folder",
        "CASE WHEN user_id % 4 IN (1, 2) AND event_type <> 'purchase' THEN 'image/jpeg' "
        "WHEN event_type = 'view' THEN 'image/jpeg' WHEN event_type = 'click' THEN 'image/png' "
        "WHEN event_type = 'purchase' THEN 'video/mp4' "
        "WHEN event_type = 'signup' THEN 'application/pdf' END AS mime",
    )
    single = events.filter("event_type = 'error'").selectExpr(
        "event_id + 1000000000 AS upload_id", "false AS folder", "'video/webm' AS mime"
    )
    return media.route_uploads(uploads.unionByName(single))


@dataset.add(
    "media_admission",
    """
    WITH f AS (
        SELECT image_id, CASE WHEN image_id % 13 = 0 THEN 'text/plain' WHEN image_id % 17 = 0 THEN NULL
                    ELSE 'image/jpeg' END AS mime,
               (image_id * 7919) % 30000000 AS bytes,
               CASE WHEN image_id % 19 <> 0 THEN 3000 + image_id % 4000 END AS width,
               2000 + image_id % 5000 AS height FROM images)
    SELECT image_id, CASE WHEN mime IS NULL OR mime NOT LIKE 'image/%' THEN 'not an image'
                WHEN bytes > 20971520 THEN 'file too large' WHEN width IS NULL THEN 'not a valid image'
                WHEN width * height > 25000000 THEN 'too many pixels' END AS reject_reason
    FROM f""",
    ("images",),
)
def media_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = images(spark, sf_dir).selectExpr(
        "image_id",
        "CASE WHEN image_id % 13 = 0 THEN 'text/plain' WHEN image_id % 17 = 0 THEN NULL "
        "ELSE 'image/jpeg' END AS mime",
        "(image_id * 7919) % 30000000 AS bytes",
        "IF(image_id % 19 <> 0, 3000 + image_id % 4000, NULL) AS width",
        "2000 + image_id % 5000 AS height",
    )
    reason = media.admission_reason(*[F.col(n) for n in ("mime", "bytes", "width", "height")])
    return files.select("image_id", reason.alias("reject_reason"))


@dataset.add(
    "yolo_export",
    """
    WITH sized AS (
        SELECT image_id, det_idx, class_id, greatest(0, least(600, x1)) AS x1, greatest(0, least(450, y1)) AS y1,
               greatest(0, least(600, x2)) AS x2, greatest(0, least(450, y2)) AS y2
        FROM review_detections WHERE NOT removed),
    lines AS (
        SELECT image_id, det_idx, concat_ws(' ', CAST(class_id AS VARCHAR),
               printf('%.6f', round((x1 + x2) / 2 / 600, 6)), printf('%.6f', round((y1 + y2) / 2 / 450, 6)),
               printf('%.6f', round((x2 - x1) / 600, 6)), printf('%.6f', round((y2 - y1) / 450, 6))) AS line
        FROM sized WHERE x2 > x1 AND y2 > y1)
    SELECT image_id, det_idx, line
    FROM images LEFT JOIN lines USING (image_id)""",
    ("images", "review_detections"),
)
def yolo_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = images(spark, sf_dir).withColumns({"width": F.lit(600.0), "height": F.lit(450.0)})
    rows = derived(spark, sf_dir, "review_detections").filter(~F.col("removed"))
    return export.yolo_label_lines(
        spine, rows.select("image_id", "det_idx", "class_name", "x1", "y1", "x2", "y2")
    )


@dataset.add(
    "yolo_format",
    r"""
    SELECT image_id, line_no, concat_ws(' ', CAST(class_id AS VARCHAR),
        regexp_replace(printf('%.10f', round(cx, 10)), '\.?0+$', ''),
        regexp_replace(printf('%.10f', round(cy, 10)), '\.?0+$', ''),
        regexp_replace(printf('%.10f', round(w, 10)), '\.?0+$', ''),
        regexp_replace(printf('%.10f', round(h, 10)), '\.?0+$', '')) AS line
    FROM annotations""",
    ("annotations",),
)
def yolo_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = [F.col(n) for n in ("cx", "cy", "w", "h")]
    return derived(spark, sf_dir, "annotations").select(
        "image_id", "line_no", export.audit_label_line(F.col("class_id"), *values).alias("line")
    )


@dataset.add(
    "safe_filename",
    r"""
    WITH n AS (SELECT p_partkey + 1 AS i, CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 11 = 1 THEN p_name
                 ELSE p_name || ' (' || p_brand || ').' || CASE p_partkey % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'tar.png' ELSE 'JPEG' END END AS name
               FROM part),
    s AS (SELECT i, CASE WHEN length(CAST(i AS VARCHAR)) < 5 THEN lpad(CAST(i AS VARCHAR), 5, '0') ELSE CAST(i AS VARCHAR) END
                 || '-' || CASE WHEN name = '' THEN 'image-' || CAST(i AS VARCHAR) || '.jpg'
                           ELSE regexp_replace(name, '[^a-zA-Z0-9._-]+', '-', 'g') END AS filename FROM n)
    SELECT i, filename, CASE WHEN contains(filename, '.') THEN regexp_replace(filename, '\.[^.]*$', '') ELSE filename END
           || '.txt' AS label_filename FROM s""",
)
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").selectExpr(
        "p_partkey + 1 AS i",
        "CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 11 = 1 THEN p_name "
        "ELSE concat(p_name, ' (', p_brand, ').', "
        "CASE p_partkey % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'tar.png' ELSE 'JPEG' END) END AS name",
    )
    named = names.select("i", t.safe_filename(F.col("name"), F.col("i")).alias("filename"))
    return named.withColumn("label_filename", t.label_filename(F.col("filename")))


@dataset.add(
    "export_guard",
    """
    WITH i AS (SELECT image_id // 500 AS dataset_id, count(*) AS n_images, CAST(sum(byte_size) AS BIGINT) AS total_bytes
               FROM images GROUP BY 1),
    u AS (SELECT image_id // 500 AS dataset_id, count(DISTINCT name) AS unsupported, string_agg(DISTINCT name, ', ' ORDER BY name) AS names
          FROM (SELECT image_id, CASE WHEN variant = 23 AND image_id % 90 = 0 THEN 'mould ' || CAST(class_id AS VARCHAR) ELSE class_name END AS name
                FROM detections) AS d
          WHERE name LIKE 'mould%' GROUP BY 1)
    SELECT dataset_id, n_images, total_bytes, coalesce(unsupported, 0) AS unsupported, coalesce(names, '') AS unsupported_classes,
           CASE WHEN n_images > 10000 THEN 'too many images' WHEN total_bytes > 750000000 THEN 'too many bytes'
                WHEN coalesce(unsupported, 0) > 0 THEN 'unsupported classes' ELSE 'ok' END AS verdict
    FROM i LEFT JOIN u USING (dataset_id)""",
    ("images", "detections"),
)
def export_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.expr("image_id div 500")
    boxes = derived(spark, sf_dir, "detections").select(
        owner.alias("dataset_id"),
        F.when(
            (F.col("variant") == 23) & (F.col("image_id") % 90 == 0),
            F.concat(F.lit("mould "), F.col("class_id").cast("string")),
        ).otherwise(F.col("class_name")).alias("class_name"),
    )
    checked = export.export_guard(
        images(spark, sf_dir).withColumn("dataset_id", owner), boxes, max_bytes=750_000_000
    )
    return checked.withColumn("unsupported_classes", F.array_join("unsupported_classes", ", "))


@dataset.add(
    "descriptor_check",
    """
    WITH d AS (SELECT image_id // 100 AS dataset_id, count(*) AS n FROM images GROUP BY 1),
    r AS (SELECT * FROM (VALUES ('path: .'), ('train: images/train'), ('val: images/valid'), ('names:'),
            ('  0: "pipe burst"'), ('  1: "water accumulation"'), ('  2: "water drop"')) AS v(line))
    SELECT dataset_id, line FROM d, r
    WHERE (dataset_id % 4 = 1 AND line = 'names:') OR (dataset_id % 4 = 2 AND line = '  2: "water drop"')
       OR (dataset_id % 4 = 3 AND line = 'val: images/valid') OR (n < 2 AND line = 'val: images/valid')""",
    ("images",),
)
def descriptor_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = images(spark, sf_dir).groupBy(F.expr("image_id div 100").alias("dataset_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    body = export.descriptor_text(F.col("n"))
    kind = F.col("dataset_id") % 4
    damaged = (
        F.when(kind == 1, F.replace(body, F.lit("names:"), F.lit("names")))
        .when(kind == 2, F.replace(body, F.lit("water drop"), F.lit("drop")))
        .when(kind == 3, F.replace(body, F.lit("images/valid"), F.lit("../valid/images")))
        .otherwise(body)
    )
    required = (
        "path: .", "train: images/train", "val: images/valid", "names:",
        *[f'  {i}: "{name}"' for i, name in enumerate(CLASS_NAMES)],
    )
    return audit.missing_lines(sizes.select("dataset_id", damaged.alias("body")), required)


@dataset.add(
    "annotation_valid",
    f"""
    WITH {_AUDIT_CTE.strip()}
    SELECT image_id, line_no, class_fault, size_fault, edge_fault, valid FROM valid_boxes""",
    ("images", "annotations"),
)
def annotation_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.with_validity(_annotations(spark, sf_dir)).select(
        "image_id", "line_no", "class_fault", "size_fault", "edge_fault", "valid"
    )


_CLAMPED_CTE = _AUDIT_CTE.strip() + """,
    edges AS (
        SELECT *, greatest(0, cx - w / 2) AS l, greatest(0, cy - h / 2) AS t, least(1, cx + w / 2) AS r,
               least(1, cy + h / 2) AS b FROM valid_boxes),
    clamped AS (
        SELECT *, CASE WHEN valid THEN cx ELSE (l + r) / 2 END AS new_cx,
               CASE WHEN valid THEN cy ELSE (t + b) / 2 END AS new_cy,
               CASE WHEN valid THEN w ELSE r - l END AS new_w,
               CASE WHEN valid THEN h ELSE b - t END AS new_h FROM edges),
    repaired AS (
        SELECT *, new_cx <> cx OR new_cy <> cy OR new_w <> w OR new_h <> h AS changed FROM clamped)"""


@dataset.add(
    "annotation_clamp",
    f"""
    WITH {_CLAMPED_CTE}
    SELECT image_id, line_no, new_cx, new_cy, new_w, new_h, changed FROM repaired""",
    ("images", "annotations"),
)
def annotation_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.clamp_annotations(_annotations(spark, sf_dir)).select(
        "image_id", "line_no", "new_cx", "new_cy", "new_w", "new_h", "changed"
    )


@dataset.add(
    "content_digest",
    "SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) AS bytes FROM documents",
)
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", dedupe.content_digest(F.col("text")).alias("digest"),
        F.octet_length("text").cast("long").alias("bytes"),
    )


@dataset.add(
    "pairing_audit",
    f"""
    WITH {_AUDIT_CTE.strip()}
    SELECT coalesce(i.split, l.split) AS split, coalesce(i.stem, l.stem) AS stem,
           i.stem IS NOT NULL AS has_image, l.stem IS NOT NULL AS has_label
    FROM audit_images AS i FULL JOIN audit_labels AS l ON i.split = l.split AND i.stem = l.stem
    WHERE i.stem IS NULL OR l.stem IS NULL""",
    ("images", "annotations"),
)
def pairing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = audit.pair_images_and_labels(
        _audit_images(spark, sf_dir), _audit_labels(spark, sf_dir)
    )
    return pairs.filter(~(F.col("has_image") & F.col("has_label")))


@dataset.add(
    "stem_except",
    f"""
    WITH {_AUDIT_CTE.strip()}
    SELECT 'label' AS missing, split, stem FROM
        (SELECT split, stem FROM audit_images EXCEPT SELECT split, stem FROM audit_labels) AS a
    UNION ALL SELECT 'image', split, stem FROM
        (SELECT split, stem FROM audit_labels EXCEPT SELECT split, stem FROM audit_images) AS b""",
    ("images", "annotations"),
)
def stem_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _audit_images(spark, sf_dir).select("split", "stem")
    right = _audit_labels(spark, sf_dir).select("split", "stem")
    no_label = left.subtract(right).select(F.lit("label").alias("missing"), "split", "stem")
    no_image = right.subtract(left).select(F.lit("image").alias("missing"), "split", "stem")
    return no_label.unionByName(no_image)


@dataset.add(
    "split_counts",
    f"""
    WITH {_AUDIT_CTE.strip()}
    SELECT s.split, count(DISTINCT i.image_id) AS images, count(b.line_no) AS annotations,
           count(DISTINCT i.image_id) FILTER (l.stem IS NOT NULL AND b.line_no IS NULL) AS null_images,
           count(*) FILTER (b.class_id = 0) AS n_pipe_burst,
           count(*) FILTER (b.class_id = 1) AS n_water_accumulation,
           count(*) FILTER (b.class_id = 2) AS n_water_drop
    FROM (VALUES ('train'), ('valid'), ('test')) AS s(split) LEFT JOIN audit_images AS i ON i.split = s.split
    LEFT JOIN audit_labels AS l ON l.image_id = i.image_id
    LEFT JOIN boxes AS b ON b.image_id = i.image_id GROUP BY s.split""",
    ("images", "annotations"),
)
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.split_counts(
        _audit_images(spark, sf_dir), _audit_labels(spark, sf_dir), _annotations(spark, sf_dir)
    )


_FOUND_CTE = _AUDIT_CTE + """,
    sound AS (SELECT * FROM audit_images WHERE decode_error IS NULL),
    unparsed AS (SELECT * FROM audit_labels WHERE parse_error IS NOT NULL),
    found AS (
        SELECT 'error' AS severity, 'image has no label' AS rule, split, stem AS subject FROM audit_images
        WHERE image_id NOT IN (SELECT image_id FROM audit_labels)
        UNION ALL SELECT 'error', 'label has no image', split, stem FROM audit_labels
        WHERE image_id NOT IN (SELECT image_id FROM audit_images)
        UNION ALL SELECT 'error', 'invalid annotation', split, stem FROM valid_boxes
        WHERE NOT valid AND image_id IN (SELECT image_id FROM sound) AND image_id NOT IN (SELECT image_id FROM unparsed)
        UNION ALL SELECT 'error', 'exact duplicates remain', min(split), digest FROM sound
        GROUP BY digest HAVING count(*) > 1
        UNION ALL SELECT 'error', 'image cannot be decoded', split, stem FROM audit_images WHERE decode_error IS NOT NULL
        UNION ALL SELECT 'error', 'EXIF orientation remains', split, stem FROM sound WHERE coalesce(orientation, 1) <> 1
        UNION ALL SELECT 'error', 'image is MPO', split, stem FROM sound WHERE format = 'MPO'
        UNION ALL SELECT 'error', 'label cannot be parsed', split, stem FROM unparsed WHERE image_id IN (SELECT image_id FROM sound)
        UNION ALL SELECT 'error', 'descriptor does not match', NULL, CAST(r_regionkey AS VARCHAR) FROM region WHERE r_regionkey % 2 = 1
        UNION ALL SELECT 'warning', 'low resolution', split, stem FROM sound WHERE least(width, height) < 256)"""


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One descriptor per region; every other one lacks its last line.
    required = ("path: .", "nc: 3")
    bodies = table(spark, sf_dir, "region").selectExpr(
        "r_regionkey AS dataset_id", "IF(r_regionkey % 2 = 1, 'path: .', 'path: .\\nnc: 3') AS body"
    )
    return audit.violations(
        _audit_images(spark, sf_dir), _audit_labels(spark, sf_dir), _annotations(spark, sf_dir),
        audit.missing_lines(bodies, required),
    )


@dataset.add(
    "audit_report",
    f"""
    WITH {_FOUND_CTE.strip()}
    SELECT severity, rule, split, count(*) AS findings, min(subject) AS first_subject
    FROM found GROUP BY severity, rule, split""",
    ("images", "annotations"),
)
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_report(_violations(spark, sf_dir))


@dataset.add(
    "audit_verdict",
    f"""
    WITH {_FOUND_CTE.strip()}
    SELECT count(*) FILTER (severity = 'error') = 0 AS ok, count(*) FILTER (severity = 'error') AS errors,
           count(*) FILTER (severity = 'warning') AS warnings FROM found""",
    ("images", "annotations"),
)
def audit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_verdict(_violations(spark, sf_dir))


@dataset.add(
    "exact_dup_groups",
    """
    SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_name
    FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select(
        dedupe.content_digest(F.col("text")).alias("digest"), "doc_id"
    )
    return audit.exact_duplicate_groups(hashed, "digest", "doc_id")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.keeper_scores(_audit_images(spark, sf_dir), _annotations(spark, sf_dir))


@dataset.add(
    "dup_keeper",
    f"""
    WITH {_SCORED_CTE.strip()}
    SELECT digest, copies, split AS keeper_split, stem AS keeper_stem, filename AS keeper,
           valid_count, total_count
    FROM placed WHERE copies > 1 AND place = 1""",
    ("images", "annotations"),
)
def dup_keeper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_keepers(_scored(spark, sf_dir))


@dataset.add(
    "quarantine_rows",
    f"""
    WITH {_CLAMPED_CTE}, {_SCORED_CTE[len(_AUDIT_CTE) + 1:].strip()},
    keepers AS (SELECT digest, filename AS keeper FROM placed WHERE place = 1)
    SELECT 'exact-duplicates' AS category, split, stem, CAST(NULL AS BIGINT) AS line_no, keeper AS detail
    FROM placed JOIN keepers USING (digest) WHERE copies > 1 AND place > 1
    UNION ALL
    SELECT 'annotation-originals', split, stem, line_no,
           CASE WHEN class_id < 3 THEN 'clamped' ELSE 'clamped, class out of range' END
    FROM repaired WHERE changed""",
    ("images", "annotations"),
)
def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.quarantine_rows(_scored(spark, sf_dir), _annotations(spark, sf_dir))


_LINE_SQL = "concat_ws(' ', CAST(class_id AS VARCHAR), " + ", ".join(
    rf"regexp_replace(printf('%.10f', round({{p}}{n}, 10)), '\.?0+$', '')" for n in ("cx", "cy", "w", "h")
) + ")"


@dataset.add(
    "quarantine_changes",
    f"""
    WITH {_CLAMPED_CTE}, {_SCORED_CTE[len(_AUDIT_CTE) + 1:].strip()},
    gone AS (SELECT split, stem, filename FROM placed WHERE copies > 1 AND place > 1),
    files AS (
        SELECT split, stem, string_agg({_LINE_SQL.format(p="")}, chr(10) ORDER BY line_no) || chr(10) AS before,
               string_agg({_LINE_SQL.format(p="new_")}, chr(10) ORDER BY line_no) || chr(10) AS after, bool_or(changed) AS changed
        FROM repaired GROUP BY split, stem)
    SELECT 1 AS phase, 'exact-duplicates' AS category, 'move' AS op, split || '/images/' || filename AS path,
           'exact-duplicates/' || split || '/images/' || filename AS target, NULL AS before, NULL AS after FROM gone
    UNION ALL
    SELECT 1, 'exact-duplicates', 'move', split || '/labels/' || stem || '.txt', 'exact-duplicates/' || split || '/labels/' || stem || '.txt', NULL, NULL
    FROM gone JOIN (SELECT split, stem FROM audit_labels) USING (split, stem)
    UNION ALL
    SELECT 2, 'annotation-originals', 'rewrite', split || '/labels/' || stem || '.txt', 'annotation-originals/' || split || '/labels/' || stem || '.txt', before, after
    FROM files WHERE changed AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.split = files.split AND gone.stem = files.stem)""",
    ("images", "annotations"),
)
def quarantine_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of a repair: moves with their other end, rewrites with the texts before and after."""
    boxes = _annotations(spark, sf_dir)
    keys = ["split", "stem"]
    pictures = _audit_images(spark, sf_dir).withColumn("path", F.concat("split", F.lit("/images/"), "filename"))
    line = export.audit_label_line(F.col("class_id"), *[F.col(n) for n in ("cx", "cy", "w", "h")])
    texts = quarantine.label_text(boxes, keys, line)
    files = _audit_labels(spark, sf_dir).join(texts, keys, "left").select(
        *keys, F.concat("split", F.lit("/labels/"), "stem", F.lit(".txt")).alias("path"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"),
    )
    log = quarantine.changes(pictures, files, boxes)
    return log.withColumns({n: F.decode(n, "UTF-8") for n in ("before", "after")})


@dataset.add(
    "manifest_reconcile",
    """
    WITH m AS (
        SELECT p_partkey, concat('m', CAST(p_partkey AS VARCHAR)) AS file, p_size * 10 AS size_bytes,
               CASE WHEN p_partkey % 13 = 1 THEN 'oops' ELSE sha256(p_name || CAST(p_partkey AS VARCHAR)) END AS sha256,
               CASE WHEN p_partkey % 2 = 1 THEN concat('m', CAST(p_partkey - 1 AS VARCHAR)) END AS pair_file
        FROM part),
    l AS (
        SELECT concat('m', CAST(p_partkey AS VARCHAR)) AS file,
               p_size * 10 + CASE WHEN p_partkey % 17 = 2 THEN 1 ELSE 0 END AS actual_size,
               sha256(p_name || CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 19 = 3 THEN '!' ELSE '' END) AS actual_sha256
        FROM part WHERE p_partkey % 23 <> 4),
    e AS (
        SELECT m.*, CASE WHEN m.pair_file IS NOT NULL THEN
                    sha256(q.p_name || CAST(q.p_partkey AS VARCHAR) || CASE WHEN q.p_partkey % 29 = 6 THEN '?' ELSE '' END) END AS exported_from
        FROM m LEFT JOIN part AS q ON q.p_partkey = m.p_partkey - 1)
    SELECT e.file, CASE WHEN e.sha256 = 'oops' THEN 'invalid digest in manifest'
             WHEN l.actual_size IS NULL THEN 'file is missing' WHEN size_bytes <> l.actual_size THEN 'size differs'
             WHEN e.sha256 <> l.actual_sha256 THEN 'digest differs'
             WHEN exported_from IS NOT NULL AND (p.actual_sha256 IS NULL OR exported_from <> p.actual_sha256)
             THEN 'not paired with its source' ELSE 'ok' END AS verdict
    FROM e LEFT JOIN l ON l.file = e.file LEFT JOIN l AS p ON p.file = e.pair_file""",
)
def manifest_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    own = "concat(p_name, CAST(p_partkey AS STRING))"
    manifest = part.selectExpr(
        "p_partkey", "concat('m', CAST(p_partkey AS STRING)) AS file", "p_size * 10 AS size_bytes",
        f"IF(p_partkey % 13 = 1, 'oops', sha2({own}, 256)) AS sha256",
        "IF(p_partkey % 2 = 1, concat('m', CAST(p_partkey - 1 AS STRING)), NULL) AS pair_file",
    )
    source = part.filter("p_partkey % 2 = 0").selectExpr(
        "p_partkey + 1 AS p_partkey",
        f"sha2(concat({own}, IF(p_partkey % 29 = 6, '?', '')), 256) AS exported_from",
    )
    listing = part.filter("p_partkey % 23 <> 4").selectExpr(
        "concat('m', CAST(p_partkey AS STRING)) AS file",
        "p_size * 10 + IF(p_partkey % 17 = 2, 1, 0) AS actual_size",
        f"sha2(concat({own}, IF(p_partkey % 19 = 3, '!', '')), 256) AS actual_sha256",
    )
    return audit.reconcile_manifest(
        manifest.join(source.hint("merge"), "p_partkey", "left"), listing
    )


@dataset.add(
    "split_assign",
    """
    WITH n AS (
        SELECT image_id, image_id // 6 AS dataset_id,
               row_number() OVER (PARTITION BY image_id // 6 ORDER BY original_index) AS image_index,
               count(*) OVER (PARTITION BY image_id // 6) AS dataset_size FROM images)
    SELECT image_id, dataset_id, image_index, dataset_size,
           CASE WHEN dataset_size >= 5 THEN CASE WHEN image_index % 5 = 0 THEN 'valid' ELSE 'train' END
                WHEN dataset_size >= 2 AND image_index = dataset_size THEN 'valid' ELSE 'train' END AS split
    FROM n""",
    ("images",),
)
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images(spark, sf_dir).selectExpr(
        "image_id", "original_index", "image_id div 6 AS dataset_id"
    )
    return export.assign_splits(rows).select(
        "image_id", "dataset_id", "image_index", "dataset_size", "split"
    )


@dataset.add(
    "page_layout",
    f"""
    WITH n AS (SELECT image_id, row_number() OVER (ORDER BY {_SPLIT}, filename, image_id) - 1 AS p FROM images)
    SELECT image_id, p // 20 + 1 AS sheet, p % 20 // 5 AS grid_row, p % 5 AS grid_column FROM n""",
    ("images",),
)
def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = images(spark, sf_dir).selectExpr("image_id", f"{_SPLIT} AS folder", "filename")
    order = [F.col("folder").asc(), F.col("filename").asc(), F.col("image_id").asc()]
    placed = skew.global_index(named, order, "place").withColumn("p", F.col("place") - 1)
    return placed.selectExpr(
        "image_id", "p div 20 + 1 AS sheet", "p % 20 div 5 AS grid_row", "p % 5 AS grid_column"
    )


@dataset.add(
    "natural_order",
    r"""
    WITH k AS (
        SELECT image_id, name, regexp_matches(name, '^[0-9]') AS number_first,
               list_aggregate(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda r:
                   CASE WHEN regexp_matches(r, '^[0-9]') THEN
                       lpad(CAST(length(CASE WHEN ltrim(r, '0') = '' THEN '0' ELSE ltrim(r, '0') END) AS VARCHAR), 4, '0')
                       || CASE WHEN ltrim(r, '0') = '' THEN '0' ELSE ltrim(r, '0') END ELSE r END), 'string_agg', '') AS key
        FROM (SELECT image_id, CASE WHEN image_id % 4 = 1 THEN 'Img-0' || filename ELSE filename END AS name FROM images) AS i)
    SELECT image_id, name, row_number() OVER (ORDER BY number_first DESC, key, image_id) AS position FROM k""",
    ("images",),
)
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = images(spark, sf_dir).selectExpr(
        "image_id", "IF(image_id % 4 = 1, concat('Img-0', filename), filename) AS name"
    )
    name = F.col("name")
    keyed = named.select("*", t.starts_with_number(name).alias("_n"), t.natural_key(name).alias("_k"))
    order = [F.col("_n").desc(), F.col("_k").asc(), F.col("image_id").asc()]
    return skew.global_index(keyed, order, "position").select("image_id", "name", "position")
