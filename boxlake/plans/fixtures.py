"""Relations derived from the given tables, as row-wise projections.

Each relation is stated once as SQL expressions whose integer arithmetic means the same in Spark
and in DuckDB. None of them needs a shuffle or a window, so their cost is one scan and a hot
source key stays spread over the scan tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns read from each table; passing the schema avoids a footer-inference job per table.
TABLE_SCHEMAS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "region": "r_regionkey INT, r_name STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
}

_X1 = "(l_partkey * 37) % 400"
_Y1 = "(l_suppkey * 53 + l_linenumber * 91) % 300"
_VARIANT = "((l_partkey * 3 + l_suppkey * 5 + l_linenumber) % 24)"
_IMAGE = "(l_orderkey // 4)"
_CLASS_ID = "((l_partkey + l_linenumber) % 3)"
_CLASS_NAME = (
    f"CASE {_CLASS_ID} WHEN 0 THEN 'pipe burst' WHEN 1 THEN 'water accumulation' "
    "ELSE 'water drop' END"
)

_DETECTION = {
    "image_id": _IMAGE,
    # Order-preserving packing of (order in image, line, part, supplier): the list position.
    "det_idx": "(((l_orderkey % 4) * 8 + l_linenumber) * 1073741824 + l_partkey) * 16777216"
    " + l_suppkey",
    "class_id": f"CAST({_CLASS_ID} AS INT)",
    "class_name": _CLASS_NAME,
    "confidence": "CAST((l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7) % 10001 AS DOUBLE)"
    " / CAST(10000 AS DOUBLE)",
    "x1": f"CAST({_X1} AS DOUBLE)",
    "y1": f"CAST({_Y1} AS DOUBLE)",
    "x2": f"CAST({_X1} + 16 + (l_partkey * 7 + l_linenumber * 13) % 224 AS DOUBLE)",
    "y2": f"CAST({_Y1} + 16 + (l_suppkey * 11 + l_partkey) % 160 AS DOUBLE)",
    "variant": f"CAST({_VARIANT} AS INT)",
}

_REMOVED = f"({_IMAGE} + {_VARIANT}) % 6 = 0"

_FRAME = "ts_ms"
_EVENT_CLASS = "(event_id % 3)"
_OBS_X1 = f"{_FRAME} // 7200000 + {_EVENT_CLASS} * 150 + (event_id % 5) * 4 + lane * 20"
_OBS_Y1 = f"50 + {_EVENT_CLASS} * 100 + (event_id % 7) * 2"

# name -> (table, filter or None, {column: expression})
RELATIONS: dict[str, tuple[str, str | None, dict[str, str]]] = {
    "detections": ("lineitem", None, _DETECTION),
    "review_detections": (
        "lineitem",
        None,
        {
            **_DETECTION,
            "removed": _REMOVED,
            "confirmed": f"{_VARIANT} % 3 = 0 AND NOT ({_REMOVED})",
            "source": f"CASE WHEN {_VARIANT} % 8 = 7 THEN 'manual' ELSE 'model' END",
        },
    ),
    "annotations": (
        "lineitem",
        None,
        {
            "image_id": _IMAGE,
            "split": f"CASE WHEN {_IMAGE} % 10 < 8 THEN 'train' WHEN {_IMAGE} % 10 = 8 "
            "THEN 'valid' ELSE 'test' END",
            "stem": f"concat('img-', CAST({_IMAGE} AS VARCHAR(20)))",
            "line_no": _DETECTION["det_idx"],
            "class_id": f"CAST(CASE WHEN {_VARIANT} = 23 THEN 3 ELSE {_CLASS_ID} END AS INT)",
            "cx": f"({_DETECTION['x1']} + {_DETECTION['x2']}) / CAST(1200 AS DOUBLE)",
            "cy": f"({_DETECTION['y1']} + {_DETECTION['y2']}) / CAST(900 AS DOUBLE)",
            "w": f"({_DETECTION['x2']} - {_DETECTION['x1']}) / CAST(600 AS DOUBLE)",
            "h": f"({_DETECTION['y2']} - {_DETECTION['y1']}) / CAST(450 AS DOUBLE)",
        },
    ),
    # One row per order position; `image_rows` below reduces them to distinct images.
    "observations": (
        "event_lanes",
        None,
        {
            "video_id": "user_id",
            "frame_idx": _FRAME,
            "t": f"CAST({_FRAME} AS DOUBLE) / CAST(1000 AS DOUBLE)",
            "minute": f"{_FRAME} // 60000",
            "det_idx": "event_id * 2 + lane",
            "class_id": f"CAST({_EVENT_CLASS} AS INT)",
            "class_name": f"CASE {_EVENT_CLASS} WHEN 0 THEN 'pipe burst' "
            "WHEN 1 THEN 'water accumulation' ELSE 'water drop' END",
            "confidence": "CAST((event_id * 37 + lane * 211) % 1001 AS DOUBLE)"
            " / CAST(1000 AS DOUBLE)",
            "x1": f"CAST({_OBS_X1} AS DOUBLE)",
            "y1": f"CAST({_OBS_Y1} AS DOUBLE)",
            "x2": f"CAST({_OBS_X1} + 60 AS DOUBLE)",
            "y2": f"CAST({_OBS_Y1} + 48 AS DOUBLE)",
        },
    ),
}

_IMAGE_COLUMNS = {
    "image_id": "image_id",
    "original_index": "image_id",
    "filename": "concat(CASE WHEN image_id % 3 = 0 THEN '' ELSE 'img-' END, "
    "CAST(image_id AS VARCHAR(20)), '.jpg')",
    "width": "CAST(640 AS DOUBLE)",
    "height": "CAST(480 AS DOUBLE)",
    "analyzed": "image_id % 11 <> 0",
    "review_edited": "image_id % 5 = 0",
    "image_approved": "image_id % 7 = 0",
    "byte_size": "(image_id * 7919) % 3000000 + 1000",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _spark_sql(expression: str) -> str:
    return expression.replace("//", " div ")


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{_spark_sql(e)} AS {name}" for name, e in columns.items()])


def event_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a millisecond frame number; every fourth event shows a second box (lane 1)."""
    return lanes_of(table(spark, sf_dir, "events"))


def lanes_of(events: DataFrame) -> DataFrame:
    """As `event_lanes`, for a batch or streaming events relation."""
    return events.selectExpr(
        "event_id",
        "user_id",
        "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) AS ts_ms",
        "explode(sequence(0, IF(event_id % 4 = 0, 1, 0))) AS lane",
    )


EVENT_LANES_SQL = """
    SELECT event_id, user_id, epoch_us(ts) // 1000 - 1704067200000 AS ts_ms, lane
    FROM events, (VALUES (0), (1)) AS lanes(lane)
    WHERE lane = 0 OR event_id % 4 = 0"""


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation of `RELATIONS` in Spark."""
    source, where, columns = RELATIONS[name]
    base = event_lanes(spark, sf_dir) if source == "event_lanes" else table(spark, sf_dir, source)
    if where:
        base = base.filter(_spark_sql(where))
    return _project(base, columns)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image spine: every order group, plus one box-less image per 400 orders."""
    ids = table(spark, sf_dir, "orders").selectExpr(
        "explode(array_compact(array(o_orderkey div 4, "
        "IF(o_orderkey % 400 = 0, o_orderkey div 4 + 1000000000, NULL)))) AS image_id"
    )
    return _project(ids.distinct(), _IMAGE_COLUMNS)


def images_sql() -> str:
    columns = ", ".join(f"{e} AS {name}" for name, e in _IMAGE_COLUMNS.items())
    return f"""
    SELECT {columns} FROM (
        SELECT o_orderkey // 4 AS image_id FROM orders
        UNION SELECT o_orderkey // 4 + 1000000000 FROM orders WHERE o_orderkey % 400 = 0) AS ids"""


def derived_sql(name: str) -> str:
    """The same relation as a DuckDB select."""
    source, where, columns = RELATIONS[name]
    base = f"({EVENT_LANES_SQL}) AS event_lanes" if source == "event_lanes" else source
    body = ", ".join(f"{e} AS {column}" for column, e in columns.items())
    return f"SELECT {body} FROM {base}" + (f" WHERE {where}" if where else "")
