"""Skewed copies of the given tables: one key, text or vector holds a third of the rows.

Run as a script: python tests/skewed.py SF_DIR OUT_DIR
"""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb

# A third of the rows (by hash of a unique column) move to one hot key; keys stay unique.
SKEWED = {
    "lineitem": """
        SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey, l_suppkey) * FROM (
            SELECT * REPLACE (CASE WHEN (l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 3 = 0
                              THEN 20 + l_orderkey % 4 ELSE l_orderkey END AS l_orderkey) FROM t)""",
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 1 THEN 7 ELSE user_id END AS user_id) FROM t",
    "documents": """
        SELECT * REPLACE (CASE WHEN doc_id % 3 = 1 THEN 'src0' ELSE source END AS source,
                          CASE WHEN doc_id % 3 = 1 THEN (SELECT text FROM t WHERE doc_id = 0) ELSE text END AS text)
        FROM t""",
    "conversations": """
        SELECT CASE WHEN hot THEN 3 ELSE conv_id END AS conv_id,
               row_number() OVER (PARTITION BY CASE WHEN hot THEN 3 ELSE conv_id END ORDER BY conv_id, turn) - 1 AS turn,
               role, text
        FROM (SELECT *, conv_id % 3 = 0 AS hot FROM t) AS c""",
    "embeddings": """
        SELECT * REPLACE (CASE WHEN vec_id % 3 = 1 THEN (SELECT embedding FROM t WHERE vec_id = 0)
                          ELSE embedding END AS embedding) FROM t""",
}
PLAIN = (
    "region", "nation", "customer", "supplier", "part", "orders", "pages", "benchmark", "labels",
)


def build(source: str, target: str) -> str:
    Path(target).mkdir(parents=True, exist_ok=True)
    con = duckdb.connect()
    for name in (*SKEWED, *PLAIN):
        con.execute(f"CREATE OR REPLACE VIEW t AS SELECT * FROM '{source}/{name}.parquet'")
        con.execute(f"COPY ({SKEWED.get(name, 'SELECT * FROM t')}) TO '{target}/{name}.parquet'")
    return target


if __name__ == "__main__":
    build(sys.argv[1], sys.argv[2])
