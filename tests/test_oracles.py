"""Every registered query against its DuckDB oracle, on tables with hot keys."""

from __future__ import annotations

import pytest
from compare import compare

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(skewed):
    return duck_for(skewed)


def duck_for(sf_dir: str):
    import duckdb
    from pathlib import Path

    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, skewed, con, name):
    ok, note = compare(spark, con, skewed, QUERIES[name], ORACLES[name])
    assert ok, note


# Queries with joins or exports whose hot branch only starts at production-size groups.
HOT_JOINS = [
    "ensemble_fallback", "point_in_box", "yolo_export", "quarantine_rows", "audit_report",
    "candidate_flatten", "near_dup_join", "review_signals", "approval_state", "persistent_tracks",
    "latency_summary",
]


@pytest.mark.parametrize("name", HOT_JOINS)
def test_hot_join_branch_gives_the_same(spark, skewed, con, tight, name):
    ok, note = compare(spark, con, skewed, QUERIES[name], ORACLES[name])
    assert ok, note


@pytest.mark.parametrize("name", ["ensemble_fallback", "review_signals", "approval_state"])
def test_salted_branch_gives_the_same(spark, skewed, con, tight, monkeypatch, name):
    monkeypatch.setattr(tight, "BROADCAST_ROWS", 0)
    ok, note = compare(spark, con, skewed, QUERIES[name], ORACLES[name])
    assert ok, note


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
