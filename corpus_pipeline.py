"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written as Parquet to
the shared folder and read again, so a lost executor repeats one stage at most. All stages but the
last return the columns of `documents`.

Defined cases: null and empty texts fail the quality rules and go; of repeated rows of one id all stay or
go together, except that they are one document of their near-duplicate group; a text that is all
repeats becomes empty and has no ids; without documents or items each stage gives an empty or an
unchanged table; columns beyond those of `documents` are carried through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from boxlake.llm import decontaminate, minhash, pieces, quality, substrings
from boxlake.llm.frames import ARROW_ROWS, PARQUET_ROWS, STORED_BATCH_ROWS, stored, table


def _narrow(spark: SparkSession) -> None:
    """Documents are long: batches of Arrow's default number of rows cost every task tens of megabytes on
    both sides, which executors then keep. So do the batches of the Parquet reader."""
    for rows in (ARROW_ROWS, PARQUET_ROWS):
        if int(spark.conf.get(rows)) > STORED_BATCH_ROWS:
            spark.conf.set(rows, str(STORED_BATCH_ROWS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, and with them the documents that lose too much."""
    _narrow(spark)
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the lowest doc_id."""
    _narrow(spark)
    return minhash.clean(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occurred before go."""
    _narrow(spark)
    return substrings.clean(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _narrow(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids and round_trip of what is left."""
    _narrow(spark)
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("piece_ids", piece_ids),
]

# Stages 2, 4 and 5 (components, alignment, piece search) are beyond SQL; tests/llm holds a
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
