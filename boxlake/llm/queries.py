"""The operators on their whole tables, and the SQL that gives the same where SQL can say it."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.llm import (
    centroids, decontaminate, licenses, minhash, periods, pieces, quality, sharding, substrings,
    suffixes, token_files, toxicity, urls,
)
from boxlake.llm.frames import shared_folder, table
from boxlake.llm.oracles import ORACLES  # noqa: F401

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_PIECES = public_tokenizers.path("word_bpe_49k.json")
URL_RULES = (
    ("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urls.rule_table(spark, URL_RULES)
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.judge(table(spark, sf_dir, "documents"))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.group(table(spark, sf_dir, "documents"))


def op2_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), PIECES)


def op7_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "token-files")
    manifest = token_files.write(docs, folder, WORD_PIECES, end_id=1)
    return token_files.read(token_files.keys_of(docs), manifest).drop("occurrence")


def op10_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.judge(table(spark, sf_dir, "documents"))


def op11_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.judge(table(spark, sf_dir, "documents"))


def op12_table_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), clusters=16, rounds=3, seed=1)


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Every tenth document by crc32 of its id repeats a stretch of its words to its end."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def op13_square_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find(table(spark, sf_dir, "documents"), planted_order)
    best = F.reduce(
        "runs", F.lit(None).cast(periods.ONE),
        lambda best, r: F.when(
            best.isNull() | (r.length * best.period > best.length * r.period), r
        ).otherwise(best),
    )
    line = lambda r: F.concat_ws(",", r.start, r.length, r.period)
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_groups, op2_piece_viterbi, op3_url_rules, op4_suffix_repeats,
        op5_line_quality, op6_lexicon_toxicity, op7_qgram_leaks,
        op8_token_files, op9_balanced_shards, op10_seed_extend, op11_license_rules,
        op12_table_centroids, op13_square_runs,
    )
}
