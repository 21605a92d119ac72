"""URL rules by a sort-merge range join.

A host is turned into its reversed labels (`a.example.net` -> `net.example.a.`), so a host and all
its subdomains form one interval of keys. Distinct hosts and rule intervals are cut at common key
borders, sorted together, and one sweep per range keeps the stack of the nested intervals that are
open: every host gets the rules that hold for it, without comparing hosts with rules pairwise. Paths
are then tested per page against the host's short list; the longest rule wins.

Defined cases: null urls and urls without `://` have empty host and path and match no rule (default
verdict); host case A-Z is folded; among rules of equal length the longer host, then the smaller
text wins; repeated pages give repeated rows; empty tables give empty results or the default
verdict; only page_id and url are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.llm.frames import arrow_map, batch_of, shuffle_parts

UPPER, FOLDED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, FOLDED), tail


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by a NUL: the keys of a subdomain start with its parent's key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\0"), F.lit("\0"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(verdict, `host/path`) pairs as a table."""
    return spark.createDataFrame([(v, r) for v, r in rules], "verdict string, rule string")


def _borders(hosts: DataFrame, parts: int) -> list[str]:
    """At most `parts` - 1 keys that cut the sorted hosts; a bounded sample of keys is enough here,
    because borders only balance the ranges and never change a result."""
    size = 64 * parts
    sample = hosts.orderBy(F.xxhash64("key")).limit(size)
    keys = sorted(r[0] for r in sample.collect())
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, key, kind): rules (kind 0) open an interval, hosts (kind 1) read it."""
    stack: list[tuple[str, list[dict]]] = []
    part = None
    for batch in batches:
        hosts, found = [], []
        for row in batch.to_pylist():
            if row["part"] != part:
                part, stack = row["part"], []
            while stack and not row["key"].startswith(stack[-1][0]):
                stack.pop()
            if row["kind"] == 0:
                rule = {n: row[n] for n in ("rule", "path", "verdict", "size", "depth")}
                if stack and stack[-1][0] == row["key"]:
                    stack[-1][1].append(rule)
                else:
                    stack.append((row["key"], [rule]))
            elif stack:
                hosts.append(row["host"])
                active = [r for _, rules in stack for r in rules]
                found.append(sorted(active, key=lambda r: (-r["size"], -r["depth"], r["rule"])))
        kind = pa.list_(pa.struct([("rule", pa.string()), ("path", pa.string()),
                                   ("verdict", pa.string())]))
        active = [[{n: r[n] for n in ("rule", "path", "verdict")} for r in rs] for rs in found]
        yield batch_of(host=pa.array(hosts, pa.string()), active=pa.array(active, kind))


def hosts_with_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, active): for each distinct host inside a rule's interval, its rules, longest first."""
    parts = shuffle_parts(hosts.sparkSession)
    slash = F.instr("rule", "/")
    intervals = rules.filter(F.col("rule").isNotNull()).distinct().select(
        F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule"))
        .alias("host"),
        F.when(slash > 0, F.substring(F.col("rule"), slash, F.length("rule"))).otherwise("")
        .alias("path"),
        "rule", "verdict", F.length("rule").alias("size"),
    ).withColumn("host", F.translate("host", UPPER, FOLDED))
    intervals = intervals.withColumn("depth", F.length("host")).withColumn("key", host_key("host"))
    keyed = hosts.select("host").distinct().withColumn("key", host_key(F.col("host")))
    borders = F.array(*[F.lit(b) for b in _borders(keyed, parts)]).cast("array<string>")
    place = lambda key: F.size(F.filter(borders, lambda b: b <= key))
    end = F.concat(F.col("key"), F.lit("\U0010FFFF"))
    opened = intervals.withColumn(
        "part", F.explode(F.sequence(place(F.col("key")), place(end)))
    ).select("part", "key", F.lit(0).alias("kind"), "host", "rule", "path", "verdict", "size", "depth")
    points = keyed.select(
        place(F.col("key")).alias("part"), "key", F.lit(1).alias("kind"), "host",
        *[F.lit(None).cast("string").alias(n) for n in ("rule", "path", "verdict")],
        *[F.lit(None).cast("int").alias(n) for n in ("size", "depth")],
    )
    rows = opened.unionByName(points).repartition(parts, "part")
    return arrow_map(
        rows.sortWithinPartitions("part", "key", "kind"), _sweep,
        "host string", "active array<struct<rule: string, path: string, verdict: string>>",
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, the longest fitting rule (or null) and the verdict of every page."""
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", "url").select(
        "page_id", host.alias("host"), F.coalesce(path, F.lit("")).alias("path")
    ).withColumn("host", F.coalesce("host", F.lit("")))
    active = hosts_with_rules(parsed.filter(F.col("host") != ""), rules)
    best = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    chosen = F.try_element_at(best, F.lit(1))
    return parsed.join(active, "host", "left").withColumn("_rule", chosen).select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.lit(default)).alias("verdict"),
    )
