"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows with one group key (by default: equal texts) stay together. Groups are spread over tasks by
hash; each task differences its groups: a heap holds partial partitions (one sum per shard), and the
two with the largest spread are merged, the largest sums of one onto the smallest of the other. Each
task ends with one partial partition, and those are differenced in the same way. What reaches the
driver is one row of `shards` sums per task, whatever the number of groups.

Large groups, those above 1 / `groups_per_task` of all bytes, are differenced first, in a task of their
own. Every other task starts from its share of the sums they left, so that small groups fill the
shards that large groups leave low.

Only a group that exceeds 1 / `split_share` of an even shard (by default: a whole one) is cut, because
it fits into no shard; into as few pieces as possible, balanced over `SLICES` hashed slices a piece.

Defined cases: null texts are empty (size 8) and form one group; repeated rows share a group; ties
are broken by key, so a repeated run gives the same shards; an empty table gives an empty result;
only doc_id and text are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlake.llm.frames import arrow_map, batch_of, keyed_texts, stored, shuffle_parts

GROUPS_PER_TASK = 20_000
SLICES = 64


def difference(items: list[tuple[np.ndarray, list]]) -> tuple[np.ndarray, list[list]]:
    """Karmarkar-Karp for many ways. Items are (sums ascending, bins: members per sum).

    Returns the final sums and the members of each. Members are nested pairs, unfolded by `flat`.
    """
    heap = [(-float(s[-1] - s[0]), i, s, bins) for i, (s, bins) in enumerate(items)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(sums, kind="stable")
        pairs = [
            (left[i], right[-1 - i]) if left[i] is not None and right[-1 - i] is not None
            else left[i] if left[i] is not None else right[-1 - i]
            for i in order
        ]
        sums = sums[order]
        heapq.heappush(heap, (-float(sums[-1] - sums[0]), count, sums, pairs))
        count += 1
    return heap[0][2], heap[0][3]


def flat(members) -> list:
    """All leaves of a nested pair tree."""
    out, stack = [], [members]
    while stack:
        top = stack.pop()
        if isinstance(top, tuple):
            stack.extend(top)
        elif top is not None:
            out.append(top)
    return out


def start_items(sizes: np.ndarray, shards: int) -> list[tuple[np.ndarray, list]]:
    """One partial partition per group: the group in the last shard, nothing in the others."""
    items = []
    for i, size in enumerate(sizes):
        sums = np.zeros(shards)
        sums[-1] = size
        items.append((sums, [None] * (shards - 1) + [i]))
    return items


def _assign(shards: int, loads: np.ndarray | None = None, rest: float = 0):
    """Differences one task's groups; `loads`: sums of the large groups, shared by `rest` bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        whole = pa.Table.from_batches(rows).sort_by(
            [("bytes", "descending"), ("group", "ascending"), ("piece", "ascending")]
        )
        sizes = whole["bytes"].to_numpy().astype(float)
        items = start_items(sizes, shards)
        if loads is not None:
            items.append((np.sort(loads) * (sizes.sum() / rest), [None] * shards))
        _, bins = difference(items)
        bin_of = np.empty(len(sizes), np.int32)
        for b, members in enumerate(bins):
            bin_of[flat(members)] = b
        sums = np.bincount(bin_of, sizes, shards)
        n = len(sizes)
        yield batch_of(
            task=whole["task"].combine_chunks(), group=whole["group"].combine_chunks(),
            piece=whole["piece"].combine_chunks(), bin=pa.array(bin_of),
            bin_bytes=pa.array(sums[bin_of].astype(np.int64)), rows=pa.array(np.full(n, n)),
        )

    return run


def _pieces(rows: DataFrame, limit: int) -> DataFrame | None:
    """(group, slice, of, piece) of the groups above `limit`: `of` slices of a group, by hash of the
    row's id, are differenced over the fewest pieces; None if there is no such group."""
    # Their number is bounded by the number of shares, and each has SLICES slices a piece.
    large = rows.groupBy("group").agg(F.sum("size").alias("whole")).filter(
        F.col("whole") > limit
    ).collect()
    if not large:
        return None
    count = {r["group"]: -(-r["whole"] // limit) for r in large}
    spark = rows.sparkSession
    named = spark.createDataFrame(
        [(g, n * SLICES) for g, n in sorted(count.items())], "group string, of int"
    )
    slices = rows.join(F.broadcast(named), "group").groupBy("group", _slice(), "of").agg(
        F.sum("size").alias("bytes")
    ).collect()
    found = []
    for group, n in sorted(count.items()):
        own = sorted((r for r in slices if r["group"] == group), key=lambda r: r["slice"])
        _, bins = difference(start_items(np.array([r["bytes"] for r in own], float), n))
        found += [
            (group, own[i]["slice"], n * SLICES, piece)
            for piece, members in enumerate(bins) for i in flat(members)
        ]
    return spark.createDataFrame(found, "group string, slice int, of int, piece int")


def _slice():
    return F.pmod(F.xxhash64("doc_id"), F.col("of")).cast("int").alias("slice")


def shard(
    docs: DataFrame, shards: int = 24, split_share: int = 1, groups_per_task: int = GROUPS_PER_TASK
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stored(keyed_texts(docs).select(
        "doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.sha2(raw, 256).alias("group"),
    ))
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    total = total or 0
    cut = _pieces(rows, max(1, total // (shards * split_share)))
    if cut is None:
        placed = rows.withColumn("piece", F.lit(0))
    else:
        of = F.broadcast(cut.select("group", "of").distinct())
        placed = rows.join(of, "group", "left").select("*", _slice()).join(
            F.broadcast(cut.drop("of")), ["group", "slice"], "left"
        ).withColumn("piece", F.coalesce("piece", F.lit(0))).drop("slice", "of")
    tasks = -(-(n or 1) // groups_per_task)
    pieces = stored(placed.groupBy("group", "piece").agg(F.sum("size").alias("bytes")))
    # Fewer than groups_per_task groups are large; a table of one task is differenced at once.
    large = F.col("bytes") > (total // groups_per_task if tasks > 1 else -1)
    first = _binned(pieces.filter(large), 1, shards, tasks)
    bins = _sums(first)
    loads = np.zeros(shards)
    for row in bins:
        loads[row["bin"]] = row["bytes"]
    rest = total - loads.sum()
    others = None
    if rest:
        others = _binned(pieces.filter(~large), tasks, shards, 0, loads if loads.any() else None, rest)
        bins += _sums(others)
    final = spark.createDataFrame(_combine(bins, shards), "task int, bin int, shard int")
    # `shards` rows per task: bounded by the number of tasks.
    located = lambda binned: binned.join(F.broadcast(final), ["task", "bin"]).select(
        "group", "piece", "shard"
    )
    # Large groups can have many rows: their places are broadcast, the others are joined by shuffle.
    known = placed.join(F.broadcast(located(first)), ["group", "piece"], "left")
    if others is None:
        return with_slots(known.drop("group", "piece"))
    rest_rows = known.filter(F.col("shard").isNull()).drop("shard").join(
        located(others), ["group", "piece"]
    )
    return with_slots(
        known.filter(F.col("shard").isNotNull()).unionByName(rest_rows).drop("group", "piece")
    )


def _binned(
    pieces: DataFrame, tasks: int, shards: int, start: int, loads: np.ndarray | None = None,
    rest: float = 0,
) -> DataFrame:
    """Pieces with their task, numbered from `start`, and their bin in it."""
    own = pieces.withColumn(
        "task", (F.pmod(F.xxhash64("group", "piece"), F.lit(tasks)) + start).cast("int")
    )
    return stored(
        arrow_map(
            _by_task(own.select("task", "group", "piece", "bytes"), tasks),
            _per_task(shards, loads, rest),
            "task int", "group string", "piece int", "bin int", "bin_bytes long", "rows long",
        )
    )


def _sums(binned: DataFrame) -> list:
    return binned.groupBy("task", "bin").agg(F.max("bin_bytes").alias("bytes")).collect()


def _by_task(pieces: DataFrame, tasks: int) -> DataFrame:
    return pieces.repartition(tasks, "task").sortWithinPartitions("task")


def _per_task(shards: int, loads: np.ndarray | None, rest: float):
    """Rows arrive sorted by task; each task's groups (at most about groups_per_task) are held."""
    one = _assign(shards, loads, rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            keys = batch.column("task").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if start == end:
                    continue
                if keys[start] != current:
                    yield from one(iter(held))
                    held, current = [], keys[start]
                held.append(batch.slice(int(start), int(end - start)))
        yield from one(iter(held))

    return run


def _combine(bins: list, shards: int) -> list[tuple[int, int, int]]:
    """Final shard of each task's bin, by differencing the tasks' partial partitions."""
    by_task: dict[int, dict[int, int]] = {}
    for row in bins:
        by_task.setdefault(row["task"], {})[row["bin"]] = row["bytes"]
    items = []
    for task in sorted(by_task):
        own = [(by_task[task].get(b, 0), [task, b]) for b in range(shards)]
        own.sort(key=lambda x: (x[0], x[1]))
        items.append((np.array([x[0] for x in own], float), [x[1] for x in own]))
    if not items:
        return []
    _, found = difference(items)
    return [(task, b, shard) for shard, tree in enumerate(found) for task, b in flat(tree)]


def with_slots(rows: DataFrame) -> DataFrame:
    """Gapless positions per shard: a window inside (shard, part), and offsets of the parts."""
    parts = shuffle_parts(rows.sparkSession)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per (shard, part).
    offsets = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    return (
        rows.withColumn("at", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("before")).alias("slot"))
    )


def write_shards(sharded: DataFrame, docs: DataFrame, path: str) -> None:
    """Documents as one folder per shard, each in the order of its slots."""
    own = keyed_texts(docs).join(sharded.select("doc_id", "shard", "slot"), "doc_id")
    (
        own.repartition("shard", F.floor(F.col("slot") / 100_000))
        .sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard")
        .parquet(path)
    )
