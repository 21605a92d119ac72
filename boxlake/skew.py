"""Building blocks that stay balanced when one key holds a large share of the rows.

Every helper is exact: hot keys are salted, cut into bounded chunks or processed in bounded
rounds, and no row is dropped, sampled or capped.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Broadcasts are only asked for when a counted row number is at most this.
BROADCAST_ROWS = 50_000
# A join key with more left rows than this is handled apart.
HOT_JOIN_ROWS = 1_000_000
# Groups of at most this many rows are ordered in one window; larger ones are cut at a time chunk.
WINDOW_ROWS = 500_000
# Up to this k, Spark limits every group inside the map tasks before it shuffles.
GROUP_LIMIT_K = 1_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a local folder is only ever chosen in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, as a URI."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if "://" not in base:
        base = f"file://{base.removeprefix('file:')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise `df` in the reliable checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def in_one_task(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The rows of each key in one task, sorted by the keys and `order`.

    Rows are placed by a hash of the keys and not by the keys themselves: a repartition by the keys of a
    join is dropped as already done, and adaptive execution, which does not know what depends on it,
    may then read the join's shuffle in local pieces or split its hot partitions.
    """
    keys = list(keys)
    placed = df.withColumn("_place", F.xxhash64(*keys)).repartition("_place")
    return placed.sortWithinPartitions(*keys, *order).drop("_place")


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys with more than `limit` rows, or None. Counting combines before the shuffle."""
    counts = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("group_rows"))
        .filter(F.col("group_rows") > limit)
    )
    if counts.isEmpty():
        return None
    return checkpointed(counts)


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting at most `limit` rows (the count stops there)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    salt_on: Sequence[str],
    limit: int | None = None,
    within: Sequence[str] | None = None,
) -> DataFrame:
    """Equi-join for a left side whose keys may be hot and a right side with few rows per key.

    Left rows per key are counted first (combining before the shuffle, on the key columns only).
    Without a key above `limit` this is a plain join. Otherwise the ordinary keys are joined
    plainly and the hot ones apart: their right rows are broadcast when counted small, so hot left
    rows never move; else both sides are salted, one salt per `limit` rows of the hottest key.
    `how` must keep left rows only (inner, left, left_semi, left_anti). `within` names some of the keys that
    take less work to count by: if no group of theirs is above `limit`, no key is.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join cannot do a {how} join")
    limit = limit or HOT_JOIN_ROWS
    keys = list(keys)
    if within is not None and hot_groups(left, within, limit) is None:
        return left.join(right, keys, how)
    hot = hot_groups(left, keys, limit)
    if hot is None:
        return left.join(right, keys, how)
    names = sized_broadcast(hot.select(*keys))
    cool = left.join(names, keys, "left_anti").join(right, keys, how)
    hot_left = left.join(names, keys, "left_semi")
    hot_right = checkpointed(right.join(names, keys, "left_semi"))
    if hot_right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return cool.unionByName(hot_left.join(F.broadcast(hot_right), keys, how))
    salts = -(-hot.agg(F.max("group_rows")).first()[0] // limit)
    salted_left = hot_left.withColumn(
        "_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int")
    )
    salted_right = hot_right.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return cool.unionByName(salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt"))


def split_hot(
    df: DataFrame, keys: Sequence[str], limit: int, counted: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """`df` as (groups of at most `limit` rows, bigger groups or None). `counted` has at least the rows of `df`
    in every group and takes less work to count."""
    hot = hot_groups(df if counted is None else counted, keys, limit)
    if hot is None:
        return df, None
    names = hot.select(*keys)
    names = sized_broadcast(names)
    return df.join(names, list(keys), "left_anti"), df.join(names, list(keys), "left_semi")


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salt_on: Sequence[str]
) -> DataFrame:
    """The first `k` rows per key, with `row_number` 1..k.

    For small k the rank filter is applied per group in the map tasks, so a hot key shuffles at
    most k rows per task. A larger k gets a salted pre-cut with the same effect.
    """
    final = Window.partitionBy(*keys).orderBy(*order)
    if k > GROUP_LIMIT_K:
        salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salt = F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int")
        partial = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_rank", F.row_number().over(partial))
            .filter(F.col("_rank") <= k)
            .drop("_salt", "_rank")
        )
    return df.withColumn("row_number", F.row_number().over(final)).filter(
        F.col("row_number") <= k
    )


def _range_sorted(df: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, int]:
    """Range-sorted, materialised rows with `_part` and the 0-based `_pos` inside it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mask = (1 << 33) - 1
    ranged = checkpointed(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    placed = ranged.withColumn("_part", F.shiftright("_row", 33)).withColumn(
        "_pos", F.col("_row").bitwiseAND(F.lit(mask))
    )
    return placed.drop("_row"), parts


def global_index(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1-based position of every row in the total order, without a one-task window.

    One range shuffle sorts the rows; the offset of a partition is the row count before it. The
    offsets table has one row per partition, so its broadcast is bounded by the partition number.
    `order` must end in a unique key.
    """
    placed, _ = _range_sorted(df, order)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_pos") + F.col("_offset") + 1)
        .drop("_part", "_pos", "_offset")
    )


def group_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, total: str | None = None
) -> DataFrame:
    """1-based position of every row inside its group, also for a group larger than any task.

    A group may span many range partitions; its rows before a partition are summed from a
    per-(partition, group) summary, so no window ever sees the whole group's rows.
    """
    placed, _ = _range_sorted(df, [*[F.col(k) for k in keys], *order])
    summary = placed.groupBy("_part", *keys).agg(
        F.count(F.lit(1)).alias("_size"), F.min("_pos").alias("_first")
    )
    group = Window.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    if total is not None:
        summary = summary.withColumn(total, F.sum("_size").over(group))
    return (
        placed.join(summary, ["_part", *keys])
        .withColumn(name, F.col("_pos") - F.col("_first") + 1 + F.col("_before"))
        .drop("_part", "_pos", "_size", "_first", "_before")
    )


def with_part(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows_per_part: int
) -> DataFrame:
    """Adds `part_no`: 0 for ordinary groups; larger groups are cut into ordered bounded parts."""
    cool, hot = split_hot(df, keys, rows_per_part)
    cool = cool.withColumn("part_no", F.lit(0).cast("long"))
    if hot is None:
        return cool
    indexed = group_index(hot, keys, order, "_index")
    parted = indexed.withColumn(
        "part_no", F.floor((F.col("_index") - 1) / rows_per_part).cast("long")
    ).drop("_index")
    return cool.unionByName(parted)


def in_windows(
    df: DataFrame, groups: Sequence[str], whole: Callable[[DataFrame], DataFrame],
    cut: Callable[[DataFrame], DataFrame], counted: DataFrame | None = None,
) -> DataFrame:
    """`whole` on the rows of ordinary groups, which one window may order, and `cut`, the same in
    chunks, on those of groups above WINDOW_ROWS."""
    cool, hot = split_hot(df, groups, WINDOW_ROWS, counted)
    return whole(cool) if hot is None else whole(cool).unionByName(cut(hot))


def last_over(
    value: Column, keys: Sequence[str], order: Sequence[Column | str], inclusive: bool = False
) -> Column:
    """Last non-null `value` before each row of a key (`inclusive`: at or before), in one window."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return F.last(value, ignorenulls=True).over(
        window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )


def carried_last(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    value: Column,
    name: str,
    inclusive: bool = False,
) -> DataFrame:
    """Last non-null `value` before each row of a key (`inclusive`: at or before).

    The row-level window is cut at `chunk` (a non-decreasing function of `order`); only one summary
    row per chunk travels across chunk borders.
    """
    valued = df.withColumn("_value", value)
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = valued.withColumn("_local", F.last("_value", ignorenulls=True).over(frame))
    known = F.when(F.col("_value").isNotNull(), F.struct(*order))
    tail = valued.groupBy(*keys, chunk).agg(F.max_by("_value", known).alias("_tail"))
    return _attach_carry(
        local, tail, keys, chunk, name,
        F.last("_tail", ignorenulls=True).over(
            Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
        ),
    )


def carried_next(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """First non-null `value` after each row of a key; the mirror image of `carried_last`."""
    valued = df.withColumn("_value", value)
    # Read backwards: a frame that grows from the start is linear, one that shrinks is quadratic.
    backwards = [F.col(c).desc() for c in order]
    inside = Window.partitionBy(*keys, chunk).orderBy(*backwards)
    frame = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = valued.withColumn("_local", F.last("_value", ignorenulls=True).over(frame))
    known = F.when(F.col("_value").isNotNull(), F.struct(*order))
    head = valued.groupBy(*keys, chunk).agg(F.min_by("_value", known).alias("_tail"))
    return _attach_carry(
        local, head, keys, chunk, name,
        F.last("_tail", ignorenulls=True).over(
            Window.partitionBy(*keys).orderBy(F.col(chunk).desc())
            .rowsBetween(Window.unboundedPreceding, -1)
        ),
    )


def _attach_carry(
    local: DataFrame, summary: DataFrame, keys: Sequence[str], chunk: str, name: str, carried: Column
) -> DataFrame:
    carry = summary.withColumn("_carry", carried).drop("_tail")
    return (
        local.join(carry, [*keys, chunk], "inner")
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop("_value", "_local", "_carry")
    )


def carried_sum(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Running total of `value` up to and including each row of a key, cut at `chunk`."""
    valued = df.withColumn("_value", value)
    inside = (
        Window.partitionBy(*keys, chunk)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = valued.withColumn("_local", F.sum("_value").over(inside))
    before = (
        Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        valued.groupBy(*keys, chunk)
        .agg(F.sum("_value").alias("_tail"))
        .withColumn("_carry", F.sum("_tail").over(before))
        .drop("_tail")
    )
    return (
        local.join(carry, [*keys, chunk], "inner")
        .withColumn(name, F.col("_local") + F.coalesce("_carry", F.lit(0)))
        .drop("_value", "_local", "_carry")
    )
