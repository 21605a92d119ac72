"""Centroid clustering of integer vectors with scalar lookup tables.

Each component x becomes floor(scale * x). In every round a task tabulates, for each dimension, the
squared differences between the integer values that occur there and the components of all centroids;
the distances of a block of vectors are then table rows gathered by value and summed over the
dimensions, without a multiplication. A table covers the range of the values seen so far while that is
narrow (`TABLE_VALUES`), and is otherwise made for the distinct values of the block.

A round needs no shuffle of vectors: each task adds up its vectors by cluster, Spark adds those sums, and
the new centroids (k * dimensions integers) come to the driver. The integers are written once and read
by every round, so a lost executor repeats one scan at most.

Defined cases: vectors of another length, null ones and those with a null or non-finite component are
left out; scaled components beyond +-2**27 count as that value, so that distances stay below 2**63;
fewer vectors than centroids give fewer centroids; equal distances go to the lower number; repeated rows
are vectors of their own; rows with a null id are clustered, but start no cluster while others can;
sums beyond a long are reported as the largest long; empty tables give empty results; only the id and
the vector are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.llm.frames import arrow_map, batch_of, schema, stored

DIMENSIONS, SCALE = 64, 64
CLUSTERS, ROUNDS = 16, 3
LIMIT = 1 << 27
TABLE_VALUES = 2_048
BLOCK_ROWS = 4_096
_MAX_LONG = (1 << 63) - 1


def scaled(column: pa.Array, dimensions: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are whole vectors, their integers in one array)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dimensions)
    flat = column.take(pa.array(rows)).flatten()
    holes = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    values, holes = values.reshape(-1, dimensions), holes.reshape(-1, dimensions)
    whole = np.isfinite(values).all(axis=1) & ~holes.any(axis=1)
    values = np.clip(np.floor(values[whole] * scale), -LIMIT, LIMIT)
    return rows[whole], values.astype(np.int32)


def quantised(
    vectors: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS, scale: float = SCALE
) -> DataFrame:
    """vec_id and components of the whole vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows, values = scaled(batch.column("vector"), dimensions, scale)
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * dimensions
            yield batch_of(
                vec_id=batch.column("vec_id").take(pa.array(rows)),
                components=pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel())),
            )

    named = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    return arrow_map(named, run, "vec_id long", "components array<int>")


class Tables:
    """Squared differences by dimension, value and centroid."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        self.low = [0] * centroids.shape[1]
        self.tables = [None] * centroids.shape[1]

    def _made(self, dimension: int, values: np.ndarray) -> np.ndarray:
        return (values.astype(np.int64)[:, None] - self.centroids[:, dimension]) ** 2

    def _rows(self, dimension: int, values: np.ndarray) -> np.ndarray:
        """The table rows of the values, (len(values), centroids)."""
        low, high = int(values.min()), int(values.max())
        table = self.tables[dimension]
        if table is not None:
            low = min(low, self.low[dimension])
            high = max(high, self.low[dimension] + len(table) - 1)
        if high - low >= TABLE_VALUES:
            distinct, place = np.unique(values, return_inverse=True)
            return self._made(dimension, distinct)[place]
        if table is None or len(table) <= high - low:
            table = self._made(dimension, np.arange(low, high + 1))
            self.low[dimension], self.tables[dimension] = low, table
        return table[values - self.low[dimension]]

    def distances(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros((len(values), len(self.centroids)), np.int64)
        for dimension in range(values.shape[1]):
            total += self._rows(dimension, values[:, dimension])
        return total


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int):
    """(batch, its integers) in blocks of rows."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK_ROWS):
            batch = whole.slice(at, BLOCK_ROWS)
            flat = batch.column("components").flatten().to_numpy(zero_copy_only=False)
            yield batch, flat.reshape(-1, dimensions)


def start(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the lowest sha256 of `seed:id`; of equal ids, the lower components first."""
    name = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string")), 256)
    chosen = vectors.orderBy(F.col("vec_id").isNull(), name, "components").limit(clusters)
    return np.array([r.components for r in chosen.select("components").collect()], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; those without vectors stay."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(centroids)
        sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for _, values in _blocks(batches, dimensions):
            own = tables.distances(values).argmin(axis=1)
            counts += np.bincount(own, minlength=k)
            order = np.argsort(own, kind="stable")
            first = np.searchsorted(own[order], np.arange(k))
            held = np.flatnonzero(np.diff([*first, len(own)]) > 0)
            sums[held] += np.add.reduceat(values[order].astype(np.int64), first[held], axis=0)
        used = np.flatnonzero(counts)
        yield batch_of(
            cluster=np.repeat(used, dimensions), dimension=np.tile(np.arange(dimensions), len(used)),
            total=sums[used].ravel(), n=np.repeat(counts[used], dimensions),
        )

    parts = arrow_map(
        vectors.select("components"), run, "cluster long", "dimension long", "total long", "n long"
    )
    added = parts.groupBy("cluster", "dimension").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")
    )
    out = centroids.copy()
    for row in added.collect():  # k * dimensions rows
        out[row.cluster, row.dimension] = int(row.total) // row.n
    return out


def fit(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1
) -> np.ndarray:
    """The centroids of (vec_id, components) after the rounds."""
    centroids = start(vectors, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    if len(centroids) == 0:
        return vectors.sparkSession.createDataFrame(
            [], schema("vec_id long", "cluster int", "distance long")
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(centroids)
        for batch, values in _blocks(batches, centroids.shape[1]):
            far = tables.distances(values)
            own = far.argmin(axis=1)
            yield batch_of(
                vec_id=batch.column("vec_id"), cluster=own.astype(np.int32),
                distance=far[np.arange(len(own)), own],
            )

    return arrow_map(vectors, run, "vec_id long", "cluster int", "distance long")


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
    clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1,
    dimensions: int = DIMENSIONS, scale: float = SCALE,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every whole vector."""
    spark = vectors.sparkSession
    whole = stored(quantised(vectors, key, vector, dimensions, scale), "integers")
    centroids = fit(whole, clusters, rounds, seed)
    placed = stored(assign(whole, centroids), "assigned")
    sums = {
        r.cluster: int(r.total)
        for r in placed.groupBy("cluster").agg(
            F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
        ).collect()  # one row a cluster
    }
    total = min(sum(sums.values()), _MAX_LONG)
    facts = [
        (k, min(sums[k], _MAX_LONG), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for k, c in enumerate(centroids.tolist()) if k in sums
    ]
    named = spark.createDataFrame(
        facts, schema("cluster int", "cluster_inertia long", "inertia long", "centroid_sha256 string")
    )
    return placed.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
