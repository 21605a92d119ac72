"""Small helpers shared by the operators: tables, Arrow output, bounded settings."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlake.skew import ensure_checkpoint_dir


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
PARQUET_ROWS = "spark.sql.parquet.columnarReaderBatchSize"
STORED_BATCH_ROWS = 1_000
FREED_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only key and text, under fixed names: other columns cannot clash with an operator's own."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def schema(*fields: str) -> T.StructType:
    return T._parse_datatype_string(", ".join(fields))


Batches = Iterator[pa.RecordBatch]


_forget: Callable[[], None] | None = None


def take_over(forget: Callable[[], None] | None) -> None:
    """Have the operator that this worker served last give up what it keeps between tasks, unless it is
    the same one again."""
    global _forget
    if _forget is not None and _forget is not forget:
        _forget()
    _forget = forget


def freed(
    fn: Callable[[Batches], Batches], forget: Callable[[], None] | None = None
) -> Callable[[Batches], Batches]:
    """`fn`, returning the memory of its batches to the system at the end of the task. Workers are kept
    for later tasks, and what an idle one holds is missing to everything else on its machine. Tasks with
    few bytes leave nothing worth the time. What `fn` keeps between tasks goes by `forget`, a function of a
    module, once the worker serves another operator."""

    def run(batches: Batches) -> Batches:
        take_over(forget)
        taken = 0

        def counted() -> Batches:
            nonlocal taken
            for batch in batches:
                taken += batch.nbytes
                yield batch

        yield from fn(counted())
        if taken < FREED_BYTES:
            return
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def arrow_map(df: DataFrame, fn: Callable[[Batches], Batches], *fields: str) -> DataFrame:
    return df.mapInArrow(fn, schema(*fields))


def same_rows(df: DataFrame, fn: Callable[[Batches], Batches]) -> DataFrame:
    """`fn` over the batches of `df`, which keeps its columns."""
    return df.mapInArrow(freed(fn), df.schema)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns)
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Written once as Parquet below the shared checkpoint folder and read back: lineage is cut, and a
    lost executor does not repeat the work. (A checkpointed plan keeps the partitionings and orderings
    of the plan before it, which grow without bound in loops; a file does not.)"""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    before = spark.conf.get(ARROW_ROWS)
    # Texts may be long: a batch of the default 10,000 rows can hold hundreds of MB on both sides.
    spark.conf.set(ARROW_ROWS, str(min(STORED_BATCH_ROWS, int(before))))
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(folder)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    for file in df.inputFiles()[:1]:
        folder = hadoop.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of a 2-d byte view: row i holds values[bounds[i]:bounds[i + 1]], end to end."""
    flat = np.ascontiguousarray(values)
    width = flat.itemsize * (flat.shape[1] if flat.ndim == 2 else 1)
    offsets = (np.asarray(bounds, np.int64) * width).astype(np.int64)
    return pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1,
        [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())],
    ).cast(pa.binary())
