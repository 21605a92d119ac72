"""Ordered folds whose state is truly sequential, with bounded memory per task.

Rows are sorted inside their shuffle partition and streamed through Arrow batches, so a task holds
one batch and one group's state, never a group's rows. Groups larger than `group_limit` are cut
into chunks and processed in rounds; their saved state travels to the next round through the
reliable checkpoint folder, so no single task ever sees such a group whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxlake import skew

GROUP_LIMIT = 200_000

_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "boolean": pa.bool_(), "binary": pa.binary(),
}


class Stepper(Protocol):
    """State machine over one group's ordered rows. Instances are pickled to the workers."""

    inputs: Sequence[str]
    outputs: Sequence[tuple[str, str]]  # (name, simple Spark type), keys excluded

    def begin(self) -> Any: ...
    def feed(self, state: Any, row: tuple) -> list[tuple]: ...
    def finish(self, state: Any) -> list[tuple]: ...
    def save(self, state: Any) -> bytes: ...
    def load(self, saved: bytes) -> Any: ...


def _kernel(stepper: Stepper, keys: list[str], out: pa.Schema):
    """Arrow kernel over key-sorted rows; a row with `_state` restores a group's state first."""
    width = len(keys)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in out]
        arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, out, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        state: Any = None
        final = True
        blank = (None,) * len(stepper.outputs)

        def close(rows: list[tuple]) -> None:
            if current is None:
                return
            if final:
                rows.extend((*current, *r, None) for r in stepper.finish(state))
            else:
                rows.append((*current, *blank, stepper.save(state)))

        for batch in batches:
            data = batch.to_pydict()
            key_rows = zip(*[data[k] for k in keys], strict=True)
            value_rows = zip(*[data[c] for c in stepper.inputs], strict=True)
            rows: list[tuple] = []
            for key, row, saved, is_final in zip(
                key_rows, value_rows, data["_state"], data["_final"], strict=True
            ):
                if key != current:
                    close(rows)
                    current, state = key, None
                if saved is not None:
                    state = stepper.load(saved)
                    continue
                if state is None:
                    state = stepper.begin()
                final = is_final
                rows.extend((*key, *r, None) for r in stepper.feed(state, row))
            if rows:
                yield emit(rows)
        rows = []
        close(rows)
        if rows:
            yield emit(rows)

    assert width
    return run


def fold_sorted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    stepper: Stepper,
    group_limit: int | None = GROUP_LIMIT,
    descending: bool = False,
) -> DataFrame:
    """Feed every group's rows in `order` through `stepper`; one output relation (keys + outputs).

    `group_limit=None` means that the caller has already split off larger groups.
    """
    keys = list(keys)
    needed = list(dict.fromkeys([*keys, *order, *stepper.inputs]))
    rows = df.select(*needed)
    key_types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    fields = [*[(k, key_types[k]) for k in keys], *stepper.outputs, ("_saved", "binary")]
    out = pa.schema([(n, _ARROW[t]) for n, t in fields])
    schema = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields))
    kernel = _kernel(stepper, keys, out)
    sort = [F.col(c).desc() if descending else F.col(c).asc() for c in order]

    def run(part: DataFrame) -> DataFrame:
        placed = skew.in_one_task(part, keys, [F.col("_state").isNull().asc(), *sort])
        return placed.mapInArrow(kernel, schema)

    cool, hot = (rows, None) if group_limit is None else skew.split_hot(rows, keys, group_limit)
    once = cool.withColumns({"_state": F.lit(None).cast("binary"), "_final": F.lit(True)})
    result = run(once).drop("_saved")
    if hot is None:
        return result

    indexed = skew.group_index(hot, keys, sort, "_i", "_n")
    chunked = skew.checkpointed(indexed.select(
        *needed, F.floor((F.col("_i") - 1) / group_limit).cast("long").alias("_chunk"),
        F.floor((F.col("_n") - 1) / group_limit).cast("long").alias("_last"),
    ))
    rounds = chunked.agg(F.max("_last")).first()[0] + 1
    saved: DataFrame | None = None
    for number in range(rounds):
        part = chunked.filter(F.col("_chunk") == number).select(
            *needed, F.lit(None).cast("binary").alias("_state"),
            (F.col("_last") == number).alias("_final"),
        )
        if saved is not None:
            part = part.unionByName(saved, allowMissingColumns=True)
        done = skew.checkpointed(run(part))
        result = result.unionByName(done.filter(F.col("_saved").isNull()).drop("_saved"))
        saved = done.filter(F.col("_saved").isNotNull()).select(
            *keys, F.col("_saved").alias("_state"), F.lit(False).alias("_final")
        )
    return result
