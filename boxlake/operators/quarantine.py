"""Dataset repair with a change log that can be taken back.

A repair is planned as a relation of changes first: whole-file moves of exact duplicates with their labels
(phase 1), then rewrites of label files whose boxes were clamped (phase 2). Each change carries what
undoes it: a move its other end, a rewrite the bytes before. `repair` writes that log below the quarantine
folder, applies it phase by phase in tasks, and writes the commit marker last; `restore` applies the
inverse changes, last phase first. Every change says what it leads to, not what it does, so repeated
tasks and repeated calls change nothing more, and a repair that broke anywhere is taken back by the
same call.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake import skew
from boxlake.operators import audit, export
from boxlake.sources import labels as label_source
from boxlake.sources.media import IMAGE_SUFFIXES

DUPLICATES, ORIGINALS = "exact-duplicates", "annotation-originals"
LOG, MARKER, UNDONE = "log", "changes.json", "restored.json"
CHANGES = ("phase", "category", "op", "path", "target", "before", "after")


def label_text(lines: DataFrame, keys: list[str], line: Column) -> DataFrame:
    """(keys, text) of label lines in the order of line_no; a file holds a few boxes."""
    gathered = lines.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))).alias("_lines")
    )
    text = F.concat(F.array_join("_lines.line", "\n"), F.lit("\n"))
    return gathered.select(*keys, text.alias("text"))


def clamped_files(annotations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, after): the text of the label files with a clamped box, all their boxes included."""
    repaired = audit.clamp_annotations(annotations)
    moved = repaired.groupBy(*keys).agg(F.max("changed").alias("changed")).filter("changed").select(*keys)
    line = export.audit_label_line(
        F.col("class_id"), *[F.col(f"new_{n}") for n in ("cx", "cy", "w", "h")]
    )
    return label_text(repaired.join(moved, keys, "left_semi"), keys, line).withColumnRenamed("text", "after")


def changes(images: DataFrame, labels: DataFrame, annotations: DataFrame) -> DataFrame:
    """The changes of a repair of images (path, split, stem, filename, digest) and label files (path,
    split, stem, content) with their parsed boxes.

    Labels of removed duplicates move with their image and are not rewritten; files that hold a line that
    cannot be read must not be among `annotations`, and so stay as they are.
    """
    keys = ["split", "stem"]
    scored = audit.keeper_scores(images, annotations)
    gone = skew.checkpointed(audit.duplicates_to_remove(scored).select(*keys, "path"))

    def moved(rows: DataFrame) -> DataFrame:
        none = F.lit(None).cast("binary")
        return rows.select(
            F.lit(1).alias("phase"), F.lit(DUPLICATES).alias("category"), F.lit("move").alias("op"), "path",
            F.concat(F.lit(f"{DUPLICATES}/"), "path").alias("target"), none.alias("before"), none.alias("after"),
        )

    names = gone.select(*keys).distinct()
    left = labels.join(names, keys, "left_anti")
    rewritten = left.join(clamped_files(annotations, keys), keys).select(
        F.lit(2).alias("phase"), F.lit(ORIGINALS).alias("category"), F.lit("rewrite").alias("op"), "path",
        F.concat(F.lit(f"{ORIGINALS}/"), "path").alias("target"),
        F.col("content").cast("binary").alias("before"), F.encode("after", "UTF-8").alias("after"),
    )
    return moved(gone).unionByName(moved(labels.join(names, keys, "left_semi"))).unionByName(rewritten)


def read_dataset(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, label files and boxes of `<split>/images/*` and `<split>/labels/*.txt` below `root`."""
    base = root.rstrip("/") + "/"
    inside = F.substring_index("path", base.split(":", 1)[-1].lstrip("/"), -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = label_source.with_path_parts(files.withColumn("path", inside)).drop("label_path")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    shown = files.filter(F.col("path").contains("/images/") & suffix.isin(*IMAGE_SUFFIXES))
    images = shown.select(
        "path", "split", "stem", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        F.sha2("content", 256).alias("digest"),
    )
    labels = files.filter(F.col("path").contains("/labels/") & (suffix == "txt")).select(
        "path", "split", "stem", "content"
    )
    lines = labels.select(
        "split", "stem", F.posexplode(F.split(F.decode("content", "UTF-8"), r"\r\n|\n|\r")).alias("n", "value")
    ).withColumn("line_no", (F.col("n") + 1).cast("long")).drop("n")
    parsed = label_source.parse_label_lines(lines)
    broken = parsed.filter("reject_reason IS NOT NULL").select("split", "stem").distinct()
    boxes = parsed.join(broken, ["split", "stem"], "left_anti").drop("reject_reason")
    return images, labels, boxes


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _exists(store: pyarrow.fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != pyarrow.fs.FileType.NotFound


def _put(store: pyarrow.fs.FileSystem, path: str, content: bytes) -> None:
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(f"{path}.new") as stream:
        stream.write(content)
    store.move(f"{path}.new", path)


def _move(store: pyarrow.fs.FileSystem, source: str, target: str) -> None:
    if _exists(store, source):
        store.create_dir(target.rsplit("/", 1)[0], recursive=True)
        store.move(source, target)
    elif not _exists(store, target):
        raise FileNotFoundError(f"neither {source} nor {target}")


def _carried_out(log: DataFrame, root: str, quarantine: str, undo: bool) -> int:
    """Applies one phase of the log, or its inverse; the number of its changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        _, aside = _store(quarantine)
        done = 0
        for batch in batches:
            for row in batch.to_pylist():
                here, there = f"{base}/{row['path']}", f"{aside}/{row['target']}"
                if row["op"] == "move":
                    _move(store, *((there, here) if undo else (here, there)))
                else:
                    if not undo:
                        _put(store, there, row["before"])
                    _put(store, here, row["before"] if undo else row["after"])
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    spread = log.repartition("path")
    return spread.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _mark(folder: str, name: str, facts: dict) -> None:
    store, base = _store(folder)
    _put(store, f"{base}/{name}", (json.dumps(facts, indent=2) + "\n").encode())


def repair(
    spark: SparkSession, root: str, quarantine: str, planned: DataFrame | None = None
) -> dict[str, int]:
    """Repairs the dataset below `root`; an existing quarantine is refused. Returns changes by category."""
    store, base = _store(quarantine)
    if _exists(store, base):
        raise FileExistsError(f"{quarantine} exists")
    planned = changes(*read_dataset(spark, root)) if planned is None else planned
    planned.select(*CHANGES).write.mode("errorifexists").parquet(f"{quarantine}/{LOG}")
    log = spark.read.parquet(f"{quarantine}/{LOG}")
    for phase in (1, 2):
        _carried_out(log.filter(F.col("phase") == phase), root, quarantine, undo=False)
    counts = {r.category: r["count"] for r in log.groupBy("category").count().collect()}
    _mark(quarantine, MARKER, counts)
    return counts


def committed(quarantine: str) -> bool:
    store, base = _store(quarantine)
    return _exists(store, f"{base}/{MARKER}")


def restore(spark: SparkSession, root: str, quarantine: str) -> int:
    """Takes a repair back, whole or broken; the number of changes that its log holds. Can be repeated.

    A log that was not written to its end belongs to a repair that changed nothing yet.
    """
    store, base = _store(quarantine)
    if not _exists(store, f"{base}/{LOG}/_SUCCESS"):
        return 0
    log = spark.read.parquet(f"{quarantine}/{LOG}")
    done = 0
    for phase in (2, 1):
        done += _carried_out(log.filter(F.col("phase") == phase), root, quarantine, undo=True)
    _mark(quarantine, UNDONE, {"changes": done})
    return done
