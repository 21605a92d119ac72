"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are folded to lower-case letters, digits and single spaces. An item of m
characters that lies in a document with at most e edits shares at least m - q + 1 - q * e q-grams with
it, all within a band of e + 1 diagonals (document position minus item position). The scan probes a
bitmap and then the sorted item q-grams, counts the hits per (document, item) in overlapping bands of
twice that width, keeps the bands that reach the bound, and verifies each by banded alignment: the
item against any stretch of the band, at most e edits.

Items are bounded in blocks of `BLOCK_BYTES`; every block scans the documents once, without a shuffle.

Defined cases: null and empty documents are clean; items without `Q` folded characters are too short
to tell and never match; the edit budget of short items shrinks so that the bound stays at least one
q-gram; repeated items are reported each; repeated documents give repeated rows, and texts of one id that
differ are judged apart, whatever the number of blocks; a document that quotes only a part of an item is
clean; empty tables give clean or empty results; `judge` reads only doc_id and text, `clean` keeps all
columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.llm import kernel
from boxlake.llm.frames import arrow_map, batch_of, keyed_texts, same_rows

Q = 12
EDIT_RATE = 0.05
BLOCK_BYTES = 4_000_000
_BITS = 22
_FOLD = kernel.LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32


def fold(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, their document bounds, and the byte position each one comes from."""
    out = _FOLD[data]
    keep = out != 32
    keep[:-1] |= out[1:] != 32  # of a run of spaces the last stays
    at = np.flatnonzero(keep)
    return out[at], np.searchsorted(at, bounds), at


def edit_budget(size: int) -> int:
    return max(0, min(int(EDIT_RATE * size), (size - Q) // Q))


@dataclass
class Items:
    """Folded items and the sorted q-grams with their places."""

    ids: np.ndarray
    texts: list[np.ndarray]
    budgets: np.ndarray
    grams: np.ndarray
    bounds: np.ndarray
    item: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        folded = []
        for number, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            out = fold(raw, np.array([0, len(raw)]))[0]
            while len(out) and out[0] == 32:
                out = out[1:]
            while len(out) and out[-1] == 32:
                out = out[:-1]
            if len(out) >= Q:
                folded.append((number, out))
        grams = [kernel.rolling_hash(kernel.prefix_hash(t), Q) for _, t in folded]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        offset = np.concatenate([np.arange(len(g)) for g in grams]) if grams else item
        order = np.argsort(every, kind="stable")
        unique, first = np.unique(every[order], return_index=True)
        return cls(
            np.array([n for n, _ in folded], np.int64), [t for _, t in folded],
            np.array([edit_budget(len(t)) for _, t in folded], np.int64), unique,
            np.append(first, len(every)).astype(np.int64), item[order], offset[order],
        )

    def bitmap(self) -> np.ndarray:
        out = np.zeros(1 << _BITS, bool)
        out[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return out


def candidates(
    hashes: np.ndarray, bounds: np.ndarray, items: Items, bitmap: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, lowest diagonal) of the bands that reach the item's bound."""
    at = np.flatnonzero(bitmap[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
    place = np.minimum(np.searchsorted(items.grams, hashes[at]), len(items.grams) - 1)
    real = items.grams[place] == hashes[at]
    at, place = at[real], place[real]
    doc = np.searchsorted(bounds, at, "right") - 1
    inside = at + Q <= bounds[doc + 1]
    at, place, doc = at[inside], place[inside], doc[inside]
    count = items.bounds[place + 1] - items.bounds[place]
    total = int(count.sum())
    if total == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    which = np.repeat(np.arange(len(at)), count)
    ordinal = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    source = items.bounds[place][which] + ordinal
    item = items.item[source]
    step = items.budgets[item] + 1
    band = (at[which] - items.offset[source]) // step
    order = np.lexsort((band, item, doc[which]))
    d, i, b = doc[which][order], item[order], band[order]
    new = np.ones(total, bool)
    new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    hits = np.diff(np.append(first, total))
    d, i, b = d[first], i[first], b[first]
    both = hits.copy()
    follows = (d[1:] == d[:-1]) & (i[1:] == i[:-1]) & (b[1:] == b[:-1] + 1)
    both[:-1] += np.where(follows, hits[1:], 0)
    sizes = np.array([len(t) for t in items.texts])
    bound = sizes - Q + 1 - Q * items.budgets
    good = both >= bound[i]
    return d[good], i[good], b[good] * (items.budgets[i[good]] + 1)


def align(
    data: np.ndarray, bounds: np.ndarray, doc: np.ndarray, item: np.ndarray, low: np.ndarray,
    items: Items,
) -> np.ndarray:
    """Edits of each item against the best stretch of its band (all candidates side by side)."""
    out = np.empty(len(doc), np.int64)
    for start in range(0, len(doc), 256):
        own = slice(start, start + 256)
        out[own] = _align(data, bounds, doc[own], item[own], low[own], items)
    return out


def _align(data, bounds, doc, item, low, items: Items) -> np.ndarray:
    budgets = items.budgets[item]
    sizes = np.array([len(items.texts[i]) for i in item])
    reach, longest = int(budgets.max()), int(sizes.max())
    width = 2 * (reach + 1) + 2 * reach + 1
    base = low - reach
    pattern = np.zeros((len(doc), longest), np.uint8)
    for row, i in enumerate(item):
        pattern[row, : sizes[row]] = items.texts[i]
    at = base[:, None] + np.arange(longest + width)[None, :]
    valid = (at >= bounds[doc][:, None]) & (at < bounds[doc + 1][:, None])
    text = np.where(valid, data[np.clip(at, 0, len(data) - 1)], 0)
    steps = np.arange(width)
    cost = np.zeros((len(doc), width), np.int64)
    best = np.full(len(doc), np.iinfo(np.int64).max)
    for i in range(longest):
        step = cost + (text[:, i : i + width] != pattern[:, i : i + 1])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - steps, axis=1) + steps
        ended = sizes == i + 1
        if ended.any():
            best[ended] = cost[ended].min(axis=1)
    return best


def _find(batch: pa.RecordBatch, items: Items, bitmap: np.ndarray) -> dict[int, list[tuple]]:
    """Per row of the batch: (item id, first byte, edits) of the best hit of each item."""
    raw, raw_bounds = kernel.string_bytes(batch.column("text"))
    if len(items.ids) == 0 or len(raw) == 0:
        return {}
    data, bounds, origin = fold(raw, raw_bounds)
    hashes = kernel.rolling_hash(kernel.prefix_hash(data), Q)
    doc, item, low = candidates(hashes, bounds, items, bitmap)
    edits = align(data, bounds, doc, item, low, items)
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for d, i, diagonal, cost in zip(doc, item, low, edits, strict=True):
        if cost <= items.budgets[i]:
            start = max(int(diagonal), int(bounds[d]))
            hit = (int(cost), int(origin[start] - raw_bounds[d]))
            found[d, i] = min(hit, found.get((d, i), hit))
    out: dict[int, list[tuple]] = {}
    for (d, i), (cost, start) in sorted(found.items()):
        out.setdefault(int(d), []).append((int(items.ids[i]), start, cost))
    return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks whose texts are about BLOCK_BYTES: one block is held at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield [(r["item_id"], r["text"]) for r in own.collect()]


HITS = "array<struct<item_id: long, start: long, edits: long>>"


def _block_hits(docs: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items.of(rows)
        bitmap = items.bitmap()
        kind = pa.list_(pa.struct(
            [("item_id", pa.int64()), ("start", pa.int64()), ("edits", pa.int64())]
        ))
        for batch in kernel.slices(batches):
            found = _find(batch, items, bitmap)
            hits = [
                [
                    dict(zip(("item_id", "start", "edits"), h, strict=True))
                    for h in sorted(found.get(r, []))
                ]
                for r in range(batch.num_rows)
            ]
            yield batch_of(
                doc_id=batch.column("doc_id"), digest=batch.column("digest"),
                hits=pa.array(hits, kind),
            )

    named = keyed_texts(docs).withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    return arrow_map(named, run, "doc_id long", "digest string", f"hits {HITS}")


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, hits (item, first byte, edits; in this order), n_hits and kept of every document row."""
    blocks = [
        _block_hits(docs, rows).withColumn("block", F.lit(n))
        for n, rows in enumerate(item_blocks(benchmark))
    ]
    whole = blocks[0]
    if len(blocks) > 1:
        # Rows of one id and text have the same hits in a block, so one of them speaks for all; their
        # number brings the rows back. Texts of one id that differ stay apart.
        for part in blocks[1:]:
            whole = whole.unionByName(part)
        row = ["doc_id", "digest"]
        once = whole.groupBy(*row, "block").agg(
            F.first("hits").alias("hits"), F.count(F.lit(1)).alias("copies")
        )
        whole = once.groupBy(*row).agg(
            F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.max("copies").alias("copies")
        ).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return whole.select(
        "doc_id", "hits", F.size("hits").cast("long").alias("n_hits"),
        (F.size("hits") == 0).alias("kept"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark item, all columns unchanged."""
    out = docs
    for rows in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            items = Items.of(rows)
            bitmap = items.bitmap()
            for batch in kernel.slices(batches):
                found = _find(batch, items, bitmap)
                keep = [row not in found for row in range(batch.num_rows)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = same_rows(out, run)
    return out
