"""Windows of a fixed length that occur more than once, found through winnowed anchors.

Shared by the substring operators. Every window of `window` units (words or bytes) is owned by one
anchor inside it, chosen by content alone, so equal windows have equal anchors. The scan claims each
anchor with the span of all windows it owns. Claims meet by anchor:

* equal spans of one anchor are whole repeats: all but the first are settled at once;
* an anchor with several different spans is open: its spans agree only in part, and the first claim
  of each span goes on to the operator's own comparison.

Claims are packed per slice and part, equal spans are combined inside a slice before the shuffle, and
a part is a hash range of anchors, so a passage that a third of all documents share still arrives as
one claim per slice. Anchors and spans are compared by 96 bits of hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.llm import kernel
from boxlake.llm.frames import arrow_map, batch_of, binaries, keyed_texts, shuffle_parts, stored
from boxlake.skew import sized_broadcast

BROADCAST_IDS = 1_000_000
PLACES = "_repeat_places"
CLAIM = ("part int", "anchor binary", "span binary", "doc binary", "place binary")


class Units:
    """The units of a slice of documents, with hashes of their runs."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, words: bool):
        self.data = data
        if words:
            self.starts, self.ends, self.bounds = kernel.words(data, bounds)
            values = kernel.range_hash(kernel.prefix_hash(data), self.starts, self.ends)
            up, _ = kernel.powers(len(values))
            self.prefix = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values * up, out=self.prefix[1:])
        else:
            self.bounds, self.prefix = bounds, kernel.prefix_hash(data)

    def grams(self, k: int, starts: np.ndarray | None = None) -> np.ndarray:
        return kernel.rolling_hash(self.prefix, k, starts)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return kernel.range_hash(self.prefix, starts, ends)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1


def _six(values: np.ndarray) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _unsix(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def settle(
    anchor: np.ndarray, span: np.ndarray, doc: np.ndarray, first: np.ndarray, within: bool
) -> tuple[np.ndarray, np.ndarray]:
    """(removed, open) claims. Removed: an equal span of the anchor starts earlier (`within`: in a
    smaller document or before it in the same one; else: in a smaller document). Open: the first
    claim of its span (else: all claims of its first document), where the anchor has other spans too."""
    removed, opened = np.zeros(len(anchor), bool), np.zeros(len(anchor), bool)
    order = np.argsort(anchor)
    same = anchor[order][1:] == anchor[order][:-1]
    order = order[np.append(same, False) | np.append(False, same)] if len(order) else order
    # Most anchors have one claim, which needs no finer order.
    order = order[np.lexsort((first[order], doc[order], span[order], anchor[order]))]
    a, s, d, f = anchor[order], span[order], doc[order], first[order]
    new_anchor = np.ones(len(a), bool)
    new_anchor[1:] = a[1:] != a[:-1]
    new_span = new_anchor.copy()
    new_span[1:] |= s[1:] != s[:-1]
    group = np.cumsum(new_span) - 1
    d0, f0 = d[new_span][group], f[new_span][group]
    later = d > d0
    if within:
        later |= f > f0
    key = np.cumsum(new_anchor) - 1
    spans = np.bincount(key[new_span])[key] if len(key) else key
    removed[order] = later
    opened[order] = (new_span if within else d == d0) & (spans > 1)
    return removed, opened


def claims(
    batch_ids: np.ndarray, units: Units, at: np.ndarray, first: np.ndarray, last: np.ndarray,
    anchor: np.ndarray, span: np.ndarray, parts: int, within: bool,
) -> Iterator[pa.RecordBatch]:
    """Packed claims of a slice by part, and (under part 0, without anchor) what it settles itself."""
    row = units.document(at)
    doc, begin = batch_ids[row], first - units.bounds[row]
    more = last - first
    part = (anchor >> np.uint64(48)).astype(np.int64) % parts
    low = anchor & np.uint64(0xFFFFFFFFFFFF)
    cut = span & np.uint64(0xFFFFFFFFFFFF)
    removed, _ = settle(low ^ (part.astype(np.uint64) << np.uint64(48)), cut, doc, begin, within)
    place = np.stack((begin, more), axis=1).astype("<i4")
    if removed.any():
        own = np.flatnonzero(removed)
        own = own[np.argsort(doc[own], kind="stable")]
        edge = np.flatnonzero(np.diff(doc[own], prepend=doc[own][0] - 1))
        bounds = np.append(edge, len(own))
        empty = pa.array([b""] * len(edge), pa.binary())
        yield batch_of(
            part=(doc[own][edge] % parts).astype(np.int32), anchor=empty, span=empty,
            doc=binaries(doc[own][edge].astype("<i8"), np.arange(len(edge) + 1)),
            place=binaries(place[own], bounds),
        )
    own = np.flatnonzero(~removed)
    if len(own):
        own = own[np.argsort(part[own], kind="stable")]
        edge = np.flatnonzero(np.diff(part[own], prepend=-1))
        bounds = np.append(edge, len(own))
        yield batch_of(
            part=part[own][edge].astype(np.int32), anchor=binaries(_six(low[own]), bounds),
            span=binaries(_six(cut[own]), bounds), doc=binaries(doc[own].astype("<i8"), bounds),
            place=binaries(place[own], bounds),
        )


def _by_document(doc: np.ndarray, place: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    if len(doc) == 0:
        return
    order = np.argsort(doc, kind="stable")
    doc, place = doc[order], place[order]
    edge = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1))
    yield batch_of(
        doc_id=doc[edge], open=pa.array(np.full(len(edge), bool(kind))),
        place=binaries(place, np.append(edge, len(doc))),
    )


def settled(claimed: DataFrame, within: bool) -> DataFrame:
    """(doc_id, open, place): packed (first window, further windows) pairs per document and part."""

    def run(table: pa.Table) -> pa.Table:
        anchors, spans, docs, places, done = [], [], [], [], []
        for row in table.to_pylist():
            if row["anchor"]:
                anchors.append(_unsix(row["anchor"]))
                spans.append(_unsix(row["span"]))
                docs.append(np.frombuffer(row["doc"], "<i8"))
                places.append(np.frombuffer(row["place"], "<i4").reshape(-1, 2))
            else:
                own = np.frombuffer(row["place"], "<i4").reshape(-1, 2)
                done.append((np.repeat(np.frombuffer(row["doc"], "<i8"), len(own)), own))
        del table
        out = []
        if anchors:
            anchor, span = np.concatenate(anchors), np.concatenate(spans)
            doc, place = np.concatenate(docs), np.concatenate(places)
            removed, opened = settle(anchor, span, doc, place[:, 0], within)
            out += _by_document(doc[opened], place[opened], 1)
            done.append((doc[removed], place[removed]))
        if done:
            out += _by_document(
                np.concatenate([d for d, _ in done]), np.concatenate([p for _, p in done]), 0
            )
        kind = pa.schema([("doc_id", pa.int64()), ("open", pa.bool_()), ("place", pa.binary())])
        return pa.Table.from_batches(out, kind)

    return claimed.groupBy("part").applyInArrow(run, "doc_id long, open boolean, place binary")


def chosen(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Documents in (left_semi) or out of (left_anti) a set of ids: a broadcast of the ids up to a
    counted bound, beyond it a shuffle."""
    return docs.join(sized_broadcast(ids, BROADCAST_IDS), "doc_id", how)


def anchored(docs: DataFrame, words: bool, window: int, k: int, within: bool, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches):
            units = Units(*kernel.string_bytes(batch.column("text")), words)
            grams = units.grams(k)
            at, first, last = kernel.anchors(grams, units.bounds, window, k)
            if len(at):
                span = kernel.mix(
                    units.spans(first, last + window) + (at - first).astype(np.uint64)
                )
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                yield from claims(ids, units, at, first, last, grams[at], span, parts, within)

    return arrow_map(keyed_texts(docs), run, *CLAIM)


def placed(rows: DataFrame) -> DataFrame:
    """One row per document with all its packed places."""
    return rows.groupBy("doc_id").agg(F.collect_list("place").alias(PLACES))


def unpack(places: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(places or []), "<i4").reshape(-1, 2).astype(np.int64)


def repeated(
    docs: DataFrame, words: bool, window: int, k: int, within: bool,
    compare: Callable[[DataFrame, int], DataFrame],
) -> DataFrame:
    """(doc_id, places) of the windows that occur earlier. `compare` settles the open spans: it gets
    (doc_id, text, PLACES) and the number of parts, and gives rows like `settled`."""
    parts = max(16, shuffle_parts(docs.sparkSession))
    own = keyed_texts(docs)
    first = stored(settled(anchored(docs, words, window, k, within, parts), within), "claims")
    opened = first.filter("open")
    texts = chosen(own, opened.select("doc_id").distinct(), "left_semi")
    second = compare(texts.join(placed(opened), "doc_id"), parts)
    both = first.filter("NOT open").select("doc_id", "place").union(second.select("doc_id", "place"))
    return stored(placed(both), "removed")


def covered(places: np.ndarray, units: int, window: int) -> np.ndarray:
    """True for each unit inside a removed window; places are (first window, further windows)."""
    edges = np.zeros(units + 1, np.int64)
    np.add.at(edges, places[:, 0], 1)
    np.add.at(edges, np.minimum(places[:, 0] + places[:, 1] + window, units), -1)
    return np.cumsum(edges)[:-1] > 0


def with_places(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """All documents with their places (null where nothing is removed): only texts that lose
    something are shuffled."""
    ids = removed.select("doc_id")
    none = F.lit(None).cast("array<binary>")
    return chosen(docs, ids, "left_anti").withColumn(PLACES, none).unionByName(
        chosen(docs, ids, "left_semi").join(removed, "doc_id")
    )
