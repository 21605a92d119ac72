"""Substring de-duplication by seed and extend over words.

Seeds are winnowed anchors: in every run of `MIN_WORDS` words the 8-word seed of the lowest hash, so
equal runs have equal seeds. Occurrences of a seed meet by its hash. Their extensions to both sides
are compared as wholes first (equal extension: the whole span repeats); where occurrences agree only
in part, each extension of the seed to `MIN_WORDS` words, from wholly left to wholly right, is
compared by itself. Neighbouring repeats merge into maximal ones, which are at least `MIN_WORDS` long,
and every occurrence but the first (lowest doc_id, then position) is removed.

No pairs of occurrences are listed: a group of any size is settled by one grouping.

Defined cases: null, empty and shorter texts lose nothing; white space between kept words becomes one
space; rows that repeat a doc_id are the same document, so equal rows lose the same words; empty
tables give empty results; `judge` reads only doc_id and text, `clean` keeps all columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxlake.llm import kernel, repeats
from boxlake.llm.frames import arrow_map, batch_of, freed, keyed_texts

MIN_WORDS, SEED_WORDS = 20, 8


def _extend(window: int):
    """Settles open spans: every extension of the seeds to `window` words claims its own hash."""

    def compare(texts: DataFrame, parts: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in kernel.slices(batches):
                units = repeats.Units(*kernel.string_bytes(batch.column("text")), True)
                starts = [
                    np.concatenate([np.arange(a, a + more + 1) for a, more in own]) + base
                    for own, base in zip(
                        map(repeats.unpack, batch.column(repeats.PLACES).to_pylist()),
                        units.bounds[:-1], strict=True,
                    )
                ]
                at = np.concatenate(starts)
                whole = units.spans(at, at + window)
                other = kernel.mix(whole ^ units.spans(at, at + window // 2))
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                yield from repeats.claims(ids, units, at, at, at, whole, other, parts, True)

        claimed = arrow_map(texts.select("doc_id", "text", repeats.PLACES), run, *repeats.CLAIM)
        return repeats.settled(claimed, True).filter("NOT open")

    return compare


def removed_places(docs: DataFrame, window: int = MIN_WORDS, seed: int = SEED_WORDS) -> DataFrame:
    return repeats.repeated(docs, True, window, seed, True, _extend(window))


def _kept(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, int, bytes]]:
    """(words, removed words, kept words joined by a space) of each document."""
    units = repeats.Units(*kernel.string_bytes(batch.column("text")), True)
    raw = units.data.tobytes()
    for row, places in enumerate(batch.column(repeats.PLACES).to_pylist()):
        a, b = units.bounds[row], units.bounds[row + 1]
        starts, ends = units.starts[a:b], units.ends[a:b]
        gone = np.zeros(b - a, bool)
        if places:
            gone = repeats.covered(repeats.unpack(places), int(b - a), window)
        kept = zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)
        yield int(b - a), int(gone.sum()), b" ".join([raw[x:y] for x, y in kept])


def judge(docs: DataFrame, window: int = MIN_WORDS, seed: int = SEED_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches):
            rows = list(_kept(batch, window))
            yield batch_of(
                doc_id=batch.column("doc_id"), n_words=pa.array([r[0] for r in rows], pa.int64()),
                n_removed=pa.array([r[1] for r in rows], pa.int64()),
                kept_sha256=pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()),
            )

    whole = repeats.with_places(keyed_texts(docs), removed_places(docs, window, seed))
    return arrow_map(
        whole, run, "doc_id long", "n_words long", "n_removed long", "kept_sha256 string"
    )


def clean(docs: DataFrame, window: int = MIN_WORDS, seed: int = SEED_WORDS) -> DataFrame:
    """The documents without their repeated words. Texts that lose nothing stay as they are, texts
    that lose all their words become empty; n_chars follows the text."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches):
            texts, sizes = [], []
            old = batch.column("text").to_pylist()
            for text, (_, gone, kept) in zip(old, _kept(batch, window), strict=True):
                texts.append(kept.decode() if gone else text)
                sizes.append(len(texts[-1] or ""))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array(texts, batch.column("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(sizes, pa.int64()).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    whole = repeats.with_places(docs, removed_places(docs, window, seed))
    return whole.select(*names, repeats.PLACES).mapInArrow(freed(run), docs.schema)
