"""Periodic runs of words by online dyadic square catching.

The words of a slice of documents arrive in steps, a separator after each document. For every power of
two B, a block of B words becomes a catcher when it is complete. It watches the B windows of B words
that start in the next block: each appended word completes one such window, which is compared (by
hash) with the one catcher that watches it. A hit at distance p, B <= p < 2B, is a suspect: the suffixes
before both places and the words after them are compared, and what agrees makes a stretch of period p.
A stretch that reaches the last word stays open, and every step advances its comparison. Squares of
one stretch merge into its run.

Every run is caught: its words but the last period are at least 2p - 1, so they hold a whole block of the
level of p. The first level takes all periods below 16, with blocks of 8 words, which is why a run must
be `LEAST_RUN` >= 24 words long. The work is one comparison a word and level, however repetitive a text
is: hits that lie in a run of a shorter period found before can only find it again and are skipped, and
hits of one distance in neighbouring blocks are one stretch.

Defined cases: null, empty and short texts have no run; white space between kept words becomes one space;
a run never crosses documents, repeated rows of one id included; documents are processed whole,
in memory of about 100 bytes a word of a slice (or of one longer document); empty tables give empty
results; `find` reads only doc_id and text, `clean` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxlake.llm import kernel
from boxlake.llm.frames import arrow_map, batch_of, keyed_texts, same_rows

FIRST_BLOCK = 8
LEAST_RUN = 24
TIMES = 3
STEP_WORDS = 1 << 16
ONE = "struct<start: long, length: long, period: long>"
RUNS = f"array<{ONE}>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_NONE = np.zeros((0, 3), np.int64)

Order = Callable[[int | None, int], "np.ndarray | None"]


class Catchers:
    """Finds the runs (start, end, period) of a stream of 64-bit values, appended in steps."""

    def __init__(self, capacity: int, longest: int, least: int = LEAST_RUN, times: int = TIMES):
        if least < 3 * FIRST_BLOCK or times < TIMES:
            raise ValueError("shorter runs may hold no whole block")
        self.least, self.times = least, times
        self.up, self.down = kernel.powers(capacity + 1)
        self.sums = np.zeros(capacity + 1, np.uint64)
        self.seen = 0
        self.levels = [FIRST_BLOCK]
        while self.levels[-1] * 2 * times <= longest:
            self.levels.append(self.levels[-1] * 2)
        self.open = _NONE  # stretches that reach the last word
        self.closed = [_NONE]

    def append(self, values: np.ndarray) -> None:
        before, now = self.seen, self.seen + len(values)
        np.cumsum(values * self.up[before:now], out=self.sums[before + 1 : now + 1])
        self.sums[before + 1 : now + 1] += self.sums[before]
        self.seen = now
        moved = self.open.copy()
        moved[:, 1] += self._agree(moved[:, 1] - moved[:, 2], moved[:, 1], now - moved[:, 1])
        self.open = _NONE
        self._keep(moved)
        for block in self.levels:
            place, period = self._hits(block, max(0, before - block + 1), now - block + 1)
            place, period = self._fresh(block, place, period)
            if len(place):
                self._keep(self._stretches(place, period))

    def finish(self) -> np.ndarray:
        """All runs by start, then period; of the periods of one stretch the smallest."""
        found = np.concatenate([*self.closed, self._long(self.open)])
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        found = found[new]
        return found[np.lexsort((found[:, 2], found[:, 0]))]

    def _hits(self, block: int, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(window start, distance to its catcher) of the windows [first, end) that look like it."""
        if end <= first:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        windows = self._hash(np.arange(first, end), block)
        at = np.arange(first, end)
        own = at // block
        base = int(own[0]) - 1
        catchers = self._hash(np.arange(max(base, 0), int(own[-1]) + 1) * block, block, pad=True)
        hits = []
        for back in (0, 1) if block == FIRST_BLOCK else (1,):
            k = own - back
            ok = (k >= 0) & (at > k * block)
            ok[ok] = windows[ok] == catchers[k[ok] - max(base, 0)]
            hits.append(np.stack((at[ok], at[ok] - k[ok] * block)))
        both = np.concatenate(hits, axis=1)
        return both[0], both[1]

    def _hash(self, starts: np.ndarray, size: int, pad: bool = False) -> np.ndarray:
        ends = starts + size
        if pad:  # a block that is not complete yet watches nothing
            ends = np.minimum(ends, self.seen)
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def _fresh(
        self, block: int, place: np.ndarray, period: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Hits outside the known runs of at most `block`, one for each chain of blocks."""
        known = np.concatenate([*self.closed, self.open])
        known = known[known[:, 2] <= block]
        if len(known) and len(place):
            known = known[np.argsort(known[:, 0])]
            reach = np.maximum.accumulate(known[:, 1])
            at = np.searchsorted(known[:, 0], place - period, "right") - 1
            out = (at < 0) | (reach[at] < place + block)
            place, period = place[out], period[out]
        order = np.lexsort((place, period))
        place, period = place[order], period[order]
        new = np.ones(len(place), bool)
        new[1:] = (period[1:] != period[:-1]) | (place[1:] != place[:-1] + block)
        return place[new], period[new]

    def _stretches(self, place: np.ndarray, period: np.ndarray) -> np.ndarray:
        first = place - period
        back = self._agree(first, place, first, forward=False)
        on = self._agree(first, place, self.seen - place)
        return np.unique(np.stack((first - back, place + on, period), axis=1), axis=0)

    def _agree(
        self, a: np.ndarray, b: np.ndarray, most: np.ndarray, forward: bool = True
    ) -> np.ndarray:
        """How many values agree from a and b on (or before them), at most `most`."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            size = (low + high + 1) // 2
            x, y = (a, b) if forward else (a - size, b - size)
            same = (self.sums[x + size] - self.sums[x]) * self.down[x] == (
                self.sums[y + size] - self.sums[y]
            ) * self.down[y]
            low, high = np.where(same, size, low), np.where(same, high, size - 1)
        return low

    def _long(self, found: np.ndarray) -> np.ndarray:
        size = found[:, 1] - found[:, 0]
        return found[size >= np.maximum(self.least, self.times * found[:, 2])]

    def _keep(self, found: np.ndarray) -> None:
        still = found[:, 1] == self.seen
        self.open = np.unique(np.concatenate((self.open, found[still])), axis=0)
        ended = self._long(found[~still])
        if len(ended):
            self.closed = [np.unique(np.concatenate((*self.closed, ended)), axis=0)]


class Slice:
    """The words of a slice of documents in the order in which they are read, and their runs."""

    def __init__(self, batch: pa.RecordBatch, order: Order | None, least: int, times: int):
        data, bounds = kernel.string_bytes(batch.column("text"))
        self.raw = data.tobytes()
        self.starts, self.ends, self.bounds = kernel.words(data, bounds)
        self.source = np.arange(len(self.starts))
        if order is not None:
            for row, key in enumerate(batch.column("doc_id").to_pylist()):
                a, b = int(self.bounds[row]), int(self.bounds[row + 1])
                places = order(key, b - a)
                if places is not None:
                    self.source[a:b] = a + places
        self.runs = self._find(data, least, times)

    def _find(self, data: np.ndarray, least: int, times: int) -> list[np.ndarray]:
        """(start, length, period) of the runs of each document."""
        docs, sizes = len(self.bounds) - 1, np.diff(self.bounds)
        longest = int(sizes.max()) if docs else 0
        if longest < least:
            return [_NONE] * docs
        words = kernel.range_hash(kernel.prefix_hash(data), self.starts, self.ends)[self.source]
        # A value of its own after each document: nothing agrees across.
        stream = np.insert(words, self.bounds[1:], kernel.mix(~np.arange(docs, dtype=np.uint64)))
        catchers = Catchers(len(stream), longest, least, times)
        for at in range(0, len(stream), STEP_WORDS):
            catchers.append(stream[at : at + STEP_WORDS])
        found = catchers.finish()
        base = self.bounds[:-1] + np.arange(docs)
        cut = np.searchsorted(found[:, 0], [*base, len(stream)])
        found[:, 1] -= found[:, 0]
        return [
            found[a:b] - np.array([first, 0, 0])
            for a, b, first in zip(cut[:-1], cut[1:], base, strict=True)
        ]

    def kept(self, row: int) -> bytes:
        """The words outside the repetitions, joined by a space."""
        places = self.source[self.bounds[row] : self.bounds[row + 1]]
        if len(self.runs[row]):
            edge = np.zeros(len(places) + 1, np.int64)
            np.add.at(edge, self.runs[row][:, 0] + self.runs[row][:, 2], 1)
            np.add.at(edge, self.runs[row][:, 0] + self.runs[row][:, 1], -1)
            places = places[np.cumsum(edge)[:-1] == 0]
        raw = self.raw
        return b" ".join([
            raw[x:y]
            for x, y in zip(self.starts[places].tolist(), self.ends[places].tolist(), strict=True)
        ])


def _run_lists(found: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*found, _NONE])
    offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
    fields = [pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)]
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.StructArray.from_arrays(fields, fields=list(_RUN))
    )


def find(
    docs: DataFrame, order: Order | None = None, least: int = LEAST_RUN, times: int = TIMES
) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the kept text.

    `order(doc_id, n)` may give the places of the n words in the order in which they are to be read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches):
            own = Slice(batch, order, least, times)
            yield batch_of(
                doc_id=batch.column("doc_id"), n_words=np.diff(own.bounds),
                runs=_run_lists(own.runs),
                text=pa.array([own.kept(r).decode() for r in range(batch.num_rows)], pa.string()),
            )

    return arrow_map(
        keyed_texts(docs), run, "doc_id long", "n_words long", f"runs {RUNS}", "text string"
    )


def clean(docs: DataFrame, least: int = LEAST_RUN, times: int = TIMES) -> DataFrame:
    """The documents with each run cut to its first period. Texts without a run stay as they are;
    n_chars follows the text."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches):
            own = Slice(batch, None, least, times)
            texts = [
                own.kept(row).decode() if len(own.runs[row]) else text
                for row, text in enumerate(batch.column("text").to_pylist())
            ]
            columns = dict(zip(names, batch.columns, strict=True))
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                sizes = pa.array([len(t or "") for t in texts], pa.int64())
                columns["n_chars"] = sizes.cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return same_rows(docs, run)
