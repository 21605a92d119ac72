"""Repeated byte strings by a suffix array that is induced from disk-backed queues.

`suffixes` sorts all suffixes of a shard. The suffixes at local minima of the text (a smaller one
follows a larger one) are sorted first: their pieces are sorted by one induction, named, and ranked by
recursive doubling of the names. From them the larger-first and then the smaller-first suffixes are
induced: one queue per first byte, filled in scan order, is a priority queue with whole batches as its
operations. Each entry carries its position and the length of the prefix it shares with the entry
before it; an induced entry shares one byte more than the least value between its two sources, so
common prefixes need no comparison of texts. Queues beyond `memory` entries go to files, and a large
text can be a memory map.

`judge` removes every byte covered by a `WINDOW`-byte string that also starts in a document of a
smaller id. Shards are cut by content: winnowed anchors bring equal strings to one shard, spans that
are equal as wholes are settled where they meet, and the spans that agree only in part are sorted.
A span is left out of the sort if no span of another document has the same `WINDOW` - (`WINDOW` - `SEED`)
/ `REACHES` bytes around the seed, which any common string contains; a span that a document repeats is
sorted once.

Defined cases: null, empty and shorter texts lose nothing; matches never cross documents; strings
are judged on the input; rows that repeat a doc_id are one document; empty tables give empty results;
only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxlake.llm import kernel, repeats
from boxlake.llm.frames import arrow_map, batch_of, binaries, keyed_texts

WINDOW, SEED = 50, 20
MEMORY = 30_000_000  # queue entries in memory, about 9 bytes each
CAP = 250
BATCH = 1_000_000
SHARDS_PER_PART = 6
REACHES = 3
SYMBOLS = 257  # separator 0, bytes from 1
SPAN = np.dtype([("doc", "<i8"), ("size", "<i4"), ("copies", "<i4"), ("reach", "<u8", REACHES)])


class Queues:
    """One first-in-first-out queue of (positions, common prefixes) per symbol; long ones on disk."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory, self.held, self.files = folder, memory, 0, 0
        self.items: list[list] = [[] for _ in range(SYMBOLS)]

    def push(self, symbol: int, positions: np.ndarray, common: np.ndarray) -> None:
        if self.held + len(positions) > self.memory:
            name = os.path.join(self.folder, f"{id(self)}-{self.files}.npz")
            self.files += 1
            np.savez(name, positions=positions, common=common)
            self.items[symbol].append(name)
        else:
            self.held += len(positions)
            self.items[symbol].append((positions, common))

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches in order, also those pushed meanwhile."""
        own = self.items[symbol]
        while own:
            size = 0
            ready = []
            while own and size < BATCH:  # waiting batches are taken together
                positions, common = self._load(own.pop(0))
                ready.append((positions, common))
                size += len(positions)
            if len(ready) == 1:
                yield ready[0]
            else:
                yield np.concatenate([p for p, _ in ready]), np.concatenate([c for _, c in ready])

    def _load(self, batch) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(batch, str):
            with np.load(batch) as raw:
                loaded = raw["positions"], raw["common"]
            os.remove(batch)
            return loaded
        self.held -= len(batch[0])
        return batch


def _least_between(common: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(common[low + 1 .. high]) of each pair, low < high, by a table of doubling runs."""
    span = high - low
    out = np.empty(len(low), common.dtype)
    table, level = common, 0
    bits = np.frexp(span.astype(float))[1] - 1
    for level in range(int(bits.max()) + 1 if len(bits) else 0):
        own = bits == level
        if own.any():
            size = 1 << level
            out[own] = np.minimum(table[low[own] + 1], table[high[own] - size + 1])
        half = 1 << level
        if len(table) > half:
            table = np.minimum(table[:-half], table[half:])
    return out


class Inducer:
    """Pushes the predecessors of scanned batches, with induced common prefixes (`counted`; else 0)."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: Queues, counted: bool):
        self.text, self.wanted, self.queues, self.counted = text, wanted, queues, counted
        self.since = np.full(SYMBOLS, -1, np.int16)  # least value since the last push; -1: none yet

    def scan(self, positions: np.ndarray, common: np.ndarray) -> None:
        before = positions - 1
        at = np.flatnonzero((positions > 0) & self.wanted[before])
        symbols = self.text[before[at]]
        order = np.argsort(symbols, kind="stable")
        at, symbols = at[order], symbols[order]
        new = np.ones(len(at), bool)
        new[1:] = symbols[1:] != symbols[:-1]
        edge = np.append(np.flatnonzero(new), len(at)).tolist()
        if self.counted:
            shared = self._shared(common.astype(np.int16), at, symbols, new)
        else:
            shared = np.zeros(len(at), np.uint8)
        before = before[at]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            self.queues.push(int(symbols[a]), before[a:b], shared[a:b])

    def _shared(
        self, common: np.ndarray, at: np.ndarray, symbols: np.ndarray, new: np.ndarray
    ) -> np.ndarray:
        low = np.minimum.accumulate(common)
        shared = np.empty(len(at), np.int16)
        rest = np.flatnonzero(~new)
        shared[rest] = _least_between(common, at[rest - 1], at[rest]) + 1
        first = np.flatnonzero(new)
        shared[first] = np.minimum(self.since[symbols[first]], low[at[first]]) + 1
        self.since = np.minimum(self.since, low[-1])
        tail = np.minimum.accumulate(np.append(common, CAP)[::-1])[::-1]
        last = np.append(first[1:], len(at))[: len(first)] - 1
        self.since[symbols[first]] = tail[at[last] + 1]
        return np.minimum(shared, CAP).astype(np.uint8)


def _common(text: np.ndarray, i: int, j: int) -> int:
    size = min(CAP, len(text) - max(i, j))
    differ = np.flatnonzero(text[i : i + size] != text[j : j + size])
    return int(differ[0]) if len(differ) else size


def kinds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix is smaller than the one after it, local minima) of a text that ends in 0."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[-1] = 1
    at = np.where(step != 0, np.arange(n), n - 1)
    small = step[np.minimum.accumulate(at[::-1])[::-1]] > 0
    least = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    return small, least


def induce(
    text: np.ndarray, small: np.ndarray, least: np.ndarray, common: np.ndarray, folder: str,
    memory: int, counted: bool = True,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (positions, common prefixes) from the sorted local minima, from the last symbol to the
    first; inside a symbol ascending. A common prefix counts from the entry before; 0 at a symbol's
    first entry. If they are not `counted`, only the order means something."""
    cut = np.searchsorted(text[least], np.arange(SYMBOLS + 1))
    queues, kept = Queues(folder, memory), Queues(folder, memory)
    inducer = Inducer(text, ~small, queues, counted)
    for symbol in range(SYMBOLS):
        last = None
        for positions, shared in queues.pop(symbol):
            kept.push(symbol, positions, shared)
            inducer.scan(positions, shared)
            last = int(positions[-1])
        own = slice(cut[symbol], cut[symbol + 1])
        if own.start < own.stop:
            shared = common[own].copy()
            if counted and last is not None:
                shared[0] = _common(text, last, int(least[own.start]))
            else:
                shared[0] = 0
            inducer.scan(least[own], shared)
    queues = Queues(folder, memory)
    inducer = Inducer(text, small, queues, counted)
    for symbol in range(SYMBOLS - 1, -1, -1):
        positions, shared = [], []
        for p, s in queues.pop(symbol):
            positions.append(p)
            shared.append(s)
            inducer.scan(p, s)
        falling = np.concatenate(positions) if positions else np.zeros(0, np.int64)
        falling_shared = np.concatenate(shared) if shared else np.zeros(0, np.uint8)
        large = list(kept.pop(symbol))
        border = 0
        rising = np.concatenate([p for p, _ in large]) if large else np.zeros(0, np.int64)
        rising_shared = np.concatenate([s for _, s in large]) if large else np.zeros(0, np.uint8)
        if len(rising):
            if len(falling) and counted:
                border = _common(text, int(rising[-1]), int(falling[-1]))
            inducer.scan(rising[::-1], np.append(rising_shared[1:], border)[::-1])
        order = np.concatenate((rising, falling[::-1]))
        if len(order):
            values = np.concatenate((
                rising_shared, np.full(min(1, len(falling)), border, np.uint8),
                falling_shared[1:][::-1],
            ))
            values[0] = 0
            yield order, values


def _ranked_minima(
    text: np.ndarray, small: np.ndarray, least: np.ndarray, depth: int, folder: str, memory: int
) -> tuple[np.ndarray, np.ndarray]:
    """Local minima in suffix order (exact up to `depth` symbols) and their common prefixes."""
    begin = least[np.argsort(text[least], kind="stable")]
    is_least = np.zeros(len(text), bool)
    is_least[least] = True
    parts = [
        order[is_least[order]] for order, _ in
        induce(text, small, begin, np.zeros(len(begin), np.uint8), folder, memory, False)
    ]
    order = np.concatenate(parts[::-1])
    order = np.append(least[-1:], order)  # the final separator is induced by none
    prefix = np.zeros(len(text) + 1, np.uint64)
    up, _ = kernel.powers(len(text))
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up, out=prefix[1:])
    ends = np.empty(len(text), np.int64)
    ends[least] = np.append(least[1:], len(text) - 1) + 1
    pieces = kernel.range_hash(prefix, order, ends[order])
    name = np.cumsum(np.append(True, pieces[1:] != pieces[:-1])) - 1
    number = np.empty(len(text), np.int64)
    number[least] = np.arange(len(least))
    rank = np.empty(len(least), np.int64)
    rank[number[order]] = name
    covered = 1
    while name[-1] + 1 < len(least) and 2 * covered < depth + 2:
        after = np.full(len(rank), -1, np.int64)
        after[:-covered] = rank[covered:]
        pair = rank * (len(rank) + 1) + after + 1
        by = np.argsort(pair)
        name = np.cumsum(np.append(True, pair[by][1:] != pair[by][:-1])) - 1
        rank = np.empty(len(least), np.int64)
        rank[by] = name
        covered *= 2
    order = least[np.argsort(rank, kind="stable")]
    shared = np.zeros(len(order), np.int64)
    length = 1 << 8
    _, down = kernel.powers(len(prefix))
    while length:  # common prefixes of the minima by bisection over prefix hashes
        a, b = order[:-1] + shared[1:], order[1:] + shared[1:]
        fits = np.maximum(a, b) + length < len(prefix)
        a, b = np.where(fits, a, 0), np.where(fits, b, 0)
        end = np.where(fits, length, 0)
        same = (prefix[a + end] - prefix[a]) * down[a] == (prefix[b + end] - prefix[b]) * down[b]
        shared[1:] += np.where(fits & same, length, 0)
        length >>= 1
    return order, np.minimum(shared, CAP).astype(np.uint8)


def suffixes(
    text: np.ndarray, depth: int = WINDOW, memory: int = MEMORY
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, common prefix with the entry before) of the suffixes of `text`, by first symbol from
    the last to the first. `text` holds 0 .. 256 and ends in 0, the separator; the order is exact up to
    `depth` symbols, and common prefixes are counted up to CAP."""
    with tempfile.TemporaryDirectory() as folder:
        small, least = kinds(text)
        order, common = _ranked_minima(text, small, least, depth, folder, memory)
        yield from induce(text, small, order, common, folder, memory)


def repeated_strings(
    text: np.ndarray, group_of: np.ndarray, left: np.ndarray, window: int, memory: int = MEMORY
) -> np.ndarray:
    """Positions whose `window`-byte string also starts in a smaller group. `left`: bytes from each
    position to its separator."""
    out = []
    for order, common in suffixes(text, window, memory):
        string = np.cumsum(common < window)
        own = left[order] >= window
        order, string = order[own], string[own]
        if len(order) == 0:
            continue
        edge = np.flatnonzero(np.diff(string, prepend=string[0] - 1))
        groups = group_of[order]
        lowest = np.repeat(
            np.minimum.reduceat(groups, edge), np.diff(np.append(edge, len(order)))
        )
        out.append(order[groups > lowest])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def owners(
    units: repeats.Units, first: np.ndarray, window: int, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the anchors that own the windows at `first`, as `kernel.anchors` finds them."""
    places = first[:, None] + np.arange(window - seed + 1)
    grams = units.grams(seed, places)
    least = np.argmin(grams >> np.uint64(32), axis=1)
    return first + least, grams[np.arange(len(first)), least]


def reaches(
    units: repeats.Units, at: np.ndarray, first: np.ndarray, last: np.ndarray, window: int, seed: int
) -> np.ndarray:
    """Hashes of the bytes around each anchor that its windows contain, by how far they reach to the left:
    windows start up to `window` - `seed` bytes before their anchor, which makes `REACHES` stretches, and all
    windows of a stretch contain the bytes from its last start to its first end. 0: the span has not all of
    these bytes, and so no window of the stretch."""
    more = window - seed
    out = np.zeros((len(at), REACHES), np.uint64)
    for stretch in range(REACHES):
        begin = at - more * stretch // REACHES
        end = at + window - more * (stretch + 1) // REACHES
        own = np.flatnonzero((begin >= first) & (end <= last + window))
        out[own, stretch] = units.spans(begin[own], end[own])
    return out


def met(reach: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True for spans that share a reach with a span of another document."""
    out = np.zeros(len(doc), bool)
    for keys in reach.T:
        own = np.flatnonzero(keys)
        own = own[np.argsort(keys[own])]
        if len(own) == 0:
            continue
        edge = np.flatnonzero(np.append(True, keys[own][1:] != keys[own][:-1]))
        docs = doc[own]
        several = np.minimum.reduceat(docs, edge) != np.maximum.reduceat(docs, edge)
        out[own[np.repeat(several, np.diff(np.append(edge, len(own))))]] = True
    return out


def open_spans(
    batches: Iterator[pa.RecordBatch], parts: int, window: int, seed: int
) -> Iterator[pa.RecordBatch]:
    """The spans at PLACES, packed by part: a span that its document repeats is sent once, with all its
    places in `begin`."""
    for batch in kernel.slices(batches):
        units = repeats.Units(*kernel.string_bytes(batch.column("text")), False)
        places = [repeats.unpack(p) for p in batch.column(repeats.PLACES).to_pylist()]
        row = np.repeat(np.arange(len(places)), [len(p) for p in places])
        first, more = np.concatenate(places).T
        first = first + units.bounds[row]
        fits = first + more + window <= units.bounds[row + 1]  # not if another row of the id has them
        first, more = np.divmod(np.unique(first[fits] * window + more[fits]), window)
        if len(first) == 0:
            continue
        at, gram = owners(units, first, window, seed)
        row = units.document(first)
        part = (gram >> np.uint64(48)).astype(np.int64) % parts
        same = (units.spans(first, first + more + window), at - first, gram, row, part)
        order = np.lexsort(same)
        at, first, more, row, part = (x[order] for x in (at, first, more, row, part))
        new = np.append(True, np.any([np.diff(x[order]) != 0 for x in same], axis=0))
        one = np.flatnonzero(new)
        end = np.append(one[1:], len(at))
        size = more[one] + window
        text = units.data[np.repeat(first[one], size) + kernel.steps(size)]
        reach = reaches(units, at[one], first[one], (first + more)[one], window, seed)
        span = np.empty(len(one), SPAN)
        span["doc"] = batch.column("doc_id").to_numpy(zero_copy_only=False)[row[one]]
        span["size"], span["copies"], span["reach"] = size, end - one, reach
        begin = (first - units.bounds[row]).astype("<i4")
        edge = np.append(np.flatnonzero(np.diff(part[one], prepend=-1)), len(one))
        yield batch_of(
            part=part[one][edge[:-1]].astype(np.int32),
            text=binaries(text, np.append(0, np.cumsum(size))[edge]),
            span=binaries(span, edge), begin=binaries(begin, np.append(one, len(at))[edge]),
        )


def sort_shard(shard: pa.Table, window: int, memory: int) -> pa.Table:
    """The repeated strings of a part's open spans, as rows like those of `repeats.settled`."""
    raw, span, begin = (
        np.concatenate([np.frombuffer(x, kind) for x in shard[name].to_pylist()])
        for name, kind in (("text", np.uint8), ("span", SPAN), ("begin", "<i4"))
    )
    kept = met(span["reach"], span["doc"])
    raw, begin = raw[np.repeat(kept, span["size"])], begin[np.repeat(kept, span["copies"])]
    doc, size, copies = (span[x][kept].astype(np.int64) for x in ("doc", "size", "copies"))
    kind = pa.schema([("doc_id", pa.int64()), ("open", pa.bool_()), ("place", pa.binary())])
    if len(doc) == 0:
        return kind.empty_table()
    text = np.zeros(int(size.sum()) + len(size), np.int16)
    starts = np.cumsum(size + 1) - size - 1
    piece = np.repeat(np.arange(len(size)), size + 1)
    offset = np.arange(len(text)) - starts[piece]
    text[offset < size[piece]] = raw.astype(np.int16) + 1
    at = np.sort(repeated_strings(text, doc[piece], size[piece] - offset, window, memory))
    new = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # windows in a row make one place
    more = np.diff(np.append(new, len(at))) - 1
    at = at[new]
    times = copies[piece[at]]
    copy = np.repeat((np.cumsum(copies) - copies)[piece[at]], times) + kernel.steps(times)
    found = np.stack((begin[copy] + np.repeat(offset[at], times), np.repeat(more, times)), axis=1)
    rows = repeats._by_document(np.repeat(doc[piece[at]], times), found.astype("<i4"), 0)
    return pa.Table.from_batches(rows, kind)


def _sort_shards(window: int, seed: int, memory: int):
    """Settles open spans: their strings are sorted shard by shard."""

    def compare(texts: DataFrame, parts: int) -> DataFrame:
        # A shard is sorted by one task; more and smaller shards than claim parts bound its memory.
        cuts = arrow_map(
            texts.select("doc_id", "text", repeats.PLACES),
            lambda batches: open_spans(batches, parts * SHARDS_PER_PART, window, seed),
            "part int", "text binary", "span binary", "begin binary",
        )
        return cuts.groupBy("part").applyInArrow(
            lambda shard: sort_shard(shard, window, memory),
            "doc_id long, open boolean, place binary",
        )

    return compare


def removed_places(
    docs: DataFrame, window: int = WINDOW, seed: int = SEED, memory: int = MEMORY
) -> DataFrame:
    return repeats.repeated(docs, False, window, seed, False, _sort_shards(window, seed, memory))


def judge(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches):
            data, bounds = kernel.string_bytes(batch.column("text"))
            removed, spans, digests = [], [], []
            for row, places in enumerate(batch.column(repeats.PLACES).to_pylist()):
                own = data[bounds[row] : bounds[row + 1]]
                count = runs = 0
                if places:
                    gone = repeats.covered(repeats.unpack(places), len(own), window)
                    count, runs, own = int(gone.sum()), len(kernel.runs(gone)[0]), own[~gone]
                removed.append(count)
                spans.append(runs)
                digests.append(hashlib.sha256(own.tobytes()).hexdigest())
            yield batch_of(
                doc_id=batch.column("doc_id"), n_bytes=np.diff(bounds),
                n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(spans, pa.int64()),
                kept_sha256=pa.array(digests, pa.string()),
            )

    whole = repeats.with_places(keyed_texts(docs), removed_places(docs, window, seed))
    return arrow_map(
        whole, run,
        "doc_id long", "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string",
    )
