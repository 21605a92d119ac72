"""Near-duplicates by bottom-k sketches of one hash function.

1. The scan keeps, per document, the size and a 128-bit digest of its set of word shingles and the
   `SKETCH` lowest hashes. Documents with equal sets become one class, so exact copies, however many,
   cost one row each from here on.
2. Inverted lists: every run of `RUN` neighbouring retained values is a key. Two sets of similarity
   0.75 or more miss all common runs with a chance below 1e-7 (never, when the sets are small enough
   to be retained whole). In every list each class is paired with one leader only, which is the
   same for most lists of a group.
3. Pairs are filtered by the union sketch (the share of common values among the lowest of both) and
   confirmed on full sets; the confirmed links give components.
4. What a leader did not settle: lists that still hold several components. In a list of up to `MANY`
   members, those outside the leader's component are paired with the members of other components.
   The members of longer lists (a passage that many texts share, or a large group of near copies)
   are listed anew by the rarest of their `LONG` lowest values: texts that only share common values do
   not meet there, and texts with too many values of their own are in no list at all. The leader step
   and the pairing repeat on these lists, of any length.

The leader of a list is the member that shares most values with others, the centre of a group of near
copies. No pair inside a component is ever listed, and no list is cut.

Defined cases: texts without words have an empty set (0 shingles) and are linked with nothing, nor
with each other; shorter texts than one shingle are one shingle; repeated rows of one id keep one row
each and share the component; null texts are empty; empty tables give empty results; only doc_id and
text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.llm import kernel
from boxlake.llm.components import components
from boxlake.llm.frames import arrow_map, batch_of, freed, keyed_texts, stored
from boxlake.skew import sized_broadcast

WORDS = 5
PERCENT = 75
SKETCH = 64
LISTED, RUN = 32, 2
LONG = 512
MANY = 16
BEFORE = 8
# Of 512 lowest values a similar set shares 384 on average; 0.65 of them is 5 deviations below.
LEAST_LONG = 0.65
# A shared value has a chance of at least 0.75 in the union sketch; 0.45 of 64 is 5 deviations below.
LEAST_ESTIMATE = 0.45
BROADCAST_IDS = 1_000_000
_PAD = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document (A-Z folded)."""
    low = kernel.LOWER[data]
    starts, ends, docs = kernel.words(low, bounds)
    hashes = kernel.range_hash(kernel.prefix_hash(low), starts, ends)
    grams = kernel.gram_hash(hashes, words)
    out = []
    for a, b in zip(docs[:-1], docs[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            out.append(kernel.gram_hash(hashes[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def node_of(doc_id: str) -> Column:
    """The node of a class, a random rank: `xxhash64` of one long is one to one."""
    return F.xxhash64(F.col(doc_id).cast("long"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (two numbers), sketch (64-bit values, ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches):
            sets = shingle_sets(*kernel.string_bytes(batch.column("text")))
            mixed = [kernel.mix(s) for s in sets]
            yield batch_of(
                doc_id=batch.column("doc_id"),
                n_shingles=np.array([len(s) for s in sets], np.int64),
                digest_a=_signed(np.array([s.sum(dtype=np.uint64) for s in mixed], np.uint64)),
                digest_b=_signed(
                    np.array([np.bitwise_xor.reduce(s * np.uint64(3)) if len(s) else 0
                              for s in mixed], np.uint64)
                ),
                sketch=pa.array([s[:SKETCH].tobytes() for s in sets], pa.binary()),
            )

    return arrow_map(
        keyed_texts(docs), freed(run), "doc_id long", "n_shingles long", "digest_a long", "digest_b long",
        "sketch binary",
    )


def run_keys(values: np.ndarray, run: int) -> np.ndarray:
    """Keys of the runs of neighbouring values; a shorter set has one key, of all its values."""
    return kernel.gram_hash(values, min(run, len(values))) + np.uint64(min(run, len(values)))


def _listed(sketches: DataFrame, listed: int, run: int) -> DataFrame:
    """(key, node) of the runs over the `listed` lowest values of (node, sketch)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            keys = [
                run_keys(np.frombuffer(s, np.uint64)[:listed], run)
                for s in batch.column("sketch").to_pylist()
            ]
            for at in range(0, len(keys), 2_000):
                part = keys[at : at + 2_000]
                yield batch_of(
                    key=_signed(np.concatenate(part)),
                    node=np.repeat(nodes[at : at + 2_000], [len(k) for k in part]),
                )

    return arrow_map(sketches.select("node", "sketch"), rows, "key long", "node long")


def _shared(lists: DataFrame) -> DataFrame:
    """The lists with more than one member, each row with its list's leader: the member whose lists
    are longest together. Rows are dealt by list, by node and by list again, and nothing is read twice;
    the windows hold the rows of one list or node, and spill."""
    by_key, by_node = Window.partitionBy("key"), Window.partitionBy("node")
    common = lists.withColumn("members", F.count(F.lit(1)).over(by_key)).filter("members > 1")
    # One number orders by the sum and then by the random rank.
    order = F.least(F.sum("members").over(by_node), F.lit(1 << 40)) * (1 << 20) + F.pmod("node", F.lit(1 << 20))
    led = common.withColumn("central", order)
    leader = F.max_by("node", "central").over(by_key)
    return led.withColumn("leader", leader).drop("members", "central")


def _to_leaders(shared: DataFrame) -> DataFrame:
    return shared.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of common values among the lowest of the union, for rows of padded sketches."""
    both = np.sort(np.concatenate((left, right), axis=1), axis=1)
    real = both != _PAD
    new = np.ones(both.shape, bool)
    new[:, 1:] = both[:, 1:] != both[:, :-1]
    new &= real
    place = np.cumsum(new, axis=1)
    inside = real & (place <= SKETCH)
    common = (inside & ~new).sum(axis=1)
    return common / np.maximum(1, np.minimum(SKETCH, new.sum(axis=1)))


def _padded(sketches: list[bytes]) -> np.ndarray:
    out = np.full((len(sketches), SKETCH), _PAD)
    for row, sketch in enumerate(sketches):
        values = np.frombuffer(sketch, np.uint64)
        out[row, : len(values)] = values
    return out


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The distinct pairs whose sizes and union sketches allow the similarity."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            found = estimates(
                _padded(batch.column("sketch_a").to_pylist()),
                _padded(batch.column("sketch_b").to_pylist()),
            )
            own = batch.filter(pa.array(found >= LEAST_ESTIMATE))
            yield batch_of(a=own.column("a"), b=own.column("b"))

    side = classes.select("node", "n_shingles", "sketch")
    named = lambda s: side.toDF(s, f"n_{s}", f"sketch_{s}")
    # Dealt by b once, for the distinct pairs and for the join.
    sized = pairs.repartition("b").distinct().join(named("b"), "b").join(named("a"), "a").filter(
        (F.least("n_a", "n_b") * 100) >= (F.greatest("n_a", "n_b") * PERCENT)
    )
    return arrow_map(sized.select("a", "b", "sketch_a", "sketch_b"), keep, "a long", "b long")


def _texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the classes' first documents. Nodes are broadcast up to a counted bound,
    beyond it joined by a shuffle."""
    wanted = sized_broadcast(stored(nodes.distinct()), BROADCAST_IDS)
    own = keyed_texts(docs).withColumn("node", node_of("doc_id"))
    return own.join(wanted, "node").select("node", "text")


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs with 100 * common >= 75 * union on full sets."""
    pairs = stored(pairs)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    texts = stored(_texts_of(nodes, docs))
    rows = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, np.zeros(0, np.uint64)
        for batch in kernel.slices(batches, "text_b"):
            nodes = batch.column("a").to_pylist()
            sets = shingle_sets(*kernel.string_bytes(batch.column("text_b")))
            good = []
            for row, (node, own) in enumerate(zip(nodes, sets, strict=True)):
                if node != last:
                    one = batch.column("text_a").slice(row, 1)
                    last, known = node, shingle_sets(*kernel.string_bytes(one))[0]
                common = len(np.intersect1d(known, own, assume_unique=True))
                union = len(known) + len(own) - common
                good.append(union > 0 and 100 * common >= PERCENT * union)
            own = batch.filter(pa.array(good, pa.bool_()))
            yield batch_of(a=own.column("a"), b=own.column("b"))

    return arrow_map(rows.select("a", "b", "text_a", "text_b"), freed(keep), "a long", "b long")


def _unsettled(shared: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of the open lists, with the component (`part`) of each member, whether it is a `stray`, and
    the number of `members`: a list is open if a member stands outside its leader's component."""
    # Leaders make stars: two rounds settle them, and what is not settled yet is only paired again.
    labels = components(links, rounds=2)
    member = shared.join(labels.toDF("node", "label"), "node", "left").select(
        *shared.columns, F.coalesce("label", "node").alias("part")
    )
    by_key = Window.partitionBy("key")
    main = F.max(F.when(F.col("node") == F.col("leader"), F.col("part"))).over(by_key)
    apart = member.withColumn("stray", F.col("part") != main)
    return apart.withColumns({
        "strays": F.sum(F.col("stray").cast("long")).over(by_key), "members": F.count(F.lit(1)).over(by_key),
    }).filter("strays > 0").drop("strays")


def _least_common(x: str, y: str) -> str:
    """SQL for the number of listed values that similar sets of these sizes share at least: exact if both
    are listed whole. A set that is listed whole can have a partner that is not: then LONG * LEAST_LONG
    are shared, as between two cut lists, however many of its higher values the partner holds."""
    return f"""CASE WHEN greatest({x}, {y}) <= {LONG}
        THEN (({x} + {y}) * {PERCENT} + {99 + PERCENT}) div {100 + PERCENT} ELSE {int(LONG * LEAST_LONG)} END"""


def _unlike(own: DataFrame) -> DataFrame:
    """The rows of one list of those that have the same members, leader and strays: the values of a passage make
    as many lists. The one that comes first in the order of places comes first for each of its members,
    so that it lists every pair that the others list."""
    whole = own.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node", "stray", "leader").cast("decimal(20,0)")).alias("a"),
        F.bit_xor(F.xxhash64(F.lit(1), "node", "stray", "leader")).alias("b"),
        (F.sum("place") if "place" in own.columns else F.lit(0)).alias("places"),
    )
    first = whole.groupBy("n", "a", "b").agg(F.min_by("key", F.struct("places", "key")).alias("key"))
    return own.join(first.select("key"), "key")


def _stray_meetings(apart: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """(a, b) of each stray with the members of other components, in all lists or in the given ones; the
    leader has been tried before. Lists
    with places meet a pair where it has no other list among the `BEFORE` last ones of both: the first list
    of a pair is never passed over, and most of the later ones are."""
    own = _unlike(apart if lists is None else apart.join(lists.select("key"), "key"))
    rule, more = "px <> py AND (NOT both OR x < y)", []
    if "size" in own.columns:
        # The first value that two sets share, in the order of places, leaves room for all others they must
        # share: no later one needs to list the pair.
        rule += f"""
            AND least(sx, sy) * 100 >= greatest(sx, sy) * {PERCENT}
            AND least(kx - ox, ky - oy) + 1 >= {_least_common("sx", "sy")}
            AND NOT arrays_overlap(bx, by)"""
        more = ["size", "kept", "place", "before"]
        last = Window.partitionBy("node").orderBy("place").rowsBetween(-BEFORE, -1)
        own = own.withColumn("before", F.collect_list("key").over(last))
    own = stored(own)
    names = lambda s: [f"{m[0] if m != 'place' else 'o'}{s}" for m in more]
    stray = own.filter("stray").select("key", "node", "part", *more).toDF("key", "x", "px", *names("x"))
    other = own.filter("node <> leader").select("key", "node", "part", "stray", *more).toDF(
        "key", "y", "py", "both", *names("y")
    )
    met = stray.join(other, "key").filter(rule)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _stray_pairs(apart: DataFrame, lists: DataFrame) -> DataFrame:
    return _stray_meetings(apart, lists).distinct()


def _long_values(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, node, size, kept): the LONG lowest values of each class, the size of its set, and how
    many values are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches):
            sets = shingle_sets(*kernel.string_bytes(batch.column("text")))
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            kept = np.array([min(len(s), LONG) for s in sets])
            yield batch_of(
                key=_signed(np.concatenate([s[:LONG] for s in sets])), node=np.repeat(nodes, kept),
                size=np.repeat(np.array([len(s) for s in sets]), kept), kept=np.repeat(kept, kept),
            )

    return arrow_map(
        _texts_of(nodes, docs), run, "key long", "node long", "size long", "kept long"
    )


def _rarest(values: DataFrame) -> DataFrame:
    """(key, node, size, kept, place) of the values that similar sets cannot all miss.

    A set that is similar to another shares at least LEAST of its listed values with it, so with all
    values in one order (rarest first) the two share a value among the first listed - LEAST + 1.
    Values of one class only come first and meet nothing; a set with enough of them is in no list.
    `place` counts in that order: two sets of known sizes must meet further ahead (`_least_common`).
    """
    holders = F.count(F.lit(1)).over(Window.partitionBy("key"))
    common = values.withColumn("holders", holders).filter("holders > 1")
    least = F.least(F.ceil(F.col("kept") * PERCENT / 100), F.lit(int(LONG * LEAST_LONG)))
    node = Window.partitionBy("node")
    placed = common.withColumns({
        "place": F.row_number().over(node.orderBy("holders", "key")),
        "alone": F.col("kept") - F.count(F.lit(1)).over(node),
    }).withColumn("place", F.col("place") + F.col("alone"))
    return placed.filter(F.col("place") <= F.col("kept") - least + 1).select(
        "key", "node", "size", "kept", "place"
    )


def links(docs: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, confirmed links between classes that connect all similar classes)."""
    grouped = signed.filter("n_shingles > 0").groupBy("n_shingles", "digest_a", "digest_b").agg(
        F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")
    )
    classes = stored(grouped.select(node_of("rep").alias("node"), "*"))
    shared = stored(_shared(_listed(classes, LISTED, RUN)))
    found = stored(_confirmed(_likely(_to_leaders(shared), classes), docs))

    apart = stored(_unsettled(shared, found))
    pairs = _stray_meetings(apart.filter(F.col("members") <= MANY))
    crowded = apart.filter(F.col("members") > MANY).select("node")
    if crowded.isEmpty():
        more = _confirmed(_likely(pairs, classes), docs)
        return classes, stored(found.union(more))
    longer = stored(_shared(_rarest(_long_values(crowded, docs))))
    pairs = pairs.union(_to_leaders(longer))
    more = _confirmed(_likely(pairs, classes), docs)
    found = stored(found.union(more))
    pairs = _stray_meetings(stored(_unsettled(longer, found)))
    last = _confirmed(_likely(pairs, classes), docs)
    return classes, stored(found.union(last))


def group(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    signed = stored(signatures(docs))
    classes, found = links(docs, signed)
    labels = components(found)
    reps = classes.select("node", "rep")
    lowest = labels.join(reps, "node").groupBy("label").agg(F.min("rep").alias("component_id"))
    named = reps.join(
        labels.join(lowest, "label").select("node", "component_id"), "node", "left"
    ).select("node", F.coalesce("component_id", "rep").alias("component_id"))
    keys = ["n_shingles", "digest_a", "digest_b"]
    members = classes.select("node", *keys).join(named, "node").drop("node")
    return signed.select("doc_id", *keys).join(members, keys, "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def clean(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the one of the lowest doc_id."""
    dropped = group(docs).filter("NOT kept").select(F.col("doc_id").alias("_dropped_id"))
    small = sized_broadcast(stored(dropped.distinct()), BROADCAST_IDS)
    return docs.join(small, docs["doc_id"] == small["_dropped_id"], "left_anti")
