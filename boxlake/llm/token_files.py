"""Token ids in shard files with a minimal perfect hash index.

`write` encodes every text in the scan and writes, per range of doc_id, one raw payload
(`NNNNN.ids`: little-endian 16- or 32-bit ids, documents in ascending order) and one index
(`NNNNN.idx`). The index is a cascade of bitmaps: at each level the keys that hash to a bit of their
own take it, the rest go on; the rank of the set bit is the key's slot, and the slot holds a 32-bit
fingerprint, offset and length. A lookup is a few hashes and one read, whatever the shard's size.
`read` looks documents up by key and reads their ids from the payload.

Shards are cut by doc_id borders, so their order is the order of all documents. Files appear under
their final name only when complete, so a repeated task replaces whole files.

Defined cases: null and empty texts hold the end id only; rows with an equal doc_id lie side by side,
ordered by payload, and are addressed by (doc_id, occurrence); a key that is not in the files gives no
row; an empty table writes no shard; only doc_id and text are read.
"""

from __future__ import annotations

import functools
import io
import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.llm import kernel
from boxlake.llm.frames import arrow_map, batch_of, keyed_texts

SHARD_BYTES = 32_000_000
CACHED_WORDS = 500_000
LEVELS = 40
_KEY = np.uint64(0xA0761D6478BD642F)


# --- minimal perfect hash ---------------------------------------------------------------------

def key_hash(doc_ids: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return kernel.mix(
        kernel.mix(doc_ids.astype(np.int64).view(np.uint64)) + occurrence.astype(np.uint64) * _KEY
    )


def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * int(_KEY) % (1 << 64))
    return kernel.mix(keys + salt) % np.uint64(size)


def build_levels(keys: np.ndarray, load: float = 2.0) -> list[np.ndarray]:
    """Bitmaps (as booleans) in which each of the distinct keys has a bit of its own."""
    levels = []
    while len(keys):
        if len(levels) == LEVELS:
            raise ValueError("equal key hashes")
        size = max(8, int(len(keys) * load))
        bits = _bit(keys, len(levels), size).astype(np.int64)
        alone = np.bincount(bits, minlength=size) == 1
        levels.append(alone)
        keys = keys[~alone[bits]]
    return levels


def slots(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Slot of each key, 0 .. n - 1 without gaps; -1 where no level has it."""
    out = np.full(len(keys), -1, np.int64)
    base, todo = 0, np.arange(len(keys))
    for number, level in enumerate(levels):
        rank = np.cumsum(level) - 1
        bits = _bit(keys[todo], number, len(level)).astype(np.int64)
        hit = level[bits]
        out[todo[hit]] = base + rank[bits[hit]]
        base += int(level.sum())
        todo = todo[~hit]
    return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (kernel.mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def pack_index(keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bytes:
    levels = build_levels(keys)
    at = slots(keys, levels)
    table = {
        "levels": np.array([len(x) for x in levels], np.int64),
        "bits": np.packbits(np.concatenate(levels)) if levels else np.zeros(0, np.uint8),
        "prints": np.zeros(len(keys), np.uint32), "starts": np.zeros(len(keys), np.int64),
        "sizes": np.zeros(len(keys), np.int64),
    }
    table["prints"][at], table["starts"][at], table["sizes"][at] = fingerprints(keys), starts, sizes
    out = io.BytesIO()
    np.savez(out, **table)
    return out.getvalue()


class Index:
    def __init__(self, raw: bytes):
        table = np.load(io.BytesIO(raw))
        sizes = table["levels"]
        bits = np.unpackbits(table["bits"])[: int(sizes.sum())].astype(bool)
        self.levels = np.split(bits, np.cumsum(sizes)[:-1]) if len(sizes) else []
        self.prints, self.starts, self.sizes = table["prints"], table["starts"], table["sizes"]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, start, size) of each key; a wrong fingerprint means that the key is not there."""
        at = slots(keys, self.levels)
        found = at >= 0
        safe = np.where(found, at, 0)
        if len(self.prints) == 0:
            return found, safe, safe
        found &= self.prints[safe] == fingerprints(keys)
        return found, self.starts[safe], self.sizes[safe]


# --- tokenizer --------------------------------------------------------------------------------

@functools.lru_cache(maxsize=2)
def load(tokenizer: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


# A word of letters that need no normalisation but lower case, with other signs after it, among lines of
# one word each (other words give two empty parts). Such a word is two pieces to the tokenizer's own
# split, so its letters can be coded apart and kept.
_PLAIN = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]++)([!-&(-/:-@\[-`{-~]*+)|.+)$", re.MULTILINE)
_END_OF_WORD = "</w>"


class Words:
    """Raw ids of words, kept per worker; for tokenizers that drop white space, never join across it
    and fold case (`by_word`). Plain letters are coded many at a time: an id that ends a word tells
    where the next one begins."""

    def __init__(self, tokenizer: str, kind: str):
        self.model, self.kind = load(tokenizer), kind
        self.whole: dict[bytes, bytes] = {}
        self.letters: dict[str, bytes] = {}
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(_END_OF_WORD)]] = True

    def _code(self, texts: list[str]) -> list[bytes]:
        coded = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, self.kind).tobytes() for c in coded]

    def _code_letters(self, words: list[str]) -> None:
        for at in range(0, len(words), 200):
            part = words[at : at + 200]
            line = self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(line[0].ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                raw, cuts = ids.tobytes(), (cuts * ids.itemsize).tolist()
                coded = [raw[a:b] for a, b in zip([0, *cuts], cuts)]
            else:
                coded = self._code(part)
            self.letters.update(zip(part, coded, strict=True))

    def learn(self, words: list[bytes]) -> None:
        """Code the words that are not known yet."""
        if len(self.whole) > CACHED_WORDS:
            self.whole.clear()
        if len(self.letters) > CACHED_WORDS:
            self.letters.clear()
        fresh = [w for w in words if w not in self.whole]
        if not fresh:
            return
        lines = b"\n".join(fresh).decode("utf-8", "surrogatepass")
        letters, signs = zip(*_PLAIN.findall(lines))
        letters = "\n".join(letters).lower().split("\n")
        known = self.letters
        known[""] = b""
        more = list(set(signs).difference(known))
        known.update(zip(more, self._code(more), strict=True))
        self._code_letters(list(set(letters).difference(known)))
        parts = map(known.__getitem__, letters), map(known.__getitem__, signs)
        self.whole.update(zip(fresh, map(operator.add, *parts), strict=True))
        other = [w for w, x in zip(fresh, letters, strict=True) if not x]
        coded = self._code([w.decode("utf-8", "surrogatepass") for w in other])
        self.whole.update(zip(other, coded, strict=True))


@functools.lru_cache(maxsize=2)
def words_of(tokenizer: str, kind: str) -> Words:
    return Words(tokenizer, kind)


def id_type(tokenizer: str) -> str:
    size = load(tokenizer).get_vocab_size(with_added_tokens=True)
    return "<u2" if size <= 1 << 16 else "<u4"


def encode_texts(tokenizer: str, texts: list[str], by_word: bool, kind: str) -> list[bytes]:
    """Raw ids of each text. With `by_word`, distinct words are coded once per worker."""
    if not by_word:
        coded = load(tokenizer).encode_batch(texts, add_special_tokens=False)
        return [np.array(c.ids, kind).tobytes() for c in coded]
    known = words_of(tokenizer, kind)
    raw = b"".join(coded := [t.encode("utf-8", "surrogatepass") for t in texts])
    data, bounds = np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, coded)])
    starts, ends, docs = kernel.words(data, bounds)
    if len(starts) == 0:
        return [b""] * len(texts)
    first, which = _distinct(data, starts, ends)
    words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    known.learn(words)
    coded = list(map(known.whole.__getitem__, words))
    flat = np.frombuffer(b"".join(coded), kind)
    sizes = np.array(list(map(len, coded)), np.int64) // flat.itemsize
    counts = sizes[which]
    total = np.concatenate(([0], np.cumsum(counts)))
    shift = (np.cumsum(sizes) - sizes)[which] - total[:-1]
    ids = flat[np.repeat(shift, counts) + np.arange(total[-1])].tobytes()
    cuts = (total[docs] * flat.itemsize).tolist()
    return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each distinct word, which of them each word is)."""
    hashes = kernel.range_hash(kernel.prefix_hash(data), starts, ends)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    sizes, here = ends - starts, starts[first][which]
    if (sizes == sizes[first][which]).all():
        at = np.repeat(starts, sizes) + (steps := kernel.steps(sizes))
        if (data[at] == data[np.repeat(here, sizes) + steps]).all():
            return first, which
    every = np.arange(len(starts))  # two words share a hash
    return every, every


# --- files ------------------------------------------------------------------------------------

def open_fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return pa.fs.FileSystem.from_uri(path)


def _write_whole(fs: pa.fs.FileSystem, folder: str, name: str, fill) -> None:
    """Fill a file under a name of this attempt, then give it its final name."""
    context = TaskContext.get()
    own = f"{folder}/.{name}.{context.taskAttemptId() if context else 0}"
    with fs.open_output_stream(own) as out:
        fill(out)
    fs.move(own, f"{folder}/{name}")


def borders_of(docs: DataFrame, shard_bytes: int) -> list[int]:
    """doc_id borders of shards of about `shard_bytes` of text; only the borders reach the driver."""
    ids = F.col("doc_id").cast("long")
    sizes = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    n = max(1, -(-(sizes[0] or 0) // shard_bytes))
    if n == 1:
        return []
    steps = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = docs.agg(F.percentile_approx(ids, steps, F.lit(10 * n + 1000))).first()[0]
    return sorted({c for c in cuts or [] if c is not None})


def _shard(borders: list[int]):
    cuts = F.array(*[F.lit(b).cast("long") for b in borders]).cast("array<long>")
    if not borders:
        return F.lit(0)
    return F.size(F.filter(cuts, lambda b: b <= F.col("doc_id")))


def _shard_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(shard, slice of one shard) of rows sorted by shard."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        numbers = batch.column("shard").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(numbers)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
            yield int(numbers[start]), batch.slice(int(start), int(end - start))


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, by_word: bool = True,
    shard_bytes: int = SHARD_BYTES,
) -> dict:
    """Write all documents; returns the manifest (folder, id type, borders, ids before each shard)."""
    rows = keyed_texts(docs)
    kind = id_type(tokenizer)
    borders = borders_of(rows, shard_bytes)
    tail = np.array([end_id], kind).tobytes()
    # The folder is on the driver's file system as well as the workers': a shared one.
    open_fs(folder)[0].create_dir(open_fs(folder)[1], recursive=True)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            coded = encode_texts(tokenizer, texts, by_word, kind)
            payload = pa.array([c + tail for c in coded], pa.binary())
            yield batch_of(doc_id=batch.column("doc_id"), payload=payload)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        width = np.dtype(kind).itemsize
        feed = _shard_batches(batches)
        ahead = next(feed, None)
        while ahead is not None:
            number = ahead[0]
            ids, sizes = [], []

            def fill(out):
                nonlocal ahead
                while ahead is not None and ahead[0] == number:
                    data, bounds = kernel.string_bytes(ahead[1].column("payload"))
                    out.write(data.tobytes())
                    ids.append(ahead[1].column("doc_id").to_numpy(zero_copy_only=False))
                    sizes.append(np.diff(bounds) // width)
                    ahead = next(feed, None)

            _write_whole(fs, path, f"{number:05d}.ids", fill)
            keys, counts = np.concatenate(ids), np.concatenate(sizes)
            first = np.searchsorted(keys, keys)
            starts = np.cumsum(counts) - counts
            index = pack_index(key_hash(keys, np.arange(len(keys)) - first), starts, counts)
            _write_whole(fs, path, f"{number:05d}.idx", lambda out, raw=index: out.write(raw))
            yield batch_of(
                shard=np.array([number], np.int32), n_ids=np.array([counts.sum()], np.int64)
            )

    coded = arrow_map(rows, code, "doc_id long", "payload binary")
    placed = coded.withColumn("shard", _shard(borders)).repartition(len(borders) + 1, "shard")
    done = arrow_map(
        placed.sortWithinPartitions("shard", "doc_id", "payload"), save, "shard int", "n_ids long"
    ).collect()  # one small row per shard
    counts = dict.fromkeys(range(len(borders) + 1), 0) | {r["shard"]: r["n_ids"] for r in done}
    before, total = {}, 0
    for number in sorted(counts):
        before[number] = total
        total += counts[number]
    return {"folder": folder, "kind": kind, "borders": borders, "before": before,
            "shards": sorted(r["shard"] for r in done)}


def read(keys: DataFrame, manifest: dict) -> DataFrame:
    """doc_id, occurrence, start, n_tokens and ids_crc32 of each key (doc_id, occurrence) found."""
    folder, kind, before = manifest["folder"], manifest["kind"], manifest["before"]
    written = set(manifest["shards"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        width, number, index, payload = np.dtype(kind).itemsize, None, None, None
        for shard, batch in _shard_batches(batches):
            if shard not in written:
                continue
            if shard != number:
                number = shard
                with fs.open_input_stream(f"{path}/{shard:05d}.idx") as raw:
                    index = Index(raw.read())
                payload = fs.open_input_file(f"{path}/{shard:05d}.ids")
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            nth = batch.column("occurrence").to_numpy(zero_copy_only=False)
            found, starts, sizes = index.find(key_hash(ids, nth))
            sums = np.zeros(len(ids), np.int64)
            for i in np.flatnonzero(found):
                raw = payload.read_at(int(sizes[i]) * width, int(starts[i]) * width)
                sums[i] = zlib.crc32(np.frombuffer(raw, kind).astype("<u4").tobytes())
            yield batch_of(
                doc_id=ids[found], occurrence=nth[found], start=(starts + before[shard])[found],
                n_tokens=sizes[found], ids_crc32=sums[found],
            )

    placed = keys.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("occurrence").cast("long").alias("occurrence")
    ).withColumn("shard", _shard(manifest["borders"]))
    placed = placed.repartition(len(manifest["borders"]) + 1, "shard")
    return arrow_map(
        placed.sortWithinPartitions("shard", "doc_id"), look_up,
        "doc_id long", "occurrence long", "start long", "n_tokens long", "ids_crc32 long",
    )


def keys_of(docs: DataFrame) -> DataFrame:
    """(doc_id, occurrence) of all rows: repeated ids are numbered from 0."""
    counted = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("occurrence")
    )
