"""The spans of the suffix operator that agree only in part: which of them are sorted, and what is found."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from boxlake.llm import kernel, repeats, suffixes

WINDOW, SEED = suffixes.WINDOW, suffixes.SEED


def places(texts: list[bytes]) -> list[list[bytes]]:
    """All anchors' (first window, further windows) of each text."""
    out = []
    for text in texts:
        data = np.frombuffer(text, np.uint8)
        units = repeats.Units(data, np.array([0, len(data)]), False)
        _, first, last = kernel.anchors(units.grams(SEED), units.bounds, WINDOW, SEED)
        out.append([np.stack((first, last - first), axis=1).astype("<i4").tobytes()])
    return out


def found(texts: list[bytes], claimed: list[list[bytes]], monkeypatch) -> tuple[list[set[int]], list[int]]:
    """Window starts that each text loses, and the bytes that were sorted."""
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array([t.decode() for t in texts]),
         pa.array(claimed, pa.list_(pa.binary()))],
        ["doc_id", "text", repeats.PLACES],
    )
    sizes, real = [], suffixes.repeated_strings
    monkeypatch.setattr(
        suffixes, "repeated_strings", lambda text, *rest: sizes.append(len(text)) or real(text, *rest)
    )
    out = [set() for _ in texts]
    shards = list(suffixes.open_spans(iter([batch]), 1, WINDOW, SEED))
    got = suffixes.sort_shard(pa.Table.from_batches(shards), WINDOW, 100) if shards else None
    for row in got.to_pylist() if got else []:
        for first, more in repeats.unpack([row["place"]]):
            out[row["doc_id"]] |= set(range(first, first + more + 1))
    return out, sizes


def plain(texts: list[bytes]) -> list[set[int]]:
    seen, out = set(), []
    for text in texts:
        own = [text[i : i + WINDOW] for i in range(len(text) - WINDOW + 1)]
        out.append({i for i, w in enumerate(own) if w in seen})
        seen |= set(own)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_open_spans_lose_what_the_plain_search_finds(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    letters = np.frombuffer(b"ab cdefg\n", np.uint8)[: rng.integers(2, 10)]
    word = lambda n: rng.choice(letters, n).tobytes()
    base = word(300)
    texts = [word(rng.integers(0, 90))]
    for _ in range(14):
        start = rng.integers(0, 240)
        part = base[start : start + rng.integers(47, 60)]
        texts.append(word(rng.integers(0, 40)) + part * rng.integers(1, 4) + word(rng.integers(0, 40)))
    got, _ = found(texts, places(texts), monkeypatch)
    assert got == plain(texts)


def test_spans_that_share_only_their_seed_are_not_sorted(monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda n: rng.choice(np.frombuffer(b"abcdefgh", np.uint8), n).tobytes()
    seed = word(SEED + 14)
    texts = [word(90) + seed + word(90) for _ in range(60)]
    got, sizes = found(texts, places(texts), monkeypatch)
    assert got == plain(texts) == [set()] * 60
    assert sum(sizes) == 0


def test_a_span_that_its_document_repeats_is_sorted_once(monkeypatch):
    line = b"Areanerator rested under the old stone bridge. "
    texts = [b"x" + line * 3, line * 400 + b"y"]
    got, sizes = found(texts, places(texts), monkeypatch)
    assert got == plain(texts)
    assert sum(sizes) < 3_000


def test_places_beyond_the_text_of_a_row_are_left_out(monkeypatch):
    """Rows of one doc_id with different texts pool their places."""
    long, short = bytes(range(40, 120)) * 2, b"short text"
    own = places([long])[0]
    got, _ = found([short, long, long], [own, own, own], monkeypatch)
    assert got == plain([short, long, long])
