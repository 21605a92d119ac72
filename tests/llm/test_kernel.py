from __future__ import annotations

import brute
import numpy as np
import pyarrow as pa
import pytest

from boxlake.llm import kernel, suffixes


def test_words_and_hashes_equal_the_plain_ones():
    column = pa.array(["a  bé\tc", None, "", "\n", "bé a", "c" * 3000])
    data, bounds = kernel.string_bytes(column)
    starts, ends, docs = kernel.words(data, bounds)
    got = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert got == [w for t in column.to_pylist() for w in brute.words(t)]
    assert np.diff(docs).tolist() == [len(brute.words(t)) for t in column.to_pylist()]
    hashes = kernel.range_hash(kernel.prefix_hash(data), starts, ends)
    assert len(set(hashes.tolist())) == len(set(got))
    assert hashes[0] == hashes[got.index("a", 1)]


def test_slices_keep_documents_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", "", "cdefgh", "i", None])], ["text"])
    parts = [b.column(0).to_pylist() for b in kernel.slices(iter([batch]), limit=3)]
    assert parts == [["ab", ""], ["cdefgh"], ["i", None]]


@pytest.mark.parametrize("window, k", [(5, 2), (20, 8), (7, 7)])
def test_every_window_has_one_owner_chosen_by_content(window, k):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 6, 400).astype(np.uint64)
    bounds = np.array([0, 0, 3, 150, 400])
    grams = kernel.gram_hash(values, k)
    at, first, last = kernel.anchors(grams, bounds, window, k)
    owned, seen = {}, {}
    for a, f, l in zip(at, first, last, strict=True):
        for start in range(f, l + 1):
            owned[start] = a - start
    assert sorted(owned) == kernel.inside(bounds, window).tolist()
    for start, offset in owned.items():
        assert 0 <= offset <= window - k
        key = tuple(values[start : start + window])
        assert seen.setdefault(key, offset) == offset


@pytest.mark.parametrize("memory", [0, 40, 10**6])
def test_induced_suffixes_with_queues_on_disk(memory):
    rng = np.random.default_rng(memory + 1)
    for _ in range(25):
        text = np.append(rng.integers(0, rng.integers(2, 6), rng.integers(1, 200)), [1, 0])
        got = list(suffixes.suffixes(text.astype(np.int16), 300, memory))[::-1]
        order = np.concatenate([o for o, _ in got]).tolist()
        common = np.concatenate([c for _, c in got]).tolist()
        plain = text.tolist()
        assert order == sorted(range(len(plain) - 1), key=lambda i: plain[i:])
        for a, b, c in zip(order, order[1:], common[1:], strict=False):
            n = 0
            while max(a, b) + n < len(plain) and plain[a + n] == plain[b + n]:
                n += 1
            assert c == min(n, suffixes.CAP)


def test_a_worker_gives_up_what_its_last_operator_kept():
    from boxlake.llm import frames, pieces

    other = frames.freed(lambda batches: batches)
    own = frames.freed(lambda batches: batches, pieces.forget)
    list(own(iter([])))
    pieces._solved["model"] = {"word": b"ids"}
    list(own(iter([])))
    assert pieces._solved
    list(other(iter([])))
    assert not pieces._solved
