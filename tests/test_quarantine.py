"""Repair and restore of a dataset folder, byte for byte, also after a repair that broke."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from boxlake.operators import quarantine

LABELS = {
    "train/labels/a.txt": b"0 0.5 0.5 0.2 0.2\n1 0.95 0.5 0.2 0.1\n",  # the second box leaves the image
    "train/labels/b.txt": b"0 0.5 0.5 0.2 0.2",
    "valid/labels/c.txt": "﻿2 0.5 0.5 0.2 0.2\r\n\r\n2 0.05 0.5 0.2 0.25\r\n".encode(),
    "valid/labels/d.txt": b"",
    "test/labels/e.txt": b"0 0.98 0.5 0.2 0.2\n1 oops 0.5 0.2 0.1\n",  # a line that cannot be read
    "test/labels/f.txt": b"0 0.98 0.5 0.2 0.2\n",
    "test/labels/g.txt": b"7 0.5 0.5 0.2 0.2",  # invalid by its class: written anew, with equal values
}
IMAGES = {
    "train/images/a.png": b"one", "train/images/b.jpg": b"two", "valid/images/c.png": b"one",
    "valid/images/d.png": b"three", "test/images/e.png": b"two", "test/images/f.png": b"two",
    "test/images/g.png": b"four", "test/images/readme.md": b"no image",
}
CLAMPED = {"test/labels/g.txt": b"7 0.5 0.5 0.2 0.2\n", "test/labels/f.txt": b"0 0.94 0.5 0.12 0.2\n", "valid/labels/c.txt": b"2 0.5 0.5 0.2 0.2\n2 0.075 0.5 0.15 0.25\n"}
# Copies: the highest split stays, then the one with more boxes.
REMOVED = ["train/images/a.png", "train/images/b.jpg", "test/images/e.png"]


def tree(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


@pytest.fixture
def dataset(tmp_path):
    root = tmp_path / "set"
    for name, content in {**LABELS, **IMAGES}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return root


def test_a_repair_is_taken_back_byte_for_byte(spark, dataset, tmp_path):
    before = tree(dataset)
    root, aside = f"file://{dataset}", f"file://{tmp_path}/aside"
    assert quarantine.repair(spark, root, aside) == {"exact-duplicates": 6, "annotation-originals": 3}
    labels = [n.replace("/images/", "/labels/").rsplit(".", 1)[0] + ".txt" for n in REMOVED]
    want = {n: c for n, c in before.items() if n not in REMOVED + labels} | CLAMPED
    assert tree(dataset) == want
    held = tree(tmp_path / "aside")
    assert all(held[f"exact-duplicates/{n}"] == before[n] for n in REMOVED + labels)
    assert all(held[f"annotation-originals/{n}"] == before[n] for n in CLAMPED)
    assert quarantine.committed(aside)
    with pytest.raises(FileExistsError):
        quarantine.repair(spark, root, aside)
    for _ in range(2):
        assert quarantine.restore(spark, root, aside) == 9
        assert tree(dataset) == before


@pytest.mark.parametrize("phases", [(), (1,), (1, 2)])
def test_a_broken_repair_is_taken_back(spark, dataset, tmp_path, phases, monkeypatch):
    before = tree(dataset)
    root, aside = f"file://{dataset}", f"file://{tmp_path}/aside"
    whole = quarantine._carried_out

    def breaks(log, root, folder, undo):
        if undo:
            return whole(log, root, folder, undo)
        phase = log.first().phase
        # The last phase that starts is only half done.
        part = log if phase in phases[:-1] else log.filter(F.xxhash64("path") % 2 == 0)
        if phase in phases:
            whole(part, root, folder, undo)
        if not phases or phase == phases[-1]:
            raise RuntimeError("lost")

    monkeypatch.setattr(quarantine, "_carried_out", breaks)
    with pytest.raises(RuntimeError):
        quarantine.repair(spark, root, aside)
    assert not quarantine.committed(aside)
    quarantine.restore(spark, root, aside)
    assert tree(dataset) == before


def test_a_log_that_was_never_finished_changes_nothing(spark, dataset, tmp_path):
    before = tree(dataset)
    (tmp_path / "aside" / "log").mkdir(parents=True)
    (tmp_path / "aside" / "log" / "part-0.parquet").write_bytes(b"torn")
    assert quarantine.restore(spark, f"file://{dataset}", f"file://{tmp_path}/aside") == 0
    assert quarantine.restore(spark, f"file://{dataset}", f"file://{tmp_path}/none") == 0
    assert tree(dataset) == before
