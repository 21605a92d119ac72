from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent)]

KIND = "doc_id long, text string, lang string, source string, n_chars long, n_words long, places string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus() -> dict[int, str | None]:
    """Hot copies, near copies, shared passages, long, empty and null texts."""
    rng = random.Random(7)
    passage, base = sentence(rng, 60), sentence(rng, 160)
    docs: dict[int, str | None] = {0: None, 1: "", 2: " \n\t ", 3: "One two", 4: "one TWO"}
    for i in range(5, 45):  # a third of all rows
        docs[i] = "Exact copy of " + base
    for i in range(45, 65):  # near copies, some of them chained
        w = base.split()
        for at in rng.sample(range(len(w)), rng.randint(1, 6)):
            w[at] = sentence(rng, 1)
        docs[i] = " ".join(w)
    for i in range(65, 85):
        docs[i] = f"{sentence(rng, rng.randint(5, 90))}\n{passage} {sentence(rng, rng.randint(0, 40))}"
    for i in range(85, 115):
        docs[i] = "\n".join(sentence(rng, rng.randint(1, 30)) + "." for _ in range(rng.randint(1, 6)))
    docs[115] = sentence(rng, 30_000) + " " + passage + " é日本😀 " + "x" * 5_000
    docs[116] = (sentence(rng, 12) + "\n") * 40
    docs[117] = passage
    return docs


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def frame(spark):
    """A table of texts with columns whose names clash with the operators' own."""

    def make(docs, repeat=()):
        rows = [(k, t, "en", "src0", len(t or ""), -1, "own") for k, t in docs.items()]
        rows += [r for r in rows if r[0] in repeat]
        return spark.createDataFrame(rows, KIND).repartition(7)

    return make


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KIND)
