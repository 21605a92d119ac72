"""Toxicity by a weighted lexicon.

Texts are folded first: case, look-alike letters of other scripts and digits that stand for letters
become plain letters, everything else a single space. The lexicon holds word beginnings and whole
words with log-odds weights learned from labelled rows, and exception phrases: words (alone or with
the next one) that contain an entry but occur in clean rows. An Aho-Corasick automaton finds all
entries in one pass; the longest entry at a word counts, exceptions are skipped, and a logistic curve
over the matched weight and the document's length gives the score.

Bounds: the lexicon is fitted on at most `max_rows` labelled rows (those with the lowest hash of
their id), from at most `max_candidates` counted entries, and keeps at most `max_terms`; only these
bounded tables reach the driver. Every document is scored, whole.

Defined cases: null and empty texts get the score of a text without matches; labels that are null
are not used; of several labels of one id the highest counts; without a toxic training row the
lexicon is empty and all scores are the base rate; repeated rows are scored alike; only doc_id and
text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.llm.frames import arrow_map, batch_of, keyed_texts

# Letters of other scripts that look like Latin ones, and digits used for letters.
LOOKALIKES = dict(zip(
    "аесорхуіјѕԁһӏкмтвнαεικνορτυχ０１２３４５６７８９",
    "aecopxyijsdhlkmtbhaeiknoptux0123456789",
    strict=True,
))
DIGITS = dict(zip("013457@", "oieasta", strict=True))
_FOLD = str.maketrans({c: DIGITS.get(x, x) for c, x in {**LOOKALIKES, **DIGITS}.items()})
_OTHER = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Settings:
    max_rows: int = 20_000
    max_candidates: int = 50_000
    max_terms: int = 5_000
    least_toxic_rows: int = 4
    least_weight: float = 2.0
    shortest: int = 3
    longest: int = 9


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # " start" or " whole word "
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self):
        """None without entries."""
        if not self.weights:
            return None
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        found.make_automaton()
        return found


def fold(text: str | None) -> str:
    """Words of plain lower-case letters, a space before and after each."""
    return f" {_OTHER.sub(' ', (text or '').lower().translate(_FOLD)).strip()} "


def terms_of(folded: str, settings: Settings) -> set[str]:
    """All entries that a document could match: word beginnings and whole words."""
    found = set()
    for word in set(folded.split()):
        found.add(f" {word} ")
        for size in range(settings.shortest, min(len(word), settings.longest) + 1):
            found.add(f" {word[:size]}")
    return found


def matched(folded: str, automaton, exceptions: set[str]) -> float:
    """Total weight of a document: the longest entry of each matched word, without exceptions."""
    if automaton is None:
        return 0.0
    best: dict[int, tuple[int, float]] = {}
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if start not in best or size > best[start][0]:
            best[start] = (size, weight)
    total = 0.0
    for start, (_, weight) in best.items():
        close = folded.find(" ", start + 1)
        if folded[start + 1 : close] in exceptions:
            continue
        then = folded.find(" ", close + 1)
        if then > 0 and folded[start + 1 : then] in exceptions:
            continue
        total += weight
    return total


def curve_inputs(total: float, n_words: int) -> tuple[float, float, float]:
    """Constant, matched weight and length, the last two on a log scale."""
    return 1.0, math.log1p(total), math.log1p(n_words)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _weight(toxic, clean, n_toxic: int, n_clean: int) -> Column:
    return F.log((toxic + 0.5) / (n_toxic + 1.0)) - F.log((clean + 0.5) / (n_clean + 1.0))


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + 1e-3 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Lexicon:
    """Lexicon and curve from labelled rows that are not held out."""
    ids = (
        labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows)
    )
    # At most max_rows pairs of numbers: a bounded broadcast.
    rows = keyed_texts(docs).join(F.broadcast(ids), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(
                batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True
            ):
                (toxic if label else clean).update(terms_of(fold(text), settings))
        terms = list(toxic.keys() | clean.keys())
        yield batch_of(
            term=pa.array(terms, pa.string()),
            toxic=pa.array([toxic[t] for t in terms], pa.int64()),
            clean=pa.array([clean[t] for t in terms], pa.int64()),
        )

    sizes = rows.groupBy("toxic").count().collect()
    n_toxic = sum(r["count"] for r in sizes if r["toxic"])
    n_clean = sum(r["count"] for r in sizes if not r["toxic"])
    if n_toxic == 0:
        return Lexicon()
    counted = (
        arrow_map(rows.select("text", "toxic"), count, "term string", "toxic long", "clean long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(F.col("toxic") >= settings.least_toxic_rows)
        .withColumn("weight", _weight(F.col("toxic"), F.col("clean"), n_toxic, n_clean))
    )
    counted = counted.orderBy(F.desc("toxic"), "term").limit(settings.max_candidates).collect()
    lexicon = choose(counted, settings)
    lexicon.exceptions = exceptions_of(counted, lexicon)
    weights, exceptions = lexicon.weights, lexicon.exceptions

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(weights, exceptions).automaton()
        for batch in batches:
            folded = [fold(t) for t in batch.column("text").to_pylist()]
            yield batch_of(
                total=pa.array([matched(f, own, exceptions) for f in folded], pa.float64()),
                n_words=pa.array([f.count(" ") - 1 for f in folded], pa.int64()),
                toxic=batch.column("toxic"),
            )

    # At most max_rows rows of three numbers.
    points = arrow_map(
        rows.select("text", "toxic"), measure, "total double", "n_words long", "toxic int"
    ).collect()
    x = np.array([curve_inputs(r["total"], r["n_words"]) for r in points])
    lexicon.curve = fit_curve(x, np.array([float(r["toxic"]) for r in points]))
    return lexicon


def choose(counted: list, settings: Settings) -> Lexicon:
    """Entries of enough weight. A beginning gives way to one longer entry that explains most of its
    toxic rows; a longer entry is kept beside a shorter one only if it says clearly more."""
    longest: dict[str, int] = {}
    for row in counted:
        for n in range(2, len(row["term"])):
            start = row["term"][:n]
            longest[start] = max(longest.get(start, 0), row["toxic"])
    kept: dict[str, float] = {}
    for row in sorted(counted, key=lambda r: (len(r["term"]), r["term"])):
        term, weight = row["term"], row["weight"]
        if weight < settings.least_weight or longest.get(term, 0) > 0.8 * row["toxic"]:
            continue
        known = max((kept[term[:n]] for n in range(2, len(term)) if term[:n] in kept), default=None)
        if known is None or weight > known + 1.0:
            kept[term] = weight
    strongest = sorted(kept.items(), key=lambda x: (-x[1], x[0]))[: settings.max_terms]
    return Lexicon(dict(strongest))


def exceptions_of(counted: list, lexicon: Lexicon) -> set[str]:
    """Whole words that begin with an entry but occur at least as often in clean rows as expected."""
    found = set()
    for row in counted:
        term = row["term"]
        if term.endswith(" ") and row["weight"] < 0.5 and any(
            term[:n] in lexicon.weights for n in range(2, len(term))
        ):
            found.add(term.strip())
    return found


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, matched weight, n_words and score of every document."""
    weights, exceptions, curve = lexicon.weights, lexicon.exceptions, np.array(lexicon.curve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Lexicon(weights, exceptions).automaton()
        for batch in batches:
            totals, sizes, scores = [], [], []
            for text in batch.column("text").to_pylist():
                folded = fold(text)
                sizes.append(len(folded.split()))
                totals.append(matched(folded, automaton, exceptions))
                z = float(np.dot(curve, curve_inputs(totals[-1], sizes[-1])))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield batch_of(
                doc_id=batch.column("doc_id"), matched_weight=pa.array(totals, pa.float64()),
                n_words=pa.array(sizes, pa.int64()), score=pa.array(scores, pa.float64()),
            )

    return arrow_map(
        keyed_texts(docs), run,
        "doc_id long", "matched_weight double", "n_words long", "score double",
    )


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Scores by a lexicon learned from `labels`, with the held-out mark and the prediction."""
    scored = score(docs, learn(docs, labels, settings))
    return scored.withColumns({
        "held_out": held_out(F.col("doc_id")),
        "predicted": F.when(F.col("score") >= 0.5, 1).otherwise(0),
    })
