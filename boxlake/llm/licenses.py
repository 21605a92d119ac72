"""License scan by ordered signature rules.

The rules (`license_rules`) are regular expressions with a priority and a weight. A text is reduced to
lower-case words. Its words are probed against the keywords of all rules, by hash; only rules whose
keywords all occur are tried, so most texts meet no expression at all. What they find are intervals of
words. A detection inside the interval of one of higher priority, or of a longer one of the same, is
suppressed: inclusion is transitive, so one sweep by start with the furthest end so far decides it.

Short fixed phrases are searched as well, at every place where their words stand consecutively; their
labels are never suppressed.

Defined cases: null and empty texts have no words and score 0; texts are read whole; a phrase or a
detection never crosses documents; repeated rows are judged alike; two rules that find the same
interval count once, by the order of the rules; empty tables give empty results; `scan` reads only
doc_id and text, `clean` keeps all columns.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.llm import kernel, license_rules
from boxlake.llm.frames import arrow_map, batch_of, keyed_texts, same_rows

PHRASES = (
    ("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"),
    ("mit license", "mit"),
)
PHRASE_WEIGHT = 0.5
PLACES = "array<struct<start: long, label: string>>"
DETECTIONS = "array<struct<start: long, end: long, label: string, priority: int, weight: double>>"
_PLACE = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
_DETECTION = pa.list_(pa.struct([
    ("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32()),
    ("weight", pa.float64()),
]))
# Everything but digits, lower-case letters and the bytes of other characters separates words.
SEPARATORS = np.ones(256, bool)
SEPARATORS[0x30:0x3A] = SEPARATORS[0x61:0x7B] = SEPARATORS[0x80:] = False
_FILTER_BITS = 16


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    priority: int
    weight: float


def hashes_of(words: Sequence[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return kernel.range_hash(kernel.prefix_hash(data), np.append(0, ends[:-1]), ends)


class Rules:
    """The rules in order, their keywords as sorted hashes, and the phrases as runs of word hashes."""

    def __init__(self, rules: Sequence[Rule], phrases: Sequence[tuple[str, str]]):
        self.rules = list(rules)
        words = sorted({k for r in rules for k in r.keywords})
        hashes = hashes_of(words) if words else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.keywords = hashes[order]
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        number = {words[i]: place for place, i in enumerate(order.tolist())}
        self.needs = [frozenset(number[k] for k in r.keywords) for r in rules]
        # Each rule waits at the keyword that fewest rules have.
        uses = np.bincount([k for n in self.needs for k in n], minlength=len(words))
        self.waiting: dict[int, list[int]] = {}
        for i, need in enumerate(self.needs):
            self.waiting.setdefault(min(need, key=lambda k: (uses[k], k)), []).append(i)
        self.phrases = [(hashes_of(p.split()), label) for p, label in phrases]

    def keywords_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word place, keyword number) of all keywords among the word hashes."""
        if len(self.keywords) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[(words >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.keywords, words[at]), len(self.keywords) - 1)
        real = self.keywords[number] == words[at]
        return at[real], number[real]

    def gated(self, present: set[int]) -> list[int]:
        """The rules whose keywords are all present, in order."""
        return sorted(
            i for k in present for i in self.waiting.get(k, ()) if self.needs[i] <= present
        )

    def detect(self, text: bytes, present: set[int]) -> list[tuple[int, int, int]]:
        """(first word, end word, rule) of what is left after suppression, by start.

        `text` holds the words with a space before each and one at the end.
        """
        spaces, found = None, []
        for i in self.gated(present):
            for hit in self.rules[i].pattern.finditer(text):
                if spaces is None:
                    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                first, end = np.searchsorted(spaces, (hit.start(), hit.end()))
                found.append((int(first), int(end), i))
        return self.unsuppressed(found)

    def unsuppressed(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        outer: list[tuple[int, int]] = []  # (start, end) of all before, by start
        for level in sorted({self.rules[i].priority for _, _, i in found}):
            own = sorted(
                (f for f in found if self.rules[f[2]].priority == level),
                key=lambda f: (f[0], -f[1], f[2]),
            )
            starts = [s for s, _ in outer]
            reach = np.maximum.accumulate([e for _, e in outer]).tolist() if outer else []
            furthest = -1
            for start, end, i in own:
                above = bisect_right(starts, start) - 1
                if end > furthest and (above < 0 or reach[above] < end):
                    out.append((start, end, i))
                furthest = max(furthest, end)
            outer = sorted(outer + [(s, e) for s, e, _ in own])
        return sorted(out)


def parsed(sections: dict[str, tuple[int, float]], texts: dict[str, str]) -> list[Rule]:
    """Rules of section texts with lines `label | keywords | expression`."""
    out = []
    for name, (priority, weight) in sorted(sections.items(), key=lambda s: s[1][0]):
        for line in texts[name].strip().splitlines():
            label, keywords, expression = line.split(" | ")
            pattern = re.compile(f" (?:{expression})(?= )".encode())
            out.append(Rule(label, tuple(keywords.split()), pattern, priority, weight))
    return out


@functools.lru_cache(maxsize=1)
def standard() -> Rules:
    return Rules(parsed(license_rules.SECTIONS, license_rules.TEXTS), PHRASES)


def _found(batch: pa.RecordBatch, rules: Rules) -> pa.RecordBatch:
    data, bounds = kernel.string_bytes(batch.column("text"))
    low = kernel.LOWER[data]
    starts, ends, docs = kernel.words(low, bounds, SEPARATORS)
    words = kernel.range_hash(kernel.prefix_hash(low), starts, ends)
    doc = kernel.owner(docs)
    places: list[list[dict]] = [[] for _ in range(batch.num_rows)]
    for phrase, label in rules.phrases:
        at = np.flatnonzero(words[: max(0, len(words) - len(phrase) + 1)] == phrase[0])
        for step in range(1, len(phrase)):
            at = at[words[at + step] == phrase[step]]
        at = at[doc[at] == doc[at + len(phrase) - 1]] if len(at) else at
        for place in at.tolist():
            row = int(doc[place])
            places[row].append({"start": place - int(docs[row]), "label": label})

    detections: list[list[dict]] = [[] for _ in range(batch.num_rows)]
    at, number = rules.keywords_of(words)
    cut = np.searchsorted(at, docs)
    raw = low.tobytes() if len(at) else b""
    for row in np.flatnonzero(np.diff(cut)).tolist():
        present = set(number[cut[row] : cut[row + 1]].tolist())
        if not rules.gated(present):
            continue
        own = zip(
            starts[docs[row] : docs[row + 1]].tolist(), ends[docs[row] : docs[row + 1]].tolist(),
            strict=True,
        )
        text = b" " + b" ".join([raw[a:b] for a, b in own]) + b" "
        for first, end, i in rules.detect(text, present):
            rule = rules.rules[i]
            detections[row].append({
                "start": first, "end": end, "label": rule.label, "priority": rule.priority,
                "weight": rule.weight,
            })
    return batch_of(
        doc_id=batch.column("doc_id"), n_words=np.diff(docs), places=pa.array(places, _PLACE),
        detections=pa.array(detections, _DETECTION),
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places (start, label of the phrases) and detections (words [start, end), label,
    priority, weight) of every document; words count from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches):
            yield _found(batch, standard())

    return arrow_map(
        keyed_texts(docs), run, "doc_id long", "n_words long", f"places {PLACES}",
        f"detections {DETECTIONS}",
    )


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score: the weight of the
    most telling detection (`PHRASE_WEIGHT` for a phrase), 0 without one."""
    base = F.array_sort(F.array_distinct("places.label"))
    every = F.array_sort(F.array_distinct(F.concat("places.label", "detections.label")))
    phrase = F.when(F.size("places") > 0, F.lit(PHRASE_WEIGHT)).otherwise(F.lit(0.0))
    return scan(docs).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max("detections.weight"), F.lit(0.0)), phrase).alias("score"),
    )


def clean(docs: DataFrame, blocked: Sequence[str], least: float = 0.5) -> DataFrame:
    """The documents, all columns unchanged, without a blocked label of at least that weight."""
    names = set(blocked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches):
            keyed = batch_of(doc_id=np.arange(batch.num_rows), text=batch.column("text"))
            found = _found(keyed, standard())
            bad = [
                any(d["label"] in names and d["weight"] >= least for d in hits)
                or (least <= PHRASE_WEIGHT and any(p["label"] in names for p in places))
                for hits, places in zip(
                    found.column("detections").to_pylist(), found.column("places").to_pylist(),
                    strict=True,
                )
            ]
            yield batch.filter(pa.array([not b for b in bad], pa.bool_()))

    return same_rows(docs, run)
