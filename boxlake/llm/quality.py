"""Line-first quality rules.

Every line is judged on its own: shouting or symbol-ridden punctuation, navigation bars and
boilerplate phrases fail it. Failed lines are removed, and a document that loses more than
`max_lost_percent` of its word characters is rejected, as is one with too few words or too many
repeated five-word windows. One scan, no shuffle.

Defined cases: a null or empty text has no words and is rejected (n_words < min_words); a text of
any length is judged whole; repeated rows are judged alike, one result each; an empty table gives an
empty result; other columns are never read by `judge` and pass through `clean` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxlake.llm import kernel
from boxlake.llm.frames import arrow_map, batch_of, keyed_texts, same_rows

SYMBOLS = b"#*$%&|<>"
SEPARATORS = b"|>"
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "accept cookies", "enable javascript", "subscribe to our newsletter", "click here",
    "skip to content", "back to top", "licensed under", "released under the", "lorem ipsum",
)


@dataclass(frozen=True)
class Rules:
    """Percentages are of the words of a line, except `max_lost_percent`."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbol_percent: int = 20
    max_shout_percent: int = 30
    min_separators: int = 3
    max_separator_percent: int = 12
    stub_words: int = 4
    max_lost_percent: int = 50


def _table(symbols: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(symbols)] = True
    return table


_SYMBOL, _SEPARATOR, _END = _table(SYMBOLS), _table(SEPARATORS), _table(b".!?:;\"')]")


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


def _first_of(keys: np.ndarray) -> np.ndarray:
    """True where a key appears for the first time."""
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return first


def _doc_keys(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return kernel.mix(hashes + docs.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def repeated_words(hashes: np.ndarray, bounds: np.ndarray, window: int = 5) -> np.ndarray:
    """True for each word inside a window of words that its document holds twice or more."""
    starts = kernel.inside(bounds, window)
    grams = kernel.gram_hash(hashes, window)[starts] if len(starts) else starts.astype(np.uint64)
    keys = _doc_keys(grams, kernel.owner(bounds)[starts])
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    at = starts[counts[which] > 1] if len(starts) else starts
    edges = np.zeros(len(hashes) + window + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return np.cumsum(edges)[: len(hashes)] > 0


def line_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines, and the n + 1 line bounds of the documents."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate((bounds[:-1], breaks + 1))
    docs = np.concatenate(
        (np.arange(len(bounds) - 1), np.searchsorted(bounds, breaks, "right") - 1)
    )
    order = np.lexsort((starts, docs))
    starts, docs = starts[order], docs[order]
    last = np.ones(len(docs), bool)
    last[:-1] = docs[1:] != docs[:-1]
    ends = np.where(last, bounds[docs + 1], np.append(starts[1:], 0) - 1)
    return starts, ends, np.searchsorted(docs, np.arange(len(bounds)))


def failing_lines(
    data: np.ndarray, lines: tuple, word_starts: np.ndarray, word_ends: np.ndarray, rules: Rules
) -> tuple[np.ndarray, np.ndarray]:
    """(line fails, words of the line). Lines without a word never fail."""
    starts, ends, _ = lines
    first, after = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
    n = after - first
    symbols = _sums(_SYMBOL[data], starts, ends)
    separators = _sums(_SEPARATOR[data], starts, ends)
    twice = np.zeros(len(word_ends), bool)
    long = word_ends - word_starts >= 2
    tail = word_ends[long]
    twice[long] = (data[tail - 1] == 33) & (data[tail - 2] == 33)
    shouts = _sums(twice, first, after)
    closed = np.ones(len(starts), bool)
    some = n > 0
    at = word_ends[after[some] - 1] - 1
    three = np.stack([data[np.maximum(at - back, 0)] for back in range(3)]).astype(np.int64)
    code = three[0] + 256 * three[1] + 65536 * three[2]
    closed[some] = _END[data[at]] | np.isin(code, (0xE280A6, 0xE2809D)) | (code % 65536 == 0xC2BB)
    lowered = kernel.LOWER[data].tobytes()
    phrase = np.zeros(len(starts), bool)
    for text in BOILERPLATE:
        pattern, at = text.encode(), lowered.find(text.encode())
        while at >= 0:
            line = int(np.searchsorted(starts, at, "right")) - 1
            phrase[line] |= at + len(pattern) <= ends[line]
            at = lowered.find(pattern, at + 1)
    fails = 100 * symbols > rules.max_symbol_percent * n
    fails |= 100 * shouts > rules.max_shout_percent * n
    fails |= (n < rules.stub_words) & ~closed
    fails |= (separators >= rules.min_separators) & (
        100 * separators > rules.max_separator_percent * n
    )
    return (fails | phrase) & some, n


def measure(data: np.ndarray, bounds: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    starts, ends, docs = kernel.words(data, bounds)
    hashes = kernel.range_hash(kernel.prefix_hash(data), starts, ends)
    lines = line_bounds(data, bounds)
    fails, n_line = failing_lines(data, lines, starts, ends, rules)
    line_hashes = kernel.range_hash(kernel.prefix_hash(data), lines[0], lines[1])
    again = ~_first_of(_doc_keys(line_hashes, kernel.owner(lines[2]))) & (n_line > 0)
    chars = _sums((data & 0xC0) != 0x80, starts, ends)
    line_chars = _sums(chars, np.searchsorted(starts, lines[0]), np.searchsorted(starts, lines[1]))
    n = np.diff(docs)
    out = {
        "n_words": n,
        "word_chars": _sums(chars, docs[:-1], docs[1:]),
        "n_symbols": _sums(_SYMBOL[data], bounds[:-1], bounds[1:]),
        "n_dup_lines": _sums(again, lines[2][:-1], lines[2][1:]),
        "n_repeat_words": _sums(repeated_words(hashes, docs), docs[:-1], docs[1:]),
        "n_failed_lines": _sums(fails, lines[2][:-1], lines[2][1:]),
        "lost_chars": _sums(np.where(fails, line_chars, 0), lines[2][:-1], lines[2][1:]),
    }
    out["base_failed"] = (n < rules.min_words) | (
        100 * out["n_repeat_words"] > rules.max_repeat_percent * n
    )
    out["kept"] = ~out["base_failed"] & (
        100 * out["lost_chars"] <= rules.max_lost_percent * out["word_chars"]
    )
    out["_lines"], out["_fails"] = lines, fails
    return out


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           "n_failed_lines", "lost_chars")


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row of measures and verdicts per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches):
            found = measure(*kernel.string_bytes(batch.column("text")), rules)
            yield batch_of(
                doc_id=batch.column("doc_id"),
                **{name: found[name].astype(np.int64) for name in NUMBERS},
                base_failed=found["base_failed"], kept=found["kept"],
            )

    return arrow_map(
        keyed_texts(docs), run, "doc_id long", *(f"{name} long" for name in NUMBERS),
        "base_failed boolean", "kept boolean",
    )


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept documents without their failed lines; all columns stay, n_chars follows the text."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches):
            data, bounds = kernel.string_bytes(batch.column("text"))
            found = measure(data, bounds, rules)
            starts, ends, docs_at = found["_lines"]
            texts, lengths = [], []
            for i in np.flatnonzero(found["kept"]):
                own = slice(docs_at[i], docs_at[i + 1])
                if found["_fails"][own].any():
                    parts = [
                        data[a:b].tobytes() for a, b, bad
                        in zip(starts[own], ends[own], found["_fails"][own], strict=True) if not bad
                    ]
                    text = b"\n".join(parts).decode()
                else:
                    text = data[bounds[i] : bounds[i + 1]].tobytes().decode()
                texts.append(text)
                lengths.append(len(text))
            kept = batch.filter(pa.array(found["kept"]))
            columns = dict(zip(names, kept.columns, strict=True))
            columns["text"] = pa.array(texts, batch.column("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(lengths, pa.int64()).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[name] for name in names], names)

    return same_rows(docs, run)
