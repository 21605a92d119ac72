"""SentencePiece encoding and decoding by batched Viterbi.

The pieces and scores of a model file are kept as sorted substring hashes. Distinct words of a batch
are grouped by length; all words of one length advance together, one end position at a time: the
hashes of all substrings that end there probe the sorted piece keys, and a vectorised maximum stores
score and backpointer. Encoded words are kept between batches (bounded), so each worker solves a word
once.

For a unigram model the best path is the one of the highest total score. For a model built by merges
(`merges=True`, as the public one) scores are only merge ranks, and the path must be the one that the
merges reach: the encoding of a prefix ends in exactly one piece that is stable beside the piece
before it, so a step counts only if no merge crosses the border of the two pieces. The ids then equal
the library's. Characters outside the vocabulary become byte pieces, so decoding restores every text;
only U+2581, which the format itself uses for the space, comes back as a space.

Words are cut where no piece can cross: before a space that follows another character, around
characters that are in no piece (such as the line break), and between Latin letters and ASCII signs if
no piece joins the two.

Defined cases: null and empty texts have no ids and decode to an empty text; texts of any length are
encoded whole; repeated rows are encoded alike; empty tables give empty results; only doc_id and text
are read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxlake.llm import kernel
from boxlake.llm.frames import arrow_map, batch_of, freed, keyed_texts

SPACE = "▁"
CACHED_WORDS = 250_000
PAIR_BITS = 19  # kept answers on pairs of pieces, 9 bytes each
SLICE_BYTES = 2_000_000
FILTER_BITS = 20
CELLS = 1_000_000  # characters of words solved together
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary of a SentencePiece model file, prepared for hash probes."""

    def __init__(self, path: str, merges: bool = True):
        import sentencepiece

        self.merges = merges

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.texts = [model.id_to_piece(i) for i in ids]
        plain = [
            i for i in ids
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        ]
        scores = np.array([model.get_score(i) for i in plain], float)
        self.build([self.texts[i] for i in plain], scores, np.array(plain, np.int32))
        self.byte_ids = np.array(
            [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32
        )
        self.surface = [
            bytes([int(t[3:5], 16)]) if model.is_byte(i)
            else b"" if model.is_control(i) else t.replace(SPACE, " ").encode()
            for i, t in enumerate(self.texts)
        ]
        self.surface_sizes = np.array([len(x) for x in self.surface], np.int64)
        self.surface_starts = np.cumsum(self.surface_sizes) - self.surface_sizes
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)

    def build(self, texts: Sequence[str], scores: np.ndarray, ids: np.ndarray) -> None:
        keys = np.array([self.key(t) for t in texts], np.uint64)
        order = np.argsort(keys)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        crossing = [t for t in texts if SPACE in t.lstrip(SPACE)]
        if crossing:
            raise ValueError(f"pieces with an inner space are not supported: {crossing[:3]}")
        self.keys, self.scores, self.ids = keys[order], scores[order], ids[order]
        self.longest = max(map(len, texts))
        spans = range(1, self.longest + 1)  # of equal scores, the shortest last piece counts
        self.spans = sorted(spans, key=(2, 3, 1, *spans[3:]).index) if self.merges and self.longest > 3 else spans
        self.known = np.unique([ord(t) for t in texts if len(t) == 1])
        self.rank = {t: (-s, int(i)) for t, s, i in zip(texts, scores, ids, strict=True)}
        self.pairs = np.full(1 << PAIR_BITS, np.iinfo(np.int64).min)
        self.answers = np.zeros(1 << PAIR_BITS, bool)
        self.edges: dict[tuple[int, int], list] = {}
        if self.merges:
            self._derive(texts, ids)
        self.unknown_score = float(scores[scores > -1e6].min()) - 10.0
        used = {c for t in texts for c in t}
        alone = "".join(re.escape(c) for c in "\n\r\t" if c not in used)
        cut = f"{SPACE}{alone}"
        joined = any(
            (x in SIGNS and LATIN.match(y)) or (y in SIGNS and LATIN.match(x))
            for t in texts for x, y in zip(t, t[1:])
        )
        sign = re.escape(SIGNS)
        finer = "" if joined else (
            f"{SPACE}*+{LATIN.pattern}++(?=[{sign}{cut}]|\\Z)|"
            f"{SPACE}*+[{sign}]++(?={LATIN.pattern}|[{cut}]|\\Z)|"
        )
        self.words = re.compile(
            f"{finer}{SPACE}*[^{cut}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")
        )
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def _derive(self, texts: Sequence[str], ids: np.ndarray) -> None:
        """The last merge of each piece, and the ids of the pieces that their own merges reach."""
        self.parts = {t: self._last_merge(t) for t in texts}
        self.reached = {
            int(i) for t, i in zip(texts, ids, strict=True)
            if self._edge(t, 0) is not None and self._edge(t, 1) is not None
        }

    def _edge(self, text: str, side: int) -> list[tuple[str, float, float]] | None:
        """The pieces at one edge (0 left, 1 right) of a piece while it grows, last first, each with
        the ranks at which it appears and at which the next one swallows it."""
        chain, now, until = [], text, np.inf
        while now is not None:
            since = self.rank[now][0] if len(now) > 1 else -1.0
            chain.append((now, since, until))
            children = self.parts.get(now)
            if children is None and len(now) > 1:
                return None
            until, now = since, children[side] if children else None
        return chain

    def _kept_edge(self, piece: int, side: int) -> list[tuple[str, float, float]]:
        found = self.edges.get((piece, side))
        if found is None:
            found = self.edges[piece, side] = self._edge(self.texts[piece], side)
        return found

    def _last_merge(self, text: str) -> tuple[str, str] | None:
        """The two pieces whose merge completes `text`; None if merging does not end there."""
        symbols = list(text)
        while len(symbols) > 2:
            best = min(
                ((self.rank[a + b][0], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
                 if a + b in self.rank), default=None,
            )
            if best is None:
                return None
            at = best[1]
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return tuple(symbols) if len(symbols) == 2 else None

    def _is_stable(self, left: int, right: int) -> bool:
        """No merge ever joins the right edge of one piece with the left edge of the next."""
        ends = self._kept_edge(right, 0)
        for a, a_since, a_until in self._kept_edge(left, 1):
            for b, b_since, b_until in ends:
                joined = self.rank.get(a + b)
                if joined is None or max(a_since, b_since) >= min(a_until, b_until):
                    continue
                if joined[0] < a_until and joined[0] <= b_until:
                    return False
        return True

    def fits(self, before: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """Which pieces can follow the ones before them (-2: start of the word, -1: unknown). The answers are
        kept by the pair's hash; a pair takes the place of another one there."""
        pairs = before * (1 << 32) + pieces
        place = (kernel.mix(pairs.view(np.uint64)) % np.uint64(len(self.pairs))).view(np.int64)
        out = self.answers[place]
        open_rows = np.flatnonzero(self.pairs[place] != pairs)
        if len(open_rows):
            fresh, first, which = np.unique(pairs[open_rows], return_index=True, return_inverse=True)
            found = np.array([self._can_follow(p >> 32, p & 0xFFFFFFFF) for p in fresh.tolist()], bool)
            out[open_rows] = found[which]
            own, one = np.unique(place[open_rows[first]], return_index=True)
            self.pairs[own], self.answers[own] = fresh[one], found[one]
        return out

    def _can_follow(self, left: int, right: int) -> bool:
        return right in self.reached and (left < 0 or self._is_stable(left, right))

    @staticmethod
    def key(text: str) -> int:
        codes = np.array([[ord(c) for c in text]], np.uint64)
        return int(_substring(_prefixes(codes), 0, len(text))[0])

    def solve(self, words: list[str]) -> list[bytes]:
        """Best ids of each word (32-bit, little-endian); words may have different lengths."""
        sizes = np.array([len(w) for w in words])
        out = [b""] * len(words)
        for size in np.unique(sizes[sizes > 0]):
            own = np.flatnonzero(sizes == size)
            step = max(1, CELLS // (int(size) * 4))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                found = self._solve([words[i] for i in part], int(size))
                for i, ids in zip(part, found, strict=True):
                    out[i] = ids
        return out

    def _solve(self, words: list[str], size: int) -> list[bytes]:
        raw = "".join(words).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(raw, "<u4").reshape(len(words), size).astype(np.uint64)
        prefixes = _prefixes(codes)
        n = len(words)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0.0
        back = np.zeros((n, size + 1), np.int16)
        chosen = np.full((n, size + 1), -1, np.int32)
        last = len(self.keys) - 1
        chosen[:, 0] = -2
        shift = np.uint64(64 - FILTER_BITS)
        for end in range(1, size + 1):
            # With merges, exactly one piece fits, so any order will do: rows leave when they have it.
            spans = [x for x in self.spans if x <= end]
            todo = np.arange(n)
            for span in spans:
                keys = _substring(prefixes[todo], end - span, end)
                own = np.flatnonzero(self.maybe[(keys >> shift).astype(np.int64)])
                own = own[best[todo[own], end - span] > -np.inf]
                at = np.minimum(np.searchsorted(self.keys, keys[own]), last)
                real = self.keys[at] == keys[own]
                own, ids = own[real], self.ids[at[real]]
                rows_hit = todo[own]
                if self.merges:
                    before = chosen[rows_hit, end - span].astype(np.int64)
                    fit = self.fits(before, ids.astype(np.int64))
                    own, rows_hit, ids = own[fit], rows_hit[fit], ids[fit]
                    total = best[rows_hit, end - span]
                else:
                    total = best[rows_hit, end - span] + self.scores[at[real]]
                better = total > best[rows_hit, end]
                put = rows_hit[better]
                best[put, end], back[put, end], chosen[put, end] = total[better], span, ids[better]
                if self.merges:
                    todo = np.delete(todo, own)
                    if len(todo) == 0:
                        break
            # A character of no piece is always possible: as bytes, below all pieces.
            alone = np.flatnonzero(
                ~np.isin(codes[:, end - 1], self.known) & (best[:, end - 1] > -np.inf)
            )
            total = best[alone, end - 1] + (0.0 if self.merges else self.unknown_score)
            put = alone[total > best[alone, end]]
            best[put, end], back[put, end], chosen[put, end] = (
                total[total > best[alone, end]], 1, -1
            )
        rows, at = np.arange(n), np.full(n, size)
        ids = np.full((n, size), -2, np.int32)
        places = np.zeros((n, size), np.int32)
        for step in range(size - 1, -1, -1):
            open_rows = rows[at > 0]
            if len(open_rows) == 0:
                break
            ends = at[open_rows]
            ids[open_rows, step] = chosen[open_rows, ends]
            at[open_rows] = ends - back[open_rows, ends]
            places[open_rows, step] = at[open_rows]
        used = ids != -2
        flat = ids[used].astype("<i4").tobytes()
        ends = (np.cumsum(used.sum(axis=1)) * 4).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for row in np.flatnonzero((ids == -1).any(axis=1)).tolist():
            out[row] = b"".join(
                self.byte_ids[list(words[row][p].encode("utf-8", "surrogatepass"))].tobytes()
                if i == -1 else int(i).to_bytes(4, "little")
                for i, p in zip(ids[row], places[row], strict=True) if i != -2
            )
        return out

    def split(self, text: str) -> list[str]:
        """The words of a text, with the dummy space before the first."""
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def restores(self, values: np.ndarray, bounds: np.ndarray, texts: Sequence[str]) -> list[bool]:
        """Whether the ids between the bounds decode to each text (U+2581 read as a space)."""
        sizes = self.surface_sizes[values]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.surface_starts[values] - ends[:-1], sizes) + np.arange(ends[-1])
        raw = self.surface_bytes[at].tobytes()
        cuts = ends[bounds].tolist()
        same = []
        for row, (a, b, text) in enumerate(zip(cuts[:-1], cuts[1:], texts, strict=True)):
            wanted = text.replace(SPACE, " ")
            same.append(
                raw[a:b].removeprefix(b" ") == wanted.encode("utf-8", "surrogatepass")
                or self.decode(values[bounds[row] : bounds[row + 1]].tolist()) == wanted
            )
        return same

    def decode(self, ids: Sequence[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def _prefixes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _BASE + codes[:, j] + np.uint64(1)
    return out


def _substring(prefixes: np.ndarray, start: int, end: int) -> np.ndarray:
    power = np.uint64(pow(int(_BASE), end - start, 1 << 64))
    return kernel.mix(prefixes[:, end] - prefixes[:, start] * power + np.uint64(end - start))


@functools.lru_cache(maxsize=2)
def load(path: str, merges: bool = True) -> Pieces:
    return Pieces(path, merges)


_solved: dict[str, dict[str, bytes]] = {}


def forget() -> None:
    """Give up models and encoded words."""
    _solved.clear()
    load.cache_clear()


def encode_texts(path: str, texts: Sequence[str]) -> list[bytes]:
    """Little-endian 32-bit ids of each text."""
    model = load(path)
    cache = _solved.setdefault(path, {})
    if len(cache) > CACHED_WORDS:
        cache.clear()
    split = [model.split(t) for t in texts]
    fresh = list({w for words in split for w in words if w not in cache})
    cache.update(zip(fresh, model.solve(fresh), strict=True))
    return [b"".join(map(cache.__getitem__, words)) for words in split]


def encode(docs: DataFrame, path: str, check: bool = True) -> DataFrame:
    """doc_id, ids, n_ids and whether decoding the ids restores the text (U+2581 read as a space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, limit=SLICE_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            coded = encode_texts(path, texts)
            values = np.frombuffer(b"".join(coded), "<i4")
            sizes = np.array([len(c) // 4 for c in coded], np.int64)
            bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            same = load(path).restores(values, bounds, texts) if check else [True] * len(texts)
            yield batch_of(
                doc_id=batch.column("doc_id"),
                ids=pa.ListArray.from_arrays(pa.array(bounds), pa.array(values)),
                n_ids=sizes, round_trip=pa.array(same, pa.bool_()),
            )

    return arrow_map(
        keyed_texts(docs), freed(run, forget), "doc_id long", "ids array<int>", "n_ids long", "round_trip boolean"
    )


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [load(path).decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield batch_of(doc_id=batch.column("doc_id"), text=pa.array(texts, pa.string()))

    return arrow_map(coded.select("doc_id", "ids"), run, "doc_id long", "text string")
