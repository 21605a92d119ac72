"""Words that are coded once: the token files' and the pieces' encoders."""

from __future__ import annotations

import numpy as np
import public_tokenizers

from boxlake.llm import kernel, pieces, token_files

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_PIECES = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "a\x85b c d\x1ce \x0b\x0c", "İstanbul ǅ ΣΑΣ ß ÿ × a× A÷!",
    "é don't 'x' ''' _x_ x_y", "﻿hi \x00 \x00a a\x00 \r\n\r a\rb", "X" * 500, "(ab) ab) #$% ## 日本a a本!",
]


class Counted(dict):
    reads = 0

    def __getitem__(self, key):
        self.reads += 1
        return super().__getitem__(key)


def test_a_word_is_looked_up_once_for_a_slice():
    texts = ["the same Words, again and AGAIN " * 1000, *ODD]
    known = token_files.words_of(WORD_PIECES, "<u2")
    kept, known.whole = known.whole, Counted()
    try:
        coded = token_files.encode_texts(WORD_PIECES, texts, True, "<u2")
        assert known.whole.reads < 100
    finally:
        known.whole = kept
    assert coded == token_files.encode_texts(WORD_PIECES, texts, False, "<u2")


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(kernel, "range_hash", lambda c, a, b: np.zeros(len(a), np.uint64))
    texts = ["one two six", "two", *ODD]
    assert token_files.encode_texts(WORD_PIECES, texts, True, "<u2") == token_files.encode_texts(
        WORD_PIECES, texts, False, "<u2"
    )


def test_answers_on_pairs_of_pieces_are_kept_and_may_be_displaced(monkeypatch):
    monkeypatch.setattr(pieces, "PAIR_BITS", 4)
    small, asked = pieces.Pieces(PIECES), []
    monkeypatch.setattr(
        small, "_can_follow", lambda a, b: asked.append((a, b)) or pieces.Pieces._can_follow(small, a, b)
    )
    words = small.split("Several unaccustomed words, misspelt wrods and 日本語 in one sentence.")
    large = pieces.load(PIECES)
    assert small.solve(words) == large.solve(words)
    asked.clear()
    one = np.array([-2]), np.array([large.ids[0]], np.int64)
    assert small.fits(*one) == small.fits(*one) and len(asked) <= 1


def test_round_trips_are_judged_for_a_slice_at_once():
    model = pieces.load(PIECES)
    texts = [*ODD, "a\u2581b", " two  spaces ", "same", "\ufffd", "same"]
    coded = pieces.encode_texts(PIECES, texts)
    coded[-1] = coded[-2]  # the ids of another text
    values = np.frombuffer(b"".join(coded), "<i4")
    bounds = np.cumsum([0, *(len(c) // 4 for c in coded)])
    assert model.restores(values, bounds, texts) == [True] * (len(texts) - 1) + [False]
