"""Plain versions of the corpus operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words((text or "").translate(LOWER))
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def groups(docs):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {k: shingles(t) for k, t in docs.items()}
    parent = {k: k for k in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(docs)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            union = len(sets[a] | sets[b])
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * union:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in keys}


def repeated_words(docs, window=20):
    """{doc_id: (n_words, n_removed, kept text)}"""
    seen, out = set(), {}
    for k in sorted(docs):
        w = words(docs[k])
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[k] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def repeated_bytes(docs, window=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)}"""
    seen, out = set(), {}
    for k in sorted(docs):
        raw = (docs[k] or "").encode()
        gone, own = [False] * len(raw), set()
        for i in range(len(raw) - window + 1):
            key = raw[i : i + window]
            if key in seen:
                gone[i : i + window] = [True] * window
            own.add(key)
        seen |= own
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out[k] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(words(line)) and line in seen
        seen.add(line)
    n = len(w)
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = n < 10 or 100 * len(hit) > 20 * n
    return n, sum(map(len, w)), symbols, dup, len(hit), failed


def fold(text):
    low = (text or "").translate(LOWER)
    return re.sub(r"[^a-z0-9\x80-\U0010FFFF]+", " ", low).strip()


def edits_inside(item: str, text: str) -> int:
    """Least edits of `item` against any stretch of `text` (bytes)."""
    a, b = item.encode(), text.encode()
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return min(row)
