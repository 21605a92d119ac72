"""License rules, table centroids and periodic runs against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from re import _parser

from boxlake.llm import centroids, license_rules, licenses, periods
from boxlake.llm.queries import op11_license_rules, op12_table_centroids, op13_square_runs, planted_order

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def saved(docs, folder, name="documents"):
    docs.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# License rules

def plain_licenses(text):
    w = LICENSE_WORD.findall((text or "").translate(brute.LOWER))
    base = sorted(
        (i, label) for phrase, label in licenses.PHRASES for i in range(len(w))
        if w[i : i + len(phrase.split())] == phrase.split()
    )
    joined = " " + " ".join(w) + " "
    found = []
    for name, (priority, weight) in license_rules.SECTIONS.items():
        for order, line in enumerate(license_rules.TEXTS[name].strip().splitlines()):
            label, words, rule = line.split(" | ")
            if not set(words.split()) <= set(w):
                continue
            for hit in re.finditer(f" (?:{rule})(?= )", joined):
                a, b = joined[: hit.start()].count(" "), joined[: hit.end()].count(" ")
                found.append((priority, -(b - a), a, order, b, label, weight))
    kept, before = [], []
    for hit in sorted(found):
        priority, _, a, _, b, label, weight = hit
        if not any(x <= a and b <= y for x, y in before):
            kept.append((a, b, label, priority, weight))
        before.append((a, b))
    return len(w), base, sorted(kept)


LICENSED = {
    1: None, 2: "", 3: "no terms at all", 4: "Licensed under CC BY-NC 4.0.",
    5: "This work is licensed under the GNU General Public License, version 3.",
    6: "Released under the MIT License.\n\nMIT license; Apache License, mit\tlicense",
    7: "SPDX-License-Identifier: GPL-2.0-or-later\nGNU Lesser General Public License version 2.1 or later",
    8: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
       "compliance with the License. http://www.apache.org/licenses/LICENSE-2.0",
    9: "permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
       "associated documentation files. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
       "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY",
    10: "cc by sa 4.0 cc by cc by-nd agplv3 ＧＰＬ gpl x", 11: "GNU GENERAL PUBLIC LİCENSE gnu general public",
    12: "mit " * 3_000 + "license " + "word " * 40_000 + "bsd 3-clause license gplv2 gpl 2 gpl",
    13: "gnu general public license", 14: "x mit", 15: "license y",
}


def test_license_rules(frame, spark):
    docs = {**LICENSED, 20: LICENSED[5], 21: LICENSED[5]}
    rows = licenses.scan(frame(docs, repeat=(5, 1))).collect()
    assert sorted(r.doc_id for r in rows) == sorted([*docs, 5, 1])
    for r in rows:
        n, base, kept = plain_licenses(docs[r.doc_id])
        assert r.n_words == n and sorted((p.start, p.label) for p in r.places) == base, r.doc_id
        got = [(d.start, d.end, d.label, d.priority, d.weight) for d in r.detections]
        assert got == kept, r.doc_id


def test_license_query(frame, tmp_path, spark):
    docs = {**LICENSED, 20: LICENSED[6]}
    for r in op11_license_rules(spark, saved(frame(docs), tmp_path)).collect():
        n, base, kept = plain_licenses(docs[r.doc_id])
        labels = {label for _, label in base} | {d[2] for d in kept}
        weights = [d[4] for d in kept] + [licenses.PHRASE_WEIGHT] * bool(base)
        assert tuple(r) == (
            r.doc_id, n, len(base), base[0][0] if base else None, base[-1][0] if base else None,
            ",".join(sorted({label for _, label in base})), ",".join(sorted(labels)), max(weights, default=0.0),
        )


def test_license_rules_are_many_and_their_keywords_necessary():
    rng = random.Random(1)

    def sample(parts):
        out = ""
        for op, av in parts:
            op = str(op)
            if op == "LITERAL":
                out += chr(av)
            elif op == "IN":
                out += chr(av[0][1])
            elif op == "ANY":
                out += "x"
            elif op == "SUBPATTERN":
                out += sample(av[3])
            elif op == "BRANCH":
                out += sample(rng.choice(av[1]))
            elif op.endswith("REPEAT"):
                out += "".join(sample(av[2]) for _ in range(rng.randint(av[0], min(av[1], av[0] + 1))))
        return out

    rules = licenses.standard().rules
    assert len(rules) > 300
    for rule in rules:
        for _ in range(20):
            text = sample(_parser.parse(rule.pattern.pattern.decode()))
            assert set(rule.keywords) <= set(text.split()), rule


def test_license_suppression_equals_a_plain_one():
    rng = random.Random(4)
    rules = licenses.standard()
    for _ in range(200):
        found = []
        for _ in range(rng.randint(0, 25)):
            a = rng.randint(0, 20)
            found.append((a, a + rng.randint(1, 6), rng.randrange(len(rules.rules))))
        key = lambda f: (rules.rules[f[2]].priority, f[0] - f[1], f[0], f[2])
        want, before = [], []
        for a, b, i in sorted(found, key=key):
            if not any(x <= a and b <= y for x, y in before):
                want.append((a, b, i))
            before.append((a, b))
        assert rules.unsuppressed(found) == sorted(want)


def test_blocked_licenses(frame):
    docs = frame(LICENSED, repeat=(4,))
    left = licenses.clean(docs, ["gpl-3.0", "cc-by-nc-4.0"], 0.9)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(LICENSED) - {4, 5})


# Table centroids

def plain_clusters(rows, k=16, rounds=3, seed=1):
    kept = []
    for vec_id, v in rows:
        if v is None or len(v) != 64 or any(x is None or not np.isfinite(x) for x in v):
            continue
        ints = [int(np.clip(np.floor(64 * float(x)), -centroids.LIMIT, centroids.LIMIT)) for x in v]
        name = hashlib.sha256(f"{seed}:{vec_id}".encode()).hexdigest()
        kept.append(((vec_id is None, name, ints), vec_id, ints))
    kept.sort(key=lambda x: x[0])
    means = [v for _, _, v in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(means))

    for _ in range(rounds):
        groups = {}
        for _, _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        means = [
            [sum(col) // len(groups[i]) for col in zip(*groups[i])] if i in groups else c
            for i, c in enumerate(means)
        ]
    out = [(vec_id, nearest(v)) for _, vec_id, v in kept]
    inertia = {}
    for _, (d, i) in out:
        inertia[i] = inertia.get(i, 0) + d
    return [
        (vec_id, i, d, inertia[i], sum(inertia.values()),
         hashlib.sha256(",".join(map(str, means[i])).encode()).hexdigest())
        for vec_id, (d, i) in out
    ]


VECTORS = "vec_id long, embedding array<float>, label int, cluster string, components int, distance int"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 0, "x", 1, 2) for k, v in rows], VECTORS).repartition(5)


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r[:4]])


@pytest.mark.parametrize("wide", [False, True])
def test_table_centroids(spark, tmp_path, wide, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(9, 64))
    rows = [
        (i, (middles[i % 9] + rng.normal(scale=0.2, size=64)).astype(np.float32).tolist()) for i in range(300)
    ]
    rows += [(i, rows[5][1]) for i in range(300, 420)]  # copies: ties between centroids
    rows += [rows[0], (0, rows[1][1]), (None, rows[2][1])]  # repeated and null ids
    bad = list(rows[3][1])
    rows += [(500, None), (501, []), (502, bad[:63]), (503, [*bad, 0.0]), (504, [None, *bad[1:]]),
             (505, [float("nan"), *bad[1:]]), (506, [float("-inf"), *bad[1:]])]
    if wide:
        rows += [(600, [1e30, *bad[1:]]), (601, [-1e5, *bad[1:]]), (602, [900.0] * 64)]
    got = op12_table_centroids(spark, saved(vectors(spark, rows), tmp_path, "embeddings")).collect()
    assert order(map(tuple, got)) == order(plain_clusters(rows))


def test_fewer_vectors_than_centroids(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    got = centroids.cluster(vectors(spark, rows)).collect()
    assert order(map(tuple, got)) == order(plain_clusters(rows))
    assert centroids.cluster(vectors(spark, rows[:0])).count() == 0
    assert centroids.cluster(vectors(spark, [(1, None)])).count() == 0


# Periodic runs

def plain_runs(w, least=24, times=3):
    n, out = len(w), []
    for p in range(1, n // times + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            a, b = i, j + p
            shorter = any(all(w[k] == w[k + q] for k in range(a, b - q)) for q in range(1, p))
            if b - a >= max(least, times * p) and not shorter:
                out.append((a, b - a, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for a, size, p in runs for k in range(a + p, a + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(rng, most):
    w = []
    while len(w) < most:
        kind = rng.random()
        if kind < 0.4:
            unit = [rng.choice("ab") for _ in range(rng.randint(1, rng.choice([2, 5, 20, 40])))]
            w += (unit * 12)[: rng.randint(1, 4 * len(unit) + 26)]
        elif kind < 0.7:
            w += [rng.choice("ab")] * rng.randint(1, 40)
        else:
            w += [rng.choice("abcd") for _ in range(rng.randint(1, 30))]
    return w


@pytest.mark.parametrize("step", [1, 7, 50, 1 << 16])
def test_catchers_find_the_runs_of_a_plain_search(monkeypatch, step):
    monkeypatch.setattr(periods, "STEP_WORDS", step)
    rng, total = random.Random(step), 0
    for _ in range(25):
        docs = [repetitive(rng, rng.randint(0, 220)) for _ in range(rng.randint(1, 5))]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(range(len(docs))), pa.array([" ".join(d) for d in docs])], ["doc_id", "text"]
        )
        found = periods.Slice(batch, None, periods.LEAST_RUN, periods.TIMES)
        for row, w in enumerate(docs):
            want = plain_runs(w)
            total += len(want)
            assert [tuple(r) for r in found.runs[row].tolist()] == want
            assert found.kept(row).decode() == collapsed(w, want)
    assert total > 50


def test_run_query(frame, spark, texts, tmp_path):
    rng = random.Random(9)
    docs = {k: t for k, t in texts.items() if k != 115}
    docs |= {k: " \n".join(repetitive(rng, 150)) for k in range(200, 260)}
    docs |= {300: "é日 " * 50, 301: "a " * 23, 302: "a " * 24, 303: "a b " * 12 + "c", 304: "x" * 5_000}
    docs |= {k: f"{rng.random()} " * 3 + "end" for k in range(310, 340)}
    got = op13_square_runs(spark, saved(frame(docs, repeat=(3, 200)), tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted([*docs, 3, 200])
    planted = 0
    for r in got:
        w = brute.words(docs[r.doc_id])
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = plain_runs(w)
        best = None
        for run in runs:
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        lines = "".join(f"{a},{size},{p}\n" for a, size, p in runs)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert tuple(r)[1:] == (
            len(runs), *want, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(collapsed(w, runs).encode()).hexdigest(),
        ), r.doc_id
    assert planted > 5 and planted_order(None, 9) is None


def test_very_long_texts_cost_no_square():
    rng = random.Random(2)
    for text in ("0 " * 400_000, " ".join("0" if rng.random() < 0.998 else "1" for _ in range(400_000))):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
        assert len(periods.Slice(batch, None, periods.LEAST_RUN, periods.TIMES).runs[0]) > 0


def test_cleaned_runs(frame):
    docs = {1: None, 2: "", 3: "all  different\nwords", 4: "start " + "a b " * 20 + "end"}
    got = {r.doc_id: r for r in periods.clean(frame(docs)).collect()}
    assert {k: r.text for k, r in got.items()} == {**docs, 4: "start a b end"}
    assert got[4].n_chars == len("start a b end") and got[4].n_words == -1


def test_empty_tables(empty):
    assert licenses.judge(empty).count() == 0 and licenses.clean(empty, ["gpl"]).count() == 0
    assert periods.find(empty).count() == 0 and periods.clean(empty).count() == 0
