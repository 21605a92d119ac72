"""Each operator against a plain version: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import hashlib
import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest

from boxlake.llm import (
    decontaminate, minhash, pieces, quality, sharding, substrings, suffixes, token_files, toxicity,
    urls,
)
from boxlake.llm.frames import shared_folder


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


@pytest.mark.parametrize("many", [minhash.MANY, 0])
def test_near_duplicates(frame, texts, monkeypatch, many):
    monkeypatch.setattr(minhash, "MANY", many)
    got = rows(minhash.group(frame(texts, repeat=(0, 6, 90))), "doc_id", "n_shingles", "component_id", "kept")
    want = [(k, n, c, k == c) for k, (n, c) in brute.groups(texts).items()]
    want += [x for x in want if x[0] in (0, 6, 90)]
    assert got == sorted(want)


def test_crowded_lists_join_whole_sets_with_cut_ones(spark):
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 63, 620, dtype=np.int64))

    def part_of(values, size, own):  # `size` values, `own` of them foreign
        kept = rng.choice(values, size - own, replace=False)
        return np.sort(np.append(kept, rng.integers(0, 1 << 63, own, dtype=np.int64)))

    sets = [part_of(base, int(n), 0) for n in np.linspace(590, 615, 30)]
    for size in [*range(380, 480, 10), *range(490, 513), 530, 560, 640, 690]:
        near = sets[int(rng.integers(30))]  # each near the threshold with one of the others
        share = rng.uniform(0.74, 0.78) if size < 490 or size > 512 else rng.uniform(0.75, 0.755)
        common = min(size, len(near), int(np.ceil(share / (1 + share) * (size + len(near)))))
        sets.append(part_of(near, size, size - common))
    listed = [
        (int(v), node, len(s), min(len(s), minhash.LONG))
        for node, s in enumerate(sets) for v in s[: minhash.LONG]
    ]
    values = spark.createDataFrame(listed, "key long, node long, size long, kept long")
    shared = minhash._shared(minhash._rarest(values)).cache()
    # Nothing is linked yet: every member is a component of its own.
    apart = shared.selectExpr("*", "node AS part", "node <> leader AS stray")
    pairs = minhash._to_leaders(shared).union(minhash._stray_pairs(apart, shared.select("key").distinct()))
    got = {tuple(sorted(r)) for r in pairs.collect()}
    want, mixed = set(), 0
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            common = len(np.intersect1d(a, sets[j]))
            if 100 * common >= 75 * (len(a) + len(sets[j]) - common):
                want.add((i, j))
                small, large = sorted((len(a), len(sets[j])))
                mixed += small <= minhash.LONG < large
    assert mixed > 20 and not want - got


def test_near_duplicates_keep_one_document_with_all_columns(frame, texts):
    docs = frame(texts)
    kept = minhash.clean(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, (_, c) in brute.groups(texts).items() if k == c}


def test_substrings(frame, texts):
    docs = frame(texts, repeat=(3, 70))
    want = brute.repeated_words(texts)
    got = rows(substrings.judge(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    plain = [(k, n, g, hashlib.sha256(t.encode()).hexdigest()) for k, (n, g, t) in want.items()]
    assert got == sorted(plain + [x for x in plain if x[0] in (3, 70)])
    cleaned = {r.doc_id: r for r in substrings.clean(docs).collect()}
    for k, (_, gone, text) in want.items():
        assert cleaned[k].text == (text if gone else texts[k])
        assert cleaned[k].places == "own" and cleaned[k].n_chars == len(cleaned[k].text or "")


def test_repeated_strings(frame, texts):
    got = rows(
        suffixes.judge(frame(texts, repeat=(70,))),
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256",
    )
    want = [(k, *v) for k, v in brute.repeated_bytes(texts).items()]
    assert got == sorted(want + [x for x in want if x[0] == 70])


def test_quality(frame, texts):
    docs = {**texts, 200: "\n\n", 201: "Home | News | About | Contact\n" + "Plain words are here now. " * 3,
            202: "a b c d e f g h i j k. <<<\n" * 2, 203: "End of it…", 204: "No end " * 6}
    got = {r.doc_id: r for r in quality.judge(frame(docs, repeat=(3,))).collect()}
    for k, t in docs.items():
        r = got[k]
        assert brute.quality(t) == (
            r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed
        )
        assert not (r.base_failed and r.kept)


def test_quality_cleans_line_by_line(frame):
    good = "Ten plain words stand here in one quiet clean line."
    more = "Nine other terms follow it without any noise at all!"
    docs = {1: f"{good}\nHome | News | About | Contact\n{more}", 2: "WOW!! BUY!! NOW!! " * 9,
            3: good, 4: None}
    got = {r.doc_id: r for r in quality.clean(frame(docs)).collect()}
    assert {k: r.text for k, r in got.items()} == {1: f"{good}\n{more}", 3: good}
    assert got[1].n_chars == len(got[1].text) and got[1].n_words == -1


def test_url_rules(spark):
    pages = [
        (1, "http://a.Example.NET/en/x?q#f"), (2, "https://example.net/EN/"), (3, None), (4, "no scheme"),
        (5, "http://example.com/de/"), (6, "http://notexample.com/de/"), (7, "http://x.org/fr/1"),
        (8, "http://org"), (9, "://net/"), (10, "http://netx/"), (1, "http://a.Example.NET/en/x?q#f"),
        (11, "http://a.b.net?x=/"), (12, ""), (13, "http://example.net./en/"),
    ]
    frame = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, host string, rule string")
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(brute.LOWER)
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        best = max(
            ((len(r), r, v) for v, r in rules for h, p in [r.split("/", 1)]
             if (host == h or host.endswith("." + h)) and path.startswith("/" + p)), default=None,
        )
        return host, path, best and best[1], best[2] if best else "allow"

    got = urls.judge_urls(frame, urls.rule_table(spark, rules)).collect()
    assert sorted(map(str, got)) == sorted(
        str(type(got[0])(page_id=i, **dict(zip(("host", "path", "rule", "verdict"), plain(u), strict=True))))
        for i, u in pages
    )
    none = urls.judge_urls(frame, urls.rule_table(spark, []), default="block")
    assert {r.verdict for r in none.collect()} == {"block"}


def test_decontamination(frame, spark, texts):
    items = {1: "The first Question, asked with care, has an answer that nobody here would guess; see?",
             2: "tiny", 3: None, 4: "another long item whose words are all quite plain and whose end is near"}
    twisted = items[4].replace("quite plain", "quitte pla1n")
    docs = {300: "before it. " + items[1].upper().replace(" ", "  \n") + " after", 301: f"x {twisted} y",
            302: "the first question, asked with care", 303: "tiny", 304: items[4] + " " + items[1], 305: None,
            306: "abc " * 30_000 + items[1]}
    docs |= {k: t for k, t in texts.items() if k > 60 and k != 115}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.judge(frame(docs), bench).collect()}
    for k, t in docs.items():
        want = [
            i for i, x in items.items()
            if len(brute.fold(x)) >= decontaminate.Q and len(t or "") < 9_000
            and brute.edits_inside(brute.fold(x), brute.fold(t)) <= decontaminate.edit_budget(len(brute.fold(x)))
        ] if k != 306 else [1]
        assert [h.item_id for h in got[k].hits] == want, k
        assert got[k].kept == (not want)
    left = decontaminate.clean(frame(docs), bench)
    assert {r.doc_id for r in left.collect()} == {k for k in docs if got[k].kept}


def test_decontamination_in_blocks_of_items(frame, spark, texts, monkeypatch):
    items = [(i, texts[i]) for i in (70, 90, 91)] + [(90, texts[90])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    other = frame({90: texts[91], 70: None, 71: f"{texts[90]} {texts[91]}"})  # other texts of the ids
    docs = frame(texts, repeat=(0, 70, 90)).union(other)
    whole = rows(decontaminate.judge(docs, bench), "doc_id", "hits", "n_hits", "kept")
    assert len(whole) == len(texts) + 6 and max(r[2] for r in whole) == 3
    assert sorted(r[2] for r in whole if r[0] == 90) == [1, 2, 2]
    left = rows(decontaminate.clean(docs, bench), "doc_id")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert len(list(decontaminate.item_blocks(bench))) > 2
    assert rows(decontaminate.judge(docs, bench), "doc_id", "hits", "n_hits", "kept") == whole
    assert rows(decontaminate.clean(docs, bench), "doc_id") == left


def test_pieces_equal_the_library_and_restore_the_text(frame, spark, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = {**texts, 400: "Hello  world\n x 😀\t ", 401: "aaaaaaa aaaaa", 402: "日本語 ﷽ é é", 403: "  ",
            404: "<s> <0x41> </s>"}
    coded = pieces.encode(frame(docs), path)
    for r in coded.collect():
        assert list(r.ids) == model.encode(docs[r.doc_id] or ""), r.doc_id
        assert r.n_ids == len(r.ids) and r.round_trip
    assert {r.doc_id: r.text for r in pieces.decode(coded, path).collect()} == {k: t or "" for k, t in docs.items()}


def test_unigram_viterbi_equals_a_plain_one():
    model = pieces.Pieces.__new__(pieces.Pieces)
    rng = np.random.default_rng(5)
    texts = [*"abc▁", "ab", "bc", "abc", "▁a", "ca", "▁ab"]
    scores = -rng.permutation(len(texts)).astype(float)
    model.merges, model.byte_ids = False, np.arange(1000, 1256, dtype=np.int32)
    model.build(texts, scores, np.arange(len(texts), dtype=np.int32))

    def plain(word):
        best = [(0.0, [])]
        for end in range(1, len(word) + 1):
            options = [
                (best[s][0] + scores[texts.index(word[s:end])], best[s][1] + [texts.index(word[s:end])])
                for s in range(end) if word[s:end] in texts
            ]
            best.append(max(options, key=lambda x: x[0]))
        return best[-1]

    words = ["".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(60)] + ["▁abca"]
    for word, raw in zip(words, model.solve(words), strict=True):
        ids = np.frombuffer(raw, "<i4")
        assert scores[ids].sum() == plain(word)[0] and "".join(texts[i] for i in ids) == word


def test_token_files(frame, spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = frame({**texts, 410: "It's ΣΑΣ é   İ x"}, repeat=(0, 6, 90, 410))
    folder = shared_folder(spark, "test-token-files")
    manifest = token_files.write(docs, folder, path, shard_bytes=40_000)
    assert len(manifest["shards"]) > 3
    got = sorted(token_files.read(token_files.keys_of(docs), manifest).collect())
    model, at, want = Tokenizer.from_file(path), 0, []
    for k, t in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    missing = spark.createDataFrame([(10**9, 0), (6, 5)], "doc_id long, occurrence long")
    assert token_files.read(missing, manifest).count() == 0


def test_perfect_hash_has_no_gaps():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5_000, dtype=np.uint64))
    levels = token_files.build_levels(keys)
    assert sorted(token_files.slots(keys, levels).tolist()) == list(range(len(keys)))
    index = token_files.Index(token_files.pack_index(keys, np.arange(len(keys)), np.ones(len(keys))))
    other = np.random.default_rng(2).integers(0, 1 << 63, 5_000, dtype=np.uint64)
    assert index.find(keys)[0].all() and index.find(other)[0].sum() <= 1


@pytest.mark.parametrize("per_task", [sharding.GROUPS_PER_TASK, 10])
def test_shards(frame, texts, per_task):
    docs = {k: t for k, t in texts.items() if k != 115}
    got = sharding.shard(frame(docs, repeat=(0, 6, 90)), 6, groups_per_task=per_task).collect()
    assert len(got) == len(docs) + 3
    sums, slots, where = {}, {}, {}
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        where.setdefault(raw, set()).add(r.shard)
    assert set(sums) == set(range(6)) and max(sums.values()) - min(sums.values()) < 2_000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(s) > 1 for s in where.values()) <= 2  # only groups too large for one shard


@pytest.mark.parametrize("per_task", [sharding.GROUPS_PER_TASK, 40])
def test_shards_keep_every_group_that_fits_whole(spark, per_task):
    # Of 6 shards of about 80,000 bytes, copies fill 0.95, 0.7, 0.5 and 0.1; one group fills 1.6.
    groups = [(k, 1_000, n) for k, n in enumerate((128, 76, 56, 40, 8))]
    groups += [(k, 100 + 7 * (k % 150), 1) for k in range(5, 300)]
    table, size = [], {}
    for k, width, copies in groups:
        text = f"{k:05d}" + "x" * (width - 13)
        size[text] = width * copies
        table += [(len(table) + i, text) for i in range(copies)]
    got = sharding.shard(
        spark.createDataFrame(table, "doc_id long, text string"), 6, groups_per_task=per_task
    ).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(table)))
    where, sums = {}, [0] * 6
    for r in got:
        where.setdefault(table[r.doc_id][1], set()).add(r.shard)
        sums[r.shard] += r.size
    even = sum(sums) / 6
    assert all(len(s) == 1 for t, s in where.items() if size[t] <= even)
    assert max(map(len, where.values())) == 2 and max(sums) - min(sums) < even / 40


def test_differencing_balances_and_keeps_all_members():
    sizes = np.array([8, 7, 6, 5, 4], float)
    sums, bins = sharding.difference(sharding.start_items(sizes, 2))
    assert sorted(i for b in bins for i in sharding.flat(b)) == [0, 1, 2, 3, 4]
    assert sums.tolist() == [14, 16]


def test_toxicity(frame, spark):
    import random

    rng = random.Random(1)
    clean = ["plain", "words", "stand", "here", "moronic", "table"]
    docs, marks = {}, []
    for i in range(400):
        w = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            w[0] = rng.choice(["Idiot", "m0r0n", "іdiot,", "MORON!"])
        docs[i] = " ".join(w)
        marks.append((i, int(i % 4 == 0)))
    docs |= {1000: None, 1001: "", 1002: "id1ot " * 3, 1003: "moronic table " * 20}
    marks += [(0, None), (1002, None), (4, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(frame(docs), labels).collect()}
    for i in docs:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1
        assert got[i].predicted == int(got[i].score >= 0.5)
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400))
    assert got[1002].predicted == 1 and got[1003].predicted == 0
    none = toxicity.judge(frame({1: "a b"}), labels.filter("doc_id < 0")).first()
    assert none.score == 0.5 or none.predicted in (0, 1)


def test_empty_tables(empty, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string")
    assert minhash.group(empty).count() == 0 and minhash.clean(empty).count() == 0
    assert substrings.judge(empty).count() == 0 and suffixes.judge(empty).count() == 0
    assert quality.judge(empty).count() == 0 and quality.clean(empty).count() == 0
    assert decontaminate.judge(empty, bench).count() == 0
    assert toxicity.judge(empty, labels).count() == 0
    assert sharding.shard(empty).count() == 0
    assert pieces.encode(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert urls.judge_urls(pages, urls.rule_table(spark, [("block", "net/")])).count() == 0
    manifest = token_files.write(
        empty, shared_folder(spark, "test-empty"), public_tokenizers.path("word_bpe_49k.json")
    )
    assert token_files.read(token_files.keys_of(empty), manifest).count() == 0
