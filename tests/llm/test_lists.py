"""Lists of near-duplicates that have the same members."""

from __future__ import annotations

from boxlake.llm import minhash


def test_lists_with_the_same_members_are_paired_once(spark):
    # Keys 0-99: one passage of 20 texts; keys 100 and 101: the same texts but one, and one text more.
    lists = {**{k: range(20) for k in range(100)}, 100: range(19), 101: range(21)}
    rows = [
        (key, node, 0, node, node > 0, 400, 400, 1 + key)
        for key, nodes in lists.items() for node in nodes
    ]
    apart = spark.createDataFrame(
        rows, "key long, node long, leader long, part long, stray boolean, size long, kept long, place long"
    )
    left = minhash._unlike(apart)
    assert sorted(r.key for r in left.select("key").distinct().collect()) == [0, 100, 101]
    pairs = minhash._stray_pairs(apart, apart.select("key").distinct())
    # Only lists at places of at most 58 can hold the first common value of two similar sets of 400.
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for a in range(1, 20) for b in range(a + 1, 20)}


def test_a_pair_meets_in_few_of_the_lists_that_it_shares(spark):
    # 30 texts, each in nine tenths of 100 lists, so that no two lists and hardly two texts are alike.
    lists = {k: [n for n in range(30) if (n * 7 + k * 3 + n * k) % 10] for k in range(100)}
    leader = {k: max(nodes) if k % 3 else min(nodes) for k, nodes in lists.items()}
    places, rows = dict.fromkeys(range(30), 0), []
    for key, nodes in lists.items():
        for node in nodes:
            places[node] += 1
            rows.append((key, node, leader[key], node, node != leader[key], 400, 400, places[node]))
    apart = spark.createDataFrame(
        rows, "key long, node long, leader long, part long, stray boolean, size long, kept long, place long"
    )
    met = [tuple(r) for r in minhash._stray_meetings(apart, apart.select("key").distinct()).collect()]
    tried = {tuple(sorted((leader[k], n))) for k, nodes in lists.items() for n in nodes if n != leader[k]}
    wanted = {(a, b) for a in range(30) for b in range(a + 1, 30)} - tried
    assert wanted <= set(met)
    assert len(met) < 1.2 * len(set(met))


def test_rows_of_lists_are_dealt_once_each_way(spark):
    # Lists of 2, 3 and 1 members; node 5 has the longest lists together.
    rows = [(1, 5), (1, 6), (2, 5), (2, 6), (2, 7), (3, 8), (4, 5), (4, 7)]
    lists = spark.createDataFrame(rows, "key long, node long")
    shared = minhash._shared(lists)
    assert {tuple(r) for r in shared.collect()} == {(k, n, 5) for k, n in rows if k != 3}
    plan = shared._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 0
    plan = shared._jdf.queryExecution().executedPlan().initialPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3


def test_texts_of_nodes_need_no_table_of_classes(spark, frame):
    docs = frame({k: f"text {k}" for k in range(200)})
    nodes = docs.filter("doc_id % 20 = 0").select(minhash.node_of("doc_id").alias("node"))
    texts = minhash._texts_of(nodes.union(nodes), docs).join(
        docs.select(minhash.node_of("doc_id").alias("node"), "doc_id"), "node"
    )
    assert sorted((r.doc_id, r.text) for r in texts.collect()) == [(k, f"text {k}") for k in range(0, 200, 20)]
