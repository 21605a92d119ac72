"""The pipeline against its stages' plain versions, and the registered queries against SQL."""

from __future__ import annotations

import brute
import public_tokenizers
import pytest
from compare import compare, duck

import corpus_pipeline
from boxlake.llm import decontaminate, quality
from boxlake.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    ok, note = compare(spark, duck(small), small, QUERIES[name], ORACLES[name])
    assert ok, note


def test_pipeline_equals_plain_stages(spark, tmp_path, texts, frame):
    import sentencepiece

    item = "a benchmark item that stands in one of the clean documents and has to be found there"
    good = "{0} plain prose goes {0} its own way {0} and it ends {0}."
    docs = dict(texts) | {
        500: "\n".join(good.format("abcd"[i] * 9) for i in range(4)) + f"\n{item}.",
        501: "\n".join(good.format("efgh"[i] * 9) for i in range(4)),
    }
    frame(docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {r.doc_id: r.text for r in quality.clean(frame(docs)).collect()}
    kept = {k: t for k, t in kept.items() if brute.groups(kept)[k][1] == k}
    kept = {k: (t if gone else kept[k]) for k, (_, gone, t) in brute.repeated_words(kept).items()}
    folded = brute.fold(item)
    kept = {k: t for k, t in kept.items()
            if len(t) > 20_000 or brute.edits_inside(folded, brute.fold(t)) > decontaminate.edit_budget(len(folded))}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {k: model.encode(t) for k, t in kept.items()}
    assert 501 in got and 500 not in got
