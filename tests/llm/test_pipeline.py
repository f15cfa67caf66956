"""The pipeline's stages, each judged on its own input."""

import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute

import corpus_pipeline
from tessella.llm.shared import stored, table
from tessella.llm.toxicity import score_toxicity


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    schema, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "suffix_dedup", "decontaminate", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stored(stage(spark, docs, sf), f"test-{name}")
        after = {r["doc_id"]: r["text"] for r in out.collect()} if name != "packing" else {}
        if name == "toxicity":
            bad = {r.doc_id for r in score_toxicity(docs, table(spark, sf, "labels")).where("predicted = 1").collect()}
            assert after == {k: v for k, v in before.items() if k not in bad} and bad
        elif name == "near_dedup":
            want = brute.components(list(before.items()), 80)
            assert set(after) == {k for k, (_, c) in want.items() if k == c}
        elif name == "suffix_dedup":
            want = dict(zip(before, brute.repeats(list(before.values()))))
            assert set(after) == set(before) and all(len((after[k] or "").encode()) <= n - gone and (gone or after[k] == before[k]) for k, (n, gone, _, _) in want.items())
            assert all(n - gone - len((after[k] or "").encode()) <= 6 * spans for k, (n, gone, spans, _) in want.items())
        elif name == "decontaminate":
            want = brute.contamination(list(before.items()), [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()])
            assert set(after) == {k for k, (_, hit, _) in want.items() if not hit}
        else:
            assert {r.doc_id for r in out.collect()} == set(before)
        if name != "packing":
            assert out.columns == schema and out.where(F.length("text") != F.col("n_chars")).count() == docs.where(F.length("text") != F.col("n_chars")).count()
        docs = out


def test_run(spark, sf):
    d = corpus_pipeline.run(spark, sf)
    assert d.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(d.columns)


def test_odd_documents(spark, sf):
    """Nulls, repeated rows, long texts, clashing columns, and no rows."""
    from test_operators import ODD, clashing, frame

    d = clashing(spark).withColumn("predicted", F.lit(9)).withColumn("contaminated", F.lit(True))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, sf)
        assert name == "packing" or out.columns == d.columns
        ids = [r["doc_id"] for r in out.collect()]
        assert {1, 2, 3, 8, None} <= set(ids) and (name == "near_dedup" or len(ids) >= len(ODD))
        assert stage(spark, frame(spark, []), sf).count() == 0
