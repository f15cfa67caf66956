"""Queries over the whole of their input, on tables small enough for brute force."""

import random

import pytest
from test_text_spans import edit

from tessella.operators import spans as S
from tessella.plans.catalog import QUERIES


def test_levenshtein(spark, tmp_path):
    same = "the same words for more than sixty characters, " * 3
    texts = [same + "end", same + "other end", "caf\u00e9 " + same, "cafe " + same, "\u00e9\u00e8", "\u00e8", ""]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.l, r.r): r.distance for r in QUERIES["levenshtein"](spark, str(tmp_path)).collect()}
    assert got == {(i, i + 1): edit(a, b) for i, (a, b) in enumerate(zip(texts, texts[1:]))}
    assert got[0, 1] == 6 and got[2, 3] == 1


def test_match_span_fuzzy(spark, tmp_path):
    # without the letters outside ASCII, the second line is empty and counts as found
    lines = ["plain letters", "\u00e9\u00e8" * 6]
    spark.createDataFrame([(1, 1, "\n".join(lines[::-1]))], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    cost = [edit(t, f"zq {lines[1][:9]} qz") for t in (*lines, " ".join(lines[::-1]))]
    assert cost[1] < min(cost[0], cost[2])
    assert [(r.start_line, r.end_line) for r in QUERIES["match_span_fuzzy"](spark, str(tmp_path)).collect()] == [(1, 1)]


def documents(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' lang").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("bucket", [3, 1024])
def test_deepest_node(spark, bucket):
    rng = random.Random(bucket)
    nodes = [(a := rng.randrange(60), a + rng.choice((0, 1, 6, 12, 40))) for _ in range(60)]
    spans = [(a := rng.randrange(70), a + rng.randrange(4)) for _ in range(80)] + [(z, z) for _, z in nodes]
    tree = spark.createDataFrame([("p", i, f"n{i}", True, a, z) for i, (a, z) in enumerate(nodes)], "path string, preorder int, type string, is_named boolean, start_byte int, end_byte int")
    sp = spark.createDataFrame([("p", i, a, z) for i, (a, z) in enumerate(spans)], "path string, span_id int, span_start int, span_end int")
    got = {r.span_id: r.node_type for r in S.deepest_node(sp, tree, bucket=bucket).collect()}
    inside = [[(z - a, -i) for i, (a, z) in enumerate(nodes) if a <= s and z >= e] for s, e in spans]
    assert got == {i: f"n{-min(x)[1]}" if x else None for i, x in enumerate(inside)}


def test_all_tokens_and_lines(spark, tmp_path):
    d = documents(spark, tmp_path, ["a b\n" * 4])
    # tokens: a, space, b, line end, four times; a line end lies in no line's node
    assert {(r.node_type, r.n, r.total) for r in QUERIES["deepest_node"](spark, d).collect()} == {("l0", 6, 42), ("l1", 3, 15), ("l2", 3, 27), ("doc", 4, 36)}
    assert {(r.line, r.n, r.total) for r in QUERIES["token_labels_graph"](spark, d).collect()} == {(1, 4, 6), (2, 4, 22), (3, 4, 38), (4, 4, 54)}


def test_all_layers(spark, sf):
    places = {}
    for r in QUERIES["ordered_metrics"](spark, sf).collect():
        places.setdefault(r.layer, []).append(r.place)
    assert sorted(places) == [0, 1] and all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())


def test_blank_tokens_and_places(spark, tmp_path):
    text = "ab e  ee\nc"
    long = "é" * 700 + "x" * 300
    d = documents(spark, tmp_path, [text, long, None])
    # tokens: ab, space, e, spaces, ee, line end, c; those of long are single é and one run of x
    got = {r.path: (r.n, r.total, r.chars) for r in QUERIES["space_filter"](spark, d).collect()}
    assert got == {"/c/en/0.txt": (3, 0 + 5 + 6, 4), "/c/en/1.txt": (701, sum(range(701)), 1000)}
    got = {(r.doc_id, r.k): r.bytes for r in QUERIES["char_to_byte"](spark, d).collect()}
    assert got == {(i, k): len(x[: k * len(x) // 10].encode()) for i, x in enumerate((text, long, "")) for k in range(11)}


def test_scoring_without_candidates(spark, tmp_path):
    # many random vectors: no pair reaches the least PMI, and no layer has a row to write
    rows = [(i, [1.0, -1.0] if i % 2 else [-1.0, 1.0], i // 2 % 2) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    d = QUERIES["scoring_job"](spark, str(tmp_path))
    assert d.collect() == [] and d.columns[:3] == ["layer", "concept", "feature_id"]
