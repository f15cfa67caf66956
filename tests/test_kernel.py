"""Association, blocks, sweep, purity and coverage against hand-made numbers and plain loops."""

import math
import random

import pytest

from tessella.operators import activations as A
from tessella.operators import association as M
from tessella.operators import blocks as B
from tessella.operators import coverage as C
from tessella.operators import purity as P
from tessella.operators.sweep import threshold_sweep
from tessella.plans import scoring
from tessella.plans.scoring import score

ROWS = "path string, token_index int, concepts array<string>, feature_ids array<int>, feature_activations array<float>"


def rows(spark, data):
    return spark.createDataFrame(data, ROWS)


def small(spark):
    act = {0: 4.0, 1: 3.0, 2: 2.0, 5: 1.0}
    return rows(spark, [("f", i, ["A"] if i < 4 else [], [7] if i in act else [], [act[i]] if i in act else []) for i in range(8)])


def test_hand_made_pair(spark):
    m = M.pair_auc(M.pair_metrics(small(spark), min_joint=1, min_feature=1)).collect()
    assert len(m) == 1
    r = m[0]
    assert (r.count_feature, r.count_concept, r.count_joint) == (4, 4, 3)
    assert (r.precision, r.recall, r.f1, r.lift, r.specificity) == (0.75, 0.75, 0.75, 1.5, 0.25)
    assert r.pmi == pytest.approx(math.log2(1.5)) and r.auroc == 0.75 and r.auprc == 0.6875


def test_hand_made_sweep(spark):
    d = small(spark)
    pairs = M.candidates(M.pair_metrics(d, min_joint=1, min_feature=1), min_pmi=0, min_joint=1)
    r = threshold_sweep(pairs, A.postings(d, ["path", "token_index"]), A.concept_rows(d, ["path", "token_index"]), B.concept_blocks(d)).collect()[0]
    assert (r.tcf, r.precision, r.recall, r.span_recall) == (1.0, 1.0, 0.75, 1.0)
    assert r.optimal_threshold == pytest.approx(5 * 4 / 19)


def test_degenerate_pairs(spark):
    d = rows(spark, [("f", i, ["A"], [1], [1.0]) for i in range(5)])
    r = M.pair_metrics(d).collect()[0]
    assert r.npmi is None and r.specificity is None and r.pmi == 0
    assert M.pair_auc(M.pair_metrics(d)).collect()[0].auroc is None
    empty = rows(spark, [])
    assert M.candidates(M.pair_metrics(empty)).collect() == []
    assert threshold_sweep(M.candidates(M.pair_metrics(empty)), A.postings(empty, ["path", "token_index"]), A.concept_rows(empty, ["path", "token_index"]), B.concept_blocks(empty)).collect() == []


def test_postings_rules(spark):
    d = rows(spark, [("f", 0, None, [3, 3, None, 9], [0.25, 0.75, 5.0]), ("f", 1, None, [], []), ("f", 2, None, None, None), ("f", 3, None, [4], [-1.0])])
    assert sorted(tuple(r) for r in A.postings(d, ["path", "token_index"]).collect()) == [("f", 0, 3, 0.75), ("f", 3, 4, -1.0)]
    assert sorted(r.feature_id for r in A.presence(d, ["path"]).collect()) == [3, 4, 9]
    assert M.feature_marginals(d, []).collect()[0].feature_id == 3


def test_dense_ties(spark):
    d = spark.createDataFrame([(1, [0.5, -1.0, 0.0, 0.5, 2.0]), (2, []), (3, None)], "id int, vector array<float>")
    got = {r.id: (r.feature_ids, r.feature_activations) for r in A.dense_to_sparse(d).collect()}
    assert got == {1: ([4, 0, 3], [2.0, 0.5, 0.5]), 2: ([], []), 3: (None, None)}


def test_blocks_with_repeats(spark):
    d = spark.createDataFrame([("p", i, ["A"]) for i in (1, 1, 2, 2, 5)] + [("q", 3, ["A", "B"])], "path string, token_index int, concepts array<string>")
    got = sorted((r.concept, r.path, r.token_indexes) for r in B.block_members(B.concept_blocks(d)).collect())
    assert got == [("A", "p", [1]), ("A", "p", [1, 2]), ("A", "p", [2]), ("A", "p", [5]), ("A", "q", [3]), ("B", "q", [3])]
    assert len(B.block_members(B.concept_blocks(d, distinct=True)).collect()) == 4


def plain_sweep(tokens, labelled, blocks, bins=20):
    """The sweep as a loop. tokens: {index: activation}, labelled: set of indexes, blocks: lists of indexes."""
    top, best, at = max(tokens.values()), (0.0, 0.0, 0.0, 0.0, 0.0), None
    for i in range(bins):
        tau = i * top / (bins - 1)
        on = {t for t, a in tokens.items() if a > tau}
        tp = len(on & labelled)
        if not tp:
            continue
        p, r, s = tp / len(on), tp / len(labelled), sum(any(t in on for t in b) for b in blocks) / len(blocks)
        f = 2 * p * s / (p + s)
        if f > best[0]:
            best, at = (f, p, r, s, tau), (p, s)
        elif at and p < at[0] and s < at[1]:
            break
    return best


@pytest.mark.parametrize("seed", range(4))
def test_sweep_against_loop(spark, seed):
    rng = random.Random(seed)
    data, want = [], {}
    for c in range(6):
        n = 40
        act = {t: rng.choice([0.5, 1.0, 1.5, rng.random() * 3]) for t in range(n) if rng.random() < 0.5}
        lab = {t for t in range(n) if rng.random() < 0.4}
        runs, last = [], None
        for t in sorted(lab):
            runs.append([t]) if last is None or t != last + 1 else runs[-1].append(t)
            last = t
        data += [(f"p{c}", t, [f"C{c}"] if t in lab else [], [c] if t in act else [], [act[t]] if t in act else []) for t in range(n)]
        want[f"C{c}"] = plain_sweep({t: float(__import__("numpy").float32(a)) for t, a in act.items()}, lab, runs)
    d = rows(spark, data)
    pairs = spark.createDataFrame([(f"C{c}", c) for c in range(6)], "concept string, feature_id int")
    for r in threshold_sweep(pairs, A.postings(d, ["path", "token_index"]), A.concept_rows(d, ["path", "token_index"]), B.concept_blocks(d)).collect():
        assert (r.tcf, r.precision, r.recall, r.span_recall, r.optimal_threshold) == pytest.approx(want[r.concept])


def test_purity(spark):
    cols = "ast_type string, feature_ids array<int>, feature_activations array<float>"
    d = spark.createDataFrame([("a", [1], [3.0]), ("b", [1], [1.0]), (None, [1], [9.0]), (None, [2], [9.0]), ("a", [3], [-1.0])], cols)
    got = P.purity(d).collect()
    assert len(got) == 1 and got[0].ast_purity == pytest.approx(0.188722, abs=1e-6)
    assert (got[0].total_activation, got[0].count_activations, got[0].count_distinct_ast_types) == (4.0, 3, 2)
    one = P.purity(spark.createDataFrame([("a", [1], [3.0])], cols)).collect()[0]
    assert (one.ast_purity, one.total_activation, one.count_activations, one.count_distinct_ast_types) == (1.0, None, None, 1)
    assert P.purity(spark.createDataFrame([], cols)).collect() == []


def test_coverage(spark):
    d = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "concept string, max_tcf double")
    curve = C.coverage_curve(d, points=5)
    assert [r.share for r in curve.orderBy("point").collect()] == [1.0, 1.0, 1.0, 0.5, 0.5]
    assert C.coverage_auc(curve).collect()[0].auc == pytest.approx(0.8125 - 0.0)
    none = C.coverage_curve(spark.createDataFrame([], "concept string, max_tcf double"))
    assert none.collect() == [] and C.coverage_auc(none).collect()[0].auc == 0


def test_score_pipeline(spark, tmp_path):
    """Two layers against the sweep as a loop and counts by hand; the job writes each layer once."""
    rng = random.Random(7)
    data, lab, acts = [], {t for t in range(60) if t % 10 < 4}, {}
    for layer in (0, 1):
        acts[layer] = {t: float(rng.randrange(1, 9)) for t in range(60) if (t in lab) == (rng.random() < 0.8)}
        data += [(layer, "L", "p", t, [7] if t in acts[layer] else [], [acts[layer][t]] if t in acts[layer] else []) for t in range(60)]
    act = spark.createDataFrame(data + [(0, "other", "q", 0, [7], [1.0])], "layer int, language string, path string, token_index int, feature_ids array<int>, feature_activations array<float>")
    labels = spark.createDataFrame([("p", t, "L", ["A"]) for t in sorted(lab)] + [("p", 1, "L", ["rare"])], "path string, token_index int, language string, concepts array<string>")
    found, pairs = score(act, labels, min_pmi=0.1, min_joint=2, threshold=5)
    runs = [[t for t in range(10 * k, 10 * k + 4)] for k in range(6)]
    n_pairs = {(r.layer, r.concept, r.feature_id): (r.count_feature, r.count_concept, r.count_joint, r.n_tokens) for r in pairs.collect()}
    assert n_pairs == {(k, "A", 7): (len(acts[k]), 24, len(lab & set(acts[k])), 60) for k in (0, 1)}
    got = {r.layer: (r.tcf, r.precision, r.recall, r.span_recall, r.optimal_threshold) for r in found.collect()}
    assert sorted(got) == [0, 1] and all(got[k] == pytest.approx(plain_sweep(acts[k], lab, runs)) for k in got)
    folder = {"tcf": str(tmp_path / "tcf"), "ast_purity": str(tmp_path / "purity")}
    kinds = spark.createDataFrame([("p", t, "L", ["x", "even" if t % 2 else "odd"]) for t in range(60)], labels.schema)
    scoring.run(act.where("layer = 0"), labels, None, folder, min_pmi=0.1, min_joint=2, threshold=5)
    scoring.run(act, labels, kinds, folder, min_pmi=0.1, min_joint=2, threshold=5)
    assert {r.layer: r.tcf for r in spark.read.parquet(folder["tcf"]).collect()} == pytest.approx({k: v[0] for k, v in got.items()})
    assert {r.layer for r in spark.read.parquet(folder["ast_purity"]).collect()} == {0, 1}


def test_numbered_metrics(spark):
    d = spark.range(500).selectExpr("concat('c', id % 23) concept", "cast(id as int) feature_id", "double(id % 7) pmi", "1D precision", "1D recall", "1D f1", "id count_joint", "cast(id % 2 as int) layer")
    got = M.numbered_metrics(d, ["layer"]).collect()
    for layer in (0, 1):
        rows = sorted((r for r in got if r.layer == layer), key=lambda r: (r.concept, -r.pmi, -r.count_joint, r.feature_id))
        assert [r.place for r in rows] == list(range(1, 251))
