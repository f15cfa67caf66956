"""Graph patterns on the fixture: which declarations and control structures each finds, and which near misses it doesn't."""

import pytest
from pyspark.sql import functions as F

from tessella import schemas
from tessella.operators import graph as G
from tessella.plans import views as V
from tessella.plans.graph_fixture import build, sources

NAMES = {
    "fixed_value": "a dep p q s x", "gatherer": "sum x", "stepper": "n x z", "walker": "it j", "most_recent_holder": "best got last", "most_wanted_holder": "best", "one_way_flag": "f h mixed t",
    "organizer": "s", "container": "v w", "follower": "fol tmp", "future_return_dependency": "p", "variable_used_in_function": "b dep e s v", "temporary": "tmp", "future_branch_dependency": "a b best last", "future_recursive_call": "b dep",
}
LINES = {"single_control_flow": {42, 84}, "binary_control_flow": {83}, "n_case_control_flow": {80, 86}, "future_loop_entry": {14, 25, 28, 38}, "future_branch_merge": {80}}


@pytest.fixture(scope="module")
def graph(spark):
    return V.fixture_cpg(spark)


@pytest.mark.parametrize("concept", sorted(NAMES))
def test_variables(graph, concept):
    n = graph.nodes.select(F.col("id").alias("var"), "name", "label")
    d = G.default_registry().run(f"{concept}_decl", graph).join(n, "var").collect()
    assert {r.name for r in d} == set(NAMES[concept].split())
    assert all(r.filename != "<empty>" for r in d)


@pytest.mark.parametrize("concept", sorted(LINES))
def test_control(graph, concept):
    n = graph.nodes.select(F.col("id").alias("var"), "line_number")
    assert {r.line_number for r in G.default_registry().run(concept, graph).join(n, "var").collect()} == LINES[concept]


def test_registry(graph):
    r = G.default_registry()
    assert len(r.patterns) == 41 and G.snake_case("FutureLoopEntry") == "future_loop_entry"
    r.register("own", lambda g: g.label("METHOD").select(F.col("id").alias("var"), "filename"))
    assert r.run("own", graph).count() > 5


def test_closure_and_empty_graph(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)], "src int, dst int")
    got = {(r.a, r.b, r.depth) for r in G.closure(chain).collect()}
    assert got == {(i, j, j - i) for i in range(10) for j in range(i + 1, 10)}
    none = G.Cpg(spark.createDataFrame([], schemas.CPG_NODES), spark.createDataFrame([], schemas.CPG_EDGES))
    assert G.default_registry().run("gatherer", none).count() == 0 and G.default_registry().run("future_branch_merge", none).count() == 0


def test_annotations(spark, graph):
    found = G.default_registry().run("future_return_dependency", graph).select(F.lit("r").alias("concept"), "var", "filename", "num_writes")
    files = spark.createDataFrame(sources(build()[0]), schemas.CODE_FILES)
    good, lost = G.annotations(found, graph.nodes, files)
    assert {r.path for r in good.collect()} == {"a.cpp"} and lost.collect()[0].unmatched >= 1
    text = {r.path: r.code.replace("\r\n", "\n") for r in files.collect()}
    assert all(text[r.path][r.span_start : r.span_end] == r.variable_name for r in good.collect())


def test_paths_up(spark):
    tree = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(3, 20), (20, 21), (30, 31)], "src int, dst int")
    got = {(a, r.b) for r in G.paths_up(tree).collect() for a in r.up}
    assert got == {(r.a, r.b) for r in G.closure(tree).collect()}
    assert {r.b: r.up for r in G.paths_up(tree).collect()}[21] == [20, 3, 2, 1, 0]


@pytest.mark.parametrize("concept", sorted({**G.VARIABLES, **G.CONTROL}))
def test_graph_is_not_broadcast(graph, concept):
    # columnar files of a graph are far smaller than its rows: a plan that goes by their size broadcasts any of these tables
    d = {**G.VARIABLES, **G.CONTROL}[concept](graph)
    for x in (d, graph.owned(d.select("d"))):
        assert "Broadcast" not in x._jdf.queryExecution().executedPlan().toString()


def test_places_are_not_broadcast(spark, graph):
    r = G.default_registry()
    r.patterns = {c: r.patterns[c] for c in ("organizer_decl", "organizer", "future_loop_entry")}
    found = r.run_all(graph)
    alone = [(c, x.var, x.filename) for c in r.patterns for x in r.run(c, graph).collect()]
    assert sorted((x.concept, x.var, x.filename) for x in found.collect()) == sorted(alone)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in G.annotations(found, graph.nodes, spark.createDataFrame(sources(build()[0]), schemas.CODE_FILES))]
    assert not any("Broadcast" in p for p in plans)
    # the patterns themselves are no part of the plan
    assert plans[0].count("FileScan") + plans[0].count("Scan ") < 12


def test_graph_of_suppliers_is_dealt(spark, sf):
    n = V.cpg_files(spark, sf)
    assert n.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
