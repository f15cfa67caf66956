"""Sources, writers and jobs over folders; deep nesting; code that is broken."""

import logging

import pytest
from pyspark.sql import functions as F

from tessella import schemas
from tessella.operators import association as M
from tessella.operators import spans as S
from tessella.plans import jobs
from tessella.plans import views as V
from tessella.sources import braces, corpus, html, providers, sinks


def test_deep_pages():
    deep = "<span>" * 5000 + "text" + "<h3>Head</h3><p>About</p><table class='wikitable'><tr><td>a</td><td>b</td></tr></table>"
    assert html.tables(deep) == [("Head", "About", "a", "b")]
    lists = "".join(f"<ul><li>n{i}" for i in range(3000))
    got = html.nested_list(lists, None)
    assert len(got) == 3000 and got[2999][:4] == ("N2999", "", "N2998", 2999)


def test_simple_pages():
    import random

    def by_parser(page):
        t = html._Tree()
        t.feed(page)
        t.close()
        return t.root

    def shape(n):
        return n if isinstance(n, str) else (n.tag, n.attrs, [shape(c) for c in n.children])

    rng = random.Random(4)
    plain = ["<li>", "</li>", "<ul class='a b'>", "</UL>", "<Td ID=\"x>y\">".replace(">y", "y"), "</td >", "<tr>", "<br/>", "<br />", "<p>", "</p>", "<h3\n a='1' b=\"'\">", "text ", " > ", "é[1]", "\r\n", "<b/>"]
    odd = ["&amp;", "<!-- <p> -->", "<a href=x>", "<a checked>", "< b>", "<script>a<b</script>", "<title>x<b></title>", "</p class='x'>", "<", "<p", "<?x?>", "<!DOCTYPE html>", "<my-tag>", "</ p>", "<x a=''>"]
    fast = 0
    for k in range(600):
        page = "".join(rng.choice(plain if k % 2 or rng.random() < 0.8 else odd) for _ in range(rng.randrange(15)))
        assert shape(html.parse(page)) == shape(by_parser(page)), page
        fast += html._simple(page) is not None
    assert fast > 250


def test_deep_code(spark):
    codes = {"sum": "x = " + " + ".join(["1"] * 3000), "minus": "x = " + "-" * 3000 + "1", "null": "x = '\0'", "plain": "x = 1\n", "empty": ""}
    files = spark.createDataFrame([(k, "Python", c) for k, c in codes.items()], schemas.CODE_FILES)
    got = {}
    for r in providers.syntax_trees(files).collect():
        got.setdefault(r.path, []).append(r.type)
    assert set(got) == set(codes) and got["plain"] == ["Module", "Assign", "Name", "Constant"] and got["empty"] == ["Module"]
    assert got["null"] == ["ERROR"] and all(t[0] in ("Module", "ERROR") for t in got.values())


def test_brace_trees(spark):
    code = 'int f(int a) { if (a) { g("x;{"); } else h(a); return 1; } // é }\nclass X { int y[2]; };'
    rows = braces.brace_tree(code, "C++")
    text = [(r[3], code.encode()[r[5] : r[6]].decode()) for r in rows]
    assert ("statement", 'if (a) { g("x;{"); } else h(a);') in text and ("string", '"x;{"') in text and ("comment", "// é }") in text and ("brackets", "[2]") in text and ("keyword", "return") in text
    for r in rows[1:]:  # children lie inside their parents, and after them
        p = rows[r[1]]
        assert p[5] <= r[5] <= r[6] <= p[6] and p[2] < r[2]
    for bad in ("f(", "a }", "( ]"):
        with pytest.raises(SyntaxError):
            braces.brace_tree(bad, "Java")
    files = spark.createDataFrame([("a", "Java", "class A { }"), ("b", "JavaScript", "f(x => { y });"), ("c", "C++", "int x = (;")], schemas.CODE_FILES)
    types = {}
    for r in providers.syntax_trees(files).collect():
        types.setdefault(r.path, []).append(r.type)
    assert types["a"] == ["source", "statement", "keyword", "name", "block"] and "block" in types["b"] and types["c"] == ["ERROR"]
    with pytest.raises(Exception, match="no tree builder"):
        providers.syntax_trees(spark.createDataFrame([("a", "Lua", "")], schemas.CODE_FILES)).collect()


def test_model_edges():
    assert providers.layer_count({"num_hidden_layers": 26}) == 26 and providers.layer_count({"n_layers": 3}) == 3
    assert providers.token_vectors([[1, 2], [3, 4]]) == providers.token_vectors([[[1, 2], [3, 4]]]) == [[1.0, 2.0], [3.0, 4.0]]
    for bad in ([1, 2], [[[1]], [[2]]], [[1, 2], [3]]):
        with pytest.raises(ValueError):
            providers.token_vectors(bad)
    for bad in ({}, {"n_layers": 0}, {"num_hidden_layers": None}):
        with pytest.raises(ValueError):
            providers.layer_count(bad)


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = (spark.createDataFrame([(x,)], "x int") for x in (1, 2))
    assert sinks.write_once(one, path) and not sinks.write_once(two, path) and spark.read.parquet(path).first().x == 1
    assert sinks.write_once(two, path, overwrite=True) and spark.read.parquet(path).first().x == 2
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_invalid_bytes(spark, tmp_path):
    (tmp_path / "Python").mkdir()
    (tmp_path / "Python/a.py").write_bytes(b"x = '\xff'\r\n")
    assert corpus.read_files(spark, str(tmp_path), strict=False).first().code == "x = '�'\n"
    with pytest.raises(Exception, match="MALFORMED_CHARACTER|MALFORMED"):
        corpus.read_files(spark, str(tmp_path)).collect()


def test_selected_concepts(spark):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["c", None]), (4, None), (5, []), (1, ["a", "b"])], "i int, concepts array<string>")
    for limit in (0, 100):
        assert sorted(r.i for r in M.select_concepts(d, 1, limit=limit).collect()) == [1, 1, 2]
        assert M.select_concepts(d, 9, limit=limit).count() == 0
    plan = M.select_concepts(d, 1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_equal_records(spark):
    code = "int x;\n"
    files = spark.createDataFrame([("/c/C/a.c", "C", code)], schemas.CODE_FILES)
    rec = ("k", "C", "/c/C/a.c", [(1, 1, "", "m", [("cat", "A", "idiom", "low", "")])], False, None)
    got = S.token_labels_from_lines(spark.createDataFrame([rec, rec], schemas.LLM_ANNOTATIONS), files, providers.tokens(files)).collect()
    assert len(got) == 2 * providers.tokens(files).count()


def test_tree_label_buckets(spark, sf):
    from tessella.plans.catalog import _tree

    f = V.files(spark, sf).limit(20)
    toks = providers.byte_tokens(f)
    tree = _tree(spark, sf)
    want = {(r.path, r.token_index): r.concepts for r in S.tree_labels(toks, tree).collect()}
    assert {(r.path, r.token_index): r.concepts for r in S.tree_labels(toks, tree, bucket=7).collect()} == want


def test_jobs(spark, tmp_path, caplog):
    (tmp_path / "code/Python").mkdir(parents=True)
    (tmp_path / "code/Python/a.py").write_text("x = 1\ny = x\n")
    code = str(tmp_path / "code")
    out = lambda name: str(tmp_path / name)
    jobs.main(["ast-labels", code, out("ast"), "--languages", "Python,Java"], spark)
    assert "no folder" in caplog.text
    labels = {r.token_index: r.concepts for r in spark.read.parquet(out("ast")).collect()}
    assert labels[0] == ["Module", "Assign", "Name"] and labels[1] == ["Module", "Assign"]
    jobs.main(["activations", code, out("act"), "--layers", "0,1"], spark)
    jobs.main(["activations", code, out("act"), "--layers", "1,2"], spark)
    acts = spark.read.parquet(out("act"))
    assert {r.layer for r in acts.select("layer").distinct().collect()} == {0, 1, 2} and acts.count() == 3 * len(labels)
    (tmp_path / "ann.jsonl").write_text('{"concept": "k", "path": "%s/Python/a.py", "spans": [{"start_line": 1, "end_line": 1, "annotations": [{"label": "A"}]}]}\n' % code)
    jobs.main(["token-labels", "llm", out("ann.jsonl"), code, out("labels")], spark)
    assert {tuple(r.concepts) for r in spark.read.parquet(out("labels")).collect()} == {("A",)}
    jobs.main(["score", out("act"), out("labels"), out("scores"), "--num-act-threshold", "1", "--min-pmi", "0", "--log", out("log.txt")], spark)
    # eight tokens are too few for a pair; a score of a larger corpus is in test_kernel
    assert sinks.cached_layers(spark, out("scores")) == set() and "score written" in (tmp_path / "log.txt").read_text()
    rows = spark.createDataFrame([("/in/b.py", "Python", "x\n" * 20, 1), ("/in/c.py", "Python", "x\n", 2)], "path string, language string, code string, ordinal int")
    rows.write.parquet(out("rows"))
    jobs.main(["corpus", out("rows"), out("corpus")], spark)
    back = corpus.read_files(spark, out("corpus"), known_only=False).collect()
    assert [r.code for r in back] == ["x\n" * 20] and "name=0_b.py" in back[0].path
    logging.getLogger("tessella").handlers.clear()


def test_graph_job(spark, tmp_path):
    from tessella.plans.graph_fixture import build, sources

    g = V.fixture_cpg(spark)
    sinks.write_graph(g.nodes, g.edges, str(tmp_path / "g"))
    files = spark.createDataFrame(sources(build()[0]), schemas.CODE_FILES)
    got = jobs.annotate_graph(spark, str(tmp_path / "g"), files, ["organizer_decl", "future_loop_entry"])
    assert {r.concept for r in got.select("concept").distinct().collect()} == {"organizer_decl", "future_loop_entry"}
    assert got.where(F.col("span_end") <= F.col("span_start")).count() == 0


def test_files_are_dealt(spark, tmp_path):
    # one task holds all rows; every task that has rows writes its own files
    rows = spark.range(60).coalesce(1).selectExpr("concat('L', id % 3) language", "concat('L/', id, '.txt') file_name", "concat('a', chr(10), id) code")
    sinks.write_files(rows, str(tmp_path / "f"))
    tasks = {p.name.split("-")[1] for p in (tmp_path / "f").rglob("part-*.txt")}
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    back = corpus.read_files(spark, str(tmp_path / "f"), known_only=False).collect()
    assert sorted(r.code for r in back) == sorted(f"a\n{i}\n" for i in range(60)) and not list((tmp_path / "f").rglob("_temporary"))
