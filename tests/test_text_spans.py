"""Text functions, overlap joins, token labels and snippet matching on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from tessella import schemas
from tessella.functions import text as X
from tessella.operators import snippets as N
from tessella.operators import spans as S
from tessella.plans.prompts import build_prompt
from tessella.sources import corpus, html, providers, sinks, taxonomy


def one(spark, f, *values):
    d = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return d.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize("f,given,want", [
    (X.normalize_text, "  a \n\t b ", "a b"), (X.clean_snippet, " 1: foo\n12:  bar \n", "foo\nbar"), (X.slugify, "Crème Brûlée -- no_1!", "creme-brulee-no_1"), (X.slugify, "layer_/width_16k/canonical", "layer_width_16kcanonical"),
    (X.clean_text, " hELLO[3]  World ", "Hello world"), (X.number_lines, "a\nb\n", "1: a\n2: b"), (X.json_object, "x {\"a\": {}} y } z", "{\"a\": {}} y }"), (X.json_object, "none", None),
])
def test_text(spark, f, given, want):
    assert one(spark, f, given) == want


def test_places(spark):
    assert one(spark, X.word_place, "foobar foo", "foo") == 7 and one(spark, X.word_place, "a.b a", "c") is None
    assert one(spark, lambda a, b: X.code_place(a, b)[0], "  if (x) {", " if (x)\n y") == 2
    assert one(spark, lambda a, b: X.code_place(a, b)[0], "  if (y) {", " if (x)") == 2 and one(spark, lambda a, b: X.code_place(a, b)[0], "x", "  ") is None


def plain_overlap(tokens, spans):
    return sorted((i, j) for i, (a, z) in enumerate(tokens) for j, (s, e) in enumerate(spans) if z > s and a < e)


@pytest.mark.parametrize("seed", range(3))
def test_overlap_join(spark, seed):
    rng = random.Random(seed)
    tokens = [(a := rng.randrange(90), a + rng.randrange(4)) for _ in range(40)]
    spans = [(a := rng.randrange(90), a + rng.randrange(30)) for _ in range(25)]
    t = spark.createDataFrame([("p", i, a, z) for i, (a, z) in enumerate(tokens)], "path string, i int, start_char int, end_char int")
    s = spark.createDataFrame([("p", j, a, z) for j, (a, z) in enumerate(spans)] + [("q", 99, 0, 99)], "path string, j int, span_start int, span_end int")
    for bucket in (3, 1024):
        assert sorted((r.i, r.j) for r in S.overlap_join(t, s, ["path"], bucket=bucket).collect()) == plain_overlap(tokens, spans)


def test_line_table(spark):
    d = spark.createDataFrame([("a", "x\r\nyé\rz\n"), ("b", ""), ("c", "q"), ("d", "\n\n")], "path string, code string")
    got = {}
    for r in S.line_table(d).orderBy("path", "line").collect():
        got.setdefault(r.path, []).append((r.line, r.text, r.line_start, r.line_end))
    assert got == {"a": [(1, "x", 0, 2), (2, "yé", 2, 5), (3, "z", 5, 7)], "b": [(1, "", 0, 0)], "c": [(1, "q", 0, 1)], "d": [(1, "", 0, 1), (2, "", 1, 2)]}
    sp = spark.createDataFrame([("a", 0, 1), ("a", 2, 99), ("a", 3, 1), ("a", 9, 9)], "path string, start_line int, end_line int")
    out = {(r.start_line, r.end_line): (r.span_start, r.span_end) for r in S.line_spans_to_chars(sp, S.line_table(d)).collect()}
    assert out == {(0, 1): (0, 2), (2, 99): (2, 7), (3, 1): (5, 7), (9, 9): (None, None)}


def test_token_labels(spark):
    code = "int x = 1;\nreturn x;\n"
    files = spark.createDataFrame([("/c/C++/a.cpp", "C++", code)], schemas.CODE_FILES)
    toks = providers.tokens(files)
    assert "".join(r.token for r in toks.orderBy("token_index").collect()) == code
    label = lambda n, ev: ("cat", n, "idiom", "low", ev)
    rec = [("k", "C++", "/c/C++/a.cpp", [(1, 1, "", "m", [label("A", "1")]), (1, 2, "", "m", [label("A", "2"), label("B", "3")])], False, None), ("k", "C++", "/c/C++/a.cpp", [], False, "failed"), ("k", "C++", "/c/C++/a.cpp", [(9, 9, "", "m", [label("Z", "")])], False, None)]
    got = S.build_token_labels("llm", spark.createDataFrame(rec, schemas.LLM_ANNOTATIONS), files, toks, False).collect()
    first = {r.token_index: r for r in got}
    assert len(got) == len(first) and first[0].concepts == ["A", "B"] and first[0].annotations[0].evidence == "1" and first[0].language == "C++"
    g = [("g", "/c/C++/a.cpp", "x", 1, 5, "x", 4, 5, None), ("h", "/c/C++/a.cpp", "x", 1, 5, "x", 4, 5, 2)]
    both = S.build_token_labels("graph", spark.createDataFrame(g, schemas.GRAPH_ANNOTATIONS), files, toks).collect()
    assert sorted((r.token, r.concepts[0]) for r in both) == [("x", "g"), ("x", "h")] and both[0].code == code
    with pytest.raises(ValueError):
        S.build_token_labels("none", None, files, toks)


def test_tree_labels(spark):
    tree = spark.createDataFrame([("p", 0, None, 0, "mod", True, 0, 10), ("p", 1, 0, 1, "blk", True, 0, 5), ("p", 2, 1, 2, "blk", True, 2, 4), ("p", 3, 0, 3, "x", False, 5, 9), ("p", 4, 0, 4, "zero", True, 3, 3)], schemas.TREE)
    toks = spark.createDataFrame([("p", 0, 0, "a", 0, 3), ("p", 1, 0, "b", 4, 6), ("p", 2, 0, "", 6, 6), ("p", 3, 0, "d", 2, 4)], "path string, token_index int, token_id int, token string, start_byte int, end_byte int")
    got = {r.token_index: r.concepts for r in S.tree_labels(toks, tree).collect()}
    assert got == {0: ["mod", "blk", "blk"], 1: ["mod", "blk"], 3: ["mod", "blk", "blk", "zero"]}
    sp = spark.createDataFrame([("p", 1, 2, 3), ("p", 2, 4, 6), ("p", 3, 9, 12)], "path string, span_id int, span_start int, span_end int")
    assert {r.span_id: r.node_type for r in S.deepest_node(sp, tree).collect()} == {1: "blk", 2: "mod", 3: None}
    py = providers.syntax_trees(spark.createDataFrame([("f", "Python", "x = 1\n"), ("g", "Python", "x = (")], schemas.CODE_FILES)).collect()
    assert {r.type for r in py if r.path == "f"} >= {"Module", "Assign", "Name", "Constant"} and [r.type for r in py if r.path == "g"] == ["ERROR"]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_match(code, snippet, start, end):
    lines = code.splitlines() or [code]
    norm = lambda s: " ".join(s.split())
    s = snippet.strip()
    if not s:
        return None, None, None
    end = end or start
    if start and end:
        a = max(1, min(start, len(lines)))
        z = max(a, min(end, len(lines)))
        if norm("\n".join(lines[a - 1 : z])) == norm(s):
            return a, z, "exact_bounds"
    near = start or 1
    w = [(a, k, "\n".join(lines[a - 1 : a - 1 + k])) for k in range(1, min(15, len(lines)) + 1) for a in range(1, len(lines) - k + 2)]
    hit = [(abs(a - near), k, a) for a, k, t in w if s in t or t in s]
    if hit:
        _, k, a = min(hit)
        return a, a + k - 1, "exact_search"
    _, _, k, a = min((edit(norm(t), norm(s)), abs(a - near), k, a) for a, k, t in w)
    return a, a + k - 1, "levenshtein"


def test_match_span(spark):
    rng = random.Random(1)
    data = [(-1, "a\nb", "", 1, 1), (-2, "", "x", 0, 0), (-3, "f(x)\n\ng(y)\n", "g(z)", 9, 12), (-4, "aa\n  bb\ncc", "aa\n bb", 1, 2)]
    for i in range(60):
        lines = ["".join(rng.choice("ab (") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 6))]
        a = rng.randrange(len(lines))
        s = "\n".join(lines[a : a + rng.randrange(1, 3)])
        s = s if rng.random() < 0.5 else s.replace("a", "c", 1) + "d"
        data.append((i, "\n".join(lines), s, rng.randrange(0, 7), rng.randrange(0, 7)))
    d = spark.createDataFrame(data, "k int, code string, snippet string, start_hint int, end_hint int")
    got = {r.k: (r.start_line, r.end_line, r.match_method) for r in N.match_span(d, ["k"]).collect()}
    assert got == {k: plain_match(*rest) for k, *rest in data}


def test_collect_spans(spark):
    answers = {
        "a": 'Sure: {"labels": [{"idiom": "Guard", "code_elements": [{"start_line": 2, "end_line": 2, "snippet": "b"}, {"line": 1, "snippet": "a"}]}, {"idiom": "Other", "confidence": "high", "code_elements": ["2: b"]}]} bye',
        "b": "no braces", "c": '{"labels": [{"label": "One", "code_elements": {"start_line": 1, "snippet": "a"}}], "no_pattern_detected": false}', "d": '{"labels": [], "no_pattern_detected": true}',
    }
    d = spark.createDataFrame([("k", "C", p, "a\nb", x) for p, x in answers.items()], "concept string, language string, path string, code string, answer string")
    got = {r.path: r for r in N.collect_spans(d).collect()}
    assert [(s.start_line, s.end_line, [a.label for a in s.annotations]) for s in got["a"].spans] == [(1, 1, ["Guard"]), (1, 2, ["Other"]), (2, 2, ["Guard"])]
    assert got["a"].spans[0].annotations[0].category == "k" and got["a"].spans[1].annotations[0].confidence == "high"
    assert got["b"].error and got["b"].spans == [] and [s.text for s in got["c"].spans] == ["a"] and got["d"].no_pattern_detected and got["d"].error is None
    whole = N.collect_spans(d.where("path = 'a'"), whole_file=True).first().spans
    assert [(s.start_line, s.end_line, s.match_method, len(s.annotations)) for s in whole] == [(1, 2, "full_file", 2)]


def test_corpus_and_sinks(spark, tmp_path):
    (tmp_path / "in/C++").mkdir(parents=True)
    (tmp_path / "in/C++/a.H").write_bytes(b"x\r\ny")
    (tmp_path / "in/C++/b.unknown").write_text("z")
    files = corpus.read_files(spark, str(tmp_path / "in"))
    assert [(r.language, r.code) for r in files.collect()] == [("C++", "x\ny")]
    assert corpus.read_files(spark, str(tmp_path / "in"), known_only=False).count() == 2
    assert corpus.language_by_extension()[".h"] == "C++" and corpus.resolve_graph_languages([" JS", "cpp", "js"]) == ["javascript", "cpp"]
    for bad in (["all", "c"], ["cobol"]):
        with pytest.raises(ValueError):
            corpus.resolve_graph_languages(bad)
    d = spark.createDataFrame([(0, "a"), (1, "b")], "layer int, x string")
    path = str(tmp_path / "layers")
    assert sinks.cached_layers(spark, path) == set()
    sinks.write_layers(d, path)
    sinks.write_layers(d.where("layer = 1").withColumn("x", F.lit("c")), path)
    assert sinks.cached_layers(spark, path) == {0, 1} and sorted(r.x for r in spark.read.parquet(path).collect()) == ["a", "c"]
    (tmp_path / "r.jsonl").write_text('{"concept": "a", "spans": []}\n\n{bad\n')
    got = corpus.read_jsonl(spark, str(tmp_path / "r.jsonl"), schemas.LLM_ANNOTATIONS).collect()
    assert [r.concept for r in got] == ["a", None] and got[1]["_corrupt_record"] == "{bad"
    with pytest.raises(ValueError):
        sinks.write_frame(d, "x.pkl")


def test_taxonomy_html_prompts(spark):
    tree = {"level": 4, "label": "T", "concepts": [{"name": "A", "description": "x", "subconcepts": [{"name": "B"}]}]}
    assert [r[3:] for r in taxonomy.flatten("f", tree, 3)] == [("A", "x", None, None, 0, 0), ("B", None, None, "A", 1, 1)]
    bare = {"name": "Root", "concepts": [{"name": "Leaf"}]}
    assert len(taxonomy.flatten("g", bare)) == 2 and taxonomy.lines(bare) == ["- Label: Root"]
    page = "<h3>One</h3><p>About <b>one</b></p><table class='wikitable'><tr><th>h</th></tr><tr><td>n[1]</td><td>d</td></tr><tr><td>only</td></tr></table><h3>Two</h3>"
    assert html.tables(page) == [("One", "About one", "n", "d")]
    nested = "<ul><li>no</li></ul><ul><li>Imperative – does[2] things<ul><li>Procedural</li></ul></li><li>Other</li></ul>"
    assert html.nested_list(nested) == [("Imperative", "Does things", None, 0, 0), ("Procedural", "", "Imperative", 1, 1), ("Other", "", None, 0, 2)]
    assert "Label this" in build_prompt("idiom", tree)[4]
    with pytest.raises(ValueError):
        build_prompt("poem", tree)
    d = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert html.extract_tables(d).count() == 1


def test_activation_provider(spark):
    files = spark.createDataFrame([("f", "C", "a b")], schemas.CODE_FILES)
    got = providers.activations(files, [0, 1]).collect()
    assert len(got) == 6 and all(r.feature_activations == sorted(r.feature_activations, reverse=True) for r in got) and all(x > 0 for r in got for x in r.feature_activations)


def test_streaming(spark, tmp_path):
    from tessella.streaming.annotations import read_annotations, stream_token_labels

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"concept": "k", "language": "C", "path": "/c/C/f.c", "spans": [{"start_line": 1, "end_line": 1, "text": "", "match_method": "m", "annotations": [{"label": "A"}]}]}\n')
    files = spark.createDataFrame([("/c/C/f.c", "C", "x y")], schemas.CODE_FILES)
    stream_token_labels(read_annotations(spark, str(tmp_path / "in")), files, providers.tokens(files), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_fuzzy_windows_by_brute_force(spark):
    # blank lines, several equal distances, windows of several lines that beat every single one
    import random
    import re

    from tessella.operators.snippets import match_span

    rng = random.Random(3)
    rows = []
    for i in range(60):
        lines = ["".join(rng.choice("ab \u00a0c") for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 12))]
        rows.append((i, "\n".join(lines), "zq " + "".join(rng.choice("abc \n") for _ in range(12)) + " qz", rng.randrange(0, 14), 0))
    d = match_span(spark.createDataFrame(rows, "k int, code string, snippet string, start_hint int, end_hint int"), ["k"], max_lines=4)
    norm = lambda t: re.sub(r"\s+", " ", t).strip(" ")
    got = {r.k: (r.start_line, r.end_line) for r in d.where("match_method = 'levenshtein'").collect()}
    assert len(got) > 12
    for k, code, snippet, hint, _ in rows:
        ls, s = re.split("\n", code), re.sub(r"^\s+|\s+$", "", snippet)
        ls = ls[:-1] if len(ls) > 1 and ls[-1] == "" else ls
        if k in got:
            best = min((edit(norm("\n".join(ls[a - 1 : a - 1 + n])), norm(s)), abs(a - (hint or 1)), n, a) for n in range(1, min(4, len(ls)) + 1) for a in range(1, len(ls) - n + 2))
            assert got[k] == (best[3], best[3] + best[2] - 1)
    plan = d.where("match_method = 'levenshtein' and start_line > 0")._jdf.queryExecution().optimizedPlan().toString()
    # distances are bounded by the best single line, white space is taken out of lines, not of windows, and no filter computes it all again
    assert "_most" in plan and plan.count("levenshtein(") == 2
