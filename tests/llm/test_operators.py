"""The ten operators: contracts against brute force or SQL, and nulls, ties, repeats, empty tables, long texts and clashing columns."""

import gzip
import hashlib
import os
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute

from tessella.llm import bytesops as B
from tessella.llm import decontaminate, line_crf, shared, near_dedup, packing, quality_rules, suffix_dedup, tokens, toxicity, training_order, url_filter, warc
from tessella.llm.queries import ORACLE, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(3000))
#: A text of several blocks.
HUGE = " ".join(f"w{i * 7919 % 1000003}x" for i in range(180_000))
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t", "en", "s", 5), (4, LONG, "en", "s", len(LONG)), (5, LONG + " end", "en", "s", 1), (6, LONG, "en", "s", 1), (6, LONG, "en", "s", 1), (None, "a null id", "xx", "s", 9), (7, "é" * 400, "fr", "s", 400), (8, "one\ntwo\n\none", "en", "s", 3)]


def frame(spark, data=ODD):
    return spark.createDataFrame(data, DOCS)


@pytest.fixture
def no_broadcasts(monkeypatch):
    """Lookup tables of more than two rows are too large to broadcast."""
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 2)


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    n = int(y.sum())
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def held_out(spark, query, label, folder="/root/testdata/sf0.01"):
    """Scores, predictions and labels of the held-out rows."""
    rows = QUERIES[query](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    return (np.array([r[c] for r in rows]) for c in ("score", "predicted", label))


def clashing(spark):
    """Extra columns that are named like the operators' own."""
    return frame(spark).selectExpr("*", "1 as score", "'x' as gram", "2 as n_words", "3 as rep", "4 as label", "5 as length", "'k' as key", "6 as a", "7 as b", "true as kept")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    r = con.execute(ORACLE[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert Counter(tuple(x[c] for c in cols) for x in df.collect()) == Counter(tuple(x[i] for i in at) for x in r.fetchall())


def test_quality_rules(spark):
    got = {r.doc_id: r for r in quality_rules.quality_rules(clashing(spark)).collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[4].n_words == 3000 and not got[4].base_failed and got[8].n_dup_lines == 1
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0
    again = quality_rules.quality_rules(frame(spark, [(1, "a b c " * 30, "en", "s", 1)])).collect()[0]
    assert again.n_repeat_words == 90 and again.base_failed
    # more languages than may be broadcast: documents are salted, with the same result
    assert Counter(quality_rules.quality_rules(frame(spark)).collect()) == Counter(quality_rules.quality_rules(frame(spark), languages=0).collect())
    plan = quality_rules.with_references(quality_rules.text_counts(frame(spark)))._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan


def test_line_crf(spark):
    score, predicted, y = held_out(spark, "op2_line_crf", "quality")
    assert len(y) > 100 and auc(score, y) > 0.97 and np.mean(predicted[y == 0] == 0) > 0.8 and np.mean(predicted == y) > np.mean(y == 1)
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = line_crf.score_quality(clashing(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = spark.createDataFrame([], labels.schema)
    assert line_crf.score_quality(frame(spark), none).count() == len(ODD) and line_crf.score_quality(frame(spark, []), labels).count() == 0


def test_line_crf_scores(spark, sf):
    """The query's scores against a forward-backward pass in plain loops, document by document, a long one too."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    few = docs.where("doc_id < 60").unionByName(spark.createDataFrame([(-1, HUGE.replace("x w1", "\n"), "en", "s", 1), (-2, None, None, None, None)], DOCS))
    model = line_crf.train(*toxicity.training_sample(few, labels, "quality", 3, 1, line_crf.SAMPLE, line_crf.SAMPLE_CHARS))
    assert "w" in model
    text = {r.doc_id: r.text or "" for r in few.collect()}
    for r in line_crf.score_quality(few, labels).collect():
        b = np.frombuffer(text[r.doc_id].encode(), np.uint8)
        x, size, first = line_crf.line_features(b, np.array([0, len(b)]))
        assert brute.crf_score((x @ model["w"] + model["shift"]).tolist(), size.tolist(), model) == pytest.approx(r.score, abs=1e-6)
        assert len(size) == text[r.doc_id].count("\n") + 1


def test_crf_marginals():
    rng = np.random.default_rng(0)
    unary, first, trans = rng.normal(size=7), np.array([0, 3, 4, 7]), rng.normal(size=(2, 2))
    good, _ = line_crf.forward_backward(unary, first, trans)
    for a, z in zip(first[:-1], first[1:]):
        paths = [[(k >> j) & 1 for j in range(z - a)] for k in range(1 << (z - a))]
        w = np.exp([sum(unary[a + j] * y for j, y in enumerate(p)) + sum(trans[x, y] for x, y in zip(p, p[1:])) for p in paths])
        for j in range(z - a):
            assert good[a + j] == pytest.approx(sum(v for p, v in zip(paths, w) if p[j]) / w.sum())


def test_tokens():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(tokens.default_path()), tokens.WordBPE(tokens.default_path())
    texts = ["", "Don't we'll  it's 'S x'", "Ünïcode ÄÖ ß 12 345,6", "日本 <|endoftext|> x", "a\x00b \u00a0c", LONG, "naïve × ÷ end"]
    raw = [t.encode() for t in texts]
    ids, bounds = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*lib.encode(t, add_special_tokens=False).ids, 1]


def check_packing(rows, limit):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= limit
    return len(by)


def expected_pieces(rows, limit):
    """{(doc_id, piece): (start, length, crc)} by the tokenizers library."""
    from tokenizers import Tokenizer

    lib, out = Tokenizer.from_file(tokens.default_path()), Counter()
    for doc, text in rows:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), limit):
            out[doc, k // limit, k, len(ids[k : k + limit]), zlib.crc32(np.array(ids[k : k + limit], "<u4").tobytes())] += 1
    return out


def test_packing(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op3_packing"](spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected_pieces(docs, 4096)
    assert check_packing(rows, 4096) <= -(-sum(r.length for r in rows) // 4096) * 1.02 + 1
    odd = [*ODD, (10, HUGE, "en", "s", 1)]
    rows = packing.pack_documents(clashing(spark).unionByName(frame(spark, odd[-1:]), allowMissingColumns=True)).collect()
    check_packing(rows, 4096)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected_pieces([x[:2] for x in odd], 4096)
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_packing_salts(spark, monkeypatch, no_broadcasts):
    monkeypatch.setattr(packing, "SALT_ROWS", 3)
    parts = spark.range(900).selectExpr("id doc_id", "0 piece", "id ids_crc32", "if(id % 3 = 0, 4000L, 1 + id % 40) length")
    rows = packing.pack(parts).collect()
    assert len(rows) == 900 and check_packing(rows, 4096) <= 302


def test_packing_plan():
    rng = np.random.default_rng(4)
    every = {k: int(rng.integers(1, 400)) for k in range(1, 4097)}  # no bin is empty: all patterns take part
    runs, n = packing.plan(every)
    assert {k: int(runs[runs[:, 0] == k, 2].sum()) for k in every} == every and n <= -(-sum(k * v for k, v in every.items()) // 4096) * 1.01
    pats = packing.patterns(packing.BINS, packing.PARTS, packing.SLACK)
    assert len(pats) > 3000
    a = np.zeros((packing.BINS, len(pats)))
    for j, p in enumerate(pats):
        for k in p:
            a[k - 1, j] += 1
    b = rng.integers(1, 1000, packing.BINS).astype(float)
    x = packing.nnls(a, b)
    grad = a.T @ (b - a @ x)  # the conditions of the optimum
    assert (x >= 0).all() and grad.max() < 1e-5 and np.abs(grad[x > 0]).max() < 1e-5


def repeated_texts():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(words, n))
    shared = text(120)
    texts = [x[1] for x in ODD] + [text(80) + shared[k : k + 150 + 20 * k] + text(60) for k in range(12)] + [text(60) + shared[60:330] + text(60) for _ in range(30)]
    return [*texts, shared, "ab" * 300, "ab" * 150 + "c", None, text(40) + "ä" + shared[:230], "z" * 5000, "z" * 700 + text(30) + "z" * 300]


@pytest.mark.parametrize("kw", [{}, {"group": 1, "bucket": 2}, {"group": 5, "bucket": 20, "split": 3}])
def test_suffix_dedup(spark, kw):
    texts = repeated_texts()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r._n_bytes, r._n_removed, r._n_spans, r._kept_sha256) for r in suffix_dedup.remove_repeats(d, **kw).collect()}
    assert got == dict(enumerate(brute.repeats(texts)))


def test_suffix_dedup_shuffled(spark, no_broadcasts):
    texts = repeated_texts()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(d).collect()}
    assert got == dict(enumerate(brute.repeats(texts)))


def shuffled(spark, job):
    """Bytes that job writes to shuffles."""
    sc = spark.sparkContext
    bus, store = sc._jsc.sc().listenerBus(), sc._jsc.sc().statusStore()

    def stages():
        bus.waitUntilEmpty()
        got = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {got.apply(i).stageId(): got.apply(i).shuffleWriteBytes() for i in range(got.size())}

    before = stages()
    job()
    return sum(v for k, v in stages().items() if k not in before)


def test_likely(spark, monkeypatch):
    rows = spark.range(-50_000, 50_000).select(F.xxhash64("id").alias("h"), "id")
    for most in (1 << 29, 1 << 15):  # a filter that is too full loses none
        monkeypatch.setattr(shared, "MAX_FILTER", most)
        for n in (0, 1, 3000):
            keys = shared.stored(rows.where(f"id % 7 = 0 and id >= 0 and id < {7 * n}").select("h"), "keys")
            got = [r.id for r in shared.likely(rows, keys, "h").collect()]
            assert keys.count() == n and len(set(got)) == len(got) and {*range(0, 7 * n, 7)} <= {*got}
            assert len(got) <= n + 100_000 * n / min(most, max(1, n) * 16) + 10
    assert shared.likely(rows, keys, "h").columns == rows.columns


def test_suffix_dedup_shuffles_shared_texts(spark, no_broadcasts):
    """Texts and anchors that share nothing with others stay out of the joins."""
    rng = np.random.default_rng(8)
    text = lambda n: rng.bytes(n).hex()
    passage = text(200)
    texts = [text(1500) + (passage + text(100)) * (k % 20 == 0) for k in range(1000)]
    d = shared.stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "documents")
    got = {}
    size = shuffled(spark, lambda: got.update({r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(d).collect()}))
    assert got == {k: x[1] for k, x in enumerate(brute.repeats(texts))} and got[0] >= 400
    assert size < 0.9 * sum(map(len, texts))


def test_suffix_dedup_segments():
    """Anchors of a long text in segments are those of the whole."""
    b = np.frombuffer((HUGE[:300_000] + "q" * 900 + HUGE[1000:3000]).encode(), np.uint8)
    whole = suffix_dedup.anchors(b, np.array([0, len(b)]))
    parts = []
    for first, end, x, z in suffix_dedup.segments(len(b), suffix_dedup.LENGTH - suffix_dedup.GRAM, suffix_dedup.LENGTH, 50_000):
        p, *rest = suffix_dedup.anchors(b[x:z], np.array([0, z - x]))
        own = (p + x >= first) & (p + x < end)
        parts.append([(p + x)[own], *(r[own] for r in rest)])
    assert all((np.concatenate([q[k] for q in parts]) == whole[k]).all() for k in range(4))


def test_suffix_dedup_long(spark):
    passage = " ".join(f"once{i}" for i in range(90))  # 600 bytes or so, in a long text and a short one
    long = HUGE[:800_000] + passage + HUGE[800_000:]
    assert len(long) > 2 * suffix_dedup.SEGMENT
    d = suffix_dedup.remove_repeats(spark.createDataFrame([(1, long), (2, "x " + passage + " y"), (3, "z" * 1_500_000)], "doc_id long, text string"))
    got = {r.doc_id: (r._n_removed, r._n_spans, [tuple(x) for x in r._removed]) for r in d.collect()}
    assert got[1][1] == 1 and got[1][2][0][0] in (800_000, 799_999) and 0 <= got[1][0] - len(passage) <= 2
    assert got[2][1] == 1 and got[3] == (1_500_000, 1, [(0, 1_500_000)])


def test_suffix_dedup_texts(spark):
    d = suffix_dedup.remove_repeats(clashing(spark).selectExpr("*", "8 as _a", "9 as _text", "10 as _x", "11 as _n_bytes")).collect()
    assert len(d) == len(ODD) and {r._kept for r in d if r.doc_id in (4, 6)} == {""} and next(r for r in d if r.doc_id == 8)._kept == "one\ntwo\n\none"
    assert {(r._a, r._text, r._x) for r in d} == {(8, 9, 10)} and {r._n_bytes for r in d if r.doc_id == 2} == {0}
    assert [(x.first, x.end) for x in next(r for r in d if r.doc_id == 5)._removed][0][0] == 0
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0


def test_loser_tree():
    rng = np.random.default_rng(2)
    runs = [sorted(bytes(rng.integers(97, 99, rng.integers(0, 9)).astype(np.uint8)) for _ in range(rng.integers(0, 12))) for _ in range(5)]
    out = list(suffix_dedup.merged([suffix_dedup.decoded(*suffix_dedup.front_coded(r)) for r in runs]))
    want = sorted(x for r in runs for x in r)
    assert [s for _, s, _ in out] == want
    assert [k for k, _, _ in out][1:] == [suffix_dedup.common(a, b, 0) for a, b in zip(want, want[1:])]


def test_url_filter(spark):
    p = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://A.example.org/es/x?y"), (4, "https://a.example.org/en/2#f"), (5, "x://b.com/de/"), (6, "x://b.com/fr/"), (7, "x://b.com/other"), (8, "x://orgs/"), (5, "x://b.com/de/"), (9, "x://c.com/de/" + "q" * 300_000)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(p.selectExpr("*", "1 as host", "2 as key")).collect()}
    assert got[1] == got[2] == ("", "", None, "allow") and got[3][2:] == ("example.org/es/", "block") and got[4][2:] == ("org/", "allow")
    assert got[5][2:] == ("com/de/", "block") and got[6][2:] == ("com/fr/", "allow") and got[7][2:] == (None, "block") and got[8][2:] == (None, "allow")
    assert len(got[9][1]) == 300_004 and got[9][3] == "block"
    assert url_filter.filter_urls(p.limit(0)).count() == 0


@pytest.mark.parametrize("bits,shards", [(url_filter.MAX_BITS, 1), (2048, 3)])
def test_cascade(spark, bits, shards):
    universe = spark.range(4000).select(F.when(F.col("id") < 3999, F.col("id").cast("string")).alias("key"))
    c = url_filter.Cascade(universe, universe.where("key like '%7'"), bits)
    assert c.shards == shards and all(n <= bits for levels in c.levels for _, n in levels)
    got = c.mark(universe, "key", "in")
    assert got.count() == 4000 and got.where("in <> coalesce(key like '%7', false)").count() == 0


def test_decontaminate(spark, monkeypatch):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short, item!"), (3, None), (4, "?!"), (10, "one two three four five six seven eight nine ten"), (None, "null id here now"), (11, "Weiß, straße"), (12, "solo")]
    docs = [(1, "x ONE two three-four five six seven eight nine ten eleven y short item"), (2, None), (3, ""), (4, "short item short item"), (5, "one two three four five six seven eight nine"), (6, "null id here now"), (7, LONG), (8, "a weiß straße SOLO"), (4, "short item short item"),
            (9, HUGE[:1_300_000] + " short item " + HUGE[1_300_000:] + " short " + "y" * 2_000_000 + " item solo")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(docs, items)
    want[6] = (4, 4, [])
    for rows in (None, 0):  # hits by a broadcast, and by a filter and a shuffle
        got = decontaminate.contamination(d, b, broadcast_rows=rows).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in got} == want and len(got) == len(docs)
        assert [(x.first, x.end) for x in next(r for r in got if r.doc_id == 1).hits] == [(1, 12), (13, 15)]
    assert decontaminate.contamination(clashing(spark), b.limit(0), keep=["text", "n_words"]).where("contaminated").count() == 0
    assert decontaminate.contamination(d.limit(0), b).count() == 0


def test_decontaminate_full_bitmap(spark, monkeypatch, no_broadcasts):
    """A bitmap that lets all through, and tables that are shuffled, give the same."""
    monkeypatch.setattr(decontaminate, "MAX_BITS", 64)
    monkeypatch.setattr(decontaminate.Bitmap.__init__, "__defaults__", (64,))
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 14)))) for i in range(40)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(60)] + [(100, items[5][1] + " tail"), (101, items[5][1] + " tail")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in got} == brute.contamination(docs, items, 4)


def test_warc(spark, no_broadcasts):
    big, huge = "<p>" + "é" * 100, "<p>" + "x" * 1_500_000
    rows = [(3, "http://a/\u00e9", big), (1, "u", big), (1, "u", big), (2, None, None), (4, "u", "small"), (5, "u", "small"), (None, "u", big), (6, "u", "x\r\n\r\ny WARC/1.1\r\n"), (7, "u", huge), (8, "v", huge)] + [(k, "u", f"<p>{k % 3}" + "z" * 200) for k in range(20, 29)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as payload", "3 as record_type", "4 as n")
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_round_trip(p).collect())
    n = len(big.encode())
    want = [(3, n, "revisit", 1), (1, n, "response", None), (1, n, "response", None), (2, 0, "response", None), (4, 5, "response", None), (5, 5, "response", None), (None, n, "revisit", 1), (6, 17, "response", None), (7, len(huge), "response", None), (8, len(huge), "revisit", 7)]
    assert got == Counter(want + [(k, 204, "response" if k < 23 else "revisit", None if k < 23 else 20 + (k - 20) % 3) for k in range(20, 29)])
    assert warc.warc_round_trip(p.limit(0)).count() == 0


def test_warc_gaps(spark, tmp_path, caplog):
    p = spark.createDataFrame([(k, "u", f"page {k} " + "x" * 300) for k in range(6)], "page_id long, url string, html string")
    warc.write_warc(p, str(tmp_path / "w"))
    file = next(f for f in (tmp_path / "w").glob("part-*") if f.read_bytes().count(b"page "))
    data = file.read_bytes()
    at = data.index(b"page ")
    file.write_bytes(data[:at] + b"PAGE" + data[at + 4 :])
    (tmp_path / "w" / f".{file.name}.crc").unlink(missing_ok=True)
    found = shared.stored(warc.read_warc(spark, str(tmp_path / "w")), "found")
    assert warc.report_gaps(found) == (5, 1) and "1 gaps" in caplog.text and "digest differs" in caplog.text


def test_warc_many_members():
    """Time in proportion: thousands of members, and as many false starts, in one archive."""
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc"
    data = warc.gzip_members([record] * 3000) + warc.GZIP * 3000 + warc.gzip_members([record])
    out = list(warc.salvage(data))
    assert sum(k == "record" for k, _ in out) == 3001 and [k for k, _ in out].count("gap") == 1


def test_warc_salvage(spark):
    def rec(body):
        return b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s" % (len(body), body)

    good = [rec(b"one"), rec(b"two" * 50), rec(b"three")]
    plain = b"".join(r + warc.END for r in good)
    hurt = plain.replace(b"twotwo", b"twoXXXtwo", 1)
    out = list(warc.salvage(hurt))
    assert [x["payload"] for k, x in out if k == "record"] == [b"one", b"three"]
    gap = [x for k, x in out if k == "gap"]
    assert len(gap) == 1 and hurt[gap[0][0] :].startswith(b"WARC/1.1") and hurt[gap[0][1] :].startswith(good[2])
    packed = warc.gzip_members(good)
    second = packed.find(warc.GZIP, 5)
    broken = packed[: second + 12] + b"\0\0\0" + packed[second + 15 :]
    assert [x["payload"] for k, x in warc.salvage(broken) if k == "record"] == [b"one", b"three"]
    assert [x["payload"] for k, x in warc.salvage(packed) if k == "record"] == [b"one", b"two" * 50, b"three"]
    assert list(warc.salvage(b"")) == [] and [k for k, _ in warc.salvage(b"junk")] == ["gap"]


def test_warc_long_header(spark):
    url = "http://a/?WARC/1.1&" + "q" * 120_000
    p = spark.createDataFrame([(1, url, "<p>" + "x" * 100), (2, "u", "<p>" + "x" * 100), (3, url, None)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_round_trip(p).collect()) == [(1, 103, "response", None), (2, 103, "revisit", 1), (3, 0, "response", None)]
    whole = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 1\r\n\r\n1" + warc.END
    out = list(warc.salvage(b"WARC/1.1\r\nWARC-Refers-To: 7\r\n" + whole))
    assert [k for k, _ in out] == ["gap", "record"] and "warc-refers-to" not in out[1][1]["head"]


def test_warc_one_member():
    def rec(i, body):
        return b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: %d\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Length: %d\r\n\r\n%s" % (i, hashlib.sha256(body).hexdigest().encode(), len(body), body)

    rng = np.random.default_rng(3)
    good = [rec(i, rng.bytes(30_000)) for i in range(4)]
    one = lambda records: gzip.compress(b"".join(r + warc.END for r in records))
    ids = lambda data: [int(x["head"]["x-page-id"]) for k, x in warc.salvage(data) if k == "record"]
    gaps = lambda data: [x for k, x in warc.salvage(data) if k == "gap"]
    whole, hurt = one(good), one([good[0], good[1][:-1] + b"?!", good[2], good[3]])
    assert ids(whole) == [0, 1, 2, 3] and gaps(whole) == []
    assert ids(hurt) == [0, 2, 3] and len(gaps(hurt)) == 1 and gaps(hurt)[0][:2] == (0, len(hurt)) and f"inside: {len(good[0]) + 4} to" in gaps(hurt)[0][2]
    cut = whole[: len(whole) * 5 // 8]
    assert ids(cut) == [0, 1] and gaps(cut)[0][:2] == (0, len(cut)) and "unfinished member, inside" in gaps(cut)[0][2]
    # damaged bytes that still inflate: the member's own check fails, and only records with a digest are taken
    flip = len(whole) * 3 // 8
    damaged = whole[:flip] + bytes([whole[flip] ^ 1]) + whole[flip + 1 :]
    assert ids(damaged) == [0, 2, 3] and len(gaps(damaged)) == 1
    assert ids(cut + whole) == [0, 1, 0, 1, 2, 3]


def test_training_order(spark, tmp_path):
    for n in (1, 2, 5, 100, 257):
        assert sorted(training_order.feistel(np.arange(n), n).tolist()) == list(range(n))
    docs = clashing(spark).unionByName(frame(spark, [(10, HUGE, "en", "s", 1)]), allowMissingColumns=True)
    got = training_order.training_order(docs, length=64, per_shard=16).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(len(got))) and all(r.shard == r.slot // 16 for r in got)
    assert [r.slot for r in got] == training_order.feistel(np.array([r["index"] for r in got]), len(got)).tolist()
    assert training_order.training_order(frame(spark, []), length=64).count() == 0


def test_training_order_content(spark, tmp_path):
    """Every slot's ids against the tokenizer, a split at a time, and the read that goes on at a slot."""
    from tokenizers import Tokenizer

    lib, odd = Tokenizer.from_file(tokens.default_path()), [*ODD, (10, HUGE[:50_000], "en", "s", 1)]
    docs = frame(spark, odd).coalesce(1)
    want, owner = [], []
    for doc, text, *_ in docs.collect():
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        want += ids
        owner += [doc] * len(ids)
    n = -(-len(want) // 64)
    owners = [owner[k * 64] for k in range(n)]
    used = [min(64, len(want) - k * 64) for k in range(n)]
    want += [1] * (n * 64 - len(want))
    raw = [np.array(want[k * 64 : k * 64 + 64], "<u2").tobytes() for k in range(n)]
    rows = training_order.training_order(docs, length=64, per_shard=16).collect()
    assert {r["index"]: (r.doc_id, r.n_ids, r.ids_crc32) for r in rows} == {k: (owners[k], used[k], zlib.crc32(raw[k])) for k in range(n)}
    slots = training_order.feistel(np.arange(n), n)
    base = shared.stored(training_order.sequences(docs, 64), "sequences")
    training_order.write_shards(training_order.ordered(base), str(tmp_path / "s"), n, 64, 16)
    for start in (0, 5, 16, 33, n - 1, n):
        got = list(training_order.resume(spark, str(tmp_path / "s"), start, 64, 16, step=7))
        assert [k for k, _ in got] == list(range(start, n)) and all(ids == raw[int(np.flatnonzero(slots == k)[0])] for k, ids in got)


@pytest.mark.parametrize("batch", [1, 2, 10_000])
def test_training_order_whole_sequences(spark, batch):
    """Batches and splits that end with a sequence have no rest, and those that don't pass theirs on."""
    one = len(tokens.word_bpe(tokens.default_path()).encode(np.frombuffer(LONG.encode(), np.uint8), np.array([0, len(LONG)]))[0])
    docs = frame(spark, [(k, LONG, "en", "s", 1) for k in range(3)]).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for length, want in ((one, [(0, one), (1, one), (2, one)]), (one * 3, [(0, one * 3)]), (one * 2, [(0, one * 2), (2, one)])):
            rows = training_order.sequences(docs, length).orderBy("number").collect()
            assert [(r.doc_id, r.n_ids) for r in rows] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_toxicity(spark):
    score, predicted, y = held_out(spark, "op9_toxicity", "toxic", "/root/testdata/sf0.1")
    assert y.sum() > 50 and auc(score, y) > 0.93 and np.mean(predicted[y == 1]) > 0.8 and np.mean(predicted[y == 0]) < 0.03
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(clashing(spark), labels, keep=["n_words"]).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and toxicity.score_toxicity(frame(spark, []), labels).count() == 0
    for kind in (0, 1):  # a single class, and none: the rate of the sample for all
        one = spark.createDataFrame([(k, kind, kind) for k in (2, 4, 8)], labels.schema)
        assert {r.predicted for r in toxicity.score_toxicity(frame(spark), one).collect()} == {kind}
    assert len({r.score for r in toxicity.score_toxicity(frame(spark), labels.limit(0)).collect()}) == 1


def test_toxicity_scores(spark):
    """Scores against plain loops over words and grams; a long text; runs at every word; unseen spellings."""
    texts = [f"plain words number {i} and more of them" for i in range(60)] + [f"plain words stupidest thing {i} here" for i in range(60)]
    table, bias = toxicity.train(texts, np.array([0] * 60 + [1] * 60))
    raw = [b"plain words and more", b"a stupiddest thing", b"", b"Stupidest", "ä stupidest\tthing".encode(), b"x " * 700_000 + b"stupidest thing"]
    s = np.array([toxicity.document_logits(*toxicity.word_scores(np.frombuffer(r, np.uint8), np.array([0, len(r)]), table.astype(float)), bias)[0] for r in raw])
    assert s == pytest.approx([brute.toxic_logit(r, table, bias) for r in raw], abs=1e-6)
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    assert toxicity.document_logits(*toxicity.word_scores(buf, off, table.astype(float)), bias) == pytest.approx(s, abs=1e-6)
    assert s[0] < 0 < s[1]  # a spelling that training never saw
    one = lambda r: brute.toxic_logit(r, table, bias)
    assert one(b"words more stupidest thing") >= one(b"more stupidest thing") - 1e-9  # words in front take nothing away


def test_training_sample(spark):
    docs = spark.createDataFrame([(k, "long " * 50 if k % 2 else "short") for k in range(60)] + [(0, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(60)], "doc_id long, toxic int")
    texts, y = toxicity.training_sample(docs, labels, "toxic", 5, 0, {1: 10, 0: 5}, 20)
    assert len(texts) == 10 and set(texts) <= {"short", "a"} and set(y.tolist()) == {1}


def near_copies(sizes):
    rng = np.random.default_rng(9)
    words, docs = [f"w{i}" for i in range(500)], []
    for size in sizes:
        base = list(rng.choice(words, 60))
        for k in range(size):
            t = list(base)
            for _ in range(k % 6):
                t[rng.integers(60)] = "edit" + str(rng.integers(9999))
            docs.append(" ".join(t))
    return list(enumerate([*docs, None, "", "a b", "A  b", "a b c d e", "a b c d e f", docs[0]]))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup(spark, percent):
    pairs = near_copies([12] * 12)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string"), percent / 100).collect()}
    assert got == brute.components(pairs, percent)


def test_near_dedup_large_nodes(spark, no_broadcasts):
    """Nodes of many blocks: hubs first, then blocks, with tables that are shuffled."""
    pairs = near_copies([60, 24])
    rows = near_dedup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string"), 0.85, node=2, block=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.components(pairs, 85)


def test_near_dedup_blocks(spark):
    """Every two documents of different components meet in some block, and the main component's rows don't grow with their pairs."""
    rows = spark.range(1000).selectExpr("1L node", "id rep", "1000L n", "if(id < 900, 0L, id) label")
    out = near_dedup._blocked(rows, 20).collect()
    by = {}
    for r in out:
        by.setdefault(r.node, set()).add(r.rep)
    met = {(min(a, b), max(a, b)) for ids in by.values() for a in ids for b in ids if a != b}
    assert all((a, b) in met for a in range(900, 1000) for b in range(a + 1, 1000)) and all((a, b) in met for a in range(0, 900, 37) for b in range(900, 1000))
    assert len(out) == 900 * 5 + 100 * 45 + 100 * 4
    tight = near_dedup._blocked(rows.selectExpr("node", "rep", "n", "if(rep < 999, 0L, rep) label"), 20)
    assert tight.count() < 1000 + 60


def test_near_dedup_verified_shuffles_its_pairs(spark, no_broadcasts, monkeypatch):
    """Sets of documents in no pair stay out of the joins, and pairs are shuffled without their hub's set."""
    rng = np.random.default_rng(4)
    values = [rng.integers(0, 1 << 62, 500).tolist() for _ in range(400)]
    for k in range(1, 11):
        values[k] = values[0][: 500 - 15 * k] + values[k][: 15 * k]
    sets = shared.stored(spark.createDataFrame(list(enumerate(values)), "rep long, shingles array<long>"), "sets")
    pairs = shared.stored(spark.createDataFrame([(k, 0) for k in range(1, 20)], "a long, b long"), "pairs")
    want = {(0, k) for k in range(1, 20) if 100 * (n := len({*values[0]} & {*values[k]})) >= 85 * (1000 - n)}
    got = []
    size = shuffled(spark, lambda: got.extend(near_dedup.verified(pairs, sets, 0.85).collect()))
    assert {(r.a, r.b) for r in got} == want and 0 < len(want) < 10
    assert size < 0.3 * 400 * 500 * 8
    monkeypatch.setattr(near_dedup, "HUB_SHINGLES", 0, raising=False)
    assert {(r.a, r.b) for r in near_dedup.verified(pairs, sets, 0.85).collect()} == want


def test_near_dedup_odd(spark):
    got = near_dedup.near_duplicates(clashing(spark)).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (4, 5, 6)} == {4} and near_dedup.near_duplicates(frame(spark, [])).count() == 0
    nulls = frame(spark, [(None, LONG, "en", "s", 1), (None, LONG + " more", "en", "s", 1)])
    assert near_dedup.near_duplicates(nulls).count() == 2
    long = frame(spark, [(1, HUGE, "en", "s", 1), (2, HUGE + " end", "en", "s", 1), (3, HUGE[:600_000], "en", "s", 1)])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(long).collect()} == brute.components([(r.doc_id, r.text) for r in long.collect()])
    left = near_dedup.drop_near_duplicates(clashing(spark), 0.8)
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [1, 2, 3, 4, 7, 8] and left.columns == clashing(spark).columns


def test_shared_counts():
    sets = [np.array([1, 2, 3]), np.array([2, 3, 9]), np.array([], int), np.array([7])]
    got = near_dedup.shared_counts(np.concatenate(sets).astype(np.int64), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    assert got.tolist() == [[len(set(a) & set(b)) for b in sets] for a in sets]


def test_links():
    """Links of a node against all its pairs: they join exactly what those join, one fewer than the components they unite."""
    rng = np.random.default_rng(4)
    base = [rng.choice(4000, 40, replace=False) for _ in range(6)]
    sets = [np.unique(np.concatenate([base[k % 6][rng.integers(0, 5) :], rng.choice(4000, rng.integers(0, 5))])).astype(np.int64) for k in range(60)]
    rep, label = rng.permutation(60) + 100, np.where(np.arange(60) % 5 == 0, np.arange(60) % 6, np.arange(60) + 10)
    got = near_dedup._links(rep, label, np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 85)

    def parts(pairs):
        of = {int(r): {("label", int(x))} | {int(r)} for r, x in zip(rep, label)}
        groups = []
        for g in [*of.values(), *({a, b} for a, b in pairs)]:
            inside = [x for x in groups if x & g]
            groups = [x for x in groups if not x & g] + [g.union(*inside)]
        return {frozenset(x) for x in groups}

    every = [(int(rep[i]), int(rep[j])) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert parts(got) == parts(every) and len(got) == len(parts([])) - len(parts(every)) > 20


def test_bytes():
    buf, off = B.column(__import__("pyarrow").array(["a b", None, "", "b"]))
    h, s, e, first = B.word_hashes(buf, off, B.NOT_SPACE)
    assert len(h) == 3 and h[1] == h[2] and first.tolist() == [0, 2, 2, 2, 3]
