"""The registered queries of the training-data operators and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.llm.decontaminate import contamination, item_digest
from tessella.llm.line_crf import score_quality
from tessella.llm.near_dedup import near_duplicates
from tessella.llm.packing import pack_documents
from tessella.llm.quality_rules import CLASSES, COMMON, MAX_CHAR_JSD, MAX_WORD_JSD, MIN_CHARS, MIN_WORDS, quality_rules
from tessella.llm.shared import table
from tessella.llm.suffix_dedup import suffix_dedup
from tessella.llm.toxicity import score_toxicity
from tessella.llm.training_order import training_order
from tessella.llm.url_filter import RULES, filter_urls
from tessella.llm.warc import warc_round_trip


def _decontaminate(spark, sf_dir):
    d = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", "n_items", item_digest(F.col("item_ids")).alias("items_sha256"), "contaminated")


QUERIES = {
    "op1_quality_rules": lambda s, d: quality_rules(table(s, d, "documents")),
    "op2_line_crf": lambda s, d: score_quality(table(s, d, "documents"), table(s, d, "labels")),
    "op3_packing": lambda s, d: pack_documents(table(s, d, "documents")),
    "op4_suffix_dedup": lambda s, d: suffix_dedup(table(s, d, "documents")),
    "op5_url_filter": lambda s, d: filter_urls(table(s, d, "pages")),
    "op6_decontaminate": _decontaminate,
    "op7_warc": lambda s, d: warc_round_trip(table(s, d, "pages")),
    "op8_training_order": lambda s, d: training_order(table(s, d, "documents")),
    "op9_toxicity": lambda s, d: score_toxicity(table(s, d, "documents"), table(s, d, "labels")),
    "op10_near_dedup": lambda s, d: near_duplicates(table(s, d, "documents")),
}


def _op1() -> str:
    hist = ", ".join(f"length(t) - length(regexp_replace(t, '{c}', '', 'g'))" for c in CLASSES)
    words = ", ".join(f"'{w}'" for w in COMMON)

    def jsd(h: str, r: str) -> str:
        p, q = f"({h}[i]::double / nullif(list_sum({h}), 0))", f"({r}[i]::double / nullif(list_sum({r}), 0))"
        part = lambda a, b: f"case when {a} > 0 then {a} * log2(2 * {a} / ({a} + {b})) else 0 end"
        return f"(select sqrt(greatest(0, sum({part(p, q)} + {part(q, p)}) / 2)) from unnest(range(1, len({h}) + 1)) u(i) where list_sum({h}) > 0)"

    return rf"""
with d as (select row_number() over () rid, doc_id, lang, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from d),
g as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from w, unnest(range(1, len(w) - 1)) u(i)),
rep as (select rid, i, count(*) over (partition by rid, g) c from g),
cov as (select rid, sum(least(3, coalesce(n - i, 3))) n from (select rid, i, lead(i) over (partition by rid order by i) n from rep where c > 1) group by rid),
k as (select rid, list_position([{words}], lower(x)) b, count(*) n from (select rid, unnest(w) x from w) group by all),
kw as (select rid, list(coalesce(n, 0) order by i) h from (select r.rid, i, k.n from (select distinct rid from d) r cross join unnest(range(1, {len(COMMON) + 1})) u(i) left join k on k.rid = r.rid and k.b = i) group by rid),
c as (select d.rid, d.doc_id, d.lang, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
  (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(cov.n, 0)::bigint n_repeat_words, [{hist}] ch0, length(t) n_chars, list_append(kw.h, len(w) - list_sum(kw.h)) wh
  from w d join kw using (rid) left join cov using (rid)),
e as (select *, list_append(ch0, n_chars - list_sum(ch0)) ch from c),
ref as (select lang, {"[" + ", ".join(f"sum(ch[{i + 1}])" for i in range(len(CLASSES) + 1)) + "]"} rc, {"[" + ", ".join(f"sum(wh[{i + 1}])" for i in range(len(COMMON) + 1)) + "]"} rw from e group by lang),
j as (select e.*, {jsd("ch", "rc")} cj, {jsd("wh", "rw")} wj from e join ref on e.lang is not distinct from ref.lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and (n_chars < {MIN_CHARS} or coalesce(cj, 0) <= {MAX_CHAR_JSD}) and (n_words < {MIN_WORDS} or coalesce(wj, 0) <= {MAX_WORD_JSD}) kept, round(cj, 6) char_jsd, round(wj, 6) word_jsd
from (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from j)"""


def _op5() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    case = lambda k: "case " + " ".join(f"when {fits(h, p)} then '{(h + p, v)[k]}'" for v, h, p in rules) + " end"
    return rf"""
with d as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) path from pages),
r as (select *, {case(0)} rule, {case(1)} v from d),
l as (select distinct host from r where v = 'block')
select page_id, host, path, rule, coalesce(v, case when host in (select host from l) then 'block' else 'allow' end) verdict from r"""


OP7 = """
with d as (select page_id, strlen(coalesce(html, ''))::bigint payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
f as (select payload_digest, min(page_id) first from d where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest, case when first is null or page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to
from d left join f using (payload_digest)"""

OP6 = r"""
with low as (select doc_id, row_number() over () rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
it as (select item_id::varchar item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item, least(10, len(w)) n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') g from it, unnest(range(1, len(w) - least(10, len(w)) + 2)) u(i) where len(w) > 0),
dw as (select rid, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') g from low, (select distinct n from win) s, unnest(range(1, len(w) - s.n + 2)) u(i) where len(w) >= s.n),
hit as (select rid, i, dw.n, item from dw join win using (n, g)),
cov as (select rid, count(distinct p) h from (select rid, unnest(range(i, i + n)) p from (select distinct rid, i, n from hit)) group by rid),
ids as (select rid, count(*) k, string_agg(item, ',' order by item) s from (select distinct rid, item from hit) group by rid)
select doc_id, len(w)::bigint n_words, coalesce(h, 0)::bigint n_hit, coalesce(k, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256, coalesce(h, 0) > 0 contaminated
from low left join cov using (rid) left join ids using (rid)"""

OP4 = r"""
with d as (select row_number() over () rid, doc_id, hex(encode(coalesce(text, ''))) x from documents),
b as (select rid, b, x[2000 * b + 1 : 2000 * b + 2398] y from d, unnest(range(0, length(x) // 2000 + 1)) u(b)),
s as (select rid, 1000 * b + j i, md5(y[2 * j + 1 : 2 * j + 400]) g from b, unnest(range(0, 1000)) u(j) where length(y) >= 2 * j + 400),
g as (select rid, i from (select rid, i, count(*) over (partition by g) c from s) where c > 1),
r as (select rid, i, i > coalesce(max(i) over (partition by rid order by i rows between unbounded preceding and 1 preceding), -1000) + 200 fresh from g),
t as (select rid, sum(fresh::int) over (partition by rid order by i) k, i from r),
c as (select rid, k, min(i) a, max(i) + 200 z from t group by all),
n as (select rid, sum(z - a)::bigint n_removed, count(*) n_spans, list(a order by a) a, list(z order by a) z from c group by rid)
select doc_id, (length(x) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
  sha256(unhex(coalesce(array_to_string(list_transform(range(1, len(a) + 2), lambda j: x[2 * (case when j = 1 then 0 else z[j - 1] end) + 1 : 2 * (case when j > len(a) then length(x) // 2 else a[j] end)]), ''), x))) kept_sha256
from d left join n using (rid)"""

OP10 = r"""
with w as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
g as (select distinct rid, array_to_string(w[i : i + 4], ' ') g from w, unnest(range(1, greatest(2, len(w) - 3))) u(i) where len(w) > 0),
n as (select rid, count(*) n from g group by rid),
rare as (select rid, g, row_number() over (partition by rid order by c, g) r from g join (select g, count(*) c from g group by g) using (g)),
pre as (select rid, g from rare join n using (rid) where r <= n - ceil(0.85 * n) + 1),
cand as (select distinct least(a.rid, b.rid) a, greatest(a.rid, b.rid) b from pre a join pre b using (g) where a.rid < b.rid),
links as (select a, b from (select a, b, count(*) i from cand join g x on x.rid = a join g y on y.rid = b and y.g = x.g group by a, b)
  join n p on p.rid = a join n q on q.rid = b where 100 * i >= 85 * (p.n + q.n - i)),
twoway as (select a, b from links union select b, a from links),
reach as (with recursive r as (select rid a, rid b from w union select r.a, twoway.b from r join twoway on twoway.a = r.b) select a, min(doc_id) c from r join w on w.rid = r.b group by a)
select doc_id, coalesce(n, 0)::bigint n_shingles, c component_id, doc_id = c kept from w join reach on a = rid left join n using (rid)"""

ORACLE = {"op10_near_dedup": OP10, "op4_suffix_dedup": OP4, "op6_decontaminate": OP6, "op1_quality_rules": _op1(), "op5_url_filter": _op5(), "op7_warc": OP7}
