"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows. Doubles are rounded to six places on both sides."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import schemas
from tessella.functions import text as X
from tessella.operators import activations as A
from tessella.operators import association as M
from tessella.operators import blocks as B
from tessella.operators import coverage as C
from tessella.operators import graph as G
from tessella.operators import purity as P
from tessella.operators import snippets as N
from tessella.operators import spans as S
from tessella.operators.sweep import threshold_sweep
from tessella.operators.tiles import pieces
from tessella.plans import graph_sql, scoring
from tessella.plans import views as V
from tessella.plans.graph_fixture import build, sources
from tessella.plans.prompts import messages, prompt_parts
from tessella.plans.scoring import labelled_tokens, same_language, same_paths
from tessella.sources import corpus, html, providers, sinks, taxonomy
from tessella.sources.storage import shared_dir

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
MIN_PMI = 0.1  # the driver's vectors are random: no pair reaches the operators' default


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r6(*cols: str) -> str:
    """Rounded columns: "name" or "expression name"."""
    return ", ".join(f"round({c.rpartition(' ')[0] or c}, 6) + 0.0 {c.rpartition(' ')[2]}" for c in cols)


# --- activations and association ---------------------------------------------------------------------------------------------

LAY = """with tok as (select '/c/L' || (vec_id // 50 % 3) || '/' || (vec_id // 50) path, 'L' || (vec_id // 50 % 3) language, (vec_id % 50)::int token_index, ['C' || label, 'P' || (label % 3)] concepts, embedding v from embeddings),
lay as (select 0 layer, * from tok union all select 1, path, language, token_index, concepts, list_transform(v, lambda x: -x) from tok),
post as (select layer, path, token_index, (i - 1)::int feature_id, v[i]::double act from lay, unnest(range(1, len(v) + 1)) u(i) where v[i] > 0),
con as (select path, token_index, unnest(concepts) concept from tok)"""
MET = f"""{LAY}, n as (select layer, count(*) n from lay group by layer), cf as (select layer, feature_id, count(*) cf from post group by all), cc as (select concept, count(*) cc from con group by all),
cj as (select layer, concept, feature_id, count(*) cj from post join con using (path, token_index) group by all having count(*) >= 3),
m0 as (select layer, concept, feature_id, cf count_feature, cc count_concept, cj count_joint, n, cf / n p_feature, cc / n p_concept, cj / n p_joint, log2((cj / n) / ((cf / n) * (cc / n))) pmi, cj / cf "precision", cj / cc recall,
  (cj / cf) / (cc / n) lift, case when n <> cc then (cf - cj) / (n - cc) end specificity from cj join cf using (layer, feature_id) join cc using (concept) join n using (layer) where cf >= 5),
m as (select *, case when p_joint < 1 then pmi / -log2(p_joint) end npmi, 2 * "precision" * recall / ("precision" + recall) f1 from m0),
top as (select * from (select *, row_number() over (partition by layer, concept order by f1 desc, pmi desc, "precision" desc, recall desc, count_joint desc, feature_id)::int rank from m where pmi > {MIN_PMI} and count_joint > 10) where rank <= 20)"""
BLK = """blk as (select concept, path, token_index, sum(fresh) over (partition by concept, path order by token_index) block from (select *, case when token_index = lag(token_index) over (partition by concept, path order by token_index) + 1 then 0 else 1 end fresh from con))"""
SWP = f"""{MET}, {BLK}, mx as (select layer, feature_id, max(act) mx from post group by all), g as (select *, unnest(range(20)) i from top join mx using (layer, feature_id)),
pp as (select layer, concept, feature_id, i, count(*) pp from g join post using (layer, feature_id) where act > i * (mx / 19) group by all),
tp as (select layer, g.concept, feature_id, i, count(*) tp from g join post using (layer, feature_id) join con on con.path = post.path and con.token_index = post.token_index and con.concept = g.concept where act > i * (mx / 19) group by all),
sp as (select layer, concept, feature_id, i, count(distinct (path, block)) sp from (select layer, g.concept, feature_id, i, blk.path, block from g join post using (layer, feature_id) join blk on blk.path = post.path and blk.token_index = post.token_index and blk.concept = g.concept where act > i * (mx / 19)) group by all),
nb as (select concept, count(distinct (path, block)) nb from blk group by all),
pt as (select layer, concept, feature_id, i, mx, tp / pp p, tp / cc r, coalesce(sp, 0) / nb s from pp join tp using (layer, concept, feature_id, i) left join sp using (layer, concept, feature_id, i) join cc using (concept) join nb using (concept) join mx using (layer, feature_id)),
pf as (select *, case when p + s > 0 then 2 * p * s / (p + s) else 0 end f from pt),
st as (select a.layer, a.concept, a.feature_id, min(a.i) stop from pf a join pf b on a.layer = b.layer and a.concept = b.concept and a.feature_id = b.feature_id and b.i < a.i
  where a.f <= b.f and a.p < b.p and a.s < b.s and not exists (select 1 from pf c where c.layer = a.layer and c.concept = a.concept and c.feature_id = a.feature_id and c.i < a.i and (c.f > b.f or c.f = b.f and c.i < b.i)) group by all),
bst as (select layer, concept, feature_id, first(p order by f desc, i) p, first(r order by f desc, i) r, first(s order by f desc, i) s, first(f order by f desc, i) f, first(i * (mx / 19) order by f desc, i) t from pf left join st using (layer, concept, feature_id) where i < coalesce(stop, 20) group by all),
swp as (select layer, concept, feature_id, pmi, count_joint, f1, rank, coalesce(bst.f, 0) tcf, coalesce(bst.p, 0) "precision", coalesce(bst.r, 0) recall, coalesce(bst.s, 0) span_recall, coalesce(bst.t, 0) optimal_threshold from top left join bst using (layer, concept, feature_id))"""  # fmt: skip


def _pairs(s, d):
    return M.pair_metrics(V.activations(s, d), ["layer"])


def _sweep(s, d):
    act, labels = V.activations(s, d), V.label_rows(s, d)
    best = M.candidates(_pairs(s, d), ["layer"], MIN_PMI)
    return threshold_sweep(best, A.postings(act, ["layer", "path", "token_index"]).where("act > 0"), A.concept_rows(labels, ["path", "token_index"]), B.concept_blocks(labels), ["layer"])


@query(f"{LAY} select layer, path, token_index, string_agg(feature_id, ',' order by act desc, feature_id) ids, count(*)::int n, {r6('sum(act) total')} from post group by layer, path, token_index")
def dense_to_sparse(s, d):
    a = V.activations(s, d).where("size(feature_ids) > 0")
    total = F.aggregate("feature_activations", F.lit(0.0), lambda x, y: x + y)
    return rounded(a.select("layer", "path", "token_index", F.array_join(F.col("feature_ids").cast("array<string>"), ",").alias("ids"), F.size("feature_ids").alias("n"), total.alias("total")))


@query(f"{LAY} select layer, path, feature_id, count(*) n, {r6('max(act) act')} from post group by all")
def token_feature_max(s, d):
    a = V.activations(s, d)
    twice = a.withColumns({"feature_ids": F.concat("feature_ids", "feature_ids"), "feature_activations": F.concat(F.transform("feature_activations", lambda x: x / 2), "feature_activations").cast("array<float>")})
    return rounded(A.postings(twice, ["layer", "path", "token_index"]).groupBy("layer", "path", "feature_id").agg(F.count("*").alias("n"), F.max("act").alias("act")))


@query(f"{LAY} select layer, feature_id, count(*) count_feature from post group by all")
def feature_marginals(s, d):
    return M.feature_marginals(V.activations(s, d), ["layer"])


@query(f"{LAY} select concept, count(*) count_concept from con group by all")
def concept_marginals(s, d):
    return M.concept_marginals(V.label_rows(s, d), [])


@query(f"{LAY} select path, token_index, array_to_string(concepts, ',') concepts from tok where exists (select 1 from (select concept from con group by concept having count(*) > 52) k where list_contains(concepts, k.concept))")
def concept_select(s, d):
    return M.select_concepts(V.label_rows(s, d), 52).select("path", "token_index", F.array_join("concepts", ",").alias("concepts"))


@query(f"{LAY} select path, token_index, array_to_string(concepts, ',') concepts from tok where exists (select 1 from (select concept from con group by concept having count(*) > 52) k where list_contains(concepts, k.concept))")
def concept_select_joined(s, d):
    # as for very many concepts
    return M.select_concepts(V.label_rows(s, d), 52, limit=0).select("path", "token_index", F.array_join("concepts", ",").alias("concepts"))


@query(f"{LAY}, once as (select layer, path, token_index, feature_id from post) select layer, feature_id, count(*) n from once group by all")
def feature_presence(s, d):
    a = V.activations(s, d)
    return A.presence(a.withColumn("feature_ids", F.concat("feature_ids", "feature_ids")), ["layer", "path", "token_index"]).groupBy("layer", "feature_id").agg(F.count("*").alias("n"))


@query(f"{LAY} select layer, concept, feature_id, count(*) count_joint from post join con using (path, token_index) group by all")
def joint_counts(s, d):
    return M.joint_counts(V.activations(s, d), ["layer"])


_BATTERY = r6("p_feature", "p_concept", "p_joint", "pmi", "npmi", '"precision"', "recall", "f1", "lift", "specificity")


@query(f"{MET} select layer, concept, feature_id, count_feature, count_concept, count_joint, {_BATTERY} from m")
def pair_metrics(s, d):
    return rounded(_pairs(s, d).drop("n_tokens"))


@query("""with t as (select p_type concept, l_suppkey feature_id from lineitem join part on l_partkey = p_partkey), n as (select count(*) n from t), j as (select concept, feature_id, count(*) cj from t group by all having count(*) >= 3),
f as (select feature_id, count(*) cf from t group by all), c as (select concept, count(*) cc from t group by all)
select concept, feature_id, cj count_joint, round(log2((cj / n) / ((cf / n) * (cc / n))), 6) + 0.0 pmi, round((cj / cf) / (cc / n), 6) + 0.0 lift from j join f using (feature_id) join c using (concept) cross join n where cf >= 5""")
def pair_metrics_items(s, d):
    return rounded(M.pair_metrics(V.items(s, d)).select("concept", "feature_id", "count_joint", "pmi", "lift"))


@query(f"""{MET} select layer, concept, feature_id, round((1 + recall - specificity) / 2, 6) + 0.0 auroc, round(recall * "precision" + (1 - recall) * count_concept / n, 6) + 0.0 auprc from m""")
def pair_auc(s, d):
    return rounded(M.pair_auc(_pairs(s, d)).select("layer", "concept", "feature_id", "auroc", "auprc"))


@query(f"{MET} select layer, concept, feature_id, rank, count_joint, {r6('pmi', 'f1')} from top")
def candidate_topk(s, d):
    return rounded(M.candidates(_pairs(s, d), ["layer"], MIN_PMI).select("layer", "concept", "feature_id", "rank", "count_joint", "pmi", "f1"))


@query(f"""{MET} select layer, concept, feature_id, (row_number() over (partition by layer order by concept, pmi desc, "precision" desc, recall desc, f1 desc, count_joint desc, feature_id))::int place from m""")
def ordered_metrics(s, d):
    return M.numbered_metrics(_pairs(s, d), ["layer"]).select("layer", "concept", "feature_id", "place")


EVT = """with ev as (select user_id::varchar path, (row_number() over (partition by user_id order by ts, event_id) - 1)::int token_index, event_type concept, value act, (props->>'$.k')::int feature_id from events),
con as (select path, token_index, concept from ev), """ + BLK


@query(f"{EVT} select concept, path, block, min(token_index) first_token, max(token_index) last_token, count(*) n_tokens from blk group by all")
def concept_blocks(s, d):
    return B.block_spans(B.concept_blocks(V.events(s, d)))


@query(f"{EVT} select concept, path, block, array_to_string(list(token_index order by token_index), ',') tokens from blk group by all")
def block_members(s, d):
    return B.block_members(B.concept_blocks(V.events(s, d), distinct=True)).select("concept", "path", "block", F.array_join(F.col("token_indexes").cast("array<string>"), ",").alias("tokens"))


@query(f"{EVT} select blk.concept, path, block, feature_id, round(greatest(max(act), 0), 6) + 0.0 act from blk join ev using (path, token_index) group by all")
def concept_blocks_merged(s, d):
    e = V.events(s, d)
    return rounded(B.block_features(B.concept_blocks(e, distinct=True), A.postings(e, ["path", "token_index"])))


_SCORE = r6("pmi", "f1", "tcf", '"precision"', "recall", "span_recall", "optimal_threshold")


@query(f"{SWP} select layer, concept, feature_id, count_joint, rank, {_SCORE} from swp")
def tcf_sweep(s, d):
    return rounded(_sweep(s, d).select("layer", "concept", "feature_id", "count_joint", "rank", "pmi", "f1", "tcf", "precision", "recall", "span_recall", "optimal_threshold"))


@query(f"{SWP}, b as (select layer, concept, max(tcf) t from swp group by all) select layer, i::int point, round(i / 99, 6) + 0.0 tau, round(count(*) filter (t >= i / 99) / count(*), 6) + 0.0 share from b, unnest(range(100)) u(i) group by layer, i")
def coverage_curve(s, d):
    return rounded(C.coverage_curve(C.best_by_concept(_sweep(s, d), ["layer"]), ["layer"]))


@query(f"{SWP}, b as (select layer, concept, max(tcf) t from swp group by all), c as (select layer, i, count(*) filter (t >= i / 99) / count(*) h from b, unnest(range(100)) u(i) group by layer, i) select layer, round(sum(w), 6) + 0.0 auc from (select layer, (h + lag(h) over (partition by layer order by i)) / 2 / 99 w from c) group by layer")
def coverage_auc(s, d):
    return rounded(C.coverage_auc(C.coverage_curve(C.best_by_concept(_sweep(s, d), ["layer"]), ["layer"]), ["layer"]))


@query(f"{SWP} select layer, {r6('max(tcf) max_tcf')}, count(distinct concept) n_concepts from swp group by layer")
def max_tcf_by_layer(s, d):
    return rounded(C.best_by_concept(_sweep(s, d), ["layer"]).groupBy("layer").agg(F.max("max_tcf").alias("max_tcf"), F.count("*").alias("n_concepts")))


@query(f"{SWP} select concept, {r6('max(tcf) max_tcf')} from swp where contains(concept, 'C') group by concept order by max(tcf) desc, concept limit 10")
def top_scores(s, d):
    return rounded(C.top_scores(_sweep(s, d), "C"))


PUR = """with p as (select value a, event_type t, (props->>'$.k')::int f from events), k as (select count(distinct t) k from p), g as (select f, t, sum(a) a, count(*) n from p where a > 0 group by all), s as (select *, sum(a) over (partition by f) tot from g),
pur as (select f feature_id, 1 + sum(a / tot * log2(a / tot)) / log2(any_value(k)) ast_purity, any_value(tot) total_activation, sum(n)::bigint count_activations, count(*) count_distinct_ast_types from s cross join k group by f)"""


@query(f"{PUR} select feature_id, count_activations, count_distinct_ast_types, {r6('ast_purity', 'total_activation')} from pur")
def ast_purity(s, d):
    return rounded(P.purity(V.events(s, d), kind="event_type"))


@query(f"{PUR} select round(avg(ast_purity), 6) + 0.0 mean_purity, count(*) n_features from pur")
def purity_mean(s, d):
    return rounded(C.purity_mean(P.purity(V.events(s, d), kind="event_type")))


@query(f"{PUR} select feature_id, round(ast_purity, 6) + 0.0 ast_purity from pur where ast_purity > 0 order by pur.ast_purity desc, feature_id limit 10")
def purest_features(s, d):
    return rounded(P.purity(V.events(s, d), kind="event_type").orderBy(F.desc("ast_purity"), "feature_id").limit(10).select("feature_id", "ast_purity"))


@query("select event_type concept, count(*) n from events group by all")
def label_counts(s, d):
    return M.label_counts(V.events(s, d))


@query(f"{LAY}, k as (select concept from con group by concept having count(*) > 52) select layer, path, token_index, case when exists (select 1 from k where list_contains(concepts, k.concept)) then array_to_string(concepts, ',') end concepts from lay")
def labels_left_join(s, d):
    labels = M.select_concepts(V.label_rows(s, d), 52)
    return labelled_tokens(V.activations(s, d).drop("concepts"), labels).select("layer", "path", "token_index", F.array_join("concepts", ",").alias("concepts"))


@query(f"{LAY} select layer, language, count(*) n from lay where language in ('L0', 'L2') group by all")
def semi_language(s, d):
    return same_language(V.activations(s, d), V.label_rows(s, d).where("language <> 'L1'")).groupBy("layer", "language").agg(F.count("*").alias("n"))


@query(f"{LAY} select path, count(*) n from lay where layer = 1 and path in (select path from tok where token_index = 7 and list_contains(concepts, 'P1')) group by all")
def layer_alignment(s, d):
    a = V.activations(s, d)
    return same_paths(a.where("layer = 1"), a.where("layer = 0 and token_index = 7 and array_contains(concepts, 'P1')")).groupBy("path").agg(F.count("*").alias("n"))


# --- text and spans ----------------------------------------------------------------------------------------------------------

DOC = "doc as (select doc_id, '/c/' || coalesce(lang, '?') || '/' || doc_id || '.txt' path, lang language, coalesce(text, '') code from documents)"
LIN = f"""with {DOC}, l0 as (select doc_id, path, k line, split(code, chr(10)) ls from doc, unnest(range(1, len(split(code, chr(10))) + 1)) u(k)),
l1 as (select doc_id, path, line, ls[line] t, len(ls) n, sum(length(ls[line]) + 1) over (partition by doc_id order by line) e, sum(strlen(ls[line]) + 1) over (partition by doc_id order by line) be from l0),
lin as (select doc_id, path, line, t, e - length(t) - 1 line_start, case when line = n then e - 1 else e end line_end, be - strlen(t) - 1 bs from l1 where line < n or length(t) > 0 or line = 1)"""
TOK = rf"""{LIN}, tk0 as (select path, unnest(regexp_extract_all(code, '\w+|\s+|[^\w\s]')) token, generate_subscripts(regexp_extract_all(code, '\w+|\s+|[^\w\s]'), 1) - 1 token_index from doc),
tk as (select path, token_index, token, sum(length(token)) over w - length(token) a, sum(length(token)) over w z, sum(strlen(token)) over w - strlen(token) ba, sum(strlen(token)) over w bz from tk0 window w as (partition by path order by token_index rows unbounded preceding))"""


@query(f"{LIN} select path, line::int line, line_start::bigint line_start, line_end::bigint line_end from lin")
def line_offsets(s, d):
    return S.line_table(V.files(s, d)).select("path", "line", "line_start", "line_end")


@query(f"{LIN}, sp as (select path, doc_id % 5 a, doc_id % 7 + 1 b from doc), c as (select path, a, b, greatest(a, 1) x, greatest(b, greatest(a, 1)) y from sp), n as (select path, max(line) n from lin group by all) select c.path, a start_line, b end_line, s.line_start::bigint span_start, case when s.line_start is not null then e.line_end::bigint end span_end from c join n using (path) left join lin s on s.path = c.path and s.line = x left join lin e on e.path = c.path and e.line = least(y, n)")
def line_span_to_char_span(s, d):
    f = s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("/c/"), F.coalesce("lang", F.lit("?")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), (F.col("doc_id") % 5).alias("start_line"), (F.col("doc_id") % 7 + 1).alias("end_line"))
    return S.line_spans_to_chars(f, S.line_table(V.files(s, d)))


@query(f"{TOK} select tk.path, line::int line, count(*) n, sum(token_index)::bigint total, sum(length(token))::bigint chars from tk join lin on lin.path = tk.path and z > line_start and a < line_end group by all")
def interval_overlap_join(s, d):
    lines = S.line_table(V.files(s, d)).select("path", "line", F.col("line_start").alias("span_start"), F.col("line_end").alias("span_end"))
    j = S.lines_over_tokens(V.files(s, d), lines, providers.token_texts())
    return j.groupBy("path", F.col("s.line").alias("line")).agg(F.count("*").alias("n"), F.sum("p.i").alias("total"), F.sum(F.length("p.item")).alias("chars"))


def _tree(s, d):
    f = V.files(s, d)
    root = f.select("path", F.lit(0).alias("preorder"), F.lit("doc").alias("type"), F.lit(0).alias("start_byte"), F.octet_length("code").alias("end_byte"))
    lines = pieces(f, ["path"], F.split("code", "\n"), "byte", gap=1).select("path", F.inline("_p"))
    lines = lines.select("path", (F.col("i") + 1).alias("preorder"), F.concat(F.lit("l"), (F.col("i") % 3).cast("string")).alias("type"), F.col("start").cast("int").alias("start_byte"), (F.col("end") - 1).cast("int").alias("end_byte"))
    return root.unionByName(lines).withColumn("is_named", F.lit(True))


TRE = f"{TOK}, tre as (select path, 0 preorder, 'doc' type, 0 a, strlen(code) z from doc union all select path, line, 'l' || (line - 1) % 3, be - strlen(t) - 1, be - 1 from l1)"


@query(f"{TRE}, h as (select tk.path, token_index, list(type order by preorder) c from tk left join tre on tre.path = tk.path and tk.bz > tre.a and tk.ba < tre.z group by tk.path, token_index) select path, c[-1] ast_type, count(*) n, sum(len(c))::bigint hits from h group by all")
def tree_overlap_join(s, d):
    t = S.tree_labels_of_files(V.files(s, d), _tree(s, d), providers.token_texts())
    return t.groupBy("path", X.last_element(F.col("concepts")).alias("ast_type")).agg(F.count("*").alias("n"), F.sum(F.size("concepts").cast("long")).alias("hits"))


@query(f"{TRE}, h as (select tk.path, tk.token_index, first(type order by z - a, preorder desc) node_type from (select path, token_index, ba, bz from tk) tk join tre on tre.path = tk.path and tre.a <= ba and tre.z >= bz group by all) select tk.path, node_type, count(*) n, sum(token_index)::bigint total from tk left join h using (path, token_index) group by all")
def deepest_node(s, d):
    t = S.deepest_node_of_files(V.files(s, d), _tree(s, d), providers.token_texts())
    return t.groupBy("path", "node_type").agg(F.count("*").alias("n"), F.sum("p.i").alias("total"))


@query("""with r as (select *, row_number() over (partition by conv_id, role, text order by turn) k from conversations)
select conv_id, string_agg(role || text, ',' order by turn) labels, string_agg(turn, ',' order by turn) turns from r where k = 1 group by conv_id""")
def annotation_dedup(s, d):
    # each conversation twice over, so that every label comes again
    c = V.table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("l")))).alias("a"))
    a = F.transform(F.concat("a", "a"), lambda x: F.struct(x["role"].alias("category"), x["l"].alias("label"), F.lit("t").alias("label_type"), F.lit("low").alias("confidence"), x["turn"].cast("string").alias("evidence")))
    k = S.dedupe_annotations(a, S.LABEL_KEYS)
    return c.select("conv_id", F.array_join(F.transform(k, lambda x: F.concat(x["category"], x["label"])), ",").alias("labels"), F.array_join(F.transform(k, lambda x: x["evidence"]), ",").alias("turns"))


def _records(s, d):
    """Two spans of lines for each document: lines 1-2 labelled A, lines 2-4 labelled A and B."""
    one = lambda name, ev: F.struct(F.lit("cat").alias("category"), F.lit(name).alias("label"), F.lit("idiom").alias("label_type"), F.lit("low").alias("confidence"), F.lit(ev).alias("evidence"))
    span = lambda a, b, x: F.struct(F.lit(a).alias("start_line"), F.lit(b).alias("end_line"), F.lit("").alias("text"), F.lit("exact_bounds").alias("match_method"), F.array(*x).alias("annotations"))
    return V.files(s, d).select(F.lit("k").alias("concept"), "language", "path", F.array(span(1, 2, [one("A", "x")]), span(2, 4, [one("A", "y"), one("B", "z")])).alias("spans"), F.lit(False).alias("no_pattern_detected"), F.lit(None).cast("string").alias("error"))


@query(rf"""{TOK}, n as (select path, max(line) n from lin group by all), sp as (select n.path, k, s.line_start a, e.line_end z from n, (values (1, 1, 2), (2, 2, 4)) v(k, x, y) join lin s on s.path = n.path and s.line = x join lin e on e.path = n.path and e.line = least(y, n)),
h as (select tk.path, token_index, token, string_agg(k, '' order by k) ks from tk join sp on sp.path = tk.path and tk.z > sp.a and tk.a < sp.z group by all)
select path, case when ks = '1' then 'A' else 'A,B' end concepts, count(*) n, sum(token_index)::bigint total from h where replace(token, '▁', '') <> '' group by all""")
def token_labels(s, d):
    f = V.files(s, d)
    t = S.build_token_labels("llm", _records(s, d), f, providers.token_texts())
    return t.groupBy("path", F.array_join("concepts", ",").alias("concepts")).agg(F.count("*").alias("n"), F.sum("token_index").alias("total"))


@query(f"{TOK} select tk.path, line, count(*) n, sum(token_index)::bigint total from tk join (select path, line::int line, line_start, line_end from lin) l on l.path = tk.path and z > line_start and a < line_end group by all")
def token_labels_graph(s, d):
    f = V.files(s, d)
    g = S.line_table(f).select(F.lit("g").alias("concept"), "path", F.lit("v").alias("variable_name"), "line", F.lit(1).alias("column"), F.lit("").alias("code"), F.col("line_start").alias("span_start"), F.col("line_end").alias("span_end"), F.lit(None).cast("int").alias("num_writes"))
    t = S.build_token_labels("graph", g, f, providers.token_texts(), filter_space_tokens=False)
    return t.groupBy("path", "line").agg(F.count("*").alias("n"), F.sum("token_index").alias("total"))


@query("select doc_id, k::int k, strlen(left(coalesce(text, ''), (k * length(coalesce(text, '')) // 10)::bigint))::int bytes from documents, unnest(range(11)) u(k)")
def char_to_byte(s, d):
    x = V.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    at = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.struct(k.alias("k"), X.char_to_byte(F.col("text"), F.floor(F.length("text").cast("long") * k / 10).cast("int")).alias("bytes")))
    return x.select("doc_id", F.inline(at))


@query(f"{TOK}, m as (select path, token_index, replace(replace(token, ' ', '▁'), 'e', '▁') token from tk) select path, count(*) n, sum(token_index)::bigint total, sum(length(token))::bigint chars from m where replace(token, '▁', '') <> '' group by path")
def space_filter(s, d):
    x = providers.tokens(V.files(s, d)).withColumn("token", F.replace(F.replace("token", F.lit(" "), F.lit("▁")), F.lit("e"), F.lit("▁")))
    return x.where(~X.is_space_token(F.col("token"))).groupBy("path").agg(F.count("*").alias("n"), F.sum("token_index").alias("total"), F.sum(F.length("token")).alias("chars"))


@query("select doc_id from documents where lang in ('en', 'de') and length(text) - length(replace(text, chr(10), '')) between 2 and 30 order by doc_id limit 150")
def corpus_filter(s, d):
    x = V.table(s, d, "documents").select("doc_id", F.col("lang").alias("language"), F.col("text").alias("code"), F.col("doc_id").alias("ordinal"))
    return corpus.filter_corpus(x, ["en", "de"], 2, 30, 150).select("doc_id")


@query("select doc_id, lang || '/' || (row_number() over (partition by lang order by doc_id) - 1) || '_' || doc_id || '.txt' file_name from documents")
def corpus_names(s, d):
    x = V.table(s, d, "documents").select("doc_id", F.col("lang").alias("language"), F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return corpus.corpus_names(x, "doc_id").select("doc_id", "file_name")


@query("select page_id, case page_id % 4 when 0 then 'Python' when 1 then 'C++' when 2 then 'TypeScript' else 'd' || page_id % 9 end language from pages")
def language_resolution(s, d):
    ext = F.element_at(F.array(*map(F.lit, (".PY", ".h", ".tsx", ".unknown"))), (F.col("page_id") % 4 + 1).cast("int"))
    p = V.table(s, d, "pages").select("page_id", F.concat(F.lit("/c/d"), (F.col("page_id") % 9).cast("string"), F.lit("/f"), F.col("page_id").cast("string"), ext).alias("path"))
    return p.select("page_id", corpus.language_of(F.col("path")).alias("language"))


def bytewise(table: str) -> str:
    """Relation x (f, g): the characters of the table's texts that aren't printable ASCII or white space, and a control character for each. DuckDB's edit distance counts bytes; an error if there are more than 22."""
    return rf"""x as (select f, case when length(f) > 22 then error('more characters than stand-ins') else left((select string_agg(chr(i::int), '' order by i) from (select unnest(range(1, 9) || range(14, 28)) i)), length(f)) end g
from (select coalesce(string_agg(distinct c, '' order by c), '') f from (select unnest(string_split(regexp_replace(text, '[\x09-\x0D\x1C-\x7F]', '', 'g'), '')) c from {table}) where c <> ''))"""


@query(f"with {bytewise('benchmark')}, t as (select item_id, translate(text, f, g) text from benchmark cross join x) select a.item_id l, b.item_id r, levenshtein(a.text, b.text)::int distance from t a join t b on b.item_id = a.item_id + 1")
def levenshtein(s, d):
    t = V.table(s, d, "benchmark").select("item_id", "text")
    return t.join(t.select((F.col("item_id") - 1).alias("_before"), F.col("item_id").alias("r"), F.col("text").alias("b")), F.col("item_id") == F.col("_before")).select(F.col("item_id").alias("l"), "r", F.levenshtein("text", "b").alias("distance"))


@query(r"select doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) text from documents")
def normalize_text(s, d):
    return V.table(s, d, "documents").select("doc_id", X.normalize_text(F.coalesce("text", F.lit(""))).alias("text"))


@query(r"select conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') text from conversations")
def clean_snippet(s, d):
    return V.table(s, d, "conversations").select("conv_id", "turn", X.clean_snippet(X.number_lines(F.col("text"))).alias("text"))


@query("select conv_id, turn, array_to_string(list_transform(split(text, chr(10)), lambda x, i: i || ': ' || x), chr(10)) text from conversations")
def number_lines(s, d):
    return V.table(s, d, "conversations").select("conv_id", "turn", X.number_lines(F.col("text")).alias("text"))


@query(r"select page_id, regexp_replace(lower(trim(regexp_replace(regexp_replace(strip_accents(split(url, '://')[2]), '[^\x00-\x7F]', '', 'g'), '[^\w\s-]', '', 'g'))), '[-\s]+', '-', 'g') slug from pages")
def slugify(s, d):
    return V.table(s, d, "pages").select("page_id", X.slugify(F.get(F.split("url", "://"), F.lit(1))).alias("slug"))


SNP = f"""with {DOC}, c as (select doc_id, case when len(l) > 1 and l[-1] = '' then l[1 : len(l) - 1] else l end l from (select doc_id, split(code, chr(10)) l from doc)),
q as (select doc_id, l, len(l) n, regexp_replace(l[greatest(1, len(l) // 2)], '^\\s+|\\s+$', '', 'g') q, (doc_id % 4 + 1)::int h from c),
w as (select doc_id, a, k, array_to_string(l[a : a + k - 1], chr(10)) t from q, unnest(range(1, n + 1)) x(a), unnest(range(1, least(15, n - a + 1) + 1)) y(k) where q <> ''),
e as (select doc_id, first(a order by abs(a - h), k, a) a, first(k order by abs(a - h), k, a) k from w join q using (doc_id) where contains(t, q) or contains(q, t) group by doc_id),
b as (select doc_id, least(h, n) a, trim(regexp_replace(l[least(h, n)], '\\s+', ' ', 'g')) = trim(regexp_replace(q, '\\s+', ' ', 'g')) same from q where q <> '')"""


@query(f"{SNP} select q.doc_id, case when same then b.a else e.a end::int start_line, case when same then b.a else e.a + e.k - 1 end::int end_line, case when same then 'exact_bounds' when e.a is not null then 'exact_search' end match_method from q left join b using (doc_id) left join e using (doc_id)")
def match_span(s, d):
    f = V.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("code"), (F.col("doc_id") % 4 + 1).cast("int").alias("start_hint"))
    ls = X.split_lines(F.col("code"))
    f = f.withColumns({"snippet": F.get(ls, F.greatest(F.lit(1), F.floor(F.size(ls) / 2).cast("int")) - 1), "end_hint": F.lit(0)})
    return N.match_span(f, ["doc_id"]).select("doc_id", "start_line", "end_line", "match_method")


@query(rf"""with {bytewise('conversations')}, p as (select conv_id, turn, translate(text, f, g) text from conversations cross join x), c as (select *, 'zq ' || left(text, 9) || ' qz' q, split(text, chr(10)) ls from p),
w as (select conv_id, turn, q, a, k, array_to_string(ls[a : a + k - 1], chr(10)) r from c, unnest(range(1, len(ls) + 1)) x(a), unnest(range(1, least(15, len(ls) - a + 1) + 1)) y(k)),
v as (select *, levenshtein(trim(regexp_replace(r, '\s+', ' ', 'g')), trim(regexp_replace(q, '\s+', ' ', 'g'))) cost from w),
g as (select conv_id, turn, first(a order by cost, abs(a - 1), k, a) a, first(k order by cost, abs(a - 1), k, a) k, bool_or(contains(r, q) or contains(q, r)) exact from v group by all)
select conv_id, turn, a::int start_line, (a + k - 1)::int end_line from g where not exact""")
def match_span_fuzzy(s, d):
    c = V.table(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("code"), F.concat(F.lit("zq "), F.left("text", F.lit(9)), F.lit(" qz")).alias("snippet"), F.lit(0).alias("start_hint"), F.lit(0).alias("end_hint"))
    return N.match_span(c, ["conv_id", "turn"]).where("match_method = 'levenshtein'").select("conv_id", "turn", "start_line", "end_line")


@query("select conv_id, role, turn // 2 start_line, string_agg(turn, ',' order by turn) turns, min(turn)::varchar match_method from conversations group by all")
def span_merge(s, d):
    c = V.table(s, d, "conversations").select("conv_id", "role", F.expr("turn div 2").alias("start_line"), F.expr("turn div 2").alias("end_line"), F.lit("x").alias("text"), F.col("turn").cast("string").alias("match_method"), F.array(F.col("turn").cast("string")).alias("annotations"), F.col("turn").alias("ordinal"))
    return S.merge_spans(c, ["conv_id", "role"]).select("conv_id", "role", "start_line", F.array_join("annotations", ",").alias("turns"), "match_method")


@query("select event_id, (props->>'$.k')::int k from events")
def extract_json(s, d):
    e = V.table(s, d, "events").select("event_id", F.concat(F.lit("Here it is:\n```"), "props", F.lit("``` done")).alias("answer"))
    return e.select("event_id", F.from_json(X.json_object(F.col("answer")), "struct<k:int>")["k"].alias("k"))


@query("""select event_id, case event_id % 3 when 0 then event_type when 1 then 'p' || event_type else '' end label, case event_id % 3 when 0 then 'idiom' when 1 then 'paradigm' else 'label' end label_type, 'con' category, 'low' confidence from events""")
def normalize_annotation(s, d):
    e = V.table(s, d, "events").withColumn("m", F.col("event_id") % 3)
    none = F.lit(None).cast("string")
    a = F.struct(F.when(F.lit(False), "").alias("pattern"), F.when(F.col("m") == 0, F.col("event_type")).alias("idiom"), F.when(F.col("m") == 1, F.concat(F.lit("p"), "event_type")).alias("paradigm"), F.lit("").alias("label"), none.alias("category"), none.alias("confidence"), none.alias("evidence"))
    e = e.withColumn("a", a)
    return e.withColumn("l", X.normalize_label(F.col("a"), F.lit("con"))).select("event_id", "l.label", "l.label_type", "l.category", "l.confidence")


@query("""select event_id, case event_id % 3 when 0 then 'own' when 1 then event_type else 'c' || event_type end label, case event_id % 3 when 0 then 'kept' when 1 then 'pattern' else 'label' end label_type, null::varchar confidence from events""")
def normalize_annotation_kept(s, d):
    m, none = F.col("event_id") % 3, F.lit(None).cast("string")
    a = F.struct(
        F.when(m == 0, "own").alias("label"), F.when(m == 1, F.col("event_type")).alias("pattern"), none.alias("idiom"), none.alias("paradigm"), F.concat(F.lit("c"), "event_type").alias("concept"), F.when(m == 0, "kept").alias("label_type"),
        none.alias("category"), none.alias("confidence"), none.alias("evidence"),
    )
    e = V.table(s, d, "events").select("event_id", a.alias("a"))
    return e.withColumn("l", X.normalize_label_kept(F.col("a"))).select("event_id", "l.label", "l.label_type", "l.confidence")


@query(r"""with t as (select doc_id, coalesce(text, '') t, regexp_extract(coalesce(text, ''), '[a-z]{4,}') w from documents),
p as (select *, '(?s)^(|.*?[^\pL\pN_])' || w || '($|[^\pL\pN_])' p from t) select doc_id, w word, case when w <> '' and regexp_matches(t, p) then length(regexp_extract(t, p, 1)) end::int place from p""")
def identifier_word(s, d):
    t = F.coalesce(F.col("text"), F.lit(""))
    d = V.table(s, d, "documents").select("doc_id", t.alias("t"), F.regexp_extract(t, "[a-z]{4,}", 0).alias("word"))
    return d.select("doc_id", "word", F.when(F.col("word") != "", X.word_place(F.col("t"), F.col("word"))).alias("place"))


@query("select l_orderkey, l_linenumber, l_partkey, length('for (' || l_suppkey || '; ')::int place, length('part' || l_partkey)::int size from lineitem")
def identifier_span(s, d):
    l = V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("for ("), F.col("l_suppkey").cast("string"), F.lit("; part"), F.col("l_partkey").cast("string"), F.lit(") part"), F.col("l_partkey").cast("string"), F.lit("x")).alias("line"), F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("name"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", X.word_place(F.col("line"), F.col("name")).alias("place"), F.length("name").alias("size"))


@query("select l_orderkey, l_linenumber, l_partkey, case when l_partkey % 2 = 0 then 2 else length('x if_ ') end::int place, case when l_partkey % 2 = 0 then length('if (' || l_partkey || ')') else 2 end::int size from lineitem")
def code_span(s, d):
    l = V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("if ("), F.col("l_partkey").cast("string"), F.lit(")")).alias("code"))
    line = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("  "), "code", F.lit(" {"))).otherwise(F.lit("x if_ if !"))
    at, size = X.code_place(line, F.concat(F.lit(" "), "code", F.lit("\nelse")))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", at.alias("place"), size.alias("size"))


@query("""with recursive e(a, b) as (select 'r' || n_regionkey, 'n' || n_nationkey from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders),
c(a, b, depth) as (select a, b, 1 from e union all select c.a, e.b, depth + 1 from c join e on e.a = c.b) select a, depth::int depth, count(*) n from c group by all""")
def ast_closure(s, d):
    pair = lambda t, p, a, q, b: V.table(s, d, t).select(F.concat(F.lit(p), F.col(a).cast("string")).alias("src"), F.concat(F.lit(q), F.col(b).cast("string")).alias("dst"))
    e = pair("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(pair("customer", "n", "c_nationkey", "c", "c_custkey")).unionByName(pair("orders", "c", "o_custkey", "o", "o_orderkey"))
    return G.closure(e).groupBy("a", "depth").agg(F.count("*").alias("n"))


@query(r"""select page_id, len(i)::int n, string_agg(replace(upper(left(x, 1)), 'ẞ', 'SS') || lower(substr(x, 2)), '|' order by k) names from (select page_id, regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), '<li>(.*?)</li>', 1) i, unnest(i) x0, generate_subscripts(i, 1) k, regexp_replace(x0, '<[^>]*>', '', 'g') x from pages) group by all""")
def html_list(s, d):
    got = html.extract_list(V.table(s, d, "pages").withColumn("html", F.regexp_replace("html", r"(?s)^.*?<ul>", "<ul>")), None)
    return got.groupBy("page_id").agg(F.count("*").cast("int").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]), "|").alias("names"))



@query("select o_custkey page_id, 'Customer ' || o_custkey section, 'Orders of ' || o_custkey section_description, 'Order ' || o_orderkey name, o_orderstatus description from orders")
def html_tables(s, d):
    row = F.concat(F.lit("<tr><td>Order <b>"), F.col("o_orderkey").cast("string"), F.lit("</b>[1]</td><td>"), "o_orderstatus", F.lit("</td></tr>"))
    o = V.table(s, d, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.collect_list(row), "").alias("r"))
    page = F.concat(F.lit("<h3>Customer "), "page_id", F.lit("</h3><p>Orders of "), "page_id", F.lit("</p><table class='wikitable big'><tr><th>a</th></tr>"), "r", F.lit("<tr><td>alone</td></tr></table><h3>No table</h3>"))
    return html.extract_tables(o.select("page_id", page.alias("html")))


@query(r"""with c as (select conv_id || '/' || turn path, split(text, chr(10))[1] l from conversations), m as (select *, trim(regexp_replace(l, '\s+', ' ', 'g')) <> '' ok from c)
select path, case when ok then 1 else 0 end::int n, case when ok then 'exact_bounds' end match_method, case when ok then 'Guard' end label, case when ok then 'k' end category from m""")
def collect_spans(s, d):
    first = F.get(F.split("text", "\n"), F.lit(0))
    element = F.struct(F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), first.alias("snippet"))
    answer = F.concat(F.lit("Sure: "), F.to_json(F.struct(F.array(F.struct(F.lit("Guard").alias("idiom"), F.array(element).alias("code_elements"))).alias("labels"))), F.lit(" bye"))
    c = V.table(s, d, "conversations").select(F.lit("k").alias("concept"), F.lit("C").alias("language"), F.concat("conv_id", F.lit("/"), "turn").alias("path"), F.col("text").alias("code"), answer.alias("answer"))
    got, one = N.collect_spans(c), F.get("spans", F.lit(0))
    return got.select("path", F.size("spans").alias("n"), one["match_method"].alias("match_method"), one["annotations"][0]["label"].alias("label"), one["annotations"][0]["category"].alias("category"))


@query("""with c as (select p_partkey k, 'v' || p_partkey || ' = ' || p_size code from part) select k, 'Module' type, 0 start_byte, length(code)::int + 1 end_byte from c union all select k, 'Assign', 0, length(code)::int from c
union all select k, 'Name', 0, instr(code, ' ')::int - 1 from c union all select k, 'Constant', instr(code, '=')::int + 1, length(code)::int from c""")
def syntax_trees(s, d):
    code = F.concat(F.lit("v"), F.col("p_partkey").cast("string"), F.lit(" = "), F.col("p_size").cast("string"), F.lit("\n"))
    t = providers.syntax_trees(V.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.lit("Python").alias("language"), code.alias("code")))
    return t.select(F.col("path").cast("long").alias("k"), "type", "start_byte", "end_byte")


@query(f"{SWP} select layer, concept, feature_id, count_joint, rank, {_SCORE} from swp")
def scoring_job(s, d):
    # every token has a frequent label, so the selection of concepts keeps all rows; one layer is there before, and stays
    base = f"{shared_dir(s)}/scoring-{uuid.uuid4().hex}"
    folder = {"tcf": f"{base}/tcf", "ast_purity": f"{base}/purity"}
    a, labels = V.activations(s, d).drop("concepts"), V.label_rows(s, d)
    scoring.run(a.where("layer = 1"), labels, None, folder, min_pmi=MIN_PMI)
    scoring.run(a, labels, None, folder, min_pmi=MIN_PMI)
    return rounded(sinks.read_layers(s, folder["tcf"], schemas.TCF).select("layer", "concept", "feature_id", "count_joint", "rank", "pmi", "f1", "tcf", "precision", "recall", "span_recall", "optimal_threshold"))


# --- what is written is read again -------------------------------------------------------------------------------------------


def _written(s, df: DataFrame, ending: str) -> str:
    path = f"{shared_dir(s)}/written-{uuid.uuid4().hex}{ending}"
    sinks.write_frame(df, path)
    return path


@query("select conv_id, turn, role, text, text || '|' || turn joined from conversations")
def write_csv(s, d):
    c = V.table(s, d, "conversations").withColumn("parts", F.array("text", F.col("turn").cast("string")))
    # quotes inside quoted fields are escaped by a backslash, line ends stay
    back = s.read.schema("conv_id long, turn int, role string, text string, parts string").option("header", "true").option("multiLine", "true").csv(_written(s, c.select("conv_id", "turn", "role", "text", "parts"), ".csv"))
    return back.select("conv_id", F.col("turn").cast(c.schema["turn"].dataType).alias("turn"), "role", "text", F.array_join(F.from_json("parts", "array<string>"), "|").alias("joined"))


@query("select conv_id, turn, role, text, text || '|' || turn joined from conversations")
def write_jsonl(s, d):
    c = V.table(s, d, "conversations").withColumn("parts", F.array("text", F.col("turn").cast("string")))
    back = corpus.read_jsonl(s, _written(s, c, ".jsonl"), "conv_id long, turn int, role string, text string, parts array<string>").where("_corrupt_record is null")
    return back.select("conv_id", F.col("turn").cast(c.schema["turn"].dataType).alias("turn"), "role", "text", F.array_join("parts", "|").alias("joined"))


@query("select vec_id, list_sum(list_transform(embedding, lambda x: round_even(x::double * 1024, 0)::bigint))::bigint total from embeddings")
def write_parquet(s, d):
    back = s.read.parquet(_written(s, V.table(s, d, "embeddings").select("vec_id", "embedding"), ".parquet"))
    return back.select("vec_id", F.aggregate("embedding", F.lit(0).cast("long"), lambda a, x: a + F.rint(x.cast("double") * 1024).cast("long")).alias("total"))


@query("select 'N' || s_nationkey language, s_suppkey || '.txt' name, s_name || chr(10) || s_suppkey code from supplier")
def write_files(s, d):
    path = f"{shared_dir(s)}/files-{uuid.uuid4().hex}"
    x = V.table(s, d, "supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("language"), F.concat(F.lit("N/"), "s_suppkey", F.lit(".txt")).alias("file_name"), F.concat("s_name", F.lit("\n"), "s_suppkey").alias("code"))
    sinks.write_files(x, path)
    back = corpus.read_files(s, path, known_only=False)
    folder = lambda k: F.regexp_extract("path", f"/{k}=([^/]*)", 1)
    return back.select(folder("language").alias("language"), folder("name").alias("name"), F.regexp_replace("code", "\n$", "").alias("code"))


@query("select n_nationkey::int ordinal, n_name name, 'In ' || n_regionkey description, 3 as level from nation")
def write_taxonomy(s, d):
    path = f"{shared_dir(s)}/taxonomy-{uuid.uuid4().hex}.json"
    x = V.table(s, d, "nation").orderBy("n_nationkey").select(F.col("n_name").alias("name"), F.concat(F.lit("In "), "n_regionkey").alias("description"))
    sinks.write_taxonomy(x, path, 3, "Nations")
    return taxonomy.read_taxonomy(s, {path: 3}).select("ordinal", "name", "description", "level")


TREE = {"label": "Shapes", "level": 9, "concepts": [{"name": "Loop", "description": "Runs again", "subconcepts": [{"name": "For", "description": "Counts"}, {"name": "While", "description": "Waits", "subconcepts": [{"name": "Do"}]}]}, {"name": "Branch", "description": "Chooses"}]}


@query("select * from (values (0, 'Loop', null, 0, '- Category: Loop: Runs again'), (1, 'For', 'Loop', 1, '  - Label: For: Counts'), (2, 'While', 'Loop', 1, '  - Category: While: Waits'), (3, 'Do', 'While', 2, '    - Label: Do'), (4, 'Branch', null, 0, '- Label: Branch: Chooses')) t(ordinal, name, parent, depth, line)")
def taxonomy_lines(s, d):
    text = s.createDataFrame(list(enumerate(taxonomy.lines(TREE))), "ordinal int, line string")
    return taxonomy.taxonomy(s, {"t": (9, TREE)}).join(text, "ordinal").select("ordinal", "name", "parent", "depth", "line")


@query("""select conv_id, turn, 'system' first_role, 'Label this code. Its lines are numbered.' || chr(10) || chr(10) || array_to_string(list_transform(split(text, chr(10)), lambda x, i: i || ': ' || x), chr(10)) content from conversations""")
def chat_messages(s, d):
    f = V.table(s, d, "conversations").select(F.struct("conv_id", "turn").alias("path"), F.col("text").alias("code"))
    m = messages(f, prompt_parts(s, {"idiom": TREE}))
    return m.select("path.conv_id", "path.turn", F.get("messages", F.lit(0))["role"].alias("first_role"), F.get("messages", F.lit(1))["content"].alias("content"))


@query("select * from (values ('Assembly', 1), ('C#', 1), ('C++', 8), ('FORTRAN', 8), ('GO', 1), ('Haskell', 1), ('Java', 1), ('JavaScript', 1), ('Julia', 1), ('Lua', 1), ('PHP', 6), ('Perl', 4), ('Python', 1), ('Ruby', 1), ('Rust', 1), ('Scala', 1), ('Shell', 4), ('TypeScript', 2), ('Visual Basic', 1)) t(language, n)")
def language_map(s, d):
    return corpus.languages(s).groupBy("language").agg(F.count("*").cast("int").alias("n"))


# --- graph patterns ----------------------------------------------------------------------------------------------------------


def _pattern(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return G.default_registry().run(name, V.cpg(spark, sf_dir))

    run.__name__ = f"cpg_{name}"
    return query(graph_sql.pattern_sql(name))(run)


CONCEPTS = list(G.default_registry().patterns)
for _name in CONCEPTS:
    _pattern(_name)


@query(graph_sql.annotations_sql(CONCEPTS, sources(build()[0])))
def graph_annotations(s, d):
    g = V.cpg(s, d)
    return G.annotations(G.default_registry().run_all(g), g.nodes, V.cpg_files(s, d))[0]


PLACES = ["future_return_dependency_decl", "future_return_dependency", *G.CONTROL]


@query(graph_sql.unmatched_sql(PLACES, sources(build()[0])))
def graph_unmatched(s, d):
    g, r = V.cpg(s, d), G.default_registry()
    r.patterns = {c: r.patterns[c] for c in PLACES}
    return G.annotations(r.run_all(g), g.nodes, V.cpg_files(s, d))[1]
