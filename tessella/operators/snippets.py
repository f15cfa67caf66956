"""Finding the lines that a quoted snippet comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as X

#: Lines of the longest window.
MAX_LINES = 15


def match_span(df: DataFrame, keys: list[str], max_lines: int = MAX_LINES, longest_first: bool = False) -> DataFrame:
    """df (keys unique per row; code, snippet, start_hint, end_hint) with start_line, end_line, match_method.

    exact_bounds: the hinted lines (clamped to the file) are the snippet up to white space. exact_search: of all windows that contain the snippet
    or lie in it, the nearest to the hint, then the shortest (the longest, if longest_first), then the first. levenshtein: the window with the least edit distance up to white space,
    then the nearest, shortest, first. Null start_line: the snippet is empty or null, or there is no code. A hint of 0 counts as missing.
    Windows are an array inside the row: nothing is shuffled; the edit distance is only evaluated where no window is exact, and no further than that of the best single line.
    """
    hint = lambda c: F.nullif(F.col(c), F.lit(0))
    d = df.withColumns({"_lines": X.split_lines(F.col("code")), "_s": X.clean_snippet(F.col("snippet")), "_from": hint("start_hint")})
    d = d.withColumns({"_to": F.coalesce(hint("end_hint"), "_from"), "_n": F.size("_lines"), "_norm": X.normalize_text(F.col("_s")), "_near": F.coalesce("_from", F.lit(1))})
    first = F.greatest(F.lit(1), F.least("_from", "_n"))
    last = F.greatest(first, F.least("_to", "_n"))
    text = lambda a, size: F.array_join(F.slice("_lines", a, size), "\n")
    ok = F.col("_s").isNotNull() & (F.col("_s") != "") & F.col("_n").isNotNull()
    d = d.withColumns({"_ok": ok, "_a": first, "_z": last})
    bounds = F.col("_ok") & F.col("_from").isNotNull() & F.col("_to").isNotNull() & (X.normalize_text(text(F.col("_a"), F.col("_z") - F.col("_a") + 1)) == F.col("_norm"))
    d = d.withColumn("_bounds", F.coalesce(bounds, F.lit(False)))
    sizes = F.sequence(F.lit(1), F.least(F.lit(max_lines), F.col("_n")))
    windows = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.col("_n") - k + 1), lambda a: F.struct(F.abs(a - F.col("_near")).alias("far"), (-k if longest_first else k).alias("size"), a.alias("start")))))
    d = d.withColumn("_w", F.when(F.col("_ok") & ~F.col("_bounds"), windows))

    def exact(w):
        t = text(w["start"], F.abs(w["size"]))
        return F.contains(t, F.col("_s")) | F.contains(F.col("_s"), t)

    # a window that holds the snippet is part of all lines together, and one that the snippet holds has its lines in it
    some = F.contains(F.array_join("_lines", "\n"), F.col("_s")) | F.exists("_lines", lambda x: F.contains(F.col("_s"), x))
    d = d.withColumn("_e", F.when(some, F.array_min(F.filter("_w", exact))))
    # the best single line bounds the distance: windows whose length differs by more are out, and the others' distances are only taken up to the bound
    d = d.withColumn("_bare", F.when(F.col("_e").isNull() & F.col("_w").isNotNull(), F.transform("_lines", X.normalize_text)))
    d = d.withColumn("_most", F.array_min(F.transform("_bare", lambda x: F.levenshtein(x, F.col("_norm")))))
    bare = lambda w: F.array_join(F.filter(F.slice("_bare", w["start"], F.abs(w["size"])), lambda x: x != ""), " ")
    close = F.filter("_w", lambda w: F.abs(F.length(bare(w)) - F.length("_norm")) <= F.col("_most"))
    near = F.transform(close, lambda w: F.struct(F.call_function("levenshtein", bare(w), F.col("_norm"), F.col("_most")).alias("cost"), w.alias("w")))
    d = d.withColumn("_l", F.array_min(F.filter(near, lambda x: x["cost"] >= 0))["w"])
    got = F.coalesce("_e", "_l")
    start = F.when(F.col("_bounds"), F.col("_a")).otherwise(got["start"])
    end = F.when(F.col("_bounds"), F.col("_z")).otherwise(got["start"] + F.abs(got["size"]) - 1)
    method = F.when(F.col("_bounds"), "exact_bounds").when(F.col("_e").isNotNull(), "exact_search").when(F.col("_l").isNotNull(), "levenshtein")
    # out of an array of one: a caller's filter of these columns would be pushed down to the source, with all that leads to them written out in it, windows in windows
    return d.select(*df.columns, F.inline(F.array(F.struct(start.alias("start_line"), end.alias("end_line"), method.alias("match_method")))))


ANSWER = "struct<labels:array<struct<pattern:string,idiom:string,paradigm:string,label:string,category:string,confidence:string,evidence:string,code_elements:string>>,no_pattern_detected:boolean>"
ELEMENT = "struct<start_line:int,line:int,end_line:int,snippet:string>"


def collect_spans(answers: DataFrame, whole_file: bool = False) -> DataFrame:
    """Annotation records (schemas.LLM_ANNOTATIONS) from model answers (concept, language, path, code, answer).

    The answer's outermost {...} is read as JSON; failure gives a record with an error and no spans. Each label's code_elements may be a list of
    objects, a list of strings, one object, or missing; each is matched to lines and spans of equal place are merged. whole_file: labels speak of the file as a whole,
    one span of all its lines, with method full_file.
    """
    a = answers.select("concept", "language", "path", "code", F.from_json(X.json_object(F.col("answer")), ANSWER).alias("_j"), X.json_object(F.col("answer")).alias("_raw"))
    a = a.withColumn("_error", F.when(F.col("_raw").isNull(), "no JSON object in the answer").when(F.col("_j").isNull() | F.col("_j.labels").isNull() & F.try_parse_json("_raw").isNull(), "malformed JSON in the answer"))
    labels = a.where("_error is null").select("concept", "language", "path", "code", F.posexplode("_j.labels").alias("_o", "_label"))
    entry = X.normalize_label(F.col("_label"), F.col("concept"))
    if whole_file:
        n = F.size(X.split_lines(F.col("code")))
        m = labels.select("concept", "path", F.lit(1).alias("start_line"), n.alias("end_line"), F.col("code").alias("text"), F.lit("full_file").alias("match_method"), F.array(entry).alias("annotations"), F.col("_o").cast("long").alias("ordinal"))
    else:
        raw = F.col("_label.code_elements")
        objects = F.from_json(raw, f"array<{ELEMENT}>")
        strings = F.transform(F.from_json(raw, "array<string>"), lambda s: F.from_json(F.to_json(F.named_struct(F.lit("snippet"), s)), ELEMENT))
        one = F.when(raw.startswith("{"), F.array(F.from_json(raw, ELEMENT)))
        plain = raw.rlike(r'^\s*\[\s*"')
        parts = F.when(plain, strings).otherwise(F.coalesce(one, objects))
        e = labels.select("concept", "path", "code", entry.alias("_entry"), "_o", F.posexplode(parts).alias("_i", "_e"))
        first = F.coalesce(F.nullif(F.col("_e.start_line"), F.lit(0)), F.col("_e.line"))
        e = e.select("concept", "path", "code", "_entry", (F.col("_o").cast("long") * 1000000 + F.col("_i")).alias("ordinal"), F.col("_e.snippet").alias("snippet"), first.alias("start_hint"), F.coalesce(F.nullif(F.col("_e.end_line"), F.lit(0)), first).alias("end_hint"))
        m = match_span(e, ["concept", "path", "ordinal"]).where("start_line is not null")
        lines = F.array_join(F.slice(X.split_lines(F.col("code")), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
        m = m.select("concept", "path", "start_line", "end_line", lines.alias("text"), "match_method", F.array("_entry").alias("annotations"), "ordinal")
    from tessella.operators.spans import merge_spans

    spans = merge_spans(m, ["concept", "path"]).groupBy("concept", "path").agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "text", "match_method", "annotations"))).alias("spans"))
    out = a.select("concept", "language", "path", F.col("_j.no_pattern_detected").alias("_none"), "_error").join(spans, ["concept", "path"], "left")
    empty = F.array().cast(spans.schema["spans"].dataType)
    return out.select("concept", "language", "path", F.coalesce("spans", empty).alias("spans"), F.coalesce("_none", F.lit(False)).alias("no_pattern_detected"), F.col("_error").alias("error"))
