"""Rule-based quality filter: base counts and distribution divergence from language references, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import stored

SEPARATORS = r"[\x20\x09-\x0D]"
#: Character classes; what none of them takes is the last class. Each is a regular expression of one character.
CLASSES = (r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]")
#: Frequent function words of the corpus languages.
COMMON = (
    "the", "of", "and", "to", "in", "is", "that", "with", "by", "for", "le", "la", "les", "des", "du", "et", "un", "une", "en", "que", "pour", "dans",
    "der", "die", "das", "und", "den", "mit", "nicht", "ist", "ein", "zu", "el", "los", "las", "por", "con", "no", "su", "para", "y", "se",
)
MAX_CHAR_JSD, MAX_WORD_JSD = 0.28, 0.40
MIN_CHARS, MIN_WORDS = 200, 50
#: Languages whose references may be broadcast (about 500 bytes each), and the salts that documents of one language are dealt to beyond.
LANGUAGES, SALTS = 20_000, 64


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts; null if either is all zero."""
    sp, sq = (F.aggregate(x, F.lit(0.0), lambda a, b: a + b) for x in (p, q))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a / sp, b / sq) + part(b / sq, a / sp))
    return F.when((sp > 0) & (sq > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2)))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, and the two histograms (arrays of double) of every whole text. One scan, no shuffle."""
    lit = F.lit
    d = docs.select("doc_id", "lang", F.coalesce("text", lit("")).alias("_t"))
    # each class is taken out of what the one before left, run by run, and counted by the length it leaves; the classes are disjoint
    rest = ["_t", *(f"_r{k}" for k in range(len(CLASSES)))]
    for k, c in enumerate(CLASSES):
        d = d.withColumn(rest[k + 1], F.regexp_replace(rest[k], f"{c}+", ""))
    d = d.select("doc_id", "lang", "_t", F.array(*((F.length(a) - F.length(b)).cast("double") for a, b in zip(rest, rest[1:]))).alias("_c"))
    d = d.withColumn("_w", F.array_remove(F.split("_t", f"{SEPARATORS}+"), ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("doc_id", "lang", "_t", "_w", "_c", lines.alias("_l"), F.size("_w").alias("_n"))
    three = F.when(F.col("_n") >= 3, F.transform(F.sequence(lit(0), F.col("_n") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    # one character for each common word, so that a bin's count is a matter of string lengths
    common = F.filter(F.transform("_w", F.lower), lambda w: w.isin(*COMMON))
    marks = F.array_join(F.transform(common, lambda w: F.char(64 + F.array_position(F.array(*map(lit, COMMON)), w))), "")
    d = d.select(
        "doc_id", "lang", F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        three.alias("_g"),
        F.length("_t").alias("_chars"),
        "_c",
        marks.alias("_k"),
    )
    # only texts in which a window repeats are sorted
    pairs = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), pairs))
    same = lambda j, k: F.get("_s", j)["h"] == F.get("_s", k)["h"]
    at = F.filter(F.sequence(lit(0), F.size("_s") - 1), lambda j: F.coalesce(same(j, j - 1), lit(False)) | F.coalesce(same(j, j + 1), lit(False)))
    d = d.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(at, lambda j: F.get("_s", j)["i"]))))
    covered = F.transform("_p", lambda p, j: F.least(lit(3), F.coalesce(F.get("_p", j + 1) - p, lit(3))))
    bins = [(F.length("_k") - F.length(F.replace("_k", lit(chr(64 + b))))).cast("double") for b in range(1, len(COMMON) + 1)]
    return d.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.aggregate(covered, lit(0), lambda a, b: a + b), lit(0)).cast("long").alias("n_repeat_words"),
        F.concat("_c", F.array(F.col("_chars") - F.aggregate("_c", lit(0.0), lambda a, b: a + b))).alias("char_hist"),
        F.concat(F.array(*bins), F.array((F.col("n_words") - F.length("_k")).cast("double"))).alias("word_hist"),
    )


def references(counts: DataFrame) -> DataFrame:
    """One row per language (null is a language of its own): summed histograms of all its documents."""
    n, m = len(CLASSES) + 1, len(COMMON) + 1
    sums = [F.sum(F.get("char_hist", F.lit(i))).alias(f"c{i}") for i in range(n)] + [F.sum(F.get("word_hist", F.lit(i))).alias(f"w{i}") for i in range(m)]
    return counts.groupBy(F.col("lang").alias("_lang")).agg(*sums).select("_lang", F.array(*(f"c{i}" for i in range(n))).alias("_rc"), F.array(*(f"w{i}" for i in range(m))).alias("_rw"))


def with_references(counts: DataFrame, languages: int = LANGUAGES) -> DataFrame:
    """counts with the references of their language. Up to `languages` of these are broadcast, so no document moves; beyond, each language's documents are dealt to SALTS."""
    ref = stored(references(counts), "language-references")
    same = F.col("lang").eqNullSafe(F.col("_lang"))
    if ref.limit(languages + 1).count() <= languages:
        return counts.join(F.broadcast(ref), same)
    dealt = counts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "char_hist"), F.lit(SALTS)))
    ref = ref.withColumn("_salted", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(ref.hint("shuffle_hash"), same & (F.col("_salt") == F.col("_salted"))).drop("_salt", "_salted")


def quality_rules(docs: DataFrame, max_char: float = MAX_CHAR_JSD, max_word: float = MAX_WORD_JSD, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, languages: int = LANGUAGES) -> DataFrame:
    """Base counts, distances to the document's language reference, and the verdict, for every row of docs (doc_id, text, lang).

    Distances are judged only from min_chars characters and min_words words on: shorter texts pass the method (base rules still hold).
    Null or empty text: all counts 0, base_failed. Repeated rows give repeated results; null lang is a language of its own; other columns are ignored.
    """
    counts = stored(text_counts(docs), "quality-counts")
    d = with_references(counts, languages)
    d = d.withColumns({"char_jsd": js_distance(F.col("char_hist"), F.col("_rc")), "word_jsd": js_distance(F.col("word_hist"), F.col("_rw"))})
    n_chars = F.aggregate("char_hist", F.lit(0.0), lambda a, b: a + b)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fits = (n_chars < min_chars) | (F.coalesce("char_jsd", F.lit(0.0)) <= max_char)
    fits &= (F.col("n_words") < min_words) | (F.coalesce("word_jsd", F.lit(0.0)) <= max_word)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & fits).alias("kept"), F.round("char_jsd", 6).alias("char_jsd"), F.round("word_jsd", 6).alias("word_jsd"))
