"""Corpus files, language tables, JSON lines, and the corpus filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.schemas import LANGUAGES

# File extensions of each language, in order; of extensions equal but for case, the later language's counts.
EXTENSIONS = {
    "Assembly": [".asm"],
    "C": [".c", ".h"],
    "C#": [".cs"],
    "C++": [".cpp", ".hpp", ".c++", ".h++", ".cc", ".hh", ".C", ".H"],
    "FORTRAN": [".f90", ".f", ".f03", ".f08", ".f77", ".f95", ".for", ".fpp"],
    "GO": [".go"],
    "Haskell": [".hs"],
    "Java": [".java"],
    "JavaScript": [".js"],
    "Julia": [".jl"],
    "Lua": [".lua"],
    "PHP": [".php", ".php3", ".php4", ".php5", ".phps", ".phpt"],
    "Perl": [".pl", ".pm", ".pod", ".perl"],
    "Python": [".py"],
    "Ruby": [".rb"],
    "Rust": [".rs"],
    "Scala": [".scala"],
    "Shell": [".sh", ".bash", ".command", ".zsh"],
    "TypeScript": [".ts", ".tsx"],
    "Visual Basic": [".vb"],
}
# Names by which graph builds know languages, their folders, and other spellings.
GRAPH_LANGUAGES = {"c": "C", "cpp": "C++", "csharp": "C#", "java": "Java", "javascript": "JavaScript", "php": "PHP", "python": "Python", "ruby": "Ruby"}
ALIASES = {"c++": "cpp", "c#": "csharp", "cs": "csharp", "js": "javascript", "py": "python", "rb": "ruby"}
# End of fixed values.


def language_by_extension(extensions: dict[str, list[str]] | None = None) -> dict[str, str]:
    return {e.lower(): language for language, es in (extensions or EXTENSIONS).items() for e in es}


def languages(spark: SparkSession, extensions: dict[str, list[str]] | None = None) -> DataFrame:
    """schemas.LANGUAGES: one row per lower-cased extension."""
    return spark.createDataFrame([(v, k) for k, v in sorted(language_by_extension(extensions).items())], LANGUAGES)


def read_extensions(spark: SparkSession, path: str) -> DataFrame:
    """schemas.LANGUAGES from a JSON object of language -> list of extensions."""
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    d = d.select(F.posexplode(F.map_entries("m")).alias("_o", "_e")).select("_o", F.col("_e.key").alias("language"), F.explode("_e.value").alias("_x"))
    return d.groupBy(F.lower("_x").alias("extension")).agg(F.max_by("language", "_o").alias("language")).select("language", "extension")


def language_of(path: Column, known: dict[str, str] | None = None) -> Column:
    """By extension; of an unknown one, the folder right above the file."""
    table = F.create_map(*(F.lit(x) for kv in (known or language_by_extension()).items() for x in kv))
    return F.coalesce(F.try_element_at(table, X.extension(path)), X.folder_language(path))


def read_files(spark: SparkSession, root: str, known_only: bool = True, limit: int = 0, strict: bool = True) -> DataFrame:
    """schemas.CODE_FILES of all files under root, newlines translated. known_only: those of known extensions, language from the folder; limit: the first in path order.

    strict: invalid UTF-8 fails the read; otherwise it is replaced.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    d = d.withColumn("_p", path)
    if known_only:
        d = d.where(X.extension(F.col("_p")).isin(*language_by_extension()))
    if limit > 0:
        d = d.orderBy("_p").limit(limit)
    text = F.decode("content", "UTF-8") if strict else F.make_valid_utf8(F.col("content").cast("string"))
    return d.select(F.col("_p").alias("path"), X.folder_language(F.col("_p")).alias("language"), X.universal_newlines(text).alias("code"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; blank lines are skipped, a malformed line gives a row with its text in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def filter_corpus(rows: DataFrame, wanted: list[str], low: int = 10, high: int = 1000, limit: int = 1000, ordinal: str = "ordinal") -> DataFrame:
    """The first `limit` rows (language, code, ordinal) of wanted languages with low to high newlines; a limit is the feature here."""
    return rows.where(F.col("language").isin(*wanted) & X.newline_count(F.col("code")).between(low, high)).orderBy(ordinal).limit(limit)


def corpus_names(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """rows (language, path, ...) with file_name: language/n_basename, n counting from 0 within the language in order of ordinal.

    The rank is summed over ranges of the order, so that a language of very many files isn't one task's.
    """
    from tessella.sources.storage import stored

    d = stored(rows.repartitionByRange("language", ordinal).withColumn("_part", F.spark_partition_id()), "ranged")
    heads = d.groupBy("language", "_part").agg(F.count("*").alias("_c"))
    heads = heads.withColumn("_head", F.coalesce(F.sum("_c").over(Window.partitionBy("language").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    n = F.row_number().over(Window.partitionBy("language", "_part").orderBy(ordinal)) - 1
    d = d.withColumn("_n", n).join(heads, ["language", "_part"])
    base = F.element_at(F.split("path", "/"), -1)
    return d.select(*rows.columns, F.concat("language", F.lit("/"), (F.col("_n") + F.col("_head")).cast("string"), F.lit("_"), base).alias("file_name"))


def resolve_graph_languages(names: list[str]) -> list[str]:
    """Canonical names, each once, in order. "all" stands alone; unknown names raise ValueError."""
    out = list(dict.fromkeys(ALIASES.get(n, n) for n in (x.strip().lower() for x in names)))
    if "all" in out:
        if len(out) > 1:
            raise ValueError("all can't be combined with other languages")
        return list(GRAPH_LANGUAGES)
    if unknown := [n for n in out if n not in GRAPH_LANGUAGES]:
        raise ValueError(f"unknown languages: {', '.join(unknown)}")
    return out
