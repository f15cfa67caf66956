"""End-to-end jobs over folders, and their command line: python -m tessella.plans.jobs JOB ..."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import schemas
from tessella.functions import text as X
from tessella.operators import graph as G
from tessella.operators.spans import build_token_labels, tree_labels
from tessella.plans import scoring
from tessella.sources import corpus, providers, sinks

LOG = logging.getLogger("tessella")


def set_up_logging(file: str | None = None) -> logging.Logger:
    """Messages on the console and, if asked for, in a file; called again, it adds nothing twice."""
    known = {getattr(h, "baseFilename", "console") for h in LOG.handlers}
    for h in [logging.StreamHandler(sys.stderr)] * ("console" not in known) + ([logging.FileHandler(file)] if file and not any(k.endswith(file) for k in known) else []):
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        LOG.addHandler(h)
    LOG.setLevel(logging.INFO)
    return LOG


def language_files(spark: SparkSession, root: str, languages: list[str]) -> DataFrame | None:
    """schemas.CODE_FILES of the language folders under root; a folder that is missing is a warning, none at all gives None."""
    out = None
    for language in languages:
        folder = f"{root.rstrip('/')}/{language}"
        if not sinks.exists(spark, folder):
            LOG.warning("no folder %s", folder)
            continue
        files = corpus.read_files(spark, folder, known_only=False).withColumn("language", F.lit(language))
        out = files if out is None else out.unionByName(files)
    return out


def build_ast_labels(files: DataFrame, builders=None) -> DataFrame:
    """schemas.AST_LABELS: every token of files with the types of the tree nodes it meets."""
    labels = tree_labels(providers.byte_tokens(files), providers.syntax_trees(files, builders))
    return labels.join(files.select("path", "language"), "path").select(*(c.split()[0] for c in schemas.AST_LABELS.split(", ")))


def export_activations(files: DataFrame, layers: list[int], path: str, source=providers.hashed_activations) -> None:
    """Activations of the layers that path lacks, in a folder for each layer."""
    if todo := sorted(set(layers) - sinks.cached_layers(files.sparkSession, path)):
        sinks.write_layers(providers.activations(files, todo, source), path)


def annotate_graph(spark: SparkSession, graph: str, files: DataFrame, concepts: list[str] | None = None) -> DataFrame:
    """Graph annotations of a stored graph; how many records of each concept have no place is logged."""
    registry, g = G.default_registry(), G.Cpg(*sinks.read_graph(spark, graph))
    if concepts:
        registry.patterns = {c: registry.patterns[c] for c in concepts}
    good, lost = G.annotations(registry.run_all(g), g.nodes, files)
    for r in lost.where("unmatched > 0").orderBy("concept").collect():  # a row for each concept
        LOG.info("%s: %d records without a place", r["concept"], r["unmatched"])
    return good


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessella")
    jobs = p.add_subparsers(dest="job", required=True)

    def job(name: str, *args: str, **options) -> None:
        j = jobs.add_parser(name)
        for a in args:
            j.add_argument(a)
        for k, v in options.items():
            j.add_argument(f"--{k.replace('_', '-')}", default=v, type=type(v) if v is not None else str)

    job("corpus", "rows", "out", languages="Python", min_code_length=10, max_code_length=1000, num_samples=1000)
    job("activations", "files", "out", languages="Python", layers="0")
    job("ast-labels", "files", "out", languages="Python")
    job("graph-annotations", "graph", "files", "out", languages="C++")
    job("token-labels", "kind", "annotations", "files", "out", languages="Python")
    job("score", "activations", "labels", "out", min_pmi=scoring.MIN_PMI, num_act_threshold=10, log="")
    a = p.parse_args(argv)
    set_up_logging(getattr(a, "log", "") or None)
    spark = spark or SparkSession.builder.appName("tessella").getOrCreate()
    files = lambda: language_files(spark, a.files, a.languages.split(","))
    if a.job == "corpus":
        rows = corpus.filter_corpus(spark.read.parquet(a.rows), a.languages.split(","), a.min_code_length, a.max_code_length, a.num_samples)
        sinks.write_files(corpus.corpus_names(rows), a.out)
    elif a.job == "activations":
        export_activations(files(), [int(x) for x in a.layers.split(",")], a.out)
    elif a.job == "ast-labels":
        sinks.write_frame(build_ast_labels(files()), a.out)
    elif a.job == "graph-annotations":
        sinks.write_frame(annotate_graph(spark, a.graph, files()), a.out)
    elif a.job == "token-labels":
        schema = schemas.LLM_ANNOTATIONS if a.kind == "llm" else schemas.GRAPH_ANNOTATIONS
        f = files()
        sinks.write_frame(build_token_labels(a.kind, corpus.read_jsonl(spark, a.annotations, schema).drop("_corrupt_record"), f, providers.token_texts()), a.out)
    else:
        labels = spark.read.parquet(a.labels).withColumn("language", X.folder_language(F.col("path")))
        scoring.run(spark.read.parquet(a.activations), labels, None, {"tcf": a.out, "ast_purity": f"{a.out}-purity"}, min_pmi=a.min_pmi, threshold=a.num_act_threshold)
    LOG.info("%s written to %s", a.job, a.out)


if __name__ == "__main__":
    main()
