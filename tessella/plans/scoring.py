"""The scoring job: labels joined to activations of all layers, metrics, candidates, sweep and purity, each layer cached on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.activations import concept_rows, postings
from tessella.operators.association import MIN_JOINT, MIN_PMI, TOP, candidates, pair_metrics, select_concepts
from tessella.operators.blocks import concept_blocks
from tessella.operators.purity import purity
from tessella.operators.sweep import BINS, threshold_sweep
from tessella.sources.sinks import cached_layers, write_layers


def same_language(activations: DataFrame, labels: DataFrame) -> DataFrame:
    """Activation rows of languages that occur in labels; this sets the number of tokens that metrics are relative to."""
    return activations.join(labels.select("language").distinct(), "language", "left_semi")


def same_paths(new: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows of a new layer whose path is in the reference layer."""
    return new.join(reference.select("path").distinct(), "path", "left_semi")


def labelled_tokens(activations: DataFrame, labels: DataFrame, dedupe_labels: bool = False) -> DataFrame:
    """Every activation row with the concepts of its token, null without. Repeated label rows of a token repeat it, unless dedupe_labels merges them first."""
    own = labels.select("path", "token_index", "concepts")
    if dedupe_labels:
        own = own.groupBy("path", "token_index").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("concepts")))).alias("concepts"))
    return activations.join(own, ["path", "token_index"], "left")


def score(activations: DataFrame, labels: DataFrame, min_pmi: float = MIN_PMI, min_joint: int = MIN_JOINT, top: int = TOP, bins: int = BINS, threshold: int = 10, dedupe_labels: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scores, pairs): candidate pairs with their sweep, and all pairs, by layer. One plan for all layers; segmentation depends on labels alone."""
    labels = select_concepts(labels, threshold)
    activations = same_language(activations, labels)
    df = labelled_tokens(activations, labels, dedupe_labels)
    pairs = pair_metrics(df, ["layer"])
    best = candidates(pairs, ["layer"], min_pmi, min_joint, top)
    post = postings(activations, ["layer", "path", "token_index"]).where("act > 0")
    found = threshold_sweep(best, post, concept_rows(labels, ["path", "token_index"]).distinct(), concept_blocks(labels), ["layer"], bins)
    return found.select("layer", "concept", "feature_id", "pmi", "count_joint", "f1", "rank", "tcf", "precision", "recall", "span_recall", "optimal_threshold"), pairs


def run(activations: DataFrame, labels: DataFrame, ast_labels: DataFrame | None, folder: dict[str, str], **options) -> None:
    """Writes scores and purity of the layers that the folder lacks; either is skipped only where it is there itself."""
    spark = activations.sparkSession
    wanted = {r[0] for r in activations.select("layer").distinct().collect()}
    if todo := wanted - cached_layers(spark, folder["tcf"]):
        write_layers(score(activations.where(F.col("layer").isin(*todo)), labels, **options)[0], folder["tcf"])
    if ast_labels is not None and (todo := wanted - cached_layers(spark, folder["ast_purity"])):
        mine = same_language(activations.where(F.col("layer").isin(*todo)), ast_labels)
        kinds = ast_labels.select("path", "token_index", F.try_element_at("concepts", F.lit(-1)).alias("ast_type"))
        write_layers(purity(mine.join(kinds, ["path", "token_index"], "left"), ["layer"]), folder["ast_purity"])
