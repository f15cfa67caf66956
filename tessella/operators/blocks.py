"""Runs of consecutive labelled tokens (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concept_blocks(labels: DataFrame, concepts: str = "concepts", distinct: bool = False) -> DataFrame:
    """concept, path, token_index, block: one row per concept of a label row (path, token_index, concepts); block numbers the runs of a concept in a path, from 1.

    A run goes on where token_index is one more than before; a repeated index opens a new run, unless distinct rows are asked for. A run never
    crosses paths, so windows are as small as a path's labels, however frequent the concept is.
    """
    d = labels.select("path", "token_index", F.explode(concepts).alias("concept")).where("concept is not null")
    d = d.distinct() if distinct else d
    w = Window.partitionBy("concept", "path").orderBy("token_index")
    d = d.withColumn("_new", F.coalesce((F.col("token_index") != F.lag("token_index").over(w) + 1).cast("int"), F.lit(1)))
    return d.withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def block_spans(blocks: DataFrame) -> DataFrame:
    """concept, path, block, first and last token and their number."""
    return blocks.groupBy("concept", "path", "block").agg(F.min("token_index").alias("first_token"), F.max("token_index").alias("last_token"), F.count("*").alias("n_tokens"))


def block_members(blocks: DataFrame) -> DataFrame:
    """concept, path, block, token_indexes in order."""
    return blocks.groupBy("concept", "path", "block").agg(F.sort_array(F.collect_list("token_index")).alias("token_indexes"))


def block_features(blocks: DataFrame, postings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, concept, path, block, feature_id, act: the largest activation of each feature in a block, 0 at least. postings: by, path, token_index, feature_id, act."""
    d = blocks.join(postings, ["path", "token_index"])
    return d.groupBy(*(by or []), "concept", "path", "block", "feature_id").agg(F.greatest(F.max("act"), F.lit(0.0)).alias("act"))
