"""Dense activation vectors to sparse token relations, and sparse relations to postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positive_features(vector: Column) -> tuple[Column, Column]:
    """Aligned arrays of ids and values of the positive entries of vector, descending by value, ties by lower id."""
    pairs = F.transform(vector, lambda x, i: F.struct((-x).alias("neg"), i.alias("id"), x.alias("act")))
    pairs = F.array_sort(F.filter(pairs, lambda p: p["act"] > 0))
    return F.transform(pairs, lambda p: p["id"]), F.transform(pairs, lambda p: p["act"])


def dense_to_sparse(df: DataFrame, vector: str = "vector") -> DataFrame:
    """df without the vector, with feature_ids and feature_activations; null vectors give null arrays. A scan-side projection: no shuffle."""
    ids, acts = positive_features(F.col(vector))
    return df.select(*(c for c in df.columns if c != vector), ids.alias("feature_ids"), acts.alias("feature_activations"))


def postings(df: DataFrame, keys: list[str], ids: str = "feature_ids", acts: str = "feature_activations") -> DataFrame:
    """keys, feature_id, act: per token the largest activation of each feature. Null ids are skipped and arrays are cut to the shorter.

    Rows that share all keys are separate tokens: the maximum is taken inside a row, so nothing is shuffled.
    """
    n = F.least(F.size(ids), F.size(acts))
    pairs = F.zip_with(F.slice(ids, 1, n), F.slice(acts, 1, n), lambda i, a: F.struct(i.alias("feature_id"), a.cast("double").alias("act")))
    pairs = F.array_sort(F.filter(pairs, lambda p: p["feature_id"].isNotNull() & p["act"].isNotNull()))
    # in order of (id, act): the last of each id is its largest
    last = F.filter(pairs, lambda p, i: F.coalesce(F.get(pairs, i + 1)["feature_id"] != p["feature_id"], F.lit(True)))
    return df.where(F.size(ids) > 0).select(*keys, F.inline(last))


def presence(df: DataFrame, keys: list[str], ids: str = "feature_ids") -> DataFrame:
    """keys, feature_id: each feature of a token once, whatever its activation."""
    return df.select(*keys, F.explode(F.array_distinct(ids)).alias("feature_id")).where("feature_id is not null")


def concept_rows(df: DataFrame, keys: list[str], concepts: str = "concepts") -> DataFrame:
    """keys, concept: each concept of a token once."""
    return df.select(*keys, F.explode(F.array_distinct(concepts)).alias("concept")).where("concept is not null")
