"""How far each feature's activation mass lies on few syntax types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def purity(df: DataFrame, by: list[str] | None = None, kind: str = "ast_type") -> DataFrame:
    """by, feature_id, ast_purity (1 - normalised entropy), total_activation, count_activations, count_distinct_ast_types.

    df has one row per token: by, kind (null where the token has none), feature_ids, feature_activations. The number of kinds is counted over all
    rows of a group. With one kind or none every feature is pure: 1.0, null totals. count_activations counts rows of null kind too; mass and
    entropy don't, and features seen only under null kinds are left out.
    """
    by = list(by or [])
    kinds = df.groupBy(*by).agg(F.countDistinct(kind).alias("_kinds"))
    n = F.least(F.size("feature_ids"), F.size("feature_activations"))
    pairs = F.zip_with(F.slice("feature_ids", 1, n), F.slice("feature_activations", 1, n), lambda i, a: F.struct(i.alias("feature_id"), a.cast("double").alias("act")))
    post = df.where("size(feature_ids) > 0").select(*by, F.col(kind).alias("_kind"), F.inline(pairs)).where("feature_id is not null and act > 0")
    mass = post.groupBy(*by, "feature_id", "_kind").agg(F.sum("act").alias("_a"), F.count("*").alias("_n"))
    w = Window.partitionBy(*by, "feature_id")
    known = F.when(F.col("_kind").isNotNull(), F.col("_a"))
    mass = mass.withColumns({"_total": F.sum(known).over(w), "_a": known})
    share = F.col("_a") / F.col("_total")
    out = mass.groupBy(*by, "feature_id").agg(
        (-F.sum(share * F.log2(share))).alias("_h"), F.max("_total").alias("total_activation"), F.sum("_n").alias("count_activations"), F.count("_kind").alias("count_distinct_ast_types")
    )
    out = out.join(kinds, by) if by else out.crossJoin(F.broadcast(kinds))  # without keys, kinds is one row
    many = F.col("_kinds") > 1
    out = out.where(~many | (F.col("count_distinct_ast_types") > 0))
    return out.select(
        *by, "feature_id", F.when(many, 1 - F.try_divide(F.col("_h"), F.log2("_kinds"))).otherwise(1.0).alias("ast_purity"), F.when(many, F.col("total_activation")).alias("total_activation"),
        F.when(many, F.col("count_activations")).alias("count_activations"), F.when(many, F.col("count_distinct_ast_types")).otherwise(F.col("_kinds")).alias("count_distinct_ast_types"),
    )
