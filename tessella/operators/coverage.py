"""Summaries over scored pairs: best score per concept, coverage curve and its area, trends by layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POINTS = 100


def best_by_concept(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scores.groupBy(*(by or []), "concept").agg(F.max("tcf").alias("max_tcf"))


def coverage_curve(best: DataFrame, by: list[str] | None = None, points: int = POINTS) -> DataFrame:
    """by, point, tau, share: concepts whose best score is tau or more, at `points` thresholds from 0 to 1. No concepts: no rows.

    Each concept is binned at the last threshold it reaches, so the curve is a running sum over `points` rows, whatever the number of concepts.
    """
    by = list(by or [])
    tau = lambda i: i / F.lit(float(points - 1))
    reached = F.size(F.filter(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("max_tcf") >= tau(i))) - 1
    bars = best.withColumn("point", reached).groupBy(*by, "point").agg(F.count("*").alias("_n"))
    grid = bars.groupBy(*by).agg(F.sum("_n").alias("_all")) if by else bars.agg(F.sum("_n").alias("_all")).where("_all is not null")
    grid = grid.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    d = grid.join(bars, [*by, "point"], "left")
    w = Window.partitionBy(*by).orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, 0)
    return d.select(*by, "point", tau(F.col("point")).alias("tau"), (F.coalesce(F.sum("_n").over(w), F.lit(0)) / F.col("_all")).alias("share"))


def coverage_auc(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the curve by trapezoids; without grouping columns an empty curve has area 0."""
    by = list(by or [])
    w = Window.partitionBy(*by).orderBy("point")
    d = curve.withColumn("_t", (F.col("share") + F.lag("share").over(w)) / 2 * (F.col("tau") - F.lag("tau").over(w)))
    return d.groupBy(*by).agg(F.coalesce(F.sum("_t"), F.lit(0.0)).alias("auc"))


def top_scores(scores: DataFrame, concept: str | None = None, n: int = 10) -> DataFrame:
    """The n best concepts by score whose names contain `concept`."""
    d = scores if concept is None else scores.where(F.col("concept").contains(concept))
    return d.groupBy("concept").agg(F.max("tcf").alias("max_tcf")).orderBy(F.desc("max_tcf"), "concept").limit(n)


def purity_mean(pure: DataFrame, by: list[str] | None = None) -> DataFrame:
    return pure.groupBy(*(by or [])).agg(F.avg("ast_purity").alias("mean_purity"), F.count("*").alias("n_features"))
