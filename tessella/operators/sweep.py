"""The threshold sweep of candidate pairs: best harmonic mean of precision and block recall, with order-dependent early stopping.

Postings and blocks are binned by the number of thresholds under them, so a pair is a histogram of `bins` rows and the sweep is running sums over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.blocks import block_features
from tessella.sources.storage import stored

BINS = 20


def threshold_sweep(pairs: DataFrame, postings: DataFrame, labels: DataFrame, blocks: DataFrame, by: list[str] | None = None, bins: int = BINS, exhaustive: bool = False) -> DataFrame:
    """pairs (by, concept, feature_id, ...) with tcf, precision, recall, span_recall, optimal_threshold (replacing columns of these names).

    postings: by, path, token_index, feature_id, act > 0 (one row per token and feature). labels: path, token_index, concept (one row per token and
    concept). blocks: concept, path, token_index, block. Thresholds are i * max / (bins - 1); a pair without postings or labels has zeros.
    Candidates (some tens for each concept) and the postings of their features are stored, so that what finds them runs once.
    exhaustive drops the early stop: without it, a pair stops at the first threshold that isn't better and has lower precision and block recall than the best so far.
    """
    by = list(by or [])
    key = [*by, "concept", "feature_id"]
    pairs = stored(pairs, "candidates")
    wanted = pairs.select(*key)
    post = postings.join(wanted.select(*by, "feature_id").distinct(), [*by, "feature_id"], "left_semi")
    top = post.groupBy(*by, "feature_id").agg(F.max("act").alias("_max"))
    step = F.col("_max") / (bins - 1)

    def under(act):  # number of thresholds below act
        return F.size(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: act > i * step))

    top = stored(top, "feature-maxima")
    post = stored(post.join(top, [*by, "feature_id"]).withColumn("_k", under(F.col("act"))), "candidate-postings")
    total = post.groupBy(*by, "feature_id", "_k").agg(F.count("*").alias("_pp"))
    on = post.join(labels.select("path", "token_index", "concept"), ["path", "token_index"]).join(wanted, key, "left_semi")
    true = on.groupBy(*key, "_k").agg(F.count("*").alias("_tp"))
    best = block_features(blocks, post.drop("_k", "_max"), by).join(wanted, key, "left_semi").join(top, [*by, "feature_id"])
    spans = best.withColumn("_k", under(F.col("act"))).groupBy(*key, "_k").agg(F.count("*").alias("_sp"))
    n_label = labels.groupBy("concept").agg(F.count("*").alias("_cc"))
    n_block = blocks.groupBy("concept").agg(F.countDistinct("path", "block").alias("_nb"))
    # a histogram bin k holds what lies over thresholds 0 .. k - 1: sums from above give the counts at each threshold
    bars = wanted.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    bars = bars.join(total, [*by, "feature_id", "_k"], "left").join(true, [*key, "_k"], "left").join(spans, [*key, "_k"], "left").na.fill(0, ["_pp", "_tp", "_sp"])
    above = Window.partitionBy(*key).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    bars = bars.select(*key, (F.col("_k") - 1).alias("_i"), *(F.sum(c).over(above).alias(c) for c in ("_pp", "_tp", "_sp")))
    bars = bars.where("_tp > 0").join(n_label, "concept").join(n_block, "concept").join(top, [*by, "feature_id"])
    p, sr = F.col("_tp") / F.col("_pp"), F.col("_sp") / F.col("_nb")
    bars = bars.select(*key, "_i", p.alias("_p"), (F.col("_tp") / F.col("_cc")).alias("_r"), sr.alias("_s"), F.when(p + sr > 0, 2 * p * sr / (p + sr)).otherwise(0.0).alias("_f"), (F.col("_i") * step).alias("_t"))
    point = F.struct("_f", (-F.col("_i")).alias("_neg"), "_p", "_s")
    before = Window.partitionBy(*key).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    bars = bars.withColumn("_b", F.max(point).over(before))
    stop = F.when((F.col("_f") <= F.col("_b._f")) & (F.col("_p") < F.col("_b._p")) & (F.col("_s") < F.col("_b._s")), F.col("_i"))
    bars = bars.withColumn("_stop", F.min(stop).over(Window.partitionBy(*key)))
    if not exhaustive:
        bars = bars.where("_i < coalesce(_stop, 2147483647)")
    got = bars.groupBy(*key).agg(F.max(F.struct("_f", (-F.col("_i")).alias("_neg"), "_p", "_r", "_s", "_t")).alias("_x"))
    out = {"tcf": "_f", "precision": "_p", "recall": "_r", "span_recall": "_s", "optimal_threshold": "_t"}
    rest = [c for c in pairs.columns if c not in out]
    return pairs.select(*rest).join(got, key, "left").select(*rest, *(F.coalesce(F.col(f"_x.{v}"), F.lit(0.0)).alias(k) for k, v in out.items()))
