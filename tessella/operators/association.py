"""Association of concepts and sparse features over tokens: marginals, joint counts, the metric battery, candidates.

Input frames have one row per token: by (grouping columns such as layer), concepts array<string>, and feature arrays. Counting explodes both
arrays of a row against each other, so a token's concepts and features meet without a join and are summed before the one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.storage import stored

MIN_PMI, MIN_JOINT, TOP = 1.5, 10, 20
#: Selected concepts that may stand in a plan as a set.
CONCEPTS = 2_000


def active(ids: str = "feature_ids", acts: str = "feature_activations") -> Column:
    """Distinct features of a row with an activation above 0."""
    n = F.least(F.size(ids), F.size(acts))
    pairs = F.zip_with(F.slice(ids, 1, n), F.slice(acts, 1, n), lambda i, a: F.struct(i.alias("i"), a.alias("a")))
    return F.array_distinct(F.transform(F.filter(pairs, lambda p: p["i"].isNotNull() & (p["a"] > 0)), lambda p: p["i"]))


def label_counts(labels: DataFrame, concepts: str = "concepts") -> DataFrame:
    """concept, n: label rows of each concept (repeats in a row count)."""
    return labels.select(F.explode(concepts).alias("concept")).groupBy("concept").agg(F.count("*").alias("n"))


def select_concepts(labels: DataFrame, threshold: int = 10, concepts: str = "concepts", limit: int = CONCEPTS) -> DataFrame:
    """Label rows that have a concept of more than `threshold` label rows.

    Up to CONCEPTS of these are a set that each row is tested against; beyond, rows are numbered, and their concepts joined with the chosen ones by name.
    """
    chosen = label_counts(labels, concepts).where((F.col("n") > threshold) & F.col("concept").isNotNull()).select("concept")
    few = [r[0] for r in chosen.limit(limit + 1).collect()]
    if len(few) <= limit:
        return labels.where(F.exists(concepts, lambda c: c.isin(few) if few else F.lit(False)))
    rows = stored(labels.withColumn("_row", F.monotonically_increasing_id()), "label-rows")
    hit = rows.select("_row", F.explode(concepts).alias("concept")).join(chosen, "concept", "left_semi").select("_row").distinct()
    return rows.join(hit, "_row", "left_semi").drop("_row")


def feature_marginals(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*by, F.explode(active()).alias("feature_id")).groupBy(*by, "feature_id").agg(F.count("*").alias("count_feature"))


def concept_marginals(df: DataFrame, by: list[str], concepts: str = "concepts") -> DataFrame:
    return df.select(*by, F.explode(F.array_distinct(concepts)).alias("concept")).where("concept is not null").groupBy(*by, "concept").agg(F.count("*").alias("count_concept"))


def joint_counts(df: DataFrame, by: list[str], concepts: str = "concepts") -> DataFrame:
    d = df.select(*by, F.array_distinct(concepts).alias("_c"), active().alias("_f")).where("size(_c) > 0 and size(_f) > 0")
    d = d.select(*by, "_f", F.explode("_c").alias("concept")).select(*by, "concept", F.explode("_f").alias("feature_id")).where("concept is not null")
    return d.groupBy(*by, "concept", "feature_id").agg(F.count("*").alias("count_joint"))


def metric_columns(n: Column, cf: Column, cc: Column, cj: Column) -> dict[str, Column]:
    """The battery as expressions on token counts: n all, cf with the feature, cc with the concept, cj with both.

    specificity is the false-positive share fp / (fp + tn), as the name is used here; npmi is null where every token has both, specificity
    where every token has the concept.
    """
    n, cf, cc, cj = (x.cast("double") for x in (n, cf, cc, cj))
    pf, pc, pj = cf / n, cc / n, cj / n
    pmi, precision, recall = F.log2(pj / (pf * pc)), cj / cf, cj / cc
    return {
        "p_feature": pf, "p_concept": pc, "p_joint": pj, "pmi": pmi, "npmi": F.try_divide(pmi, -F.log2(pj)), "precision": precision, "recall": recall,
        "f1": F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0), "lift": precision / (cc / n), "specificity": F.try_divide(cf - cj, n - cc),
    }


def pair_metrics(df: DataFrame, by: list[str] | None = None, min_joint: int = 3, min_feature: int = 5, concepts: str = "concepts") -> DataFrame:
    """Metrics of every (concept, feature) pair with count_joint >= min_joint and count_feature >= min_feature. Rows without either still count in n.

    The marginals are joined to the pairs by key (they are far smaller than the tokens, and Spark checks their size before broadcasting).
    """
    by = list(by or [])
    total = df.groupBy(*by).agg(F.count("*").alias("_n"))
    pairs = joint_counts(df, by, concepts).where(F.col("count_joint") >= min_joint)
    pairs = pairs.join(feature_marginals(df, by).where(F.col("count_feature") >= min_feature), [*by, "feature_id"]).join(concept_marginals(df, by, concepts), [*by, "concept"])
    pairs = pairs.join(total, by) if by else pairs.crossJoin(F.broadcast(total))  # without keys, total is one row
    m = metric_columns(F.col("_n"), F.col("count_feature"), F.col("count_concept"), F.col("count_joint"))
    return pairs.withColumns(m).select(*by, "concept", "feature_id", "count_feature", "count_concept", "count_joint", *m, F.col("_n").alias("n_tokens"))


def pair_auc(metrics: DataFrame) -> DataFrame:
    """metrics with auroc and auprc of the binary score "feature active", in closed form; auroc is null where all tokens or none have the concept."""
    n, cf, cc, cj = (F.col(c).cast("double") for c in ("n_tokens", "count_feature", "count_concept", "count_joint"))
    tpr, fpr = cj / cc, F.try_divide(cf - cj, n - cc)
    return metrics.withColumns({"auroc": (1 + tpr - fpr) / 2, "auprc": F.col("recall") * F.col("precision") + (1 - F.col("recall")) * cc / n})


def candidates(metrics: DataFrame, by: list[str] | None = None, min_pmi: float = MIN_PMI, min_joint: int = MIN_JOINT, top: int = TOP, excluded: tuple[str, ...] = ("ERROR",)) -> DataFrame:
    """The `top` pairs of each concept by f1 among those with pmi > min_pmi and count_joint > min_joint, with rank.

    Ties go to higher pmi, precision, recall, count_joint, then the lower feature.
    """
    d = metrics.where((F.col("pmi") > min_pmi) & (F.col("count_joint") > min_joint) & ~F.col("concept").isin(*excluded))
    order = [F.desc(c) for c in ("f1", "pmi", "precision", "recall", "count_joint")] + [F.asc("feature_id")]
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or []), "concept").orderBy(*order))).where(F.col("rank") <= top)


def best_first() -> list[Column]:
    """The order of a concept's pairs."""
    return [*(F.desc(c) for c in ("pmi", "precision", "recall", "f1", "count_joint")), F.asc("feature_id")]


def ordered_metrics(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total order of the pair table: by, concept, then the best pairs first."""
    return metrics.orderBy(*(by or []), "concept", *best_first())


def numbered_metrics(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The pair table with place: each pair's number, from 1, in the order of its group. Concepts are dealt by ranges; a range's first number is a sum over the ranges before it."""
    by = list(by or [])
    d = stored(metrics.repartitionByRange(*by, "concept").withColumn("_part", F.spark_partition_id()), "ranged-pairs")
    heads = d.groupBy(*by, "_part").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_head", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    n = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("concept", *best_first()))
    return d.withColumn("_n", n).join(heads, [*by, "_part"]).withColumn("place", (F.col("_n") + F.col("_head")).cast("int")).drop("_n", "_head", "_part")
