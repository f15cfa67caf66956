"""The driver's tables in the shapes of the engine's relations."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import schemas
from tessella.operators.activations import dense_to_sparse
from tessella.operators.graph import Cpg
from tessella.plans.graph_fixture import build, sources
from tessella.sources.sinks import read_graph, write_graph
from tessella.sources.storage import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """layer, language, path, token_index, concepts, vector: two layers over the same tokens, the second of the negated vectors."""
    n, k = F.expr("vec_id div 50"), (F.col("vec_id") % 50).cast("int")
    e = table(spark, d, "embeddings").select(
        F.concat(F.lit("L"), (n % 3).cast("string")).alias("language"), F.concat(F.lit("/c/L"), (n % 3).cast("string"), F.lit("/"), n.cast("string")).alias("path"), k.alias("token_index"),
        F.array(F.concat(F.lit("C"), F.col("label").cast("string")), F.concat(F.lit("P"), (F.col("label") % 3).cast("string"))).alias("concepts"), F.col("embedding").alias("_v"),
    )
    both = F.array(F.col("_v"), F.transform("_v", lambda x: -x))
    return e.select("language", "path", "token_index", "concepts", F.posexplode(both).alias("layer", "vector"))


def activations(spark: SparkSession, d: str) -> DataFrame:
    return dense_to_sparse(vectors(spark, d))


def label_rows(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where("layer = 0").select("path", "token_index", "language", "concepts")


def events(spark: SparkSession, d: str) -> DataFrame:
    """path, token_index, concepts, feature_ids, feature_activations: a user's events in order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), n.alias("token_index"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.select("path", "token_index", F.array("event_type").alias("concepts"), F.array("k").alias("feature_ids"), F.array("value").alias("feature_activations"), "event_type")


def items(spark: SparkSession, d: str) -> DataFrame:
    """concepts (part type), feature_ids (supplier), feature_activations (quantity): one token for each line item."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(p, "l_partkey").select(F.array("p_type").alias("concepts"), F.array("l_suppkey").alias("feature_ids"), F.array("l_quantity").alias("feature_activations"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """path, language, code of all documents."""
    return table(spark, d, "documents").select(F.concat(F.lit("/c/"), F.coalesce("lang", F.lit("?")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("lang").alias("language"), F.coalesce("text", F.lit("")).alias("code"))


_CPG: dict[tuple[str, str], Cpg] = {}


def _per_supplier(spark: SparkSession, d: str, rows: list[tuple], schema: str) -> DataFrame:
    """k and the rows of a small literal table, once for each supplier: the literal is a constant of the plan, so nothing is joined.

    Suppliers are few bytes, in one task, and their rows hundreds of times more: they are dealt to all cores first.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    kind = f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>"
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k")).repartition(tasks, "k").select("k", F.inline(F.from_json(F.lit(text), kind)))


def fixture_cpg(spark: SparkSession) -> Cpg:
    nodes, edges = build()
    return Cpg(spark.createDataFrame(nodes, schemas.CPG_NODES), spark.createDataFrame(edges, schemas.CPG_EDGES))


def cpg(spark: SparkSession, d: str) -> Cpg:
    """The fixture's graph once for each supplier, in files of its own, so that the graph grows with the tables. Its stored relations serve all pattern queries of an application."""
    key = spark.sparkContext.applicationId, d
    if key not in _CPG:
        nodes, edges = build()
        own = F.when(F.col("filename") != "<empty>", F.concat(F.lit("s"), F.col("k").cast("string"), F.lit("/"), "filename")).otherwise(F.col("filename"))
        n = _per_supplier(spark, d, nodes, schemas.CPG_NODES).withColumns({"id": F.col("id") + 1000 * F.col("k"), "filename": own}).drop("k")
        e = _per_supplier(spark, d, edges, schemas.CPG_EDGES).withColumns({c: F.col(c) + 1000 * F.col("k") for c in ("edge_id", "src", "dst")}).drop("k")
        root = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
        write_graph(n, e, root)
        _CPG[key] = Cpg(*read_graph(spark, root))
    return _CPG[key]


def cpg_files(spark: SparkSession, d: str) -> DataFrame:
    return _per_supplier(spark, d, sources(build()[0]), schemas.CODE_FILES).withColumn("path", F.concat(F.lit("s"), F.col("k").cast("string"), F.lit("/"), "path")).drop("k")
