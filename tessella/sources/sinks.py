"""Writers: by extension, JSON lines, per-language files, and the per-layer cache."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import slug
from tessella.schemas import CPG_EDGES, CPG_NODES


def write_frame(df: DataFrame, path: str) -> None:
    """.csv: CSV with nested columns as JSON; .json or .jsonl: JSON lines; else Parquet. Pickle isn't offered: it can't be written by parts nor read safely."""
    kind = path.rpartition(".")[2].lower()
    if kind in ("pkl", "pickle"):
        raise ValueError("pickle is not supported")
    if kind == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
        df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", "true").csv(path)
    elif kind in ("json", "jsonl"):
        df.write.mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def write_once(df: DataFrame, path: str, overwrite: bool = False) -> bool:
    """Parquet at path, unless it is there and overwrite isn't set; whether it was written. Written beside it first and then renamed, so that path is there whole or not at all.

    A job that leaves nothing behind is an error.
    """
    spark = df.sparkSession
    if exists(spark, path) and not overwrite:
        return False
    part = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    df.write.parquet(part)
    src, dst = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (part, path))
    fs = dst.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(src):
        raise RuntimeError(f"nothing was written to {part}")
    fs.delete(dst, True)
    if not fs.rename(src, dst):
        raise RuntimeError(f"{part} can't be renamed to {path}")
    return True


def read_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a stored graph: root/nodes and root/edges, as write_graph() leaves them."""
    return spark.read.schema(CPG_NODES).parquet(f"{root}/nodes"), spark.read.schema(CPG_EDGES).parquet(f"{root}/edges")


def write_graph(nodes: DataFrame, edges: DataFrame, root: str, overwrite: bool = False) -> None:
    write_once(nodes, f"{root}/nodes", overwrite)
    write_once(edges, f"{root}/edges", overwrite)


def write_files(rows: DataFrame, path: str) -> None:
    """One text file for each row (language, file_name, code), in a folder for each language and file. Texts end in a line end: one is added where there is none.

    Files cost far more than their bytes: rows are dealt to all cores, however few bytes they are, and each task moves its own files into place (the committer's algorithm 2)
    instead of the driver all of them. A task that runs again writes the same names.
    """
    d = rows.select("language", F.element_at(F.split("file_name", "/"), -1).alias("name"), F.regexp_replace("code", r"\n\z", "").alias("value"))
    spark = rows.sparkSession
    d = d.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "language", "name")
    d.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("language", "name").text(path)


def write_taxonomy(rows: DataFrame, path: str, level: int, label: str) -> None:
    """A taxonomy as one JSON document; entries are configuration, some hundred rows."""
    entries = [r.asDict() for r in rows.select("name", "description").collect()]
    text = json.dumps({"level": level, "label": label, "concepts": entries}, ensure_ascii=False, indent=2)
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def output_folder(root: str, model: str, sae: str, annotation: str) -> dict[str, str]:
    """Paths of a run, from slugs of its parts."""
    base = f"{root.rstrip('/')}/{slug(model)}/{slug(sae.replace('{}', ''))}/{slug(annotation)}"
    return {"label": f"{root.rstrip('/')}/label", "output": base, "ast_purity": f"{base}/ast_purity", "tcf": f"{base}/tcf", "activations": f"{root.rstrip('/')}/SAE/{slug(model)}/{slug(sae.replace('{}', ''))}"}


def cached_layers(spark: SparkSession, path: str) -> set[int]:
    """Layers that a cache written by write_layers() holds; none if there is no cache."""
    try:
        return {r[0] for r in spark.read.parquet(path).select("layer").distinct().collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return set()
        raise


def read_layers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """layer and the columns of schema, as write_layers() left them. If no layer had a row, there is no file to take a schema from, and no row."""
    return spark.read.schema(f"{schema}, layer int").parquet(path)


def write_layers(df: DataFrame, path: str) -> None:
    """Writes df (with layer) by layer; layers that df doesn't hold stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer").parquet(path)
