"""Annotation records as a stream: each micro-batch of new JSON lines becomes token labels, written by batch so that a repeated batch replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.spans import token_labels_from_lines
from tessella.schemas import LLM_ANNOTATIONS


def read_annotations(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(LLM_ANNOTATIONS).option("maxFilesPerTrigger", files_per_batch).json(path)


def stream_token_labels(records: DataFrame, files: DataFrame, tokens: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes token labels under out/batch=n. Batches are idempotent: a batch that is run again after a failure overwrites its own folder."""

    def write(batch: DataFrame, n: int) -> None:
        token_labels_from_lines(batch, files, tokens).withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
