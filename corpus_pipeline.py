"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, packing.

Every stage takes all documents that the one before kept, and all but the last return the columns of documents. Nulls: a null text has no words and
passes every filter; a null doc_id passes the near-duplicate stage; empty tables give empty tables. Columns beyond those of documents go along under
whatever name they have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.decontaminate import contamination
from tessella.llm.near_dedup import drop_near_duplicates
from tessella.llm.packing import pack_documents
from tessella.llm.shared import drop, stored, table
from tessella.llm.suffix_dedup import remove_repeats
from tessella.llm.toxicity import score_toxicity

#: Documents of this shingle similarity or more are near duplicates.
SIMILARITY = 0.8


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _guarded(docs: DataFrame) -> DataFrame:
    """docs with further columns under names that no operator uses."""
    return docs.toDF(*(c if c in COLUMNS else f"_x{i}" for i, c in enumerate(docs.columns)))


def _restored(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, from a frame that descends from _guarded(docs)."""
    return out.select(*_guarded(docs).columns).toDF(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labels outside its held-out fold, does not reject."""
    d = _guarded(docs)
    scored = score_toxicity(d, table(spark, sf_dir, "labels"), keep=[c for c in d.columns if c != "doc_id"])
    return _restored(scored.where("predicted = 0"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id."""
    return _restored(drop_near_duplicates(_guarded(docs), SIMILARITY), docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 200 bytes that occur more than once; n_chars is that of the remaining text."""
    d = remove_repeats(_guarded(docs))
    kept = F.when(F.col("text").isNotNull(), F.col("_kept"))
    n_chars = F.when(F.col("_n_removed") > 0, F.length("_kept").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return _restored(d.withColumns({"n_chars": n_chars, "text": kept}), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    d = _guarded(docs)
    return _restored(contamination(d, table(spark, sf_dir, "benchmark"), keep=d.columns).where("not contaminated"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]
#: A trained model rejects the toxic documents: SQL can't express that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
