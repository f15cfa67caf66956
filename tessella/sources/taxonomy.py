"""Concept taxonomies: JSON trees to rows, rows to text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tessella.schemas import TAXONOMY


def roots(tree: dict) -> list[dict]:
    """The list under "concepts"; without a level's wrapping, the object itself."""
    return tree["concepts"] if "concepts" in tree and "name" not in tree else [tree]


def flatten(file: str, tree: dict, level: int | None = None) -> list[tuple]:
    """schemas.TAXONOMY rows in pre-order; children stand under "subconcepts" (or, of a bare object, "concepts")."""
    out: list[tuple] = []

    def walk(node: dict, parent: str | None, depth: int) -> None:
        out.append((file, level if level is not None else tree.get("level"), tree.get("label"), node.get("name"), node.get("description"), node.get("languages"), parent, depth, len(out)))
        for child in node.get("subconcepts") or (node.get("concepts") if "name" in node else None) or []:
            walk(child, node.get("name"), depth + 1)

    for node in roots(tree):
        walk(node, None, 0)
    return out


def taxonomy(spark: SparkSession, trees: dict[str, tuple[int | None, dict]]) -> DataFrame:
    """Taxonomies are configuration of some hundred rows: they are flattened on the driver."""
    return spark.createDataFrame([r for f, (level, t) in trees.items() for r in flatten(f, t, level)], TAXONOMY)


def read_taxonomy(spark: SparkSession, paths: dict[str, int | None]) -> DataFrame:
    """Taxonomy files by Spark's file systems; the values are the levels of their folders."""
    trees = {p: (level, json.loads(spark.read.text(p, wholetext=True).first()[0])) for p, level in paths.items()}
    return taxonomy(spark, trees)


def lines(tree: dict) -> list[str]:
    """Indented listing: categories (nodes with subconcepts) and labels; only subconcepts are descended into."""
    out: list[str] = []

    def walk(node: dict, depth: int) -> None:
        kind = "Category" if node.get("subconcepts") else "Label"
        about = f": {node['description']}" if node.get("description") else ""
        out.append(f"{'  ' * depth}- {kind}: {node.get('name', '')}{about}")
        for child in node.get("subconcepts") or []:
            walk(child, depth + 1)

    for node in roots(tree):
        walk(node, 0)
    return out
