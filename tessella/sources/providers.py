"""Pluggable edges: tokenizer, syntax trees, activations. The defaults are deterministic and need no model."""

from __future__ import annotations

import ast
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators.tiles import pieces
from tessella.schemas import ACTIVATIONS, TREE
from tessella.sources.braces import KEYWORDS, brace_tree

#: Words, runs of white space, and single other characters.
TOKEN = r"\w+|\s+|[^\w\s]"


def hook_name(layer: int, point: str) -> str:
    return f"blocks.{layer}.{point}"


def layer_count(config: dict) -> int:
    """The number of layers of a model's configuration (num_hidden_layers or n_layers); ValueError if it is missing or 0."""
    n = config.get("num_hidden_layers") or config.get("n_layers")
    if not n:
        raise ValueError("the model configuration states no layers")
    return int(n)


def token_vectors(values: list) -> list[list[float]]:
    """Activations of one text as a vector for each token: tokens x width as they are, 1 x tokens x width without its outer level; anything else raises ValueError."""
    depth, x = 0, values
    while isinstance(x, (list, tuple)) or hasattr(x, "shape") and getattr(x, "shape", ()):
        depth, x = depth + 1, x[0] if len(x) else None
    if depth == 3 and len(values) == 1:
        values, depth = values[0], 2
    if depth != 2 or len({len(v) for v in values}) != 1:
        raise ValueError("activations must be tokens x width, or 1 x tokens x width")
    return [list(map(float, v)) for v in values]


def tokens(files: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """schemas.TOKENS of files (path, code; a row for each path) by a regular expression: expressions, no Python. token_id is a hash.

    pattern must match every character, so that tokens tile the text and their places are running sums of lengths.
    """
    return _tiled(files, pattern, "char")


def byte_tokens(files: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """tokens() with start_byte and end_byte in UTF-8 instead of characters."""
    return _tiled(files, pattern, "byte")


def token_texts(pattern: str = TOKEN) -> Column:
    """The tokens of code, in order."""
    return F.regexp_extract_all("code", F.lit(f"({pattern})"), 1)


def _tiled(files: DataFrame, pattern: str, unit: str) -> DataFrame:
    place = [F.col(f"_x.{k}").cast("int").alias(f"{k}_{unit}") for k in ("start", "end")]
    d = pieces(files, ["path"], token_texts(pattern), unit).select("path", F.explode("_p").alias("_x"))
    return d.select("path", F.col("_x.i").alias("token_index"), X.token_id(F.col("_x.item")).alias("token_id"), F.col("_x.item").alias("token"), *place)


def python_tree(code: str) -> list[tuple]:
    """(node_id, parent_id, preorder, type, is_named, start_byte, end_byte) of Python source by the standard parser."""
    out: list[tuple] = []
    heads, n = [], 0
    for line in code.encode().split(b"\n"):
        heads.append(n)
        n += len(line) + 1

    todo: list[tuple[ast.AST, int | None]] = [(ast.parse(code), None)]  # a stack: deep trees are no deep calls
    while todo:
        node, parent = todo.pop()
        here = parent
        if hasattr(node, "lineno"):
            here = len(out)
            out.append((here, parent, here, type(node).__name__, True, heads[node.lineno - 1] + node.col_offset, heads[node.end_lineno - 1] + node.end_col_offset))
        elif isinstance(node, ast.Module):
            here = 0
            out.append((0, None, 0, "Module", True, 0, len(code.encode())))
        todo += [(child, here) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out


#: Language -> source text to tree rows: Python by its own parser, the others by their brackets and words. Register another parser here.
TREE_BUILDERS: dict[str, Callable[[str], list[tuple]]] = {"Python": python_tree, **{k: partial(brace_tree, language=k) for k in KEYWORDS}}


def syntax_trees(files: DataFrame, builders: dict[str, Callable[[str], list[tuple]]] | None = None) -> DataFrame:
    """schemas.TREE of files (path, language, code). A language without a builder raises ValueError; code that doesn't parse gives one ERROR node."""
    table = dict(builders or TREE_BUILDERS)
    cols = [c.split()[0] for c in TREE.split(", ")]

    def rows(batches):
        for b in batches:
            got = []
            for path, language, code in zip(b["path"], b["language"], b["code"]):
                if language not in table:
                    raise ValueError(f"no tree builder for {language!r}")
                try:
                    tree = table[language](code or "")
                except (SyntaxError, RecursionError, MemoryError, ValueError):  # the parser itself gives up on some nesting, and on null bytes
                    tree = [(0, None, 0, "ERROR", True, 0, len((code or "").encode()))]
                got += [(path, *r) for r in tree]
            yield pd.DataFrame(got, columns=cols).astype({"node_id": "int32", "preorder": "int32", "start_byte": "int32", "end_byte": "int32", "parent_id": "Int32"})

    return files.select("path", "language", "code").mapInPandas(rows, TREE)


def hashed_activations(path: str, language: str, code: str, toks: list[tuple], layer: int) -> list[tuple[list[int], list[float]]]:
    """Default activation source: a few features per token, by hashes of its text and layer."""
    out = []
    for _, _, t, _, _ in toks:
        h = [int.from_bytes(f"{layer}:{k}:{t}".encode(), "little") * 2654435761 % 4294967291 for k in range(3)]
        acts = sorted({x % 64: (x >> 8) % 1000 / 100 + 0.01 for x in h}.items(), key=lambda p: (-p[1], p[0]))
        out.append(([p[0] for p in acts], [p[1] for p in acts]))
    return out


def activations(files: DataFrame, layers: list[int], source=hashed_activations, pattern: str = TOKEN) -> DataFrame:
    """schemas.ACTIVATIONS of files for all layers in one pass. source(path, language, code, tokens, layer) -> (ids, values) of each token.

    Values that aren't positive are dropped, and the rest sorted by value; a file whose source raises gives no rows for that layer.
    """
    toks = tokens(files, pattern).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("token_index", "token_id", "token", "start_char", "end_char"))).alias("_t"))
    d = files.select("path", "language", "code").join(toks, "path")
    cols = [c.split()[0] for c in ACTIVATIONS.split(", ")]

    def rows(batches):
        for b in batches:
            got = []
            for path, language, code, ts in zip(b["path"], b["language"], b["code"], b["_t"]):
                ts = [(t["token_index"], t["token_id"], t["token"], t["start_char"], t["end_char"]) for t in ts]
                for layer in layers:
                    try:
                        acts = source(path, language, code, ts, layer)
                    except (RuntimeError, MemoryError):
                        continue
                    if len(acts) != len(ts):
                        raise ValueError("the source must give one entry for each token")
                    for (i, tid, t, _, _), (ids, vals) in zip(ts, acts):
                        keep = sorted(((v, k) for k, v in zip(ids, vals) if v > 0), key=lambda p: (-p[0], p[1]))
                        got.append((layer, language, path, i, tid, t, [k for _, k in keep], [v for v, _ in keep]))
            yield pd.DataFrame(got, columns=cols)

    return d.mapInPandas(rows, ACTIVATIONS)
