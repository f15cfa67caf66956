"""Document quality from a linear-chain conditional random field over lines.

Each line is good (1) or bad (0); its features are those of the line and of its two neighbours. Forward-backward marginals, weighted by line
length, add up to the document's quality, which a one-dimensional logistic fit on the training documents maps to a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bytesops as B
from tessella.llm.shared import fold, plus
from tessella.llm.toxicity import training_sample

#: Bound of the training sample: rows of each class, and characters of one row.
SAMPLE, SAMPLE_CHARS = {1: 1500, 0: 1500}, 8_000
ITERATIONS, RATE, L2 = 150, 0.05, 1e-3
_KINDS = {
    "upper": lambda b: 65 <= b <= 90, "digit": lambda b: 48 <= b <= 57, "symbol": lambda b: chr(b) in "#*$%&<>@^~_=+\\{}[]`", "pipe": lambda b: b == 124,
    "stop": lambda b: chr(b) in ".,;:!?", "space": lambda b: not B.NOT_SPACE[b], "wide": lambda b: b >= 128,
}
_CODE = np.zeros(256, np.uint8)
for _i, _f in enumerate(_KINDS.values()):
    _CODE[[b for b in range(256) if _f(b)]] = _i + 1
_NOT_NEWLINE = B.lut(lambda b: b != 10)


def line_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature matrix and byte lengths of all lines, and each document's first line; every document has one line at least."""
    n = len(off) - 1
    cut = np.flatnonzero(buf == 10)
    doc_of_cut = np.searchsorted(off, cut, "right") - 1
    lines = np.bincount(doc_of_cut, minlength=n) + 1
    first = np.concatenate([[0], np.cumsum(lines)])
    start = np.empty(first[-1], np.int64)
    start[first[:-1]] = off[:-1]
    start[np.arange(len(cut)) + doc_of_cut + 1] = cut + 1
    end = np.empty_like(start)
    end[first[1:] - 1] = off[1:]
    end[np.arange(len(cut)) + doc_of_cut] = cut
    size = end - start
    code = _CODE[buf]
    share = []
    for k in range(1, len(_KINDS) + 1):
        acc = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(code == k, out=acc[1:])
        share.append(np.sqrt((acc[end] - acc[start]) / np.maximum(size, 1)))
    s, e, _ = B.spans(B.NOT_SPACE[buf], off)
    h = B.hash_spans(buf, s, e)
    again = np.zeros(len(s) + 1, np.int64)
    np.cumsum(np.concatenate([[False], h[1:] == h[:-1]])[: len(s)], out=again[1:])
    lo, hi = np.searchsorted(s, start), np.searchsorted(s, end)
    words = hi - lo
    line_hash = B.hash_spans(buf, start, end)
    same = np.zeros(len(size), bool)
    same[1:] = (line_hash[1:] == line_hash[:-1]) & (size[1:] > 0)
    same[first[:-1]] = False
    x = np.stack([
        *share, np.log1p(size) / 5, np.log1p(words) / 3, np.minimum(size / np.maximum(words, 1), 40) / 10,
        np.sqrt((again[hi] - again[np.minimum(lo + 1, hi)]) / np.maximum(words, 1)), same, size == 0,
    ], 1).astype(np.float64)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], 1), size, first


def forward_backward(unary: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the summed pair marginals. unary: score of good over bad; trans: 2 x 2."""
    n, count = len(first) - 1, np.diff(first)
    order = np.argsort(-count, kind="stable")
    at, steps = first[:-1][order], count[order]
    longest = int(steps[0]) if n else 0
    active = np.searchsorted(-steps, -np.arange(longest), "left")  # documents with more than t lines
    alpha, pairs = np.zeros((len(unary), 2)), np.zeros((2, 2))
    lse = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    for t in range(longest):
        k = active[t]
        i = at[:k] + t
        u = np.stack([np.zeros(k), unary[i]], 1)
        if t:
            u = u + lse(np.swapaxes(alpha[i - 1][:, :, None] + trans[None], 1, 2))
        alpha[i] = u - lse(u)[:, None]
    good = np.empty(len(unary))
    beta = np.zeros((n, 2))
    for t in range(longest - 1, -1, -1):
        k = active[t]
        i = at[:k] + t
        both = alpha[i] + beta[:k]
        good[i] = np.exp(both[:, 1] - lse(both))
        if t:
            ahead = beta[:k] + np.stack([np.zeros(k), unary[i]], 1)
            pair = alpha[i - 1][:, :, None] + trans[None] + ahead[:, None, :]
            p = np.exp(pair - pair.max((1, 2), keepdims=True))
            pairs += (p / p.sum((1, 2), keepdims=True)).sum(0)
            b = lse(trans[None] + ahead[:, None, :])
            beta[:k] = b - lse(b)[:, None]
    return good, pairs


def document_quality(good: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of each document; a line counts its bytes and its line end."""
    w = size + 1.0
    return np.add.reduceat(good * w, first[:-1]) / np.add.reduceat(w, first[:-1])


def train(texts: list[str], y: np.ndarray) -> dict:
    """Conditional likelihood of the lines' labels (their document's), by Adam on weights and transitions."""
    raw = [t.encode() for t in texts]
    if not raw:
        return {"none": 0.5}
    if len(set(y.tolist())) < 2:
        return {"none": float(np.clip(y.mean(), 0.01, 0.99))}
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    parts = [line_features(b, o) for _, _, b, o in B.blocks(buf, off)]
    x, size = (np.concatenate([part[k] for part in parts]) for k in (0, 1))
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(part[2]) for part in parts]))])
    del parts
    mean, std = x.mean(0), x.std(0) + 1e-3
    mean[-1], std[-1] = 0, 1
    x = (x - mean) / std
    count = np.diff(first)
    target = np.repeat(y, count).astype(float)
    weight = np.repeat(1 / count, count)
    real = np.zeros((2, 2))
    for c in (0, 1):
        real[c, c] = (count[y == c] - 1).sum()
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = [0.0, 0.0], [0.0, 0.0]
    for k in range(1, ITERATIONS + 1):
        good, pairs = forward_backward(x @ w, first, trans)
        grads = (x.T @ ((good - target) * weight) / len(raw) + L2 * w, (pairs - real) / len(x) + 0.05 * trans)
        step = []
        for j, g in enumerate(grads):
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.99 * v[j] + 0.01 * g * g
            step.append(RATE * (m[j] / (1 - 0.9**k)) / (np.sqrt(v[j] / (1 - 0.99**k)) + 1e-8))
        w, trans = w - step[0], trans - step[1]
    good, _ = forward_backward(x @ w, first, trans)
    q = document_quality(good, size, first)
    z = np.log((q + 1e-3) / (1 - q + 1e-3))
    a, b = 1.0, 0.0
    balance = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    for _ in range(500):
        g = (1 / (1 + np.exp(-np.clip(a * z + b, -50, 50))) - y) * balance
        a, b = a - 0.2 * ((g * z).sum() + 1e-3 * a), b - 0.5 * g.sum()
    return {"w": w / std, "shift": float(-(mean / std) @ w), "trans": trans, "a": a, "b": b}


def score_block(buf: np.ndarray, off: np.ndarray, model: dict) -> np.ndarray:
    if "none" in model:
        return np.full(len(off) - 1, model["none"])
    x, size, first = line_features(buf, off)
    good, _ = forward_backward(x @ model["w"] + model["shift"], first, model["trans"])
    q = document_quality(good, size, first)
    z = model["a"] * np.log((q + 1e-3) / (1 - q + 1e-3)) + model["b"]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    A null or empty text is one empty line. Null doc_id: held_out is false. Repeated rows score alike; other columns are ignored. Labels only choose training rows.
    """
    fitted = train(*training_sample(docs, labels, "quality", folds, held, SAMPLE, SAMPLE_CHARS))
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def score(batches):
        for batch in batches:
            buf, off = B.column(batch.column(1))
            out = np.zeros(batch.num_rows)
            for i, j, b, o in B.blocks(buf, off, 1 << 18):
                out[i:j] = score_block(b, o, model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    d = docs.select("doc_id", "text").mapInArrow(score, plus(docs.select("doc_id").schema, "score double"))
    return d.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
