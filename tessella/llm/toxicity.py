"""Toxicity: bags of subword embeddings, averaged, into a linear softmax; embeddings and softmax are trained together in numpy.

A bag is a run of RUN words, at whatever word it starts, and a document scores as its most toxic run, so that one insult in a long text is not averaged away.
With run = 0 the bag is the whole document.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bytesops as B
from tessella.llm.shared import fold, plus

GRAMS = (3, 4, 5, 6, 7)
BUCKET_BITS, DIM, RUN = 18, 4, 2
#: Grams of fewer training documents than this keep a zero embedding.
MIN_DOCS = 6
#: Bound of the training sample: rows of each class, and characters of one row.
SAMPLE = {1: 1200, 0: 1800}
SAMPLE_CHARS = 6_000
#: Labelled ids that are looked up for each text of the sample, as some texts are too long.
OVERSAMPLE = 4
EPOCHS, RATE, DECAY = 30, 0.0005, 0.0
#: Runs whose gradients are spread over their words at once in training.
SPREAD = 1 << 16


def _padded(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with each document between spaces, all separators spaces; and where each document starts."""
    n = len(off) - 1
    out = np.full(len(buf) + n + 1, 32, np.uint8)
    out[np.arange(len(buf)) + np.repeat(np.arange(1, n + 1), np.diff(off))] = B.lowered(buf)
    out[~B.NOT_SPACE[out]] = 32
    return out, off + np.arange(n + 1)


def _grams(buf: np.ndarray, pre: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n bytes from each position, and whether they lie in one word and its two bounds."""
    m = len(buf) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    at = np.arange(m)
    h = B.span_hash(pre, at, at + n) >> B.U(64 - BUCKET_BITS)
    gap = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(buf == 32, out=gap[1:])
    return h.astype(np.int64), gap[n - 1 : n - 1 + m] == gap[1 : 1 + m]


def word_scores(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean over the grams of each word of table, and each document's first word. A long document is taken in pieces that cut no word."""
    if len(off) == 2 and len(buf) > B.BLOCK:
        at = B.cuts(buf, B.BLOCK // 4)
        words = np.concatenate([word_scores(buf[i:j], np.array([0, j - i]), table)[0] for i, j in zip(at, at[1:])]) if len(at) > 2 else None
        if words is not None:
            return words, np.array([0, len(words)])
    p, start = _padded(buf, off)
    s, e, _ = B.spans(p != 32, np.array([0, len(p)]))
    pre = B.prefix(p)
    total, count = np.zeros(len(s)), np.zeros(len(s))
    for n in GRAMS:
        h, ok = _grams(p, pre, n)
        acc = np.zeros(len(h) + 1)
        np.cumsum(np.where(ok, table[h], 0), out=acc[1:])
        lo, hi = np.minimum(s - 1, len(h)), np.clip(e + 2 - n, 0, len(h))
        hi = np.maximum(hi, lo)
        total += acc[hi] - acc[lo]
        count += hi - lo
    return total / np.maximum(count, 1), np.searchsorted(s, start)


def runs_of(first: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end word and document of all runs: of `run` words from each word that has so many from it on, else of all words of the document."""
    count = np.diff(first)
    many = np.minimum(count, np.maximum(1, count - run + 1) if run else 1)
    doc = np.repeat(np.arange(len(count)), many)
    lo = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + first[:-1][doc]
    return lo, np.minimum(lo + run, first[1:][doc]) if run else first[1:][doc], doc


def document_logits(words: np.ndarray, first: np.ndarray, bias: float, run: int = RUN) -> np.ndarray:
    """Largest mean over the runs of each document; bias where there is no word."""
    out = np.full(len(first) - 1, float(bias))
    lo, hi, doc = runs_of(first, run)
    if len(doc):
        acc = np.concatenate([[0.0], np.cumsum(words)])
        head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        out[doc[head]] = np.maximum.reduceat((acc[hi] - acc[lo]) / (hi - lo), head) + bias
    return out


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each word, start and end of each distinct word in a text that has each once, that text, and the number of words of each document.

    Texts are taken in blocks, so that what is held grows with the words and not with several numbers for each byte.
    """
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    hashes, count, known, spelt = [], [], np.zeros(0, B.U), []
    for _, _, b, o in B.blocks(buf, off):
        p, start = _padded(b, o)
        s, e, _ = B.spans(p != 32, np.array([0, len(p)]))
        h = B.span_hash(B.prefix(p), s, e)
        hashes.append(h)
        count.append(np.diff(np.searchsorted(s, start)))
        new, one = np.unique(h, return_index=True)
        fresh = ~np.isin(new, known)
        text = p.tobytes()
        spelt += [text[i:j] for i, j in zip(s[one[fresh]].tolist(), e[one[fresh]].tolist())]
        known = np.concatenate([known, new[fresh]])
    order = np.argsort(known)
    ids = order[np.searchsorted(known[order], np.concatenate(hashes))] if hashes else np.zeros(0, np.int64)
    ue = np.cumsum([len(w) + 1 for w in spelt]).astype(np.int64)
    us = ue - np.array([len(w) for w in spelt], np.int64)
    return ids, us, ue, np.frombuffer(b" " + b"".join(w + b" " for w in spelt), np.uint8), np.concatenate(count) if count else np.zeros(0, np.int64)


def train(texts: list[str], y: np.ndarray, epochs: int | None = None, seed: int = 7, run: int = RUN) -> tuple[np.ndarray, float]:
    """Joint gradient descent on embeddings and softmax. Returns each bucket's part of the logit, and the bias."""
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    if len(set(y.tolist())) < 2:
        rate = float(y.mean()) if len(y) else 0.0
        return np.zeros(size, np.float32), float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    ids, us, ue, p, count = _words(texts)
    pre = B.prefix(p)
    grams, per = [], np.zeros(len(us), np.int64)
    for n in GRAMS:
        h, _ = _grams(p, pre, n)
        many = np.maximum(ue + 2 - n - (us - 1), 0)
        w = np.repeat(np.arange(len(us), dtype=np.int32), many)
        grams.append((h[np.repeat(us - 1 - np.cumsum(many) + many, many) + np.arange(len(w))].astype(np.int32), w))
        per += many
    del pre, h
    per = np.maximum(per, 1)
    lo, hi, doc = runs_of(np.concatenate([[0], np.cumsum(count)]), run)
    if not len(doc):
        return np.zeros(size, np.float32), 0.0
    head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    word_doc = np.unique(ids * np.int64(len(texts)) + np.repeat(np.arange(len(texts)), count))
    ids, lo, hi, doc = (x.astype(np.int32) for x in (ids, lo, hi, doc))  # the sample bounds them
    length = hi - lo
    runs = np.bincount(doc, minlength=len(texts))
    in_docs = np.bincount(word_doc // len(texts), minlength=len(us))
    del word_doc
    known = sum(np.bincount(g, in_docs[w], size) for g, w in grams) >= MIN_DOCS
    grams = [(g[known[g]], w[known[g]]) for g, w in grams]  # the others stay zero

    def spread(value: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Sum, for each distinct word, of the value of every chosen run that holds it."""
        out = np.zeros(len(us))
        for k in range(0, len(which), SPREAD):
            part = which[k : k + SPREAD]
            n = length[part].astype(np.int64)
            at = np.repeat(lo[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out += np.bincount(ids[at], np.repeat(value[k : k + SPREAD], n), len(us))
        return out

    emb = np.where(known[:, None], rng.normal(0, 0.02, (size, DIM)), 0).astype(np.float32)
    soft = np.zeros((DIM, 2), np.float32)
    soft[:, 1] = rng.choice([-1, 1], DIM) * 0.5
    soft[:, 0] = -soft[:, 1]
    bias = np.zeros(2)
    # a gram's step is its gradient over the mean square of its share of a run: frequent grams don't outweigh telling ones
    every = np.arange(len(doc), dtype=np.int32)
    share = spread(1 / length.astype(np.int64) ** 2, every) / per**2
    square = sum(np.bincount(g, share[w], size) for g, w in grams) / len(doc)
    scale = (1 / (square + MIN_DOCS / len(doc) * np.median(1 / per) ** 2 / np.median(length) ** 2))[:, None].astype(np.float32)
    speed = [np.zeros_like(emb), np.zeros_like(soft), np.zeros_like(bias)]
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    epochs = epochs or EPOCHS
    acc, mean = np.zeros(len(ids) + 1), np.zeros((len(doc), DIM))
    for epoch in range(epochs):
        words = np.zeros((len(us), DIM), np.float32)
        for g, w in grams:
            if len(w):
                first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                words[w[first]] += np.add.reduceat(emb[g], first, axis=0)
        words /= per[:, None]
        for k in range(DIM):
            np.cumsum(words[ids, k], out=acc[1:])
            mean[:, k] = acc[hi]
            mean[:, k] -= acc[lo]
            mean[:, k] /= length
        diff = mean @ (soft[:, 1] - soft[:, 0]) + (bias[1] - bias[0])
        if epoch < epochs // 4:  # every run of a document, until the grams tell something
            pick, share = every, 1 / runs[doc]
        else:  # its most toxic run, the first of equal ones
            top = np.flatnonzero(diff == np.repeat(np.maximum.reduceat(diff, head), np.diff(np.append(head, len(doc)))))
            pick = top[np.unique(doc[top], return_index=True)[1]]
            share = np.ones(len(pick))
        prob = 1 / (1 + np.exp(-diff[pick]))
        g = ((prob - y[doc[pick]]) * weight[doc[pick]] * share).astype(np.float32)
        both = np.stack([-g, g], 1)
        grad_soft, grad_bias = sum(mean[pick[k : k + SPREAD]].T @ both[k : k + SPREAD] for k in range(0, len(pick), SPREAD)), both.sum(0)
        word_grad = np.stack([spread(both @ soft[k] / length[pick], pick) for k in range(DIM)], 1) / per[:, None]
        grad = np.stack([sum(np.bincount(g, word_grad[w, k], size) for g, w in grams) for k in range(DIM)], 1)
        grad = np.where(known[:, None], grad * scale + DECAY * emb, 0)
        for x, g, v, rate in zip((emb, soft, bias), (grad, grad_soft, grad_bias), speed, (RATE, 0.02, 0.5)):
            v *= 0.9
            v += g
            x -= rate * v
    return (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def give_back() -> None:
    """Hands memory that training has freed back to the system, where the C library can: it would otherwise keep some 100 MB for the rest of the session."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, sizes: dict[int, int], chars: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of a bounded sample outside the held-out fold: of each class c, the sizes[c] texts of lowest hash and of at most chars characters among the OVERSAMPLE * sizes[c] labelled ids of lowest hash.

    Of rows that repeat a doc_id, the least text counts, and of its labels the largest.
    """
    lab = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held))
    lab = lab.groupBy("doc_id").agg(F.max(label).alias("_y"))
    chosen = None
    for c, n in sizes.items():
        part = lab.where(F.col("_y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(OVERSAMPLE * n)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", F.col("text").alias("_t")).where(F.col("_t").isNotNull() & (F.length("_t") <= chars)).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_y").agg(F.min("_t").alias("_t"))
    found = None
    for c, n in sizes.items():
        part = rows.where(F.col("_y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        found = part if found is None else found.unionByName(part)
    got = sorted((r["doc_id"], r["_y"], r["_t"]) for r in found.collect())
    return [r[2] for r in got], np.array([r[1] for r in got], np.int64)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; keep: further columns of docs to return.

    Null and empty texts score as the bias alone; null doc_id: held_out is false. Repeated rows score alike. Labels only choose training rows.
    """
    table, bias = train(*training_sample(docs, labels, "toxic", folds, held, SAMPLE, SAMPLE_CHARS))
    give_back()
    model = docs.sparkSession.sparkContext.broadcast((table.astype(np.float64), bias))
    src = docs.select("doc_id", *(keep or []), F.col("text").alias("_t"))

    def score(batches):
        table, bias = model.value
        for batch in batches:
            buf, off = B.column(batch.column(batch.num_columns - 1))
            out = np.zeros(batch.num_rows)
            for i, j, b, o in B.blocks(buf, off, 1 << 18):
                out[i:j] = document_logits(*word_scores(b, o, table), bias)
            prob = 1 / (1 + np.exp(-out))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prob)], names=[*batch.schema.names[:-1], "score"])

    schema = plus(src.drop("_t").schema, "score double")
    d = src.mapInArrow(score, schema)
    return d.select("doc_id", *(keep or []), F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
