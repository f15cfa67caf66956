"""Packing pieces of documents into sequences: length patterns fitted by non-negative least squares, residuals by best fit.

The driver only sees the histogram of piece lengths (at most `limit` numbers) and returns runs: "of length l, the next n pieces go to
sequences q, q + 1, ... at offset o". Pieces find their run by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import bytesops as B
from tessella.llm.shared import plus, small, stored
from tessella.llm.tokens import default_path, word_bpe

LIMIT = 4096
#: Bins of the pattern fit; patterns have up to PARTS documents and leave at most SLACK bins empty.
BINS, PARTS, SLACK = 64, 4, 1
#: Ranks within a length are counted in salts, so that a frequent length is not one task's: SALTS of them, and more where they would hold over SALT_ROWS pieces.
SALTS, SALT_ROWS = 32, 20_000


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares by Lawson and Hanson's active sets, up to the optimum: each round that moves lowers the residual, so it ends."""
    n = a.shape[1]
    x, free, shut = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
    eps = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0))
    while True:
        grad = np.where(free | shut, -np.inf, a.T @ (b - a @ x))
        j = int(np.argmax(grad)) if n else 0
        if not n or grad[j] <= eps:
            return x
        free[j] = True
        while True:
            idx = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, idx], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[idx] = z
                break
            neg = z <= 0
            step = np.min(x[idx][neg] / np.maximum(x[idx][neg] - z[neg], 1e-300))
            x[idx] += step * (z - x[idx])
            gone = idx[neg & (x[idx] <= eps * 1e-3)]
            free[gone if len(gone) else idx[neg][:1]] = False
            x[~free] = 0
        # a column that rounding put out again at once waits until another one has moved
        shut[:] = False if free[j] else shut
        shut[j] = not free[j]


def patterns(bins: int, parts: int, slack: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of two to `parts` bin numbers that sum to bins - slack .. bins."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], top: int, left: int) -> None:
        if len(head) > 1 and left <= slack:
            out.append(head)
        if len(head) < parts:
            for k in range(min(top, left), 0, -1):
                grow((*head, k), k, left - k)

    grow((), bins - 1, bins)
    return out


def plan(histogram: dict[int, int], limit: int = LIMIT) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece, and the number of sequences."""
    left = {k: int(v) for k, v in histogram.items() if v > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    slots: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]  # by free space: (first sequence, count)
    n_seq = 0

    def take(length: int, count: int, seq: int, offset: int) -> None:
        runs.append((length, used[length], count, seq, offset))
        used[length] += count
        left[length] -= count

    if limit in left:
        n_seq += left[limit]
        take(limit, left[limit], 0, 0)
    width = max(1, limit // BINS)
    bins = -(-limit // width)
    bin_of = lambda x: -(-x // width)
    wanted = np.zeros(bins + 1)
    for k, v in left.items():
        wanted[bin_of(k)] += v
    pats = [p for p in patterns(bins, PARTS, SLACK) if all(wanted[k] for k in p)]
    if pats:
        a = np.zeros((bins, len(pats)))  # all of them: under 5,000 for 64 bins
        for j, p in enumerate(pats):
            for k in p:
                a[k - 1, j] += 1
        times = np.floor(nnls(a, wanted[1:]) + 1e-6).astype(np.int64)
        members = {k: sorted((x for x in left if bin_of(x) == k), reverse=True) for k in range(1, bins + 1)}
        for j in np.argsort([-p[0] for p in pats], kind="stable"):
            p, todo = pats[j], int(times[j])
            while todo > 0:
                chosen, need = [], {}
                for i, k in enumerate(p):  # the longest pieces left of each bin; the last is the longest that fits, of whatever bin
                    space = limit - sum(chosen)
                    x = next((x for b in ((k,) if i + 1 < len(p) else range(bin_of(space), 0, -1)) for x in members[b] if x <= space and left[x] > need.get(x, 0)), None)
                    if x is None:
                        break
                    need[x] = need.get(x, 0) + 1
                    chosen.append(x)
                if len(chosen) < len(p):
                    break
                n = min([todo, *(left[x] // c for x, c in need.items())])
                offset = 0
                for x in chosen:
                    take(x, n, n_seq, offset)
                    offset += x
                slots[limit - offset].append((n_seq, n))
                n_seq += n
                todo -= n
    # residuals: longest first, into the fullest sequence that still has room
    room = np.array([bool(s) for s in slots])
    for x in sorted(left, reverse=True):
        while left[x] > 0:
            fit = np.flatnonzero(room[x:])
            if not len(fit):
                per = limit // x  # equal pieces fill new sequences together
                n = max(1, left[x] // per)
                k = min(per, left[x])
                for i in range(k):
                    take(x, n, n_seq, i * x)
                rest = limit - k * x
                slots[rest].append((n_seq, n))
                room[rest] = True
                n_seq += n
                continue
            space = x + int(fit[0])
            seq, count = slots[space].pop()
            room[space] = bool(slots[space])
            n = min(count, left[x])
            take(x, n, seq, limit - space)
            if n < count:
                slots[space].append((seq + n, count - n))
                room[space] = True
            if space > x:
                slots[space - x].append((seq, n))
                room[space - x] = True
    return np.array(runs, np.int64).reshape(-1, 5), n_seq


def pieces(docs: DataFrame, limit: int = LIMIT, path: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, unsigned 16 bits each, if asked for) of every document's pieces.

    Null text is empty: one piece that holds the end id alone. Repeated rows give repeated pieces.
    """
    path = path or default_path()

    def cut(batches):
        bpe = word_bpe(path)
        for batch in batches:
            buf, off = B.column(batch.column(1))
            doc = batch.column(0)
            for i, j, b, o in B.blocks(buf, off):
                got, bounds = bpe.encode(b, o)
                size = np.diff(bounds)
                many = -(-size // limit)
                row = np.repeat(np.arange(len(size)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * limit
                length = np.minimum(limit, size[row] - start)
                at = bounds[row] + start
                wide = got.astype("<u4").tobytes()
                crc = [zlib.crc32(wide[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                cols = [doc.slice(i, j - i).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if ids:
                    raw = got.astype("<u2").tobytes()
                    cols.append(pa.array([raw[2 * a : 2 * (a + n)] for a, n in zip(at.tolist(), length.tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    schema = plus(docs.select("doc_id").schema, "piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(parts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """parts (any columns, with doc_id, piece, ids_crc32 and length in 1..limit) with sequence_id and offset; parts must be a stored table."""
    spark = parts.sparkSession
    hist = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    runs, _ = plan(hist, limit)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shift = 44
    model = spark.sparkContext.broadcast(((runs[:, 0] << shift) + runs[:, 1], runs))
    # at most limit rows
    salts = spark.createDataFrame([(k, max(SALTS, -(-v // SALT_ROWS))) for k, v in hist.items()], "_length long, _salts int")
    salted = parts.join(F.broadcast(salts), F.col("length") == F.col("_length"), "left").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_salts")).cast("int")).drop("_length", "_salts")
    counts = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_head"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_rank", rank.cast("long"))
    # beyond the bound of a broadcast, heads go to where the window has dealt the pieces
    ranked = ranked.join(small(stored(heads, "salt-heads")), (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_rank") + F.col("_head"))

    def place(batches):
        key, runs = model.value
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length, rank = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            r = runs[np.searchsorted(key, (length << shift) + rank, "right") - 1]
            t = t.drop_columns(["_rank"]).append_column("sequence_id", pa.array(r[:, 3] + rank - r[:, 1])).append_column("offset", pa.array(r[:, 4]))
            yield from t.to_batches()

    ranked = ranked.select(*parts.columns, "_rank")
    return ranked.mapInArrow(place, plus(parts.schema, "sequence_id long, offset long"))


def pack_documents(docs: DataFrame, limit: int = LIMIT, path: str | None = None, ids: bool = False) -> DataFrame:
    """Tokenizes docs (doc_id, text), cuts documents over `limit` ids, and packs all pieces; see pieces() and pack(). No rows: no rows."""
    return pack(stored(pieces(docs, limit, path, ids), "pieces"), limit)
