"""Removal of repeated byte strings by a distributed merge sort of sparse suffixes.

Every string of `length` bytes holds an anchor: a place whose GRAM bytes have the least hash of a stretch, so that equal strings have their anchors
at equal places. Around an anchor lies its window: every byte that a string over the anchor can take. Anchors whose GRAM bytes occur once are left out by counting, and
equal windows are one (by a 128-bit digest), summed before the shuffle. The windows of each GRAM are sorted as suffixes: each task sorts its own and front-codes the run, runs
are exchanged, and a loser tree merges them by their known common prefixes. The merged order's common prefixes, cut at each depth, with the order of the bytes to the left,
then say which strings over an anchor occur again. Windows of one GRAM that are too many for a task are dealt again by more bytes: a string that starts d bytes before its anchor holds
those from p - l to p + length - h for every d from l to h, so each class of depths is a group of its own, of fewer and shorter windows, down to one depth.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bytesops as B
from tessella.llm.shared import drop, likely, small, stored, weighted_join

LENGTH, GRAM = 200, 64
#: Suffixes that one bucket of the merge should hold, and those of one group beyond which it is dealt again, into SPLIT classes of depths.
BUCKET, GROUP, SPLIT = 30_000, 20_000, 8
#: Bytes of a long text that are looked at in one go.
SEGMENT = 1 << 19
#: Suffixes of one sorted run.
RUN_ROWS = 50_000
_STEP = B.U(0xD6E8FEB86659FD93)
_P2 = 0xC2B2AE3D27D4EB4F
_P2INV = pow(_P2, -1, 1 << 64)
_BYTE2 = np.random.default_rng(20240301).integers(1, 1 << 63, 256).astype(B.U) * B.U(2) + B.U(1)


def _slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over each n values in a row; len(x) - n + 1 results."""
    size = 1
    while 2 * size <= n:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors in buf, the hash of the gram bytes there, and the two digests of the window there.

    A place is an anchor if its gram hash is the least of some string's grams; ties all count.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none.view(B.U), none.view(B.U), none.view(B.U)
    w = length - gram + 1
    pre = B.prefix(buf)
    back = B.powers(B._PINV, len(pre))
    h = ((pre[gram:] - pre[:-gram]) * back[: len(pre) - gram] >> B.U(33)).astype(np.uint32)
    low = _slide(h, w, np.minimum)  # one for each string
    ends = np.repeat(off[1:], np.diff(off))
    inside = np.arange(len(low)) + length <= ends[: len(low)]
    # a string's least hash counts one more, so that 0 stands for strings across documents
    most = np.zeros(len(h) + w - 1, np.uint32)
    most[w - 1 : w - 1 + len(low)] = np.where(inside, low + np.uint32(1), np.uint32(0))
    best = _slide(most, w, np.maximum)
    p = np.flatnonzero(best == h + np.uint32(1))
    d = np.searchsorted(off, p, "right") - 1
    lo, hi = np.maximum(p - (length - gram), off[d]), np.minimum(p + length, off[d + 1])
    return p, B.mix((pre[p + gram] - pre[p]) * back[p] + B.U(1)), *_digests(buf, pre, lo, hi, (p - lo) * 1024 + (hi - p))


def _digests(buf: np.ndarray, pre: np.ndarray, lo: np.ndarray, hi: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent digests of buf[lo : hi] and code."""
    code = code.astype(B.U) * _STEP
    second = np.zeros(len(buf) + 1, B.U)
    np.cumsum(_BYTE2[buf] * B.powers(_P2, len(buf)), out=second[1:])
    one = (pre[hi] - pre[lo]) * B.powers(B._PINV, len(pre))[lo]
    two = (second[hi] - second[lo]) * B.powers(_P2INV, len(pre))[lo]
    return B.mix(one + code), B.mix(two ^ B.mix(code))


def segments(n: int, left: int, right: int, size: int = SEGMENT):
    """(first, end, first byte, end byte) of the parts of a text of n bytes: each owns the places from first to end, and sees left bytes before and right bytes after them."""
    for first in range(0, n, size):
        end = min(n, first + size)
        yield first, end, max(0, first - left), min(n, end + right)


# --- runs -------------------------------------------------------------------------------------------------------------------


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b; the first `known` bytes are not looked at again."""
    n = min(len(a), len(b))
    step = 16
    while known < n:
        x, y = a[known : known + step], b[known : known + step]
        if x != y:
            m = min(len(x), len(y))
            diff = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return known + (m - (diff.bit_length() + 7) // 8 if diff else m)
        known += step
        step = 64
    return n


def front_coded(suffixes: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Sorted suffixes as common prefix lengths with the one before, lengths of what follows, and that, end to end."""
    lcp, size, tail, last = [], [], [], b""
    for s in suffixes:
        k = common(last, s, 0)
        lcp.append(k)
        size.append(len(s) - k)
        tail.append(s[k:])
        last = s
    return np.array(lcp, "<u2").tobytes(), np.array(size, "<u2").tobytes(), b"".join(tail)


def decoded(lcp: bytes, size: bytes, tail: bytes) -> Iterator[tuple[int, bytes]]:
    """(common prefix with the one before, suffix) of a front-coded run."""
    last, at = b"", 0
    for k, n in zip(np.frombuffer(lcp, "<u2").tolist(), np.frombuffer(size, "<u2").tolist()):
        last = last[:k] + tail[at : at + n]
        at += n
        yield k, last


def merged(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, bytes, int]]:
    """(common prefix with the one before, suffix, run) in order, by a loser tree.

    Every waiting suffix knows its common prefix with the last one given out. Of two, the one with the longer such prefix is smaller, with no
    byte compared; only where these are equal are bytes compared, and only those after the prefix. Ties go to the lower run.
    """
    n = 1
    while n < len(runs):
        n *= 2
    end = None
    iters = [*runs, *[iter(())] * (n - len(runs))]
    # an entry is (prefix, suffix, run); an exhausted run's prefix is -1 and loses to all
    heads = [next(((0, s, i) for _, s in it), (-1, end, i)) for i, it in enumerate(iters)]

    def play(a, b):
        """(winner, loser), the loser with its prefix with the winner."""
        if a[0] > b[0]:
            return a, b
        if b[0] > a[0]:
            return b, a
        if a[0] < 0:
            return a, b
        x, y = a[1], b[1]
        k = common(x, y, a[0])
        if k == len(x) and (k < len(y) or a[2] < b[2]) or k < len(x) and k < len(y) and x[k] < y[k]:
            return a, (k, y, b[2])
        return b, (k, x, a[2])

    losers = [None] * n
    row = heads
    base = n
    while len(row) > 1:
        base //= 2
        nxt = []
        for i in range(0, len(row), 2):
            won, losers[base + i // 2] = play(row[i], row[i + 1])
            nxt.append(won)
        row = nxt
    top = row[0]
    while top[0] >= 0:
        yield top
        i = top[2]
        got = next(iters[i], None)
        cur = (got[0], got[1], i) if got is not None else (-1, end, i)  # a run's own prefix is with its suffix before, which was given out last
        node = (n + i) // 2
        while node:
            cur, losers[node] = play(cur, losers[node])
            node //= 2
        top = cur


# --- groups -----------------------------------------------------------------------------------------------------------------


def repeated_depths(lcp: np.ndarray, size: np.ndarray, left: np.ndarray, left_size: np.ndarray, wanted: np.ndarray, length: int, depths: range) -> tuple[np.ndarray, np.ndarray]:
    """(entry, d) for which the string that starts d bytes before the entry's anchor occurs at another entry too; wanted entries only.

    Entries are in suffix order; lcp[i] is the common prefix with entry i - 1. left: the bytes before the anchor, nearest first, one row each.
    At depth length - d, entries between two smaller common prefixes share that many bytes; in the same way those between two smaller common prefixes of the lefts' own order share d bytes.
    """
    n, reach = left.shape
    by_left = np.argsort(np.ascontiguousarray(left).view(f"S{reach}").ravel(), kind="stable") if reach else np.arange(n)
    same = left[by_left[1:]] == left[by_left[:-1]]
    left_lcp = np.concatenate([[0], np.where(same.all(1), reach, np.argmin(same, 1) if reach else 0)])
    who, what = [], []
    group = np.zeros(n, np.int64)
    for d in depths:
        can = np.flatnonzero((left_size >= d) & (size >= length - d))
        if len(can) < 2:
            continue
        group[by_left] = np.cumsum(left_lcp < d)
        key = np.cumsum(lcp < length - d)[can] * np.int64(n + 1) + group[can]
        order = np.argsort(key, kind="stable")
        k = key[order]
        again = np.zeros(len(k) + 1, bool)
        again[1:-1] = k[1:] == k[:-1]
        hit = can[order[again[1:] | again[:-1]]]
        hit = hit[wanted[hit]]
        who.append(hit)
        what.append(np.full(len(hit), d))
    if not who:
        z = np.zeros(0, np.int64)
        return z, z
    return np.concatenate(who), np.concatenate(what)


def intervals(who: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(who, lowest, highest) of runs of consecutive `what` of each `who`."""
    if not len(who):
        return who, what, what
    order = np.lexsort((what, who))
    a, b = who[order], what[order]
    cut = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1] + 1)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(a)]]) - 1
    return a[lo], b[lo], b[hi]


# --- the distributed job ----------------------------------------------------------------------------------------------------


def _places(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """a, b (content), gram, c1, c2 (the window's digests), n, pos, more of all anchors of docs (a, b, text).

    Equal windows of a text are one row: n of them, the first at pos, and their union in more (first, end), which is empty for a single one.
    """
    reach = length - gram
    names = ["a", "b", "gram", "c1", "c2", "n", "pos", "more"]

    def rows(a, b, d, p, h, x, y, size):
        """One batch from anchors at p of documents d; size: bytes of each document."""
        order = np.lexsort((p, y, x, h, d))
        d, p, h, x, y = d[order], p[order], h[order], x[order], y[order]
        new = np.ones(len(p), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(p)))
        lo, hi = np.maximum(p - reach, 0), np.minimum(p + length, size[d])
        apart = new.copy()
        apart[1:] |= lo[1:] > hi[:-1]
        apart &= np.repeat(n > 1, n)
        at = np.flatnonzero(apart)
        ends = np.append(at[1:], len(p)) - 1
        ends = np.minimum(ends, (head + n - 1)[np.searchsorted(head, at, "right") - 1]) if len(at) else at
        bounds = np.searchsorted(at, np.append(head, len(p)))
        more = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(lo[at].astype(np.int32)), pa.array(hi[ends].astype(np.int32))], names=["first", "end"]))
        cols = [pa.array(v[head].view(np.int64)) for v in (h, x, y)]
        return pa.RecordBatch.from_arrays([pa.array(a[d[head]]), pa.array(b[d[head]]), *cols, pa.array(n), pa.array(p[head].astype(np.int32)), more], names=names)

    def find(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, buf, off in B.blocks(*B.column(batch.column(2)), SEGMENT):
                if j - i > 1 or len(buf) <= 2 * SEGMENT:
                    p, *found = anchors(buf, off, length, gram)
                    d = np.searchsorted(off, p, "right") - 1
                    yield rows(a[i:j], b[i:j], d, p - off[d], *found, np.diff(off))
                    continue
                for first, end, x, z in segments(len(buf), reach, length):
                    p, *found = anchors(buf[x:z], np.array([0, z - x]), length, gram)
                    own = (p + x >= first) & (p + x < end)
                    yield rows(a[i:j], b[i:j], np.zeros(own.sum(), np.int64), (p + x)[own], *(f[own] for f in found), np.diff(off))

    return docs.select("a", "b", "text").mapInArrow(find, "a long, b long, gram long, c1 long, c2 long, n long, pos int, more array<struct<first:int,end:int>>")


def _dealt_again(texts: DataFrame, length: int, width: int) -> DataFrame:
    """a, b, pos, single, l, h, gram (digest of the bytes that all strings of depths l to h share), c1, c2 (of all that they take) for each class of at most `width` depths of the entries of texts (a, b, text, at)."""
    names = ["a", "b", "pos", "single", "l", "h", "gram", "c1", "c2"]

    def find(batches):
        for batch in batches:
            buf, off = B.column(batch.column(2))
            for k, (a, b, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                raw = buf[off[k] : off[k + 1]]
                pos, single, low, high = (np.array([x[c] for x in at], t) for c, t in (("pos", np.int64), ("single", bool), ("l", np.int64), ("h", np.int64)))
                for first, end, x, z in segments(len(raw), length, length):
                    own = np.flatnonzero((pos >= first) & (pos < end))
                    if not len(own):
                        continue
                    pre = B.prefix(raw[x:z])
                    for step in range(int((high[own] - low[own]).max()) // width + 1):
                        l = low[own] + step * width
                        h = np.minimum(l + width - 1, high[own])
                        ok = (l <= high[own]) & (pos[own] - l >= 0) & (pos[own] + length - h <= len(raw))
                        i, l, h = own[ok], l[ok], h[ok]
                        p = pos[i] - x
                        core, _ = _digests(raw[x:z], pre, p - l, p + length - h, l * 1024 + h)
                        lo, hi = np.maximum(p - h, -x), np.minimum(p + length - l, len(raw) - x)
                        c1, c2 = _digests(raw[x:z], pre, lo, hi, (p - lo) * 1024 + (hi - p))
                        n = len(i)
                        cols = [pa.array(np.full(n, a)), pa.array(np.full(n, b)), pa.array(pos[i].astype(np.int32)), pa.array(single[i]), pa.array(l.astype(np.int32)), pa.array(h.astype(np.int32)), *(pa.array(v.view(np.int64)) for v in (core, c1, c2))]
                        yield pa.RecordBatch.from_arrays(cols, names=names)

    return texts.select("a", "b", "text", "at").mapInArrow(find, "a long, b long, pos int, single boolean, l int, h int, gram long, c1 long, c2 long")


RUN = "l int, h int, bucket int, lcp binary, size binary, tail binary, lefts binary, a array<long>, b array<long>, pos array<int>, single array<boolean>"


def _runs(texts: DataFrame, buckets: int, length: int) -> DataFrame:
    """Front-coded sorted runs, one row for each class of depths, bucket and run. texts: a, b, text, at (array of gram, pos, single, l, h)."""

    def code(rows: list[tuple]):
        rows.sort(key=lambda r: r[:2])
        out = []
        k = 0
        while k < len(rows):
            m = k
            while m < len(rows) and rows[m][0] == rows[k][0]:
                m += 1
            part = rows[k:m]
            lcp, size, tail = front_coded([r[1] for r in part])
            lefts = np.array([len(r[2]) for r in part], "<u2").tobytes() + b"".join(r[2] for r in part)
            out.append((*rows[k][0], *(zlib.compress(x, 1) for x in (lcp, size, tail, lefts)), *([r[c] for r in part] for c in range(3, 7))))
            k = m
        cols = list(zip(*out))
        kinds = [*[pa.int32()] * 3, *[pa.binary()] * 4, *[pa.list_(pa.int64())] * 2, pa.list_(pa.int32()), pa.list_(pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[c.split()[0] for c in RUN.split(", ")])

    def cut(batches):
        rows = []
        for batch in batches:
            buf, off = B.column(batch.column(2))
            for k, (a, b, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                raw = buf[off[k] : off[k + 1]].tobytes()
                for x in at:
                    p, l, h = x["pos"], x["l"], x["h"]
                    rows.append(((l, h, x["gram"] % buckets), raw[p : p + length - l], raw[max(0, p - h) : p][::-1], a, b, p, x["single"]))
                    if len(rows) >= RUN_ROWS:
                        yield code(rows)
                        rows = []
        if rows:
            yield code(rows)

    return texts.select("a", "b", "text", "at").mapInArrow(cut, RUN)


def _merge(table: pa.Table, length: int) -> pa.Table:
    """a, b, first, end (bytes of strings that repeat) from the runs of one bucket and class."""
    blob = lambda c: [zlib.decompress(x) for x in table.column(c).to_pylist()]
    a, b, pos, single = (table.column(c).to_pylist() for c in ("a", "b", "pos", "single"))
    l, reach = table.column("l")[0].as_py(), table.column("h")[0].as_py()
    left_rows, left_sizes = [], []
    for raw, ids in zip(blob("lefts"), a):
        n = len(ids)
        size = np.frombuffer(raw, "<u2", n).astype(np.int64)
        data = np.frombuffer(raw, np.uint8, offset=2 * n)
        m = np.zeros((n, reach), np.uint8)
        m[np.arange(reach)[None, :] < size[:, None]] = data
        left_rows.append(m)
        left_sizes.append(size)
    heads = np.cumsum([0] + [len(x) for x in a])
    at = [0] * len(a)
    order, lcp, size = [], [], []
    for k, s, run in merged([decoded(*x) for x in zip(blob("lcp"), blob("size"), blob("tail"))]):
        order.append(int(heads[run]) + at[run])
        at[run] += 1
        lcp.append(k)
        size.append(len(s))
    order = np.array(order, np.int64)
    flat = lambda x, t: np.concatenate([np.array(y, t) for y in x])[order]
    who, d = repeated_depths(np.array(lcp), np.array(size), np.concatenate(left_rows)[order], np.concatenate(left_sizes)[order], flat(single, bool), length, range(l, reach + 1))
    who, lo, hi = intervals(who, d)
    p = flat(pos, np.int64)[who]
    return pa.table({"a": flat(a, np.int64)[who], "b": flat(b, np.int64)[who], "first": (p - hi).astype(np.int32), "end": (p - lo + length).astype(np.int32)})


def _with_texts(each: DataFrame, todo: DataFrame, name: str) -> DataFrame:
    """todo (a, b and more) with the texts of each, both of them stored; only texts of todo's contents, and a few others, are shuffled."""
    todo = stored(todo, f"{name}-places")
    out = stored(likely(each, todo, "a").join(todo, ["a", "b"]), name)
    drop(todo)
    return out


def _sorted_spans(each: DataFrame, todo: DataFrame, bucket: int, length: int, used: list[DataFrame]) -> DataFrame:
    """a, b, first, end of the strings of wanted (single) entries that the merged order finds again. todo: a, b, gram, pos, single, l, h."""
    todo = todo.groupBy("a", "b").agg(F.collect_list(F.struct("gram", "pos", "single", "l", "h")).alias("at"))
    texts = _with_texts(each, todo, "ambiguous")
    total = texts.agg(F.sum(F.size("at"))).first()[0] or 0
    runs = stored(_runs(texts, int(max(1, -(-total // bucket))), length), "runs")
    out = stored(runs.groupBy("l", "h", "bucket").applyInArrow(lambda t: _merge(t, length), "a long, b long, first int, end int"), "sorted-out")
    drop(texts, runs)
    used.append(out)
    return out


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET, group: int = GROUP, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(contents, spans) of docs (text), both stored. contents: a, b (a content's digest), n (its rows). spans: a, b, spans (array of first, end: bytes of repeated strings, they may overlap).

    Contents of several rows are wholly repeated and have no spans row for that.
    """
    reach = length - gram
    ab = docs.select(*_digest("text"), "text").where(F.octet_length("text") >= length)
    contents = stored(ab.groupBy("a", "b").agg(F.count("*").alias("n")), "contents")
    copies = stored(contents.where("n > 1").select("a", "b"), "copies")
    each, used = ab.join(small(copies), ["a", "b"], "left_anti").select("a", "b", "text"), [copies]
    if not copies.isEmpty():  # one text of each content that has copies; each task keeps one before the shuffle
        several = stored(ab.join(small(copies), ["a", "b"], "left_semi").dropDuplicates(["a", "b"]), "copied-texts")
        each = each.unionByName(several)
        used.append(several)
    every = stored(_places(each, length, gram), "anchors")
    grams = stored(every.groupBy("gram").agg(F.sum("n").alias("k"), F.count("*").alias("n")).where("k > 1").select("gram", "n"), "shared-grams")
    found = stored(weighted_join(likely(every.withColumnRenamed("n", "k"), grams, "gram"), grams, ["gram"]), "shared-anchors")
    drop(every, grams)
    kinds = stored(found.groupBy("gram", "c1", "c2").agg(F.sum("k").alias("k"), F.count("*").alias("n"), F.min(F.struct("a", "b", "pos")).alias("at")), "windows")
    one = F.array(F.struct((F.col("pos") - reach).alias("first"), (F.col("pos") + length).alias("end")))
    whole = weighted_join(found, kinds.where("k > 1").select("gram", "c1", "c2", "n"), ["gram", "c1", "c2"])
    # (first, end) of a whole window is cut to the text where it is applied
    spans = whole.select("a", "b", F.inline(F.when(F.size("more") == 0, one).otherwise(F.col("more"))))
    used += [found, kinds]
    # windows of a gram with several, one of them single at least; l to h are the depths of strings that a group is about
    rows = kinds.select("gram", (F.col("k") == 1).alias("single"), "at.*", F.lit(0).alias("l"), F.lit(reach).alias("h"))
    width = reach + 1
    while True:
        sizes = rows.groupBy("gram").agg(F.count("*").alias("n"), F.count_if("single").alias("u")).where("n > 1 and u > 0").select("gram", "n")
        sizes = stored(sizes, "groups")
        used.append(sizes)
        fine = weighted_join(rows, sizes.where(F.col("n") <= group) if width > 1 else sizes, ["gram"])
        spans = spans.unionByName(_sorted_spans(each, fine, bucket, length, used))
        large = sizes.where(F.col("n") > group)
        if width == 1 or large.isEmpty():
            break
        width = -(-width // split)
        again = weighted_join(rows, large, ["gram"]).groupBy("a", "b").agg(F.collect_list(F.struct("pos", "single", "l", "h")).alias("at"))
        texts = _with_texts(each, again, "large-groups")
        members = stored(_dealt_again(texts, length, width), "dealt-again")
        drop(texts)
        same = stored(members.groupBy("gram", "c1", "c2").agg(F.sum(F.when(F.col("single"), 1).otherwise(2)).alias("k"), F.count("*").alias("n"), F.min(F.struct("a", "b", "pos", "l", "h")).alias("at")), "windows")
        used += [members, same]
        twice = weighted_join(members.where("single"), same.where("k > 1").select("gram", "c1", "c2", "n"), ["gram", "c1", "c2"])
        spans = spans.unionByName(twice.select("a", "b", (F.col("pos") - F.col("h")).alias("first"), (F.col("pos") - F.col("l") + length).alias("end")))
        rows = same.select("gram", (F.col("k") == 1).alias("single"), "at.*")
    out = stored(spans.groupBy("a", "b").agg(F.collect_list(F.struct("first", "end")).alias("spans")), "spans")
    drop(*used)
    return contents, out


def _digest(text: str):
    return F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")


def _cut(raw: bytes, first: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int, list[tuple[int, int]]]:
    """What is left of raw, bytes removed, and the maximal removed runs."""
    first, end = np.maximum(first, 0), np.minimum(end, len(raw))
    order = np.argsort(first, kind="stable")
    out, runs, at = [], [], 0
    for a, z in zip(first[order].tolist(), end[order].tolist()):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], z)
        elif z > a:
            runs.append([a, z])
    for a, z in runs:
        out.append(raw[at:a])
        at = z
    out.append(raw[at:])
    return b"".join(out), sum(z - a for a, z in runs), len(runs), [(a, z) for a, z in runs]


def _kept(d: DataFrame, length: int, gram: int) -> DataFrame:
    """a, b, n_removed, n_spans, kept, removed of d (a, b, text, spans): one row for each content that loses bytes but has no copies."""

    def cut(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            buf, off = B.column(batch.column(2))
            raw = buf.tobytes()
            out = []
            for k, spans in enumerate(batch.column(3)):
                v = spans.values
                # a surrounding that the text's bounds cut is only repeated where a string of it fits
                first, end = v.field("first").to_numpy().astype(np.int64), v.field("end").to_numpy().astype(np.int64)
                n = int(off[k + 1] - off[k])
                ok = np.minimum(end, n) - np.maximum(first, 0) >= length
                out.append(_cut(raw[off[k] : off[k + 1]], first[ok], end[ok]))
            kept, gone, count, runs = zip(*out) if out else ((), (), (), ())
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [a, b, pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()),
                 pa.array([[{"first": x, "end": z} for x, z in r] for r in runs], kind)],
                names=["a", "b", "n_removed", "n_spans", "kept_sha256", "kept", "removed"],
            )

    return d.select("a", "b", "text", "spans").mapInArrow(cut, "a long, b long, n_removed long, n_spans long, kept_sha256 string, kept string, removed array<struct<first:long,end:long>>")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET, group: int = GROUP, split: int = SPLIT, texts: bool = True) -> DataFrame:
    """docs (any columns, with text) with _n_bytes, _n_removed, _n_spans, _kept_sha256, _removed (maximal removed runs, as byte bounds) and, if texts, _kept; they replace columns of these names.

    Each byte covered by a string of `length` bytes that also starts anywhere else in docs, the same document included, is removed; strings
    are judged on the input. Null text is empty. _kept leaves out the rest of a character that was cut through; _kept_sha256 is that of the bytes.
    Repeated rows are copies of each other: all their bytes go, from `length` bytes on. No rows give no rows.
    """
    new = ["_n_bytes", "_n_removed", "_n_spans", "_kept_sha256", *["_kept", "_removed"] * texts]
    names = [c for c in docs.columns if c not in new and (texts or c != "text")]
    d = docs.select(*(F.col(f"`{c}`").alias(f"_d{i}") for i, c in enumerate(names)), F.coalesce("text", F.lit("")).alias("_text"))
    own = [f"_d{i}" for i in range(len(names))]
    contents, spans = repeats(d.select(F.col("_text").alias("text")), length, gram, bucket, group, split)
    a, b = _digest("_text")
    ab = d.select("*", a.alias("_a"), b.alias("_b"), F.octet_length("_text").cast("long").alias("_n_bytes"))
    cols = ["a", "b", "n_removed", "n_spans", "kept_sha256", "kept", "removed"][: None if texts else -2]
    copies = contents.where("n > 1").select("a", "b")
    part = d.select(*_digest("_text"), F.col("_text").alias("text")).join(small(copies), ["a", "b"], "left_anti")
    part = likely(part, spans, "a").join(spans, ["a", "b"])
    some = stored(_kept(part, length, gram).where("n_removed > 0").select(*cols), "kept")
    drop(spans)
    whole = small(copies.select(F.col("a").alias("_ca"), F.col("b").alias("_cb")))
    out = ab.join(whole, (F.col("_a") == F.col("_ca")) & (F.col("_b") == F.col("_cb")), "left")
    whole_sha = F.sha2(F.encode("_text", "UTF-8"), 256)
    if not texts:
        out, whole_sha = out.select(*own, whole_sha.alias("_whole"), "_a", "_b", "_n_bytes", "_ca"), F.col("_whole")
    some = some.toDF(*(f"_s_{c}" for c in cols))
    out = out.join(some, (F.col("_a") == F.col("_s_a")) & (F.col("_b") == F.col("_s_b")), "left")
    all_gone = F.col("_ca").isNotNull()
    choose = lambda gone, part, none: F.when(all_gone, gone).otherwise(F.coalesce(part, none))
    got = {
        "_n_bytes": F.col("_n_bytes"), "_n_removed": choose(F.col("_n_bytes"), F.col("_s_n_removed"), F.lit(0).cast("long")),
        "_n_spans": choose(F.lit(1).cast("long"), F.col("_s_n_spans"), F.lit(0).cast("long")), "_kept_sha256": choose(F.lit(hashlib.sha256(b"").hexdigest()), F.col("_s_kept_sha256"), whole_sha),
    }
    if texts:
        none = F.array().cast("array<struct<first:long,end:long>>")
        got["_kept"] = choose(F.lit(""), F.col("_s_kept"), F.col("_text"))
        got["_removed"] = choose(F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("_n_bytes").alias("end"))), F.col("_s_removed"), none)
    return out.select(*own, *(v.alias(k) for k, v in got.items())).toDF(*names, *got)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text); see remove_repeats()."""
    d = remove_repeats(docs.select("doc_id", "text"), length, gram, texts=False)
    return d.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")))
