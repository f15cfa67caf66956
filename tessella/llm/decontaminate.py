"""Benchmark decontamination by a prefix-filtered containment join.

Item windows are cut into shingles; the shingles are counted over the whole corpus, and of each window only the rarest one, its necessary prefix token, is joined with
the documents: each occurrence of a prefix shingle in a document, with the words around it, meets the windows that have this prefix. Length and position bounds say
where the window would lie there, and its words are compared exactly. Windows, counts, occurrences and hits are tables of their own; the driver holds bitmaps of fixed size.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import bytesops as B
from tessella.llm.shared import drop, small, stored, weighted_join

WINDOW, SHINGLE = 10, 3
#: Bits of a bitmap of shingles, for each shingle and at most (64 MB). A fuller bitmap lets more occurrences through to the join, and loses none.
BITS_PER_KEY, MAX_BITS = 64, 1 << 29
#: Longs of a bitmap in one row.
CHUNK = 8192
#: Bits of the filter of contaminated texts, where these are too many to broadcast.
TEXT_BITS = 1 << 26
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").translate(B.LOWER))


def _hashed(words: list[bytes]) -> np.ndarray:
    """The hashes that word_hashes() gives the same words in a document."""
    raw = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return B.hash_spans(raw, np.concatenate([[0], ends[:-1] + 1]), ends)


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, w (the words of a window, with spaces between), size, shingles (size of a shingle, hashes) of every window of items (item_id, text)."""

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text or "")
                size = min(window, len(words))
                n = min(SHINGLE, size)
                if not n:
                    continue
                grams, raw = B.grams(_hashed(words), n).view(np.int64), [x.decode() for x in words]
                for low in range(0, len(words) - size + 1, 4096):  # a few thousand windows of a long item at a time
                    at = range(low, min(low + 4096, len(words) - size + 1))
                    cols = [pa.array([item] * len(at), pa.string()), pa.array([" ".join(raw[i : i + size]) for i in at]), pa.array([size] * len(at), pa.int32()), pa.array([n] * len(at), pa.int32()), pa.array([grams[i : i + size - n + 1] for i in at], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["item", "w", "size", "n", "shingles"])

    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(cut, "item string, w string, size int, n int, shingles array<long>")


class Bitmap:
    """A set of 64-bit hashes as bits, two for each; it may hold more than was put in, never less. Its size is fixed by the number of keys, up to MAX_BITS."""

    def __init__(self, keys: DataFrame, name: str, count: int, most: int = MAX_BITS):
        """keys: the column `name`, which may repeat; count: how many there may be."""
        self.bits = min(most, max(1 << 13, 1 << (max(1, count) * BITS_PER_KEY - 1).bit_length()))
        mask = F.lit(self.bits - 1)
        place = F.explode(F.array(F.col(name).bitwiseAND(mask), F.shiftrightunsigned(name, 34).bitwiseAND(mask)))
        words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        rows = words.groupBy(F.expr(f"w div {CHUNK}").alias("c")).agg(F.collect_list(F.struct("w", "b")).alias("x"))
        self.words = np.zeros(self.bits // 64, B.U)
        for batch in rows.select(F.col("x.w").alias("w"), F.col("x.b").alias("b")).toArrow().to_batches():
            w, b = (batch.column(c).flatten().to_numpy() for c in ("w", "b"))
            self.words[w] = b.view(B.U)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of h whose values may be in the set."""
        mask = B.U(self.bits - 1)
        has = lambda p: (self.words[p >> B.U(6)] >> (p & B.U(63))) & B.U(1) == 1
        at = np.flatnonzero(has(h & mask))
        return at[has((h[at] >> B.U(34)) & mask)]


def _occurrences(h: np.ndarray, first: np.ndarray, bitmap: Bitmap, sizes: list[int]):
    """(shingle size, document, word place, hash) of the shingles in the bitmap, none across documents."""
    for n in sizes:
        g = B.grams(h, n)
        p = bitmap.find(g)
        d = np.searchsorted(first, p, "right") - 1
        ok = p + n <= first[d + 1]
        yield n, d[ok], p[ok], g[p[ok]].view(np.int64)


def shingle_counts(docs: DataFrame, bitmap: Bitmap, sizes: list[int]) -> DataFrame:
    """n, h, c: occurrences of shingles in all documents, summed in each block first; of the bitmap's set, and a few others."""
    model = docs.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches):
        for batch in batches:
            for _, _, b, o in B.blocks(*B.column(batch.column(0))):
                h, _, _, first = B.word_hashes(B.lowered(b), o, B.ALNUM)
                for n, _, _, g in _occurrences(h, first, model.value, sizes):
                    v, c = np.unique(g, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), n), pa.int32()), pa.array(v), pa.array(c)], names=["n", "h", "c"])

    return docs.select("text").mapInArrow(count, "n int, h long, c long").groupBy("n", "h").agg(F.sum("c").alias("c"))


def occurrences(docs: DataFrame, bitmap: Bitmap, sizes: list[int], longest: int, window: int = WINDOW) -> DataFrame:
    """k1, k2 (a text's digest), n, h, place, before, ctx: shingles of the bitmap in docs (k1, k2, text), with up to window - 1 words on each side.

    A word of more than `longest` bytes, longer than any of an item, stands there as an empty one, so that what a row holds is bounded.
    """
    model = docs.sparkSession.sparkContext.broadcast(bitmap)
    names = ["k1", "k2", "n", "h", "place", "before", "ctx"]

    def find(batches):
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, _, b, o in B.blocks(*B.column(batch.column(2))):
                low = B.lowered(b)
                h, s, e, first = B.word_hashes(low, o, B.ALNUM)
                size = e - s
                fits = size <= longest
                size = np.where(fits, size, 0)
                held = np.zeros(len(low), bool)
                edge = np.zeros(len(low) + 1, np.int8)
                edge[s[fits]] += 1
                edge[e[fits]] -= 1
                held = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
                bounds = np.concatenate([[0], np.cumsum(size)])
                words = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(low[held].tobytes()))
                for n, doc, place, g in _occurrences(h, first, model.value, sizes):
                    for low_at in range(0, len(place), 1 << 16):
                        part = slice(low_at, low_at + (1 << 16))
                        p, d = place[part], doc[part]
                        a, z = np.maximum(first[d], p - (window - 1)), np.minimum(first[d + 1], p + window)
                        many = z - a
                        ends = np.cumsum(many)
                        flat = np.repeat(a - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)
                        ctx = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pc.cast(words.take(pa.array(flat)), pa.string()))
                        cols = [pa.array(k1[i + d]), pa.array(k2[i + d]), pa.array(np.full(len(p), n), pa.int32()), pa.array(g[part]), pa.array((p - first[d]).astype(np.int32)), pa.array((p - a).astype(np.int32)), ctx]
                        yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(find, "k1 long, k2 long, n int, h long, place int, before int, ctx array<string>")


def prefixes(docs: DataFrame, found: DataFrame, sizes: list[int], window: int = WINDOW) -> DataFrame:
    """w, size, n, h, at: each distinct window of found with its rarest shingle, the first of equal ones, and that shingle's place in it."""
    distinct = stored(found.groupBy("w", "size", "n").agg(F.first("shingles").alias("shingles")), "windows")
    each = distinct.select("w", "size", "n", F.posexplode("shingles").alias("at", "h"))
    known = each.groupBy("n", "h").agg(F.count("*").alias("k"))
    counts = shingle_counts(docs, Bitmap(each, "h", distinct.count() * window), sizes).join(known, ["n", "h"])
    counts = stored(counts.select("h", F.col("n").alias("m"), "c", F.col("k").alias("n")), "shingle-counts")
    each = weighted_join(each.withColumnRenamed("n", "m"), counts, ["m", "h"], "left")
    rarest = F.min_by(F.struct("h", "at"), F.struct(F.coalesce("c", F.lit(0)), "at"))
    return stored(each.groupBy("w", "size", F.col("m").alias("n")).agg(rarest.alias("x")).select("w", "size", "n", "x.*"), "prefixes")


def window_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(hits, owners). hits: k1, k2, first, end, w of every occurrence of a window in docs (k1, k2, text), once for each text; owners: w, item."""
    found = stored(windows(items, window), "item-windows")
    sizes, longest = found.agg(F.sort_array(F.collect_set("n")), F.max(F.array_max(F.transform(F.split("w", " "), F.octet_length)))).first()
    owners = found.where("item is not null").select("w", "item").distinct()
    none = docs.sparkSession.createDataFrame([], "k1 long, k2 long, first int, end int, w string")
    if not sizes:
        return none, owners
    rare = prefixes(docs.select("text"), found, sizes, window)
    seen = stored(occurrences(docs, Bitmap(rare, "h", rare.count()), sizes, longest, window), "occurrences")
    # the words where the window would lie, if it fits between the words around; a hot prefix is dealt by Spark's own splitting of skewed joins
    low = F.col("before") - F.col("at")
    fits = (low >= 0) & (low + F.col("size") <= F.size("ctx"))
    same = F.array_join(F.slice("ctx", low + 1, F.col("size")), " ") == F.col("w")
    hits = seen.join(small(rare, 200_000), ["n", "h"]).where(fits).where(same)
    first = F.col("place") - F.col("at")
    hits = stored(hits.select("k1", "k2", first.alias("first"), (first + F.col("size")).alias("end"), "w").distinct(), "hits")
    drop(rare, seen)
    return hits, owners


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep: list[str] | None = None, broadcast_rows: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, hits (runs of hit words: first, end), contaminated for every row of docs; keep: more columns of docs.

    Null text or item text has no words; a null item_id is hit but not listed; repeated items count once by id; repeated documents stay.
    An empty benchmark hits nothing. Column names of items never clash with those of docs, and columns of docs may have any name but _text, _k1, _k2.
    """
    keep = [c for c in keep or [] if c != "doc_id"]
    k1, k2 = F.xxhash64("_text"), F.xxhash64(F.lit(7), "_text")
    d = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("_text"))
    hits, owners = window_hits(d.select(k1.alias("k1"), k2.alias("k2"), F.col("_text").alias("text")), items, window)
    # runs that overlap or touch as one
    step = lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] >= x["first"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["first"].alias("first"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x)))
    empty = F.array().cast("array<struct<first:int,end:int>>")
    spans = hits.select("k1", "k2", "first", "end").distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("_s"))
    spans = spans.select("k1", "k2", F.aggregate("_s", empty, step).alias("hits"))
    ids = hits.select("k1", "k2", "w").distinct().join(small(owners, 200_000), "w").select("k1", "k2", "item").distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    found = stored(spans.join(ids, ["k1", "k2"], "left").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "hits", "item_ids"), "contaminated").toDF("_k1", "_k2", "_hits", "_ids")
    own = (k1 == F.col("_k1")) & (k2 == F.col("_k2"))
    rows = 100_000 if broadcast_rows is None else broadcast_rows
    if found.limit(rows + 1).count() <= rows:
        d = d.join(F.broadcast(found), own, "left")
    else:  # only texts that a filter of the contaminated ones lets through are dealt by their digest
        bits = stored(_text_filter(found.select(F.col("_k1").alias("k"))), "contaminated-filter")
        some = F.getbit(F.get(bits.scalar(), F.shiftright(k1.bitwiseAND(F.lit(TEXT_BITS - 1)), 6).cast("int")), (k1.bitwiseAND(F.lit(63))).cast("int")) == 1
        part = d.where(some).join(found.hint("merge"), own, "left")
        none = [F.lit(None).cast(t).alias(c) for c, t in found.dtypes]
        d = part.unionByName(d.where(~some).select("*", *none))
    runs, items_of = F.coalesce("_hits", empty), F.coalesce("_ids", F.array().cast("array<string>"))
    n_hit = F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    n_words = F.regexp_count("_text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    return d.select("doc_id", *keep, n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("item_ids"), runs.alias("hits"), (n_hit > 0).alias("contaminated"))


def _text_filter(keys: DataFrame) -> DataFrame:
    """One row: a bitmap of TEXT_BITS bits by the low bits of k."""
    p = F.col("k").bitwiseAND(F.lit(TEXT_BITS - 1))
    words = keys.select(F.shiftright(p, 6).alias("w"), F.expr("shiftleft(1L, cast(k & 63 as int))").alias("b"))
    words = words.unionByName(keys.sparkSession.range(TEXT_BITS // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b")))
    return words.groupBy("w").agg(F.bit_or("b").alias("b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits"))


def item_digest(ids: Column) -> Column:
    return F.sha2(F.encode(F.array_join(ids, ","), "UTF-8"), 256)
