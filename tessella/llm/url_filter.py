"""URL verdicts: longest-prefix rules, then exact list membership by a cascade of Bloom filters. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import drop, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BITS_PER_KEY, HASHES = 10, 5
#: Bits that one level may have (16 MB); a longer list is cut into shards by its keys' hash.
MAX_BITS = 1 << 27
URL = r"(?s)://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty where url is null or has no ://."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits (its host or a subdomain, and its path's start), else nulls."""
    text = verdict = None
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)) if text is None else F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(v)) if verdict is None else F.when(fits, F.lit(v)).otherwise(verdict)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    """HASHES bit positions by double hashing; each level has its own seed."""
    a, b = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    return [F.pmod(F.shiftright(a, 2) + F.lit(i) * F.shiftright(b, 8), F.lit(bits).cast("long")) for i in range(HASHES)]


def _encode(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row: the filter's 64-bit words as an array. Its size is bits, whatever the number of keys."""
    pos = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("p"))
    words = pos.select(F.expr("p div 64").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
    zero = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    return words.unionByName(zero).groupBy("w").agg(F.bit_or("b").alias("b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits"))


def _probe(key: Column, bits: Column, level: int, n: int) -> Column:
    out = F.lit(True)
    for p in _positions(key, level, n):
        out &= F.getbit(F.get(bits, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1
    return out


class Cascade:
    """Exact membership in `listed` for every key of `universe`, without a join on the probing side.

    Level 0 encodes the listed keys; each next level encodes those keys of the other side that the level before wrongly lets
    through, over the whole key universe, until none is left. Null keys are in neither set. Repeated keys count once. Keys are dealt by hash to as many shards, each with a
    cascade of its own, as keep a level within max_bits.
    """

    def __init__(self, universe: DataFrame, listed: DataFrame, max_bits: int = MAX_BITS):
        """universe, listed: one column `key`."""
        inside = listed.where("key is not null").distinct()
        rest = stored(universe.where("key is not null").distinct().join(inside, "key", "left_anti"), "unlisted")
        inside = stored(inside, "listed")
        # a level may take 64 bits more than its keys ask for, and a shard more keys than the mean
        self.shards = max(1, -(-inside.count() * BITS_PER_KEY * 5 // (4 * max_bits)))
        if self.shards > 1:
            inside, rest = (stored(d.withColumn("_shard", self.shard(F.col("key"))), "key-shards", ("_shard",)) for d in (inside, rest))
        self.levels = [self._levels(*((d.where(F.col("_shard") == k).select("key") if self.shards > 1 else d) for d in (inside, rest))) for k in range(self.shards)]

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(self.shards)).cast("int")

    @staticmethod
    def _levels(now: DataFrame, other: DataFrame) -> list[tuple[DataFrame, int]]:
        levels, count = [], now.count()
        while count:
            level, n = len(levels), max(64, -(-count * BITS_PER_KEY // 64) * 64)
            bits = stored(_encode(now, level, n), f"bloom-{level}")
            levels.append((bits, n))
            now, other = stored(other.where(_probe(F.col("key"), bits.scalar(), level, n)), f"pass-{level}"), now
            count = now.count()
        return levels

    def contains(self, key: Column, shard: int = 0) -> Column:
        """True for the shard's listed keys, false for the universe's others; the first level that lacks the key decides."""
        levels = self.levels[shard]
        out = F.lit(len(levels) % 2 == 1)
        for level in range(len(levels) - 1, -1, -1):
            bits, n = levels[level]
            out = F.when(_probe(key, bits.scalar(), level, n), out).otherwise(F.lit(level % 2 == 1))
        return F.coalesce(key.isNotNull() & out, F.lit(False))

    def mark(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """df with the boolean column `name`. Of several shards, each is a pass over its own rows, stored, so that one shard's filters are in memory at a time."""
        if self.shards == 1:
            return df.withColumn(name, self.contains(F.col(key)))
        dealt = stored(df.withColumn("_shard", self.shard(F.col(key))), "rows-by-shard", ("_shard",))
        parts = [stored(dealt.where(F.col("_shard") == k).drop("_shard").withColumn(name, self.contains(F.col(key), k)), "marked") for k in range(self.shards)]
        drop(dealt)
        return reduce(DataFrame.unionByName, parts)


def filter_urls(pages: DataFrame, rules=RULES, listed: DataFrame | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url).

    listed: blocked hosts (column key); by default the hosts that have at least one page blocked by a rule, so that a page no
    rule covers is blocked where its host is known for blocked pages. Null or malformed urls have an empty host, no rule, and
    are allowed unless the empty host is listed. Repeated rows stay; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    d = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    d = d.withColumns({"rule": rule, "_v": verdict})
    hosts = stored(d.groupBy(F.col("host").alias("key")).agg(F.max(F.col("_v") == "block").alias("blocked")), "hosts")
    listed = hosts.where("blocked").select("key") if listed is None else listed.select("key")
    d = Cascade(hosts.select("key"), listed, max_bits).mark(d, "host", "_listed")
    return d.select("page_id", "host", "path", "rule", F.coalesce("_v", F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"))
