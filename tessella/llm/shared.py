"""Session and storage helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Rows of a lookup table that may be broadcast (16 to 50 bytes each).
BROADCAST_ROWS = 20_000
#: Bits of a filter of likely() for each key, and at most (64 MB); bits in one of its rows.
FILTER_BITS, MAX_FILTER, FILTER_ROW = 16, 1 << 29, 1 << 11


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, a temporary folder of our own serves local mode (tests); a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN.get("dir") or _OWN.setdefault("dir", tempfile.mkdtemp(prefix="tessella-"))


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df to the shared folder (in a folder for each value of `by`) and reads it back: cuts lineage, and survives the loss of executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Deletes tables that stored() wrote and that no frame still to be evaluated reads."""
    for df in frames:
        if df is not None and (path := _PATHS.pop(df, None)):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, n: int):
    """crc32 of doc_id as text, modulo n; null ids fall in fold null, so they are neither trained on nor held out."""
    return F.crc32(doc_id.cast("string")) % F.lit(n)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast hint for a frame whose row count was checked against the bound (BROADCAST_ROWS); otherwise left to a shuffled join."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def likely(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose key is not in keys, a stored table; both have the column key, a 64-bit hash.

    A bitmap by the low bits of the hashes is broadcast, of FILTER_BITS for each key and at most MAX_FILTER. A fuller one lets more rows through, and loses none: the join that follows decides.
    """
    bits = min(MAX_FILTER, 1 << max(15, (keys.count() * FILTER_BITS).bit_length()))
    whole = 1 << 15  # bits of one bitmap_construct_agg
    at = F.col(key).bitwiseAND(F.lit(bits - 1))
    bitmaps = keys.select(F.shiftright(at, 15).alias("w"), (at % whole).alias("p")).groupBy("w").agg(F.bitmap_construct_agg("p").alias("bits"))
    part = f"substring(bits, cast(i * {FILTER_ROW // 8} + 1 as int), {FILTER_ROW // 8})"
    small_rows = bitmaps.select("w", "bits", F.explode(F.sequence(F.lit(0), F.lit(whole // FILTER_ROW - 1))).alias("i"))
    small_rows = small_rows.select((F.col("w") * (whole // FILTER_ROW) + F.col("i")).alias("_w"), F.expr(part).alias("_bits"))
    place = at % FILTER_ROW
    byte = F.conv(F.hex(F.col("_bits").substr((F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (place % 8).cast("int")) == 1
    found = rows.withColumn("_w", F.shiftright(at, FILTER_ROW.bit_length() - 1))
    return found.join(F.broadcast(small_rows), "_w").where(hit).select(*rows.columns)


def weighted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """left joined (inner or left) to right, a stored table with a row for each key and n, how many rows of left have that key; n isn't returned.

    right is broadcast if it has at most `rows` rows. Otherwise its heavy keys are: those of more than a rows-th of all that n counts, of which there are fewer
    than `rows`. The others meet by a shuffle, in which no key has more than that share.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    if right.limit(rows + 1).count() <= rows:
        return left.join(F.broadcast(right.drop("n")), on, how)
    most = (right.agg(F.sum("n")).first()[0] or 0) // max(1, rows)
    heavy, light = right.where(F.col("n") > most).drop("n"), right.where(F.col("n") <= most).drop("n")
    return left.join(F.broadcast(heavy), on).unionByName(left.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light.hint("merge"), on, how))


def plus(schema: StructType, ddl: str) -> StructType:
    """schema with the fields of ddl after its own; schema itself stays as it is."""
    return StructType(schema.fields + StructType.fromDDL(ddl).fields)
