"""Training-order materialisation: a keyed permutation gives every sequence its global slot, and fixed-stride shards hold the slots in order.

A shard file is a run of records of `length` little-endian unsigned 16-bit ids and one more id, END_ID, so slot k is at byte
(k mod per_shard) * 2 * (length + 1) of shard k div per_shard. Spark's own file system writes the files; a lost task is simply run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bytesops as B
from tessella.llm.shared import plus, shared_path, stored
from tessella.llm.tokens import END_ID, default_path, word_bpe

LENGTH, PER_SHARD, ROUNDS, KEY = 1024, 4096, 6, 20240229
#: Bytes of ids that one task sorts into shards.
TASK_BYTES = 64 << 20


def feistel(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0 .. n - 1: a balanced Feistel network over the next even power of two, walked until it falls inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = B.U((1 << half) - 1), index.astype(B.U)
    todo = np.arange(len(out))
    keys = B.mix(np.arange(1, rounds + 1).astype(B.U) * B.U(0x9E3779B97F4A7C15) + B.U(key))
    while len(todo):
        left, right = out[todo] >> B.U(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (B.mix(right + k) & mask)
        out[todo] = (left << B.U(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """part, number, doc_id (the first document in it), n_ids, ids (unsigned 16 bits each): each split's documents, end to end, in sequences of `length` ids.

    The last sequence of a split is filled up with END_ID; n_ids counts the ids before that. Null text is empty: it gives its end id.
    """
    path = path or default_path()

    def cut(batches):
        from pyspark import TaskContext

        part, bpe, number = TaskContext.get().partitionId(), word_bpe(path), 0
        rest, rest_doc = np.zeros(0, np.uint16), None

        def out(ids, docs_at, counts, first):
            raw = [x.tobytes() for x in ids.astype("<u2").reshape(-1, length)]
            n = len(raw)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(first, first + n)), pa.array(docs_at, pa.int64()), pa.array(counts, pa.int32()), pa.array(raw, pa.binary())],
                names=["part", "number", "doc_id", "n_ids", "ids"],
            )

        for batch in batches:
            buf, off = B.column(batch.column(1))
            doc = batch.column(0)
            for i, j, b, o in B.blocks(buf, off):
                got, bounds = bpe.encode(b, o)
                ids, bounds = np.concatenate([rest, got]), bounds + len(rest)
                n = len(ids) // length
                owner = np.searchsorted(bounds, np.arange(0, len(ids), length), "right") - 1  # of the rest too, if there is one
                owners = [doc[i + k].as_py() if k >= 0 else rest_doc for k in owner.tolist()]
                if n:
                    yield out(ids[: n * length], owners[:n], np.full(n, length), number)
                number += n
                rest, rest_doc = ids[n * length :], owners[n] if n < len(owners) else None
        if len(rest):
            yield out(np.concatenate([rest, np.full(length - len(rest), END_ID, np.uint16)]), [rest_doc], [len(rest)], number)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "part int, number long, doc_id long, n_ids int, ids binary")


def ordered(seqs: DataFrame, key: int = KEY) -> DataFrame:
    """A stored table of sequences with their index (split by split) and slot. What the driver gathers is one count for each split."""
    counts = sorted((r[0], r[1]) for r in seqs.groupBy("part").count().collect())
    heads, n = {}, 0
    for part, c in counts:
        heads[part] = n
        n += c
    model = seqs.sparkSession.sparkContext.broadcast((heads, n))

    def place(batches):
        heads, n = model.value
        for batch in batches:
            t = pa.Table.from_batches([batch])
            part, number = (t.column(c).to_numpy() for c in ("part", "number"))
            index = number + np.array([heads[p] for p in part.tolist()], np.int64)
            yield from t.append_column("index", pa.array(index)).append_column("slot", pa.array(feistel(index, n, key))).to_batches()

    return seqs.mapInArrow(place, plus(seqs.schema, "index long, slot long"))


def write_shards(seqs: DataFrame, path: str, total: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> None:
    """Writes shard=k folders of one file each, slots in order, of `total` sequences of `length` ids. A task sorts about TASK_BYTES of whole shards."""

    def each(f):
        def run(batches):
            for batch in batches:
                for k in range(0, batch.num_rows, 1000):  # two megabytes of sequences at once
                    t = pa.Table.from_batches([batch.slice(k, 1000)])
                    ids = pa.array([f(x) for x in t.column("ids").to_pylist()], pa.binary())
                    yield from t.set_column(t.schema.get_field_index("ids"), "ids", ids).to_batches()

        return run

    d = seqs.select(F.expr(f"cast(slot div {per_shard} as int)").alias("shard"), "slot", "ids")
    n = max(1, -(-total // per_shard))
    parts = min(n, max(seqs.sparkSession.sparkContext.defaultParallelism, -(-n * per_shard * 2 * length // TASK_BYTES)))
    d = d.mapInArrow(each(lambda x: zlib.compress(x, 1)), d.schema)
    # slots are known to be 0 .. total: ranges of shards need no sample
    d = d.repartitionById(parts, F.expr(f"cast(shard * {parts}L div {n}L as int)")).sortWithinPartitions("shard", "slot")
    d = d.mapInArrow(each(zlib.decompress), d.schema).select(F.col("ids").cast("string").alias("value"), "shard")
    d.write.partitionBy("shard").option("lineSep", chr(END_ID) + "\0").text(path)


def shard_files(spark: SparkSession, path: str) -> dict[int, str]:
    """The file of each shard under path, by Spark's file system."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = {}
    for folder in fs.listStatus(top):
        name = folder.getPath().getName()
        if name.startswith("shard="):
            out[int(name[6:])] = next(p for f in fs.listStatus(folder.getPath()) if (p := f.getPath().toString()).rpartition("/")[2].startswith("part-"))
    return out


def resume(spark: SparkSession, path: str, slot: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD, step: int = 256) -> Iterator[tuple[int, bytes]]:
    """(slot, ids) of every record from `slot` on, in order: a trainer's sequential read, resumed anywhere.

    The first shard is opened at the record's own byte, (slot mod per_shard) * 2 * (length + 1); nothing before it is read, and at most `step` records are held.
    """
    stride, conf = 2 * (length + 1), spark._jsparkSession.sessionState().newHadoopConf()
    for shard, file in sorted(shard_files(spark, path).items()):
        if shard < slot // per_shard:
            continue
        at = spark._jvm.org.apache.hadoop.fs.Path(file)
        fs = at.getFileSystem(conf)
        k = slot - shard * per_shard if shard == slot // per_shard else 0
        n = fs.getFileStatus(at).getLen() // stride
        stream = fs.open(at)
        try:
            if k < n:
                stream.seek(k * stride)
            while k < n:
                many = min(step, n - k)
                data = bytes(spark._jvm.org.apache.commons.io.IOUtils.readFully(stream, many * stride))
                for i in range(many):
                    yield shard * per_shard + k + i, data[i * stride : (i + 1) * stride - 2]
                k += many
        finally:
            stream.close()


def read_slots(spark: SparkSession, path: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """slot, ids (binary) of every record of the shards under path."""
    stride = 2 * (length + 1)

    def split(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                base = int(file.rpartition("shard=")[2].partition("/")[0]) * per_shard
                if len(data) % stride:
                    raise ValueError(f"{file}: {len(data)} bytes are no whole records")
                n = len(data) // stride
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(base, base + n)), pa.array([data[k * stride : (k + 1) * stride - 2] for k in range(n)], pa.binary())], names=["slot", "ids"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(split, "slot long, ids binary")


def training_order(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """Writes the shards into the shared folder and returns, per sequence, slot, shard, index, doc_id, n_ids, and the crc32 of the ids read back."""
    spark = docs.sparkSession
    base = stored(sequences(docs, length), "sequences")
    path = shared_path(spark, "shards")
    write_shards(ordered(base, key), path, base.count(), length, per_shard)
    seqs = ordered(base.drop("ids"), key)
    back = read_slots(spark, path, length, per_shard).select(F.col("slot").alias("_slot"), F.crc32("ids").alias("ids_crc32"))
    return seqs.drop("part", "number").join(back, F.col("slot") == F.col("_slot")).select("slot", F.expr(f"slot div {per_shard}").alias("shard"), "index", "doc_id", "n_ids", "ids_crc32")
