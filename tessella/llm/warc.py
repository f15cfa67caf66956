"""WARC archives: a writer with payload deduplication, and a reader that salvages records from damaged archives."""

from __future__ import annotations

import hashlib
import logging
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.shared import shared_path, stored, weighted_join

LOG = logging.getLogger(__name__)
MIN_REVISIT = 100
#: Bytes of payload for one archive file, on average over the corpus: files are read whole.
FILE_BYTES = 32 << 20
END, VERSION, GZIP = b"\r\n\r\n", b"WARC/1.", b"\x1f\x8b\x08"
UNFINISHED = "gzip: unfinished member"
#: Compressed bytes that are read at a time.
STEP = 1 << 14
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def decided(pages: DataFrame, min_revisit: int = MIN_REVISIT, broadcast_rows: int | None = None) -> DataFrame:
    """pages (page_id, url, html) with payload, payload_bytes, digest, record_type, refers_to.

    Of records with equal payloads of min_revisit bytes or more, the one with the smallest page_id is the response; rows that
    repeat that page_id are responses too, and so is every row of a group that has no page_id at all.
    """
    d = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    d = d.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.encode("payload", "UTF-8"), 256)})
    groups = d.where(F.col("payload_bytes") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("n")).where("n > 1")
    d = weighted_join(d, stored(groups, "payload-groups"), ["digest"], "left", broadcast_rows)
    revisit = F.coalesce((F.col("payload_bytes") >= min_revisit) & (F.col("page_id").isNull() | (F.col("page_id") != F.col("_first"))) & F.col("_first").isNotNull(), F.lit(False))
    return d.select("page_id", "url", "payload", "payload_bytes", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def record(date: str) -> Column:
    """One WARC/1.1 record without its closing blank lines. Bytes outside printable ASCII in the url are left out of the header line."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    block = F.concat(F.lit(HTTP), F.when(F.col("record_type") == "response", F.col("payload")).otherwise(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.regexp_replace("url", r"[^\x21-\x7E]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("X-Page-Id", F.col("page_id").cast("string")), line("WARC-Refers-To", F.col("refers_to").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )
    return head


def write_warc(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes uncompressed archives of about file_bytes each through Spark's own file system; a record ends in two blank lines."""
    d = decided(pages, min_revisit)
    n, size = pages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    rows = max(1, int(file_bytes // max(1, size / max(1, n) + 600)))
    d.select(record(date).alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", rows).text(path)


def gzip_members(records: list[bytes]) -> bytes:
    """A .warc.gz archive: one gzip member for each record."""
    out = []
    for r in records:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        out += [z.compress(r + END), z.flush()]
    return b"".join(out)


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at `at` and the place after it; raises ValueError if a check fails. Its header may have any length, up to the next version line."""
    if not data.startswith(VERSION, at):
        raise ValueError("no version line")
    head_end = data.find(END, at)
    if head_end < 0 or data.find(b"\n" + VERSION, at, head_end) >= 0:
        raise ValueError("unfinished header")
    head = {}
    for row in data[at:head_end].split(b"\r\n")[1:]:
        k, colon, v = row.partition(b":")
        if not colon:
            raise ValueError("malformed header line")
        head[k.decode("ascii", "replace").lower()] = v.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        raise ValueError("no content length")
    start = head_end + 4
    end = start + int(head["content-length"])
    if data[end : end + 4] != END:
        raise ValueError("no blank lines after the block")
    block = data[start:end]
    payload = block.partition(END)[2] if head.get("content-type", "").startswith("application/http") else block
    kind, want = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response" and want and hashlib.sha256(payload).hexdigest() != want:
        raise ValueError("payload digest differs")
    return {"head": head, "type": kind, "payload": payload, "checked": kind == "response" and bool(want)}, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """The bytes of the gzip member at `at`, up to the place where it ends or fails; the place after it, or None and a reason."""
    z, out, k = zlib.decompressobj(31), [], at
    while k < len(data) and not z.eof:
        before = z.copy()
        try:
            out.append(z.decompress(data[k : k + STEP]))
        except zlib.error as e:
            try:
                for b in range(k, k + STEP):
                    out.append(before.decompress(data[b : b + 1]))
            except zlib.error:
                pass
            return b"".join(out), None, f"gzip: {e}"
        k += STEP
    if not z.eof:
        return b"".join(out), None, UNFINISHED
    return b"".join(out), min(k, len(data)) - len(z.unused_data), ""


def _inside(inner: bytes, damaged: bool) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """Records in a member's bytes, and the gaps between. Of a member that zlib finds damaged, only records whose payload digest was checked."""
    found, gaps, at, bad, why = [], [], 0, None, ""
    while at < len(inner):
        try:
            got, nxt = _parse(inner, at)
            if damaged and not got["checked"]:
                raise ValueError("no digest to check")
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            at = inner.find(VERSION, at + 1)
            at = at if at >= 0 else len(inner)
            continue
        if bad is not None:
            gaps.append((bad, at, why))
            bad = None
        found.append(got)
        at = nxt
    if bad is not None:
        gaps.append((bad, len(inner), why))
    return found, gaps


def salvage(data: bytes) -> Iterator[tuple[str, object]]:
    """("record", dict) for each valid record, ("gap", (start, end, reason)) for each quarantined run of bytes.

    After a failed check the search goes on at the next gzip member or version line from which a whole record can be read, inside a gzip member too: a gap there has the
    bytes of its member, and its place inside in the reason.
    """
    at, n, bad, why = 0, len(data), None, ""
    ahead = {GZIP: -1, VERSION: -1}  # the next place of each, so that no bytes are searched twice
    while at < n:
        gaps = []
        try:
            if data.startswith(GZIP, at):
                inner, nxt, wrong = _inflate(data, at)
                found, gaps = _inside(inner, nxt is None and wrong != UNFINISHED)
                if nxt is None:
                    for got in found:
                        yield "record", got
                    raise ValueError(f"{wrong}, inside: {gaps[0][0] if gaps else len(inner)} to {len(inner)}")
                if gaps and not found:
                    raise ValueError(gaps[0][2])
            else:
                got, nxt = _parse(data, at)
                found = [got]
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            for k, p in ahead.items():
                if p <= at:
                    ahead[k] = (data.find(k, at + 1) + n + 1) % (n + 1)  # n if there is none
            at = min(ahead.values())
            continue
        if bad is not None:
            yield "gap", (bad, at, why)
            bad = None
        for got in found:
            yield "record", got
        for a, z, reason in gaps:
            yield "gap", (at, nxt, f"{reason}, inside: {a} to {z}")
        at = nxt
    if bad is not None:
        yield "gap", (bad, n, why)


SCHEMA = "path string, kind string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, gap_start long, gap_end long, reason string"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records (kind 'record') and quarantined gaps (kind 'gap': file, first byte, end, reason) of all archives under path, files of up to 2 GB each.

    payload_bytes and payload_digest are those of the full payload, for revisits as their record states them. Empty files give no row.
    """

    def rows(batches):
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                out, size = {k.split()[0]: [] for k in SCHEMA.split(", ")}, 0

                def add(**x):
                    for k in out:
                        out[k].append(x.get(k))

                for kind, x in salvage(content.as_py() or b""):
                    if kind == "gap":
                        add(path=file.as_py(), kind=kind, gap_start=x[0], gap_end=x[1], reason=x[2])
                    else:
                        h, p, full = x["head"], x["payload"], x["type"] != "revisit"
                        num = lambda k, h=h: int(h[k]) if h.get(k, "").lstrip("-").isdigit() else None
                        add(path=file.as_py(), kind=kind, page_id=num("x-page-id"), payload_bytes=len(p) if full else num("x-payload-length"),
                            payload_digest=hashlib.sha256(p).hexdigest() if full else h.get("warc-payload-digest", "").removeprefix("sha256:"),
                            record_type=x["type"], refers_to=num("warc-refers-to"), payload=p if payloads and full else None)
                        size += len(p)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pydict(out, arrow)
                        out, size = {k: [] for k in out}, 0
                if out["path"]:
                    yield pa.RecordBatch.from_pydict(out, arrow)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(k, kinds[t]) for k, t in (c.split() for c in SCHEMA.split(", "))])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(rows, SCHEMA)


def report_gaps(found: DataFrame) -> tuple[int, int]:
    """Numbers of records and gaps in a stored result of read_warc(); the gaps are logged, by file."""
    n = {r[0]: r[1] for r in found.groupBy("kind").count().collect()}
    if n.get("gap"):
        files = found.where("kind = 'gap'").groupBy("path").agg(F.count("*").alias("gaps"), F.sum(F.col("gap_end") - F.col("gap_start")).alias("bytes"), F.min("reason").alias("reason"))
        for r in files.orderBy(F.desc("bytes"), "path").limit(100).collect():  # a report of the worst; all are in found
            LOG.warning("%s: %d gaps of %d bytes quarantined (%s)", r["path"], r["gaps"], r["bytes"], r["reason"])
    return n.get("record", 0), n.get("gap", 0)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives into the shared folder and returns what the salvage reader finds in them, one row per page.

    Gaps are logged; a page whose record is not found again is an error, never a row left out.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path)
    found = stored(read_warc(spark, path, payloads=False), "warc-records")
    records, gaps = report_gaps(found)
    if records != (want := pages.count()):
        raise RuntimeError(f"{records} records read back of {want} pages, with {gaps} gaps, under {path}")
    return found.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
