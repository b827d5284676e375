"""WARC archives with an index, and coalesced range reads of selected records (operator 7).

Writing: every task writes one archive of gzip members (a record each) under a name of its own attempt, and returns
an index row per record: archive, offset, length, URL, digest. Only the rows of committed attempts get into the
index, so archives of lost or repeated attempts are never read. Equal payloads (by SHA-1) are stored once: the one
with the smallest page_id is the response, the others are revisits of it; which ones is settled before by an
aggregation over digests alone.

Reading: the selected index rows are dealt in order of archive and offset, so many bytes a task; ranges that touch or nearly touch are
read at once, up to a bounded size, and each member is unpacked and parsed from that buffer.

Archives are opened through Arrow file systems, so the folder must be one that Arrow reaches (file, hdfs, s3, gs).

Defined cases: null html is an empty payload; null urls become empty target URIs; a null page_id stays null and
never is the one that others refer to, unless all are null; rows that repeat the smallest id are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import qualified
from .common import new_path, read_table, stage

#: Payloads of fewer bytes are always stored themselves.
REVISIT_BYTES = 0
#: Ranges closer than GAP are read together, up to READ bytes.
GAP, READ = 64 << 10, 8 << 20
#: Archive bytes of a reading task, and what a task has at least where there are fewer tasks than cores.
TASK_BYTES, LEAST_TASK_BYTES = 64 << 20, 2 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_digest", pa.string())])
INDEX_DDL = "page_id long, url string, archive string, offset long, length long, payload_digest string"


def record_urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode()]
    head += [f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in fields.items() if v is not None]
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    common = {"WARC-Record-ID": record_urn(page_id), "WARC-Date": DATE, "WARC-Target-URI": _clean(url), "WARC-Payload-Digest": "sha1:" + digest, "X-Page-ID": page_id, "X-Payload-Bytes": len(payload)}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if revisit:
        more = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_urn(refers_to), "X-Refers-To-Page-ID": refers_to, "Content-Type": "application/http; msgtype=response"}
        return record("revisit", common | more, http)
    return record("response", common | {"Content-Type": "application/http; msgtype=response"}, http + payload)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b": ")
        fields[k.decode().lower()] = v.decode("utf-8", "surrogatepass")
    return fields, rest[: int(fields["content-length"])]


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to, revisit): which rows only refer to another row's equal payload."""
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("html")).withColumn("_d", F.sha1("html"))
    same = p.where(F.octet_length("html") >= least).groupBy("_d").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    same = stage(same.select("_d", "refers_to"), "equal-payloads")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return p.join(same, "_d", "left").select("page_id", "url", "html", "refers_to", revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Write the archives of ``pages`` (page_id, url, html) under ``folder`` and return the stable index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        name = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, at = None, 0
        try:
            for b in batches:
                rows = []
                for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(name, compression=None)
                        info = member(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                        out.write(info)
                        at = len(info)
                    payload = html.encode("utf-8", "surrogatepass")
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    data = member(page_record(page_id, url, payload, digest, refers_to, revisit))
                    out.write(data)
                    rows.append((page_id, url, name, at, len(data), digest))
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), INDEX.types, strict=True)], schema=INDEX)
        finally:
            if out is not None:
                out.close()

    return stage(with_revisits(pages, least).mapInArrow(run, INDEX_DDL), "warc-index")


def ranges(offsets: list[int], lengths: list[int], gap: int = GAP, most: int = READ) -> list[tuple[int, int, int, int]]:
    """(first, after last, start, end): runs of sorted records that one read fetches."""
    out: list[list[int]] = []
    for i, (o, n) in enumerate(zip(offsets, lengths, strict=True)):
        if out and o - out[-1][3] <= gap and max(o + n, out[-1][3]) - out[-1][2] <= most:
            out[-1][1], out[-1][3] = i + 1, max(out[-1][3], o + n)
        else:
            out.append([i, i + 1, o, o + n])
    return [tuple(x) for x in out]


def read_records(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    Digest and size of responses are computed again from the stored payload.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.string())] if payloads else [])])
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload string" if payloads else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        name, source = None, None
        try:
            for b in batches:
                archive, offset, length = (c.to_pylist() for c in b.columns)
                rows, i = [], 0
                while i < len(archive):
                    j = i
                    while j < len(archive) and archive[j] == archive[i]:
                        j += 1
                    if archive[i] != name:
                        if source is not None:
                            source.close()
                        name, source = archive[i], store.open_input_file(archive[i])
                    for a, z, start, end in ranges(offset[i:j], length[i:j]):
                        data = source.read_at(end - start, start)
                        for k in range(i + a, i + z):
                            fields, block = parse(zlib.decompress(data[offset[k] - start : offset[k] - start + length[k]], 31))
                            kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-bytes"])
                            payload = block.partition(b"\r\n\r\n")[2]
                            if kind == "response":
                                size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            page, ref = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                            row = (None if page is None else int(page), fields["warc-target-uri"], size, digest, kind, None if ref is None else int(ref))
                            rows.append((*row, payload.decode("utf-8", "replace") if kind == "response" else None) if payloads else row)
                    i = j
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        finally:
            if source is not None:
                source.close()

    # Tasks by the bytes of the archives, not by those of the index rows: contiguous ranges of them, in order.
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-size // TASK_BYTES), min(2 * index.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_TASK_BYTES)))
    dealt = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, ddl)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    folder = qualified(spark, new_path(spark, "warc"))
    return read_records(write_archives(read_table(spark, sf_dir, "pages"), folder), folder).drop("url")


OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, unhex(sha1(html)) AS raw, min(page_id) OVER (PARTITION BY sha1(html)) AS first_id FROM p),
bits AS (SELECT *, bit_string AS b FROM (SELECT *, CAST(raw AS BIT)::VARCHAR AS bit_string FROM d))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(b, CAST(5 * i + j + 1 AS INTEGER), 1) AS INTEGER) * (16 >> CAST(j AS INTEGER)))) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to
FROM bits
"""
