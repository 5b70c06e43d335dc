"""WARC archives: write records with chunked HTTP bodies and segments, read them back.

Writing: one pass over the pages makes records; a block above SEGMENT_BYTES is
split into a first record and continuations (WARC-Segment-Number, -Origin-ID,
-Total-Length). Spark's own text writer stores them, records parted by the two
line ends that the format wants, so any file system that Spark knows will do and
a lost executor's file is written again. A file holds at most FILE_RECORDS records.

Reading: a whole record is decoded where it is parsed. Only segments are
shuffled, by their origin and number; a record's block is put together, its length
verified, its chunked framing decoded and its digest compared.

Equal payloads: by digest, the smallest page id is the response. A digest of more
than a thousandth of all records is joined by broadcast (fewer than 1,000 such),
so one hot payload does not fill a task.

Nulls: a null html is an empty payload; a null url or id has no header and comes
back null; a null id never is the response of a group that has an id. Rows that
repeat the smallest id are all responses. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_hot_key, materialize, runs, shared_dir

SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 64 * 1024, 8 * 1024, 2048
EOL = b"\r\n"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in HTTP's chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x" % len(piece), EOL, piece, EOL]
    return b"".join([*parts, b"0", EOL, EOL])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped.

    Raises ValueError where the framing is broken or ends early.
    """
    parts, at = [], 0
    while True:
        end = body.index(EOL, at)
        size = int(body[at:end].split(b";", 1)[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != EOL:
            raise ValueError("chunk does not end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def _head(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in fields) + EOL


def records(page_id, url: str | None, payload: bytes, record: str, segment_bytes: int) -> Iterator[bytes]:
    """The record, or its segments, without the two line ends that close each."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    more = [("WARC-Target-URI", " ".join(url.split()))] if url else []
    more += [("X-Page-Id", str(page_id))] if page_id is not None else []
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for n, piece in enumerate(pieces, 1):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record}#{n}')}>"
        fields = [("WARC-Type", "response" if n == 1 else "continuation"), ("WARC-Record-ID", own), ("WARC-Date", "2000-01-01T00:00:00Z")]
        if n == 1:
            first = own
            fields += [*more, ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
        else:
            fields.append(("WARC-Segment-Origin-ID", first))
        if len(pieces) > 1:
            fields.append(("WARC-Segment-Number", str(n)))
            if n == len(pieces):
                fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _head([*fields, ("Content-Length", str(len(piece)))]) + piece


def _to_records(segment_bytes: int):
    def run(batches):
        task = TaskContext.get().partitionId()
        count = 0
        for batch in batches:
            out, held = [], 0
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = html.as_py()
                payload = text.encode("utf-8", "surrogatepass") if text else b""
                count += 1
                for r in records(page_id, url, payload, f"{task}/{count}", segment_bytes):
                    out.append(r)
                    held += len(r)
                if held > 8 << 20:
                    yield _as_text(out)
                    out, held = [], 0
            if out:
                yield _as_text(out)

    return run


def _as_text(rows: list[bytes]) -> pa.RecordBatch:
    """Bytes in a string column; a segment may end within a character."""
    return pa.record_batch([pa.array(rows, pa.binary()).cast(pa.string(), safe=False)], ["value"])


def write_warc(pages: DataFrame, path: str, id_col="page_id", url_col="url", html_col="html", segment_bytes=SEGMENT_BYTES, file_records=FILE_RECORDS) -> None:
    """Write a record for each row to .txt-named WARC files in the folder ``path``."""
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    rows.mapInArrow(_to_records(segment_bytes), "value string").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record in an archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = end + 4 + int(head["content-length"])
        if content[at : at + 4] != b"\r\n\r\n":
            raise ValueError("record does not end where its length says")
        yield head, content[end + 4 : at]
        at += 4


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response without its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64())])


def _whole(head: dict, block: bytes, keep: bool) -> tuple:
    payload = payload_of(block)
    digest = payload_digest(payload)
    if (said := head.get("warc-payload-digest")) and said != f"sha1:{digest}":
        raise ValueError(f"payload of {head.get('warc-record-id')} does not have its digest")
    page = head.get("x-page-id")
    return (int(page) if page is not None else None, head.get("warc-target-uri"), len(payload), digest, payload if keep else None, None, None, None)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*rows), _READ)], _READ)


def _parse_files(keep: bool):
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                out, held = [], 0
                for head, block in parse(content.as_py()):
                    if "warc-segment-number" not in head:
                        out.append(_whole(head, block, keep))
                    else:
                        n, total = int(head["warc-segment-number"]), head.get("warc-segment-total-length")
                        page = head.get("x-page-id")
                        origin = head["warc-record-id"] if n == 1 else head["warc-segment-origin-id"]
                        out.append((int(page) if page is not None else None, head.get("warc-target-uri"), None, head.get("warc-payload-digest"), block, origin, n, int(total) if total else None))
                    held += len(block)
                    if held > 8 << 20:
                        yield _rows(out)
                        out, held = [], 0
                if out:
                    yield _rows(out)

    return run


def _reassemble(keep: bool):
    def run(batches):
        for (origin,), group in runs(batches, ["origin"]):
            parts = group.sort_by("segment").to_pylist()
            # a task that ran twice may have left a segment twice; numbers must be 1..n
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                raise ValueError(f"segments of {origin} are not 1..{len(parts)}")
            block = b"".join(p["payload"] for p in parts)
            if parts[-1]["total"] != len(block):
                raise ValueError(f"{origin} has {len(block)} bytes, not {parts[-1]['total']}")
            head = {"warc-record-id": origin, "warc-payload-digest": parts[0]["payload_digest"]}
            head |= {k: str(v) for k, v in (("x-page-id", parts[0]["page_id"]), ("warc-target-uri", parts[0]["url"])) if v is not None}
            yield _rows([_whole({k: v for k, v in head.items() if v is not None}, block, keep)])

    return run


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, payload) of each record, segments joined."""
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, payload binary, origin string, segment long, total long"
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = materialize(files.mapInArrow(_parse_files(keep_payload), ddl), "warc-read")
    split = rows.filter("origin is not null").repartition("origin").sortWithinPartitions("origin", "segment")
    out = rows.filter("origin is null").unionByName(split.mapInArrow(_reassemble(keep_payload), ddl))
    return out.drop("origin", "segment", "total")


def with_revisits(recs: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds record_type and refers_to: of equal payloads the smallest page_id is the response."""
    rows = materialize(recs.select("page_id", "url", "payload_bytes", "payload_digest"), "warc-recs")
    firsts = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = materialize(firsts, "warc-firsts")
    out = join_by_hot_key(rows, firsts, "payload_digest", "n", rows.count())
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = out.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    return out.withColumn("refers_to", F.when(again, F.col("first"))).drop("first", "n")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all pages to WARC archives and back, revisits marked."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    out = with_revisits(read_warc(spark, path, keep_payload=False))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) || '0' AS hex FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i * 5 // 4 + 1)::INT, 2))::INT >> (3 - i * 5 % 4)::INT) & 31) + 1, 1)), '') AS payload_digest FROM h),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM m
"""
