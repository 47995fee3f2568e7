"""Web archives: writing them with deduplication, and reading them back with salvage.

An archive is a row (archive, content): a run of WARC records, each its own gzip
member. The reader also takes plain records and files read by Spark's binaryFile
source. After a failed check it searches for the next valid member or version
line, goes on there, and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import pick, scratch, stored, table

RECORDS = "archive string, offset long, size long, gap string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
_DATE = "2000-01-01T00:00:00Z"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC record. A revisit holds the digest and length of its payload, not the payload."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {_DATE}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        target = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {target}")
        if target != url:  # what stands there as it is, so that reading gives the same string
            head.append(f"WARC-Page-URL: {json.dumps(url)}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """The gzip member at `at`, its checksum tested, and where it ends."""
    d, out, pos = zlib.decompressobj(31), [], at
    while not d.eof:
        if pos >= len(data):
            raise ValueError("the member is cut off")
        out.append(d.decompress(data[pos : pos + 65536]))
        pos += 65536
    return b"".join(out), min(pos, len(data)) - len(d.unused_data)


class Damaged(ValueError):
    """A record whose header can be read, but whose check fails; `end` is where it says that it ends."""

    def __init__(self, why: str, end: int):
        super().__init__(why)
        self.end = end


_HEAD_END, _TAIL = re.compile(rb"\r\n\r\n|\n\n"), re.compile(rb"\r\n\r\n|\n\n")


def _parsed(data: bytes | memoryview, at: int, exact: bool) -> tuple[dict, bytes, int]:
    """Headers (names in lower case) and block of the record at `at`, tested, and where it ends. Lines end with CR LF or with LF alone."""
    found, size = None, 4096
    while found is None:
        head = bytes(data[at : at + size])
        found = _HEAD_END.search(head)
        if found is None and len(head) < size:
            raise ValueError("the header has no end")
        size *= 4
    lines = re.split("\r?\n", head[: found.start()].decode("utf-8", "strict"))
    if not lines[0].startswith("WARC/1."):
        raise ValueError("there is no version line")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    begin = at + found.end()
    block, end = bytes(data[begin : begin + length]), begin + length
    tail = _TAIL.match(bytes(data[end : end + 4]))
    if length < 0 or len(block) != length or tail is None or exact and end + tail.end() != len(data):
        raise ValueError("the length is wrong")
    if (said := fields.get("warc-block-digest", "")).startswith("sha1:") and said[5:].upper() != base32(hashlib.sha1(block).digest()):
        raise Damaged("the block digest is wrong", end + tail.end())
    return fields, block, end + tail.end()


def salvage(content: bytes) -> Iterator[tuple[int, int, str | None, dict, bytes]]:
    """(offset, size, gap, headers, block): gap is None for a record, else why its bytes are quarantined.

    A record that only its digest proves damaged is passed over whole if it ends where the archive does or another begins, so that
    a version line within its block is not taken for a record.
    """
    data, at, lost, why = memoryview(content), 0, -1, ""
    while at < len(data):
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                raw, end = _member(data, at)
                fields, block, _ = _parsed(raw, 0, True)
            else:
                fields, block, end = _parsed(data, at, False)
        except (ValueError, KeyError, zlib.error) as error:
            if lost < 0:
                lost, why = at, str(error) or type(error).__name__
            if isinstance(error, Damaged) and data[at : at + 2] != b"\x1f\x8b" and (error.end == len(data) or _START.match(content, error.end)):
                at = error.end
                continue
            found = _START.search(content, at + 1)
            at = found.start() if found else len(data)
            continue
        if lost >= 0:
            yield lost, at - lost, why, {}, b""
            lost = -1
        yield at, end - at, None, fields, block
        at = end
    if lost >= 0:
        yield lost, len(data) - lost, why, {}, b""


def _page(text: str | None) -> int | None:
    return int(m[1]) if text and (m := re.fullmatch(r"<urn:page:(-?\d+)>|(-?\d+)", text)) and m[1] else int(text) if text and re.fullmatch(r"-?\d+", text) else None


def _write(target: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, buffer, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{n:05d}.warc.gz"]), pa.array([b"".join(buffer)], pa.binary())], names=["archive", "content"])

        for b in batches:
            for page, url, payload, refers, sha in zip(*(b.column(i) for i in range(5)), strict=True):
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py(), base32(bytes.fromhex(sha.as_py())))
                buffer.append(z.compress(raw) + z.flush())
                size += len(buffer[-1])
                if size >= target:
                    yield flush()
                    n, buffer, size = n + 1, [], 0
        if buffer:
            yield flush()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for b in batches:
        for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows, held = [], 0
            for at, size, gap, fields, block in salvage(content.as_py() or b""):
                if gap is not None:
                    rows.append((name, at, size, gap, *[None] * 7))
                else:
                    kind, payload = fields.get("warc-type"), block
                    if fields.get("content-type", "").startswith("application/http"):
                        payload = block[m.end() :] if (m := _HEAD_END.search(block)) else b""
                    if kind == "revisit":
                        length, digest, payload = int(fields.get("warc-payload-length", 0)), fields.get("warc-payload-digest", "").removeprefix("sha1:"), None
                    else:
                        length, digest = len(payload), base32(hashlib.sha1(payload).digest())
                    rows.append((name, at, size, None, _page(fields.get("warc-page-id")), json.loads(fields["warc-page-url"]) if "warc-page-url" in fields else fields.get("warc-target-uri"), kind, _page(fields.get("warc-refers-to")), length, digest, payload))
                    held += len(payload or b"")
                if held > 8 << 20 or len(rows) >= 2000:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, target: int = 4 << 20, level: int = 1) -> DataFrame:
    """Archives (archive, content) of about `target` bytes with a record for each row.

    Of records with equal payloads of at least `least_bytes`, that with the
    largest id is the response and the others revisit it. Null html: an empty
    payload. Rows with a null id revisit the group's response; if all ids are
    null, or rows repeat the largest id, each such row is a response. An empty
    table gives no archives. Other columns are not read.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    src = pick(pages, id_col, url_col, html_col).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    same = src.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "last")
    # stored, so that adaptive execution can split a payload that very many pages share
    same = stored(same)
    refers = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    rows = src.join(same, "sha", "left").select("page_id", "url", "payload", refers.alias("refers_to"), "sha")
    return rows.mapInArrow(_write(target, level), "archive string, content binary")


def records(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives, and one (gap not null) for each quarantined run of bytes.

    Null and empty contents have no records; archives that repeat are each read; an empty table gives none. Other columns are not read.
    """
    return pick(archives, "archive", "content").mapInArrow(_read, RECORDS)


def logged(found: DataFrame, path: str) -> DataFrame:
    """records() without the gaps, which are written to `path` as JSON lines: archive, offset, size, gap. Lines are appended to what is there."""
    found.where("gap is not null").select("archive", "offset", "size", "gap").coalesce(1).write.mode("append").json(path)
    return found.where("gap is null").drop("gap")


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Archive files of any file system as rows for records(). A file is one value, read by one task, and so may have 2 GB at most
    (Spark's limit; it fails beyond, and names the file)."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, these stored and read back, gaps logged beside them."""
    archives = stored(archived(table(spark, sf_dir, "pages")))
    found = stored(records(archives).drop("payload"))
    return logged(found, scratch(spark)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: op3_warc in DuckDB's SQL; the digest's base 32 is put together from groups of five bits.
SQL = r"""with p as (select page_id, url, coalesce(html, '') as html from pages),
d as (select page_id, url, strlen(html) as n, sha1(html) as hex from p),
b as (select *, list_aggregate(list_transform(string_split(hex, ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), 'string_agg', '') as bits from d),
k as (select *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * cast(substr(bits, 5 * i + 1, 1) as int) + 8 * cast(substr(bits, 5 * i + 2, 1) as int)
+ 4 * cast(substr(bits, 5 * i + 3, 1) as int) + 2 * cast(substr(bits, 5 * i + 4, 1) as int) + cast(substr(bits, 5 * i + 5, 1) as int), 1)), 'string_agg', '') as digest, max(page_id) over (partition by hex) as last from b)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to, url from k"""
