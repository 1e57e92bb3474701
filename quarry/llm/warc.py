"""Legacy web archives: ARC files are read, converted to WARC, written and read back.

An ARC file opens with a version block (a filedesc record) that names the version; each record after it is one header
line, whose fields that version fixes, and as many bytes as the line's last field declares. The converter takes over
what the line says and makes what WARC wants besides: record ids (from the archive's name and the record's offset),
dates, types (response for HTTP, resource for the rest, warcinfo for the version block) and SHA-1 digests of block and
payload. Of the records with one payload (digest and length), that with the largest page id stays a response; the
others become revisits, which keep their HTTP head and name the response's id, address, date and page. Exactly one
record of a payload is its response: equal page ids are told apart by record id, null page ids come last.

Archives are files that Spark writes, one for about ARCHIVE_BYTES of records, so a task holds one archive and no more;
they may be compressed (gzip, in one member or many). Which payloads occur more than once is found on digests alone,
before any payload moves; the groups go to the records by broadcast up to BROADCAST_GROUPS of them, which is counted,
beyond that by a join on the digest. A record is taken from its archive by its declared length, so nothing in a payload
can pass for the next record's head.

Null html is an empty payload, null or empty urls are written as "-", blanks and other bytes that a header line can't
hold are percent-encoded. Repeated rows are records of their own. Headers that can't be read, dates that are none,
unknown versions, broken compression and bodies shorter than declared are rows with a problem; what follows an unknown
length in an archive can't be found and is reported as one such row. Empty tables give no records. Further columns are
not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote_from_bytes

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import application_dir, materialize, read

ARCHIVE_BYTES, BATCH_BYTES, BROADCAST_GROUPS, MIN_BYTES = 16 << 20, 8 << 20, 200_000, 0
CAPTURED = "20240101000000"
#: Fields of a header line in each version of the format.
FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "status", "checksum", "location", "offset", "filename", "length"),
}
TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "archive string, offset long, version int, record_id string, type string, date string, url string, ip string, content_type string, page_id long, payload_bytes long, payload_digest string, head binary, payload binary, problem string"
BACK = "archive string, offset long, record_id string, type string, date string, url string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, refers_to long, payload binary, problem string"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as archives write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _batches(rows: Iterator[dict], ddl: str, weight) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about BATCH_BYTES of rows."""
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in ddl.split(", "))])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + weight(row)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def _pack(pieces: Iterator[tuple[bytes, object]], frame, limit: int) -> Iterator[dict]:
    """Join records to archives of about `limit` bytes: frame(number, records) -> an archive's bytes."""
    held, size, number = [], 0, 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size >= limit:
            yield {"content": frame(number, held)}
            held, size, number = [], 0, number + 1
    if held:
        yield {"content": frame(number, held)}


def _write(archives: DataFrame, path: str, end: str) -> None:
    """One file for each row of archives(content); `end` is what the last record of an archive ends with."""
    bytes_as_text = archives.select(F.col("content").cast("string"))
    bytes_as_text.write.mode("overwrite").option("maxRecordsPerFile", 1).option("lineSep", end).option("compression", "gzip").text(path)


def _field(url: str | None) -> bytes:
    return quote_from_bytes((url or "").encode("utf-8", "replace"), safe="!#$%&'()*+,/:;=?@[]~-._").encode() or b"-"


def write_arc(pages: DataFrame, path: str, version: int | None = None, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """pages(page_id, url, html) as ARC files of one version, or of both in turn if none is given."""

    def record(page_id: int | None, url: str | None, html: bytes | None) -> tuple[bytes, bytes]:
        html = html or b""
        own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
        return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (own, len(html), html), _field(url)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def frame(number: int, records: list) -> bytes:
            v = version or 1 + (task + number) % 2
            name = f"pages-{task:06d}-{number:06d}.arc"
            about = f"{v} 0 quarry\n{TITLES[v]}\n".encode()
            size, parts = 0, []
            for body, url in [(about, f"filedesc://{name}".encode()), *records]:
                kind = b"text/plain" if not parts else b"text/html"
                if v == 1:
                    line = b" ".join((url, b"0.0.0.0", CAPTURED.encode(), kind, b"%d" % len(body)))
                else:
                    check = hashlib.md5(body).hexdigest().encode()
                    line = b" ".join((url, b"0.0.0.0", CAPTURED.encode(), kind, b"200", check, b"-", b"%d" % size, name.encode(), b"%d" % len(body)))
                parts.append(line + b"\n" + body)
                size += len(parts[-1]) + 1
            return b"\n".join(parts)

        pieces = (record(*row) for f in frames for row in zip(*(f.column(c).to_pylist() for c in ("page_id", "url", "html"))))
        yield from _batches(_pack(pieces, frame, archive_bytes), "content binary", lambda r: len(r["content"]))

    _write(pages.select("page_id", "url", F.col("html").cast("binary").alias("html")).mapInArrow(run, "content binary"), path, "\n")


def archives(spark: SparkSession, path: str) -> DataFrame:
    """The archive files under a path: path, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _stream(content: bytes) -> io.BufferedIOBase:
    plain = io.BytesIO(content or b"")
    return io.BufferedReader(gzip.GzipFile(fileobj=plain)) if plain.getvalue()[:2] == b"\x1f\x8b" else plain


def _take(stream: io.BufferedIOBase, n: int) -> bytes:
    """Up to n bytes, fewer only at the end."""
    parts = []
    while n > 0 and (part := stream.read(min(n, 1 << 20))):
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """A stored HTTP response's head (with the empty line) and payload; no head if it is none."""
    if body.startswith(b"HTTP/"):
        m = re.search(rb"\r?\n\r?\n", body)
        if m:
            return body[: m.end()], body[m.end() :]
    return b"", body


def http_field(head: bytes, name: str) -> str | None:
    for line in head.splitlines()[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.encode():
            return value.strip().decode("utf-8", "replace")
    return None


def _page(head: bytes) -> int | None:
    value = http_field(head, "x-page-id")
    return int(value) if value and re.fullmatch(r"-?[0-9]{1,19}", value) and -(1 << 63) <= int(value) < 1 << 63 else None


def record_id(archive: str, offset: int) -> str:
    """The same id for the same place, whenever it is made."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{archive}@{offset}'.encode()).digest()[:16], version=5)}"


def _iso(date: str) -> str | None:
    if not re.fullmatch(r"[0-9]{12}|[0-9]{14}", date):
        return None
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def parse_arc(archive: str, content: bytes) -> Iterator[dict]:
    """The records of one ARC file in order, the version block among them as warcinfo."""
    stream, at, version = _stream(content), 0, 0
    try:
        while line := stream.readline():
            start, at = at, at + len(line)
            if not line.strip():
                continue  # what stands between records
            row = {"archive": archive, "offset": start, "version": version, "record_id": record_id(archive, start), "type": None}
            info = line.startswith(b"filedesc://")
            names = FIELDS.get(version) if not info else None
            fields = line.rstrip(b"\r\n").rsplit(b" ", len(names) - 1) if names else line.split()
            if not fields[-1].isdigit():
                yield row | {"problem": "header without a length"}
                return
            size = int(fields[-1])
            body = _take(stream, size)
            at += len(body)
            if len(body) < size:
                row["problem"] = f"body of {len(body)} bytes, {size} declared"
            if info:
                told = body.split(None, 1)[0] if body.split() else b""
                version = row["version"] = int(told) if told.isdigit() and len(told) < 4 else 0
                if version not in FIELDS:
                    row.setdefault("problem", f"unknown version {told[:20].decode('latin-1')}")
                yield row | {"type": "warcinfo", "head": b"", "payload": body, "payload_bytes": len(body), "payload_digest": digest(body), "content_type": "text/plain", "date": _iso(fields[2].decode("latin-1")) if len(fields) > 2 else None}
                continue
            if names is None or len(fields) != len(names):
                yield row | {"problem": f"{len(fields)} header fields in version {version}"}
                continue
            told = {n: f.decode("utf-8", "replace") for n, f in zip(names, fields)}
            head, payload = split_http(body)
            date = _iso(told["date"])
            if date is None:
                row.setdefault("problem", "no date")
            yield row | {
                "type": "response" if head else "resource", "date": date, "url": told["url"], "ip": told["ip"], "content_type": told["content_type"], "page_id": _page(head),
                "payload_bytes": len(payload), "payload_digest": digest(payload), "head": head, "payload": payload,
            }
    except (EOFError, OSError, zlib.error) as e:
        yield {"archive": archive, "offset": at, "record_id": record_id(archive, at), "problem": f"broken compression: {e}"[:200]}


def _rows(parse, ddl: str, bodies: bool):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for f in frames:
                for path, content in zip(f.column("path"), f.column("content")):
                    for row in parse(path.as_py().rsplit("/", 1)[-1], content.as_py()):
                        yield row if bodies else row | {"head": None, "payload": None}

        yield from _batches(rows(), ddl, lambda r: len(r.get("payload") or b"") + len(r.get("head") or b""))

    return run


def read_arc(files: DataFrame, bodies: bool = True) -> DataFrame:
    """files(path, content) -> a row for each record; without bodies, head and payload are null (digests are not)."""
    return files.mapInArrow(_rows(parse_arc, RECORD, bodies), RECORD)


def revisited(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Payloads that several records hold -> payload_digest, payload_bytes, first (the record that is the response)."""
    held = records.filter(F.col("problem").isNull() & F.col("type").isin("response", "resource") & (F.col("payload_bytes") >= min_bytes))
    first = F.max(F.struct(F.col("page_id").isNotNull().alias("has_page"), "page_id", "record_id", "url", "date")).alias("first")
    return held.groupBy("payload_digest", "payload_bytes").agg(first, F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")


def convert(files: DataFrame, min_bytes: int = MIN_BYTES, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """ARC files(path, content) -> the records of read_arc plus first: the response that a revisit refers to, else null."""
    groups = materialize(revisited(read_arc(files, bodies=False), min_bytes))
    small = groups.count() <= broadcast_groups
    records = read_arc(files).join(F.broadcast(groups) if small else groups, ["payload_digest", "payload_bytes"], "left")
    other = F.col("first").isNotNull() & (F.col("first.record_id") != F.col("record_id")) & F.col("type").isin("response", "resource") & F.col("problem").isNull()
    records = records.withColumn("first", F.when(other, F.col("first")))
    return records.withColumn("type", F.when(F.col("first").isNotNull(), F.lit("revisit")).otherwise(F.col("type")))


def warc_record(row: dict) -> bytes:
    """One record without the four bytes that end it."""
    revisit, head, payload = row["type"] == "revisit", row["head"] or b"", row["payload"] or b""
    block = head if revisit else head + payload
    kind = "application/warc-fields" if row["type"] == "warcinfo" else "application/http; msgtype=response" if head else row["content_type"] or "application/octet-stream"
    lines = [
        "WARC/1.1", f"WARC-Type: {row['type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row['date'] or '1970-01-01T00:00:00Z'}",
        f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Type: {kind}", f"Content-Length: {len(block)}",
    ]
    if row["type"] == "warcinfo":
        lines.append(f"WARC-Filename: {row['archive']}")
    else:
        lines += [f"WARC-Target-URI: {row['url']}", f"WARC-IP-Address: {row['ip']}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    if row["page_id"] is not None:
        lines.append(f"X-Page-Id: {row['page_id']}")
    if revisit:
        first = row["first"]
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{first['record_id']}>", f"WARC-Refers-To-Target-URI: {first['url']}", f"WARC-Refers-To-Date: {first['date']}"]
        if first["page_id"] is not None:
            lines.append(f"X-Refers-To-Page-Id: {first['page_id']}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace") + block


def write_warc(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Records of convert() without a problem as WARC files."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((warc_record({n: c.as_py() for n, c in zip(f.schema.names, values)}), None) for f in frames for values in zip(*f.columns))
        packed = _pack(pieces, lambda number, held: b"\r\n\r\n".join(p for p, _ in held), archive_bytes)
        yield from _batches(packed, "content binary", lambda r: len(r["content"]))

    _write(records.filter("problem IS NULL").mapInArrow(run, "content binary"), path, "\r\n\r\n")


def parse_warc(archive: str, content: bytes) -> Iterator[dict]:
    """The records of one WARC file in order. Digests of responses are made anew and compared with what is written."""
    stream, at = _stream(content), 0
    try:
        while line := stream.readline():
            start, at = at, at + len(line)
            if not line.strip():
                continue
            row = {"archive": archive, "offset": start}
            fields: dict[str, str] = {}
            good = line.startswith(b"WARC/")
            while good and (line := stream.readline()).strip():
                at += len(line)
                key, _, value = line.partition(b":")
                fields[key.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
            at += len(line) if good else 0
            size = fields.get("content-length", "")
            if not size.isdigit():
                yield row | {"problem": "header without a length"}
                return
            block = _take(stream, int(size))
            at += len(block)
            head, payload = split_http(block)
            kind, told = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
            page, first = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
            row |= {
                "type": kind, "record_id": fields.get("warc-record-id", "").strip("<>"), "date": fields.get("warc-date"), "url": fields.get("warc-target-uri"), "page_id": int(page) if page else None,
                "refers_to_id": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "refers_to": int(first) if first else None,
            }
            if len(block) < int(size):
                row["problem"] = f"block of {len(block)} bytes, {size} declared"
            if kind == "revisit":
                yield row | {"payload_bytes": int(fields["x-payload-length"]) if "x-payload-length" in fields else None, "payload_digest": told}
                continue
            made = digest(payload)
            if told and told != made:
                row.setdefault("problem", "payload digest differs")
            yield row | {"payload_bytes": len(payload), "payload_digest": made, "payload": payload}
    except (EOFError, OSError, zlib.error) as e:
        yield {"archive": archive, "offset": at, "problem": f"broken compression: {e}"[:200]}


def read_warc(files: DataFrame, bodies: bool = True) -> DataFrame:
    """files(path, content) -> a row for each record."""
    run = _rows(parse_warc, BACK, bodies)
    return files.mapInArrow(lambda frames: (b.select([c.split()[0] for c in BACK.split(", ")]) for b in run(frames)), BACK)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as ARC files of both versions, converted, written as WARC files and read back."""
    old, new = (f"{application_dir(spark)}/{uuid.uuid4().hex}-{kind}" for kind in ("arc", "warc"))
    write_arc(read(spark, sf_dir, "pages"), old)
    write_warc(convert(archives(spark, old)), new)
    back = read_warc(archives(spark, new), bodies=False).filter("type <> 'warcinfo'")
    return back.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def oracle_sql() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex,
    row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST) AS place, max(page_id) OVER (PARTITION BY body) AS first_page
  FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN first_page END AS refers_to
FROM d"""
