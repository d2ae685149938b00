"""WARC archives with revisit records, and a salvage reader.

Writer: one record per page, each a gzip member of its own, one archive per task (temporary
name, then renamed, so a repeated task replaces its archive). Of pages with equal payloads of at
least ``min_revisit_bytes`` the one with the smallest id is a response, the others are revisit
records that refer to it; rows that repeat the response's id are responses too. A null id is
never the smallest unless a payload has no other.

Reader: each member (or plain record) is checked: inflation and its checksum, the version line,
named fields, content length, block digest and payload digest. After a failed check the reader
searches byte by byte for the next start that passes all checks, a gzip member or a plain
version line, goes on from there, and logs the bytes between as a quarantined gap.

Null payloads are empty, null URLs become ``about:blank``. Empty tables write no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import open_fs, stored, text_bytes

DATE = "2000-01-01T00:00:00Z"      # records carry no crawl time here: one fixed date keeps archives reproducible
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 16
BLOCK = 1 << 22


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One plain WARC record; a revisit keeps the HTTP head only, whose length is the payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"),
              ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"),
              ("WARC-Date", DATE),
              ("WARC-Target-URI", quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~")),
              ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
              ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


MANIFEST = "file string, records long, bytes long"


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_revisit_bytes: int = 0, level: int = 3) -> DataFrame:
    """Write the archives under ``folder``; returns the stored manifest (file, records, bytes)."""
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text_bytes(payload_col).alias("payload"))
    src = src.withColumn("key", F.unhex(F.sha2("payload", 256)))
    first = src.groupBy("key").agg(F.min("id").alias("first"))
    same = F.col("first").isNull() | F.col("id").eqNullSafe(F.col("first")) | (F.length("payload") < min_revisit_bytes)
    rows = src.join(first, "key").select("id", "url", "payload", "first", (~same).alias("revisit"))

    def run(batches):
        fs, root = open_fs(folder)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        temp = f"{root}/.{uuid.uuid4().hex}.tmp"
        out, n, size = None, 0, 0
        for b in batches:
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(temp)
            for row in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "first", "revisit"))):
                size += out.write(zlib.compress(record(*row), level, wbits=31))
                n += 1
        if out is not None:
            out.close()
            fs.move(temp, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

    return stored(rows.mapInArrow(run, MANIFEST), "warc-manifest")


class Broken(ValueError):
    """A start that does not hold a valid record."""


class _File:
    """Reads by position through one buffered block."""

    def __init__(self, handle):
        self.handle, self.size = handle, handle.size()
        self.at, self.data = 0, b""

    def get(self, offset: int, n: int) -> bytes:
        n = min(n, self.size - offset)
        if n <= 0:
            return b""
        if not (self.at <= offset and offset + n <= self.at + len(self.data)):
            self.at, self.data = offset, self.handle.read_at(min(max(n, BLOCK), self.size - offset), offset)
        return self.data[offset - self.at:offset - self.at + n]


def _parse_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise Broken("version line")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise Broken("named field")
        out[name.strip().lower()] = value.strip()
    return out


def _check(data: bytes) -> dict:
    """A whole plain record to its fields; raises Broken when a check fails."""
    cut = data.find(b"\r\n\r\n")
    if cut < 0:
        raise Broken("header end")
    try:
        fields = _parse_fields(data[:cut])
        length = int(fields["content-length"])
        kind = fields["warc-type"]
    except (KeyError, ValueError) as e:
        raise e if isinstance(e, Broken) else Broken("header fields") from e
    block, tail = data[cut + 4:cut + 4 + length], data[cut + 4 + length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise Broken("content length")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise Broken("block digest")
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    size = len(payload)
    if kind == "revisit":
        sizes = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(sizes[0]) if sizes and sizes[0].isdigit() else None
    elif "warc-payload-digest" in fields and fields["warc-payload-digest"] != f"sha1:{digest(payload)}":
        raise Broken("payload digest")
    return {"type": kind, "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
            "payload_digest": fields.get("warc-payload-digest", f"sha1:{digest(payload)}").removeprefix("sha1:"), "payload_bytes": size, "payload": payload}


def _member(f: _File, at: int) -> tuple[dict, int]:
    """The record of the gzip member at ``at`` and the member's end."""
    inflate, out, pos = zlib.decompressobj(wbits=31), [], at
    while not inflate.eof:
        data = f.get(pos, READ)
        if not data:
            raise Broken("truncated member")
        try:
            out.append(inflate.decompress(data))
        except zlib.error as e:
            raise Broken("damaged member") from e
        if len(out) == 1 and not b"WARC/1."[:len(out[0])] == out[0][:7]:
            raise Broken("version line")
        pos += len(data)
    return _check(b"".join(out)), pos - len(inflate.unused_data)


def _plain(f: _File, at: int) -> tuple[dict, int]:
    """The plain record at ``at`` and its end."""
    head, pos = b"", at
    while b"\r\n\r\n" not in head:
        data = f.get(pos, READ)
        if not data or len(head) > 1 << 20:
            raise Broken("header end")
        head += data
        pos += len(data)
    head = head[:head.index(b"\r\n\r\n")]
    try:
        length = int(_parse_fields(head)["content-length"])
    except (KeyError, ValueError) as e:
        raise Broken("header fields") from e
    end = at + len(head) + 4 + length + 4
    if length < 0 or end > f.size:
        raise Broken("truncated record")
    return _check(f.get(at, end - at)), end


def _record(f: _File, at: int) -> tuple[dict, int]:
    start = f.get(at, 7)
    if start[:3] == b"\x1f\x8b\x08":
        return _member(f, at)
    if start == b"WARC/1.":
        return _plain(f, at)
    raise Broken("no record start")


def _next_start(f: _File, at: int) -> int:
    """The next place, ``at`` or later, that looks like a member or a version line; else the end."""
    while at < f.size:
        data = f.get(at, BLOCK)
        found = [x for x in (data.find(b"\x1f\x8b\x08"), data.find(b"WARC/1.")) if x >= 0]
        if found:
            return at + min(found)
        if at + len(data) >= f.size:
            break
        at += len(data) - 6
    return f.size


def salvage(handle) -> Iterator[tuple[str, int, int, dict | str]]:
    """("record", start, end, fields) and ("gap", start, end, reason) over a whole archive, in order;
    together they cover every byte once."""
    f = _File(handle)
    at, bad, why = 0, None, ""
    while at < f.size:
        try:
            fields, end = _record(f, at)
        except Broken as e:
            if bad is None:
                bad, why = at, str(e)
            at = _next_start(f, at + 1)
            continue
        if bad is not None:
            yield "gap", bad, at, why
            bad = None
        yield "record", at, end, fields
        at = end
    if bad is not None:
        yield "gap", bad, f.size, why


RECORDS = ("file string, kind string, start long, end long, reason string, type string, record_id string, uri string, "
           "refers_to string, payload_digest string, payload_bytes long")
_FIELDS = ("type", "record_id", "uri", "refers_to", "payload_digest", "payload_bytes")


def read(manifest: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """Every record (kind ``record``) and quarantined gap (kind ``gap``, with its reason) of the
    archives that ``manifest.file`` names."""
    schema = RECORDS + (", payload binary" if keep_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if n in ("start", "end", "payload_bytes") else pa.binary() if n == "payload" else pa.string() for n in names]
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        fs, _ = open_fs(folder)
        for b in batches:
            for file in b.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_file(file) as handle:
                    for kind, start, end, x in salvage(handle):
                        got = x if kind == "record" else {}
                        rows.append((file, kind, start, end, None if kind == "record" else x, *(got.get(k) for k in _FIELDS))
                                    + ((got.get("payload"),) if keep_payload else ()))
                        held += end - start
                        if len(rows) >= 2000 or held >= BLOCK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return manifest.select("file").repartition(n, "file").mapInArrow(run, schema)


def page_number(col: str):
    """The id inside a record URN, null for pages without one."""
    return F.regexp_extract(F.coalesce(F.col(col), F.lit("")), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
