"""WARC records in ZIP-packaged archives: writing them, and reading records by range without extraction.

An archive is a ZIP whose members are stored, not compressed: one WARC of
gzip members (one per record) and a CDX-J style index of where each record
lies.  The reader parses the end record, the ZIP64 one, the central directory
and the local header, and then reads byte ranges of the archive file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import new_path, written

RECORDS = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
_END, _END64, _AT64, _CENTRAL, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_M32, _M16 = 0xFFFFFFFF, 0xFFFF
_WHEN = "2024-01-01T00:00:00Z"


class Member(NamedTuple):
    name: str
    method: int
    size: int
    crc: int
    header: int
    data: int


class ZipWriter:
    """Stored members one after another; sizes and places over 32 bits go to ZIP64 fields, as with force64."""

    def __init__(self, out: BinaryIO, force64: bool = False) -> None:
        self.out, self.at, self.done, self.force64 = out, 0, [], force64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, big = name.encode(), zlib.crc32(data), self.force64 or len(data) >= _M32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        size = _M32 if big else len(data)
        header = self.at
        self._put(struct.pack("<4sHHHHHIIIHH", _LOCAL, 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.done.append((raw, crc, len(data), header))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, header in self.done:
            wide = [v for v in (size, size, header) if self.force64 or v >= _M32]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            s, h = (_M32 if self.force64 or v >= _M32 else v for v in (size, header))
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, h) + raw + extra)
        n, size = len(self.done), self.at - start
        if self.force64 or n >= _M16 or start >= _M32 or size >= _M32:
            end64 = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<4sIQI", _AT64, 0, end64, 1))
        n, size, start = (m if self.force64 else min(v, m) for v, m in ((n, _M16), (size, _M32), (start, _M32)))
        self._put(struct.pack("<4sHHHHIIH", _END, 0, 0, n, n, size, start, 0))


class ZipReader:
    """Members of a ZIP file that can seek; only directories are read until a range is asked for."""

    def __init__(self, file: BinaryIO) -> None:
        self.file = file
        self.size = file.seek(0, 2)
        tail_at = max(0, self.size - 22 - _M16)
        tail = self._read(tail_at, self.size - tail_at)
        end = tail.rfind(_END)
        if end < 0:
            raise ValueError("not a ZIP file: no end of central directory")
        n, size, start = struct.unpack_from("<HII", tail, end + 10)
        if _M16 == n or _M32 in (size, start):
            mark, _, end64, _ = struct.unpack("<4sIQI", self._read(tail_at + end - 20, 20))
            if mark != _AT64:
                raise ValueError("ZIP64 locator is missing")
            head = self._read(end64, 56)
            if head[:4] != _END64:
                raise ValueError("ZIP64 end record is missing")
            n, size, start = struct.unpack_from("<QQQ", head, 32)
        self.members = self._central(self._read(start, size), n)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(n)
        if len(out) != n:
            raise ValueError("ZIP file is cut short")
        return out

    def _central(self, raw: bytes, n: int) -> dict[str, Member]:
        out, at = {}, 0
        for _ in range(n):
            mark, _, _, _, method, _, _, crc, packed, size, n_name, n_extra, n_note, _, _, _, header = struct.unpack_from("<4sHHHHHHIIIHHHHHII", raw, at)
            if mark != _CENTRAL:
                raise ValueError("central directory is damaged")
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            at += 46 + n_name + n_extra + n_note
            k = 0
            while k + 4 <= len(extra):
                tag, length = struct.unpack_from("<HH", extra, k)
                if tag == 1:  # in this order, and only what the short fields can't hold
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, k + 4))
                    size, packed, header = (next(wide) if v == _M32 else v for v in (size, packed, header))
                k += 4 + length
            out[name] = Member(name, method, size, crc, header, -1)
        return out

    def locate(self, name: str) -> Member:
        """With where the member's bytes begin, which only its local header tells."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = self._read(m.header, 30)
        if head[:4] != _LOCAL:
            raise ValueError("local header is damaged")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return m._replace(data=m.header + 30 + n_name + n_extra)

    def range(self, member: Member, start: int, n: int) -> bytes:
        if start < 0 or start + n > member.size:
            raise ValueError("range lies outside the member")
        return self._read(member.data + start, n)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(url: str, page: int, payload: bytes, sha: str, refers: int | None) -> bytes:
    """A response with its payload, or a revisit that has its HTTP head alone (whose Content-Length is the full payload's)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers is None else http
    kind = "response" if refers is None else "revisit"
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {_WHEN}", f"WARC-Payload-Digest: sha1:{sha}"]
    head += [f"WARC-Target-URI: {''.join(url.split())}"] if url else []
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write pages (page_id, url, html, payload_digest, refers_to) as archives below folder; a row per archive: uri.

    A task that is run again writes other files; only those that its
    successful attempt returned are listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        stem, n = f"{base}/part-{task.partitionId()}-{task.taskAttemptId()}", 0
        body, index = bytearray(), []

        def flush() -> str:
            nonlocal n, body, index
            path = f"{stem}-{n}.wacz"
            with store.open_output_stream(path) as out:
                z = ZipWriter(out)
                z.add(RECORDS, bytes(body))
                z.add(INDEX, "".join(f"{json.dumps(x)}\n" for x in index).encode())
                z.close()
            n, body, index = n + 1, bytearray(), []
            return path

        paths = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    page, payload = r["page_id"], (r["html"] or "").encode()
                    packed = gzip.compress(record(r["url"] or "", page, payload, r["payload_digest"], r["refers_to"]), 1, mtime=0)
                    index.append({"offset": len(body), "length": len(packed)})
                    body += packed
                    if len(body) >= archive_bytes:
                        paths.append(flush())
        if index:
            paths.append(flush())
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return pages.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(run, "path string")


FIELDS = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, url string, payload binary"


def read_archives(archives: DataFrame, folder: str, payloads: bool = True, chunk: int = 4 << 20) -> DataFrame:
    """Records of archives (path), read by range through each one's index; a damaged payload raises."""

    def page(text: str | None) -> int | None:
        number = (text or "").strip("<>").rpartition(":")[2]
        return int(number) if number not in ("", "None") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(folder)
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_file(path) as file:
                    z = ZipReader(file)
                    where, data = z.locate(INDEX), z.locate(RECORDS)
                    index = [json.loads(x) for x in z.range(where, 0, where.size).splitlines()]
                    rows, held = [], 0
                    for entry in index:
                        fields, block = parse(gzip.decompress(z.range(data, entry["offset"], entry["length"])))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(next(x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                        sha, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                        if kind == "response" and digest(payload) != sha:
                            raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
                        rows.append((page(fields["warc-record-id"]), kind, sha, size, page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), payload if payloads and kind == "response" else None))
                        held += len(payload)
                        if held >= chunk or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.mapInArrow(run, FIELDS)


def plan_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with payload_digest and refers_to: of equal payloads of min_bytes or more, that of the largest page_id is the response.

    Group sizes don't matter: only (digest, page_id) is shuffled, and the
    largest is found by partial aggregates.  Rows without a page_id are responses.
    """
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.sha1(F.encode(html, "UTF-8")).alias("sha"), F.octet_length(html).alias("n"))
    # Only digests that occur more than once can make revisits.
    firsts = keyed.filter((F.col("n") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    # Written first, so that both sides of the join are plain exchanges and a hot digest's rows can be split.
    out = keyed.join(written(pages.sparkSession, firsts.select("sha", "keeper"), "keepers"), "sha", "left")
    refers = F.when((F.col("n") >= min_bytes) & (F.col("page_id") < F.col("keeper")), F.col("keeper"))
    return out.select("page_id", "url", "html", "sha", refers.alias("refers_to"))


def base32(hexadecimal):
    """Upper-case base32 of a column of 40 hexadecimal digits: five of them are four characters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for k in range(0, 40, 5):
        v = F.conv(F.substring(hexadecimal, k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(letters), F.shiftright(v, s).bitwiseAND(F.lit(31)) + F.lit(1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def archive(pages: DataFrame, min_bytes: int = 0, folder: str | None = None, payloads: bool = True) -> DataFrame:
    """Write a record per row of pages (page_id, url, html, ...) into archives and return them as read back.

    Null html is an empty payload, a null url leaves out the target, other
    columns are ignored, an empty table writes nothing.  Repeated page_ids are
    each a record.  A null page_id is a response that none refers to.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "archives")
    planned = plan_revisits(pages, min_bytes).withColumn("payload_digest", base32(F.col("sha")))
    listed = folder + "-list"
    write_archives(planned, folder).write.parquet(listed)
    archives = spark.read.schema("path string").parquet(listed)
    return read_archives(archives.repartition(max(1, spark.sparkContext.defaultParallelism * 4)), folder, payloads)
