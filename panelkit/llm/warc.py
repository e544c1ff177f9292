"""WARC archives as a Spark data source (format ``warc``): write with one record per row, read headers first.

Reading: one partition is one or more whole archive files. Each record's
headers are parsed first; predicates on ``record_type`` and on equality of
other header columns are pushed down and decided there, and an unwanted
payload is skipped by its length. In plain files a skip is a seek. In ``.gz``
files each record is a gzip member of its own that names its length in the
``sl`` (skip lengths) extra field; a skip then leaves the rest of the member
packed and goes on at the next one. Members without that field (other writers)
are inflated to their ends.

Writing: each task writes files of its own and names them to the driver, which
lists the files of successful tasks in a manifest. Files of lost or repeated
tasks are in no manifest and are not read. Paths can be in any store that
pyarrow opens (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage)

SCHEMA = ("record_id string, record_type string, target_uri string, date string, refers_to string, "
          "payload_digest string, payload_bytes long, payload binary")
HEADER_SCHEMA = SCHEMA.rpartition(", payload ")[0]  # all but the payload
HEADER_COLUMNS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
                  "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "date": "warc-date"}
MANIFEST = "_warc_files-"
FILE_BYTES = 256 << 20
PLAN_BYTES = 128 << 20
HTTP_BYTES = 256  # an HTTP header is read in steps of this size
VERSION = b"WARC/1.1\r\n"
DATE = "1970-01-01T00:00:00Z"  # a fixed date keeps archives equal from run to run
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str):
    """The store of a path, and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + (path[5:] if path.startswith("file:") else path))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean_uri(uri: str) -> str:
    """A header value may hold no control characters or white space; those are percent-encoded."""
    return "".join(ch if ch > " " and ch != "\x7f" else "".join(f"%{b:02X}" for b in ch.encode()) for ch in uri)


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One response record, or with ``refers_to`` a revisit record, which has the HTTP header but no payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {clean_uri(uri)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("compress", "false") == "true")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.wanted = path, columns, []

    def pushFilters(self, filters: list[Filter]):
        """Take equality and IN predicates on header columns; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADER_COLUMNS and isinstance(f, EqualTo):
                self.wanted.append((column, {f.value}))
            elif column in HEADER_COLUMNS and isinstance(f, In):
                self.wanted.append((column, set(f.value)))
            elif column in HEADER_COLUMNS and isinstance(f, IsNotNull):
                self.wanted.append((column, None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """The manifests' files, or all archives of a folder without a manifest, packed to about PLAN_BYTES."""
        from pyarrow import fs

        store, root = filesystem(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root))
        manifests = [f for f in found if f.base_name.startswith(MANIFEST)]
        if manifests:
            names = set()
            for m in manifests:
                with store.open_input_stream(m.path) as f:
                    names |= set(json.loads(f.readall()))
            found = [f for f in found if f.base_name in names]
        else:
            found = [f for f in found if f.base_name.endswith((".warc", ".warc.gz"))]
        plan, packed = [], 0
        for f in sorted(found, key=lambda f: f.path):
            if not plan or packed + f.size > PLAN_BYTES:
                plan.append(Files([]))
                packed = 0
            plan[-1].paths.append(f.path)
            packed += f.size
        return plan

    def read(self, partition: Files | None) -> Iterator[tuple]:
        if partition is None:
            return
        store, _ = filesystem(self.path)
        for path in partition.paths:
            if path.endswith(".gz"):
                with store.open_input_file(path) as raw:
                    f = Members(raw)
                    yield from self._records(f, f.skip)
            else:
                with store.open_input_file(path) as raw:
                    f = Lines(raw)
                    yield from self._records(f, f.skip)

    def _records(self, f, skip) -> Iterator[tuple]:
        while True:
            line = f.readline()
            while line in (b"\r\n", b"\n"):
                line = f.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            head = _headers(f)
            length = int(head.get("content-length", 0))
            row = {c: head.get(k) for c, k in HEADER_COLUMNS.items()}
            for c in ("record_id", "refers_to"):
                row[c] = row[c][1:-1] if row[c] and row[c].startswith("<") else row[c]
            if row["payload_digest"]:
                row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
            if any(row[c] is None or values is not None and row[c] not in values for c, values in self.wanted):
                skip(length)
                continue
            row["payload_bytes"], row["payload"] = length, None
            http = head.get("content-type", "").startswith("application/http")
            body = f.read(min(length, HTTP_BYTES)) if http else b""
            while http and b"\r\n\r\n" not in body and len(body) < length:
                body += f.read(min(length - len(body), HTTP_BYTES))
            inner, _, start = body.partition(b"\r\n\r\n") if http else (b"", b"", b"")
            for x in inner.split(b"\r\n"):
                if x.lower().startswith(b"content-length:"):
                    row["payload_bytes"] = int(x.partition(b":")[2])
            if "payload" in self.columns and row["record_type"] != "revisit":
                row["payload"] = start + f.read(length - len(body))
            else:
                skip(length - len(body))
            yield tuple(row[c] for c in self.columns)


class Lines:
    """A seekable file with buffered lines; a skip beyond the buffer is a seek."""

    def __init__(self, raw, ahead: int = 1 << 16):
        self.raw, self.ahead, self.buffer, self.at = raw, ahead, b"", 0

    def _more(self) -> bool:
        new = self.raw.read(self.ahead)
        self.buffer, self.at = self.buffer[self.at:] + new, 0
        return bool(new)

    def readline(self) -> bytes:
        end = self.buffer.find(b"\n", self.at)
        while end < 0 and self._more():
            end = self.buffer.find(b"\n", self.at)
        end = len(self.buffer) if end < 0 else end + 1
        line, self.at = self.buffer[self.at:end], end
        return line

    def read(self, n: int) -> bytes:
        out = self.buffer[self.at:self.at + n]
        self.at += len(out)
        return out if len(out) == n else out + self.raw.read(n - len(out))

    def skip(self, n: int) -> None:
        held = len(self.buffer) - self.at
        if n <= held:
            self.at += n
        else:
            self.raw.seek(self.raw.tell() + n - held)
            self.buffer, self.at = b"", 0


def member(data: bytes) -> bytes:
    """One gzip member with its packed and unpacked lengths in the extra field ``sl``, where they fit 32 bits."""
    packed = gzip.compress(data, 6, mtime=0)
    size = len(packed) + 14
    if max(size, len(data)) >> 32:
        return packed
    # flag 4: an extra field follows the ten bytes of the plain header
    return packed[:3] + b"\x04" + packed[4:10] + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + packed[10:]


class Members:
    """A seekable file of gzip members, inflated only as far as it is read.

    A skip to the end of a member whose lengths are known is a step in the
    packed bytes (a seek beyond those held), so nothing of it is inflated.
    """

    CLOSING = 4  # the two line ends after a record's block

    def __init__(self, raw, ahead: int = 1 << 16, step: int = 1 << 10):
        self.raw, self.ahead, self.step = raw, ahead, step
        self.packed, self.inflate = b"", None
        self.buffer, self.at = b"", 0
        self.end, self.left = None, 0  # where the member ends in the file, and what it has beyond the buffer
        self.inflated = 0

    def _fill(self, n: int) -> bool:
        """Hold at least ``n`` packed bytes, if the file has them."""
        while len(self.packed) < n:
            new = self.raw.read(max(self.ahead, n - len(self.packed)))
            if not new:
                return False
            self.packed += new
        return True

    def _open(self) -> bool:
        if not self._fill(1):
            return False
        self.inflate, self.end = zlib.decompressobj(31), None
        if self._fill(12) and self.packed[3] & 4:
            extra = int.from_bytes(self.packed[10:12], "little")
            if self._fill(12 + extra):
                at, stop = 12, 12 + extra
                while at + 4 <= stop:
                    name, n = self.packed[at:at + 2], int.from_bytes(self.packed[at + 2:at + 4], "little")
                    if name == b"sl" and n == 8 and at + 12 <= stop:
                        size, self.left = struct.unpack_from("<II", self.packed, at + 4)
                        self.end = self.raw.tell() - len(self.packed) + size
                    at += 4 + n
        return True

    def _more(self, n: int) -> bool:
        """Put at most ``n`` further bytes into the buffer; False at the end of the file."""
        while True:
            if self.inflate is None and not self._open():
                return False
            data = self.inflate.decompress(self.packed, n)
            done = self.inflate.eof
            self.packed = self.inflate.unused_data if done else self.inflate.unconsumed_tail
            if done:
                self.inflate = self.end = None
            if data:
                self.buffer, self.at = self.buffer[self.at:] + data, 0
                self.left -= len(data)
                self.inflated += len(data)
                return True
            if not done and not self._fill(len(self.packed) + 1):
                raise EOFError("a gzip member ends early")

    def readline(self) -> bytes:
        end = self.buffer.find(b"\n", self.at)
        while end < 0 and self._more(self.step):
            end = self.buffer.find(b"\n", self.at)
        end = len(self.buffer) if end < 0 else end + 1
        line, self.at = self.buffer[self.at:end], end
        return line

    def read(self, n: int) -> bytes:
        out, have = [], 0
        while have < n:
            if self.at == len(self.buffer) and not self._more(min(n - have, 1 << 20)):
                break
            out.append(self.buffer[self.at:self.at + n - have])
            self.at += len(out[-1])
            have += len(out[-1])
        return b"".join(out)

    def skip(self, n: int) -> None:
        n -= len(self.buffer) - self.at
        if n <= 0:
            self.at = len(self.buffer) + n
            return
        self.buffer, self.at = b"", 0
        if self.end is not None and 0 <= self.left - n <= self.CLOSING:
            start = self.raw.tell() - len(self.packed)
            if self.end - start <= len(self.packed):
                self.packed = self.packed[self.end - start:]
            else:
                self.raw.seek(self.end)
                self.packed = b""
            self.inflate = self.end = None
            return
        while n > 0:
            n -= len(self.read(min(n, 1 << 16))) or n


def _headers(f) -> dict[str, str]:
    head: dict[str, str] = {}
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        head[name.strip().lower()] = value.strip()
    return head


class WarcWriter(DataSourceArrowWriter):
    """Rows of (record_id, target_uri, payload, refers_to); files are cut at about FILE_BYTES."""

    def __init__(self, path: str, compress: bool):
        self.path, self.compress = path, compress

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        out, paths, size = None, [], 0
        for b in batches:
            for x in zip(*[b.column(c).to_pylist() for c in ("record_id", "target_uri", "payload", "refers_to")]):
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    paths.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.compress)
                    out, size = store.open_output_stream(f"{root}/{paths[-1]}", compression=None), 0
                data = record(x[0], x[1], x[2] or b"", x[3])
                data = member(data) if self.compress else data
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([p for m in messages if m for p in m.paths]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files without a manifest are never read."""


def use(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def classify(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, payload, refers_to (null: a response): of equal payloads of at least ``min_bytes``, the smallest id responds.

    Rows that repeat the smallest id with the same payload are responses too.
    A null id is never referred to; where a payload has null ids only, all its
    rows are responses. A null html is an empty payload. The groups are only
    counted to their smallest id before the join, and a payload with one row
    has nothing to join.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumns({"d1": F.sha1("payload"), "d2": F.length("payload")})
    first = p.where(F.col("d2") >= min_bytes).groupBy("d1", "d2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").drop("n")
    joined = p.join(first, ["d1", "d2"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select("id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"))


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                compress: bool = False) -> None:
    """A record per row of ``pages``; ids become record ids ``urn:page:<id>`` (``urn:page:`` for null)."""
    use(pages.sparkSession)
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = classify(pages, min_bytes, id_col, url_col, html_col)
    rows.select(urn("id").alias("record_id"), F.col("url").cast("string").alias("target_uri"), "payload",
                F.when(F.col("refers_to").isNotNull(), urn("refers_to")).alias("refers_to")).write.format("warc").mode("append").option(
        "compress", str(compress).lower()).save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``write_pages`` with page ids again; an empty archive gives an empty result.

    Only header columns are asked for, so payloads are skipped, however long.
    """
    use(spark)
    page = lambda c: F.when(F.length(c) > 9, F.substring(c, 10, 30).cast("long"))
    r = spark.read.format("warc").schema(HEADER_SCHEMA).load(path)
    return r.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    page("refers_to").alias("refers_to"))
