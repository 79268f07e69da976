"""WARC writing and reading (operator 5).

Writer. Every page becomes one record in one gzip member. Pages with equal payloads (by SHA-1) of
at least ``min_revisit_bytes`` share one ``response``, that of the largest page id; the others are
``revisit`` records that name it. Which page is which comes from a count of digests, pre-aggregated
in each task, and is known before a record is made, so that no payload is compressed in vain. Up to
``BROADCAST_DIGESTS`` repeated digests go to all tasks, and pages are not shuffled; more meet the pages
in a join. A task writes whole archives under names that no other attempt has, and the table of
files that Spark commits tells which count: files of an attempt that was lost or beaten are never read.

Reader. One task reads an archive from front to end: a zlib stream per member, fed chunk by chunk,
header lines up to the blank line, exactly ``Content-Length`` bytes of block, the closing blank
lines. Block and payload digests are computed on the way and compared. Memory is one chunk, unless
payloads are asked for.

Defined cases. A null html is an empty payload, a null url an empty target. A null page id is
written as such and read back as null; it never is the response of a group that has another id.
Rows with equal id and payload are all responses, if their id is the largest, else all revisits;
rows of one page id share a record id. Tabs, line ends and blanks of a url become one blank.
A damaged record ends its archive with a row whose ``error`` says what was wrong. An empty table
gives no archive and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import get_file, put_file, scratch, small_batches, stored

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
CHUNK = 1 << 16
#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 1 << 26
#: Repeated digests (of some 60 bytes) that are broadcast at most.
BROADCAST_DIGESTS = 1_000_000
#: Bytes of an HTTP header at most.
MAX_HEAD = 1 << 20
_BLANKS = re.compile(r"[ \t\n\f\r]+")


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(kind: str, page_id: int | None, url: str, digest: str, size: int, block: bytes, date: str, refers_to: int | None = None) -> bytes:
    """One record as a gzip member."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_BLANKS.sub(' ', url).strip(' ')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


class Archives:
    """Writes members to numbered archives of one task, in a mounted folder or in a store."""

    def __init__(self, folder: str) -> None:
        # A name of this attempt alone: rows of a join come in any order, so a second attempt can deal
        # them out to its archives otherwise.
        self.prefix, self.n, self.held, self.size = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, [], 0

    def add(self, member: bytes) -> str | None:
        self.held.append(member)
        self.size += len(member)
        return self.close() if self.size >= ARCHIVE_BYTES else None

    def close(self) -> str | None:
        if not self.held:
            return None
        name = f"{self.prefix}-{self.n:04d}.warc.gz"
        put_file(name, b"".join(self.held))
        self.held, self.size, self.n = [], 0, self.n + 1
        return name


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, date: str = "2020-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes all pages below ``folder``; returns one row (``file``) per archive."""
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("body"))
    digests = src.select("id", F.sha1(F.encode("body", "UTF-8")).alias("sha"), F.octet_length("body").alias("size"))
    shared = digests.where(F.col("size") >= min_revisit_bytes).groupBy("sha").agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "best")

    shared = stored(shared, "shared")
    if shared.count() <= BROADCAST_DIGESTS:
        shared = F.broadcast(shared)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = Archives(folder)
        for batch in batches:
            names = []
            for i, url, body, sha, best in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload, digest = body.encode(), b32(bytes.fromhex(sha))
                if best is None or i == best:
                    member = record("response", i, url, digest, len(payload), http_head(len(payload)) + payload, date)
                else:
                    member = record("revisit", i, url, digest, len(payload), http_head(len(payload)), date, best)
                names.append(archives.add(member))
            if names := [x for x in names if x]:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])
        if name := archives.close():
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string())], ["file"])

    small_batches(pages.sparkSession)
    rows = src.withColumn("sha", F.sha1(F.encode("body", "UTF-8"))).join(shared, "sha", "left").select("id", "url", "body", "sha", "best")
    return stored(rows.mapInArrow(files, "file string"), "warc-files")


class Damaged(Exception):
    pass


class Reader:
    """Reads the records of one archive in order."""

    def __init__(self, stream: BinaryIO, keep_payload: bool = False) -> None:
        self.stream, self.keep = stream, keep_payload
        self.raw = b""
        self.plain = b""
        self.z: zlib._Decompress | None = None

    def _more(self) -> bool:
        """Adds some decompressed bytes of the present member; false at its end."""
        while not self.z.eof:
            data = self.z.unconsumed_tail or self.raw or self.stream.read(CHUNK)
            self.raw = b""
            if not data:
                raise Damaged("the archive ends within a member")
            try:
                got = self.z.decompress(data, CHUNK)
            except zlib.error as e:
                raise Damaged(f"not a gzip member: {e}") from None
            if self.z.eof:
                self.raw = self.z.unused_data
            if got:
                self.plain += got
                return True
        return False

    def _line(self, limit: int = 1 << 20) -> bytes:
        while (end := self.plain.find(b"\r\n")) < 0:
            if len(self.plain) > limit or not self._more():
                raise Damaged("a header line doesn't end")
        line, self.plain = self.plain[:end], self.plain[end + 2 :]
        return line

    def _fields(self) -> dict[str, str]:
        out = {}
        while line := self._line():
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if not colon:
                raise Damaged("a header line has no colon")
            out[name.strip().lower()] = value.strip(" \t")
        return out

    def _take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.plain and not self._more():
                raise Damaged("the block is shorter than Content-Length")
            part, self.plain = self.plain[:n], self.plain[n:]
            n -= len(part)
            yield part

    def __iter__(self) -> Iterator[dict]:
        try:
            while True:
                self.raw = self.raw or self.stream.read(CHUNK)
                if not self.raw:
                    return
                yield self._record()
        except (Damaged, ValueError, KeyError) as e:
            yield {"error": str(e) or type(e).__name__}

    def _record(self) -> dict:
        self.z, self.plain = zlib.decompressobj(31), b""
        if not self._line().startswith(b"WARC/1."):
            raise Damaged("no WARC version")
        head = self._fields()
        block, payload = hashlib.sha1(), hashlib.sha1()
        http, body, size = b"", [], 0
        for part in self._take(int(head["content-length"])):
            block.update(part)
            if http is not None:
                http += part
                cut = http.find(b"\r\n\r\n", max(0, len(http) - len(part) - 3))
                if cut < 0:
                    if len(http) > MAX_HEAD:
                        raise Damaged("the HTTP header doesn't end")
                    continue
                part, inner, http = http[cut + 4 :], http[:cut], None
            payload.update(part)
            size += len(part)
            if self.keep:
                body.append(part)
        while len(self.plain) < 4 and self._more():
            pass
        if self.plain != b"\r\n\r\n" or self._more():
            raise Damaged("the record doesn't end after its block")
        if http is not None:
            raise Damaged("no HTTP header")
        told = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in inner.decode("latin-1").split("\r\n")[1:])}
        kind = head["warc-type"]
        if head["warc-block-digest"] != f"sha1:{b32(block.digest())}":
            raise Damaged("the block digest differs")
        if kind == "response" and (head["warc-payload-digest"] != f"sha1:{b32(payload.digest())}" or size != int(told["content-length"])):
            raise Damaged("the payload digest differs")
        refers = head.get("warc-refers-to")
        return {
            "page_id": self._id(head["warc-record-id"]),
            "target_uri": head.get("warc-target-uri", ""),
            "record_type": kind,
            "payload_digest": head["warc-payload-digest"].partition(":")[2],
            "payload_bytes": int(told["content-length"]),
            "refers_to": self._id(refers) if refers else None,
            "payload": b"".join(body) if self.keep and kind == "response" else None,
            "error": None,
        }

    @staticmethod
    def _id(urn: str) -> int | None:
        tail = urn.strip("<>").removeprefix(URN)
        return int(tail) if tail else None


FIELDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("error", pa.string())])


def read_archives(files: DataFrame, keep_payload: bool = False, tasks: int | None = None) -> DataFrame:
    """The records of the archives named in ``files.file``, one task per archive at a time."""
    fields = FIELDS.append(pa.field("payload", pa.binary())) if keep_payload else FIELDS
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, error string" + ", payload binary" * keep_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with open(get_file(name), "rb") as f:
                    for row in Reader(f, keep_payload):
                        rows.append(row)
                        held += len(row.get("payload") or b"")
                        if len(rows) >= 4096 or held > 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, fields)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, fields)

    n = tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").repartition(n, "file").mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads all records back."""
    return read_archives(write_archives(pages, scratch(spark, "warc"), min_revisit_bytes))
