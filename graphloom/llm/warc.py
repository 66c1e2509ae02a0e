"""WARC archives: a writer that stores equal payloads once, and a PySpark data source that reads archives.

Each record is a gzip member of its own whose extra field "SL" holds the member's length, so a reader can step over it.
The source plans partitions of files and byte ranges, takes equality and IN filters on the record type and on the header
columns, inflates and parses a record's headers first, and inflates the rest only for records that pass, and only if a
payload is asked for. Plain (uncompressed) archives and gzip members without the extra field are read too.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .common import filesystem, map_batches, with_group, write_atomically

#: Payloads from this size are written once.
LEAST_BYTES = 1000
#: The date of every record, so that equal input gives equal archives.
DATE = "2000-01-01T00:00:00Z"
#: Bytes of an archive that one read partition covers.
SPLIT_BYTES = 64 << 20

COLUMNS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To", "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS) + ", payload_bytes long, payload binary, path string, offset long"


# -- records ---------------------------------------------------------------------------------------------------------


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_id(page_id: int | None, url: str | None) -> str:
    """A record's URI; it names the page, and rows that share a page_id by their URL."""
    return f"<urn:page:{'' if page_id is None else page_id}:{hashlib.sha1((url or '').encode()).hexdigest()[:16]}>"


def page_of(uri: str | None) -> int | None:
    """The page_id in a record's URI."""
    found = re.fullmatch(r"<urn:page:(-?\d+):[0-9a-f]{16}>", uri or "")
    return int(found[1]) if found else None


def record(kind: str, uri: str, url: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """A response record, or a revisit of one that leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", uri), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    if refers_to:
        head += [("WARC-Refers-To", refers_to), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field holds its own length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 8 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHI", 8, b"SL", 4, size) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _member_size(data: bytes) -> int | None:
    if len(data) >= 20 and data[3] == 4 and data[12:14] == b"SL":
        return struct.unpack("<I", data[16:20])[0]
    return None


# -- writing ---------------------------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, compress: bool = True) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) into archives below ``path``.

    The payload is the html in UTF-8 (null: empty). Of the rows with equal payloads of at least ``least_bytes`` bytes, the one
    with the largest page_id is a response and the others revisit it; rows that share that page_id are all responses. A null
    page_id is smallest. An empty table writes no record, and other columns are not looked at, whatever their names.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    # Which rows share a payload is told from ids and digests, dealt over tasks by a salt; each payload moves at most once, and not to its copies.
    shared = with_group(rows.withColumn("latest", F.struct("page_id", "url")), ["digest"], ["page_id", "url"], last=(F.max, "latest"))
    first = (F.octet_length("html") < least_bytes) | F.col("page_id").eqNullSafe(F.col("last.page_id"))
    ready = shared.select("page_id", "url", "html", "digest", first.alias("first"), F.col("last.page_id").alias("to_page"), F.col("last.url").alias("to_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records(stream) -> None:
            for batch in batches:
                for i in range(batch.num_rows):
                    page, url, html, digest, is_first, to_page, to_url = (c[i].as_py() for c in batch.columns)
                    kind = "response" if is_first else "revisit"
                    data = record(kind, record_id(page, url), url, html, digest, None if is_first else record_id(to_page, to_url))
                    stream.write(member(data) if compress else data)

        write_atomically(f"{path}/part-{TaskContext.get().partitionId():05d}.warc{'.gz' if compress else ''}", records)
        yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})

    map_batches(ready, run, "n long").agg(F.sum("n")).collect()


# -- reading ---------------------------------------------------------------------------------------------------------


class _Input:
    """A file with a window of bytes read ahead."""

    def __init__(self, path: str):
        system, at = filesystem(path)
        self.file, self.size = system.open_input_file(at), system.get_file_info(at).size
        self.start, self.data = 0, b""

    def at(self, offset: int, n: int) -> bytes:
        if offset < self.start or offset + n > self.start + len(self.data):
            self.data, self.start = self.file.read_at(min(max(n, 1 << 20), max(0, self.size - offset)), offset), offset
        return self.data[offset - self.start : offset - self.start + n]


def _parse(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    out = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        out[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


class _Member:
    """A gzip member that is inflated as far as it is asked for."""

    def __init__(self, source: _Input, offset: int):
        self.source, self.offset, self.next = source, offset, offset
        self.size = _member_size(source.at(offset, 20))
        self.inflate, self.out, self.ended = zlib.decompressobj(31), bytearray(), False

    def _more(self, n: int) -> None:
        piece = self.source.at(self.next, n)
        if not piece:
            raise EOFError(f"a record is cut off at {self.offset}")
        self.out += self.inflate.decompress(piece)
        self.next += len(piece) - len(self.inflate.unused_data)
        self.ended = self.inflate.eof

    def head(self) -> bytes:
        end = self.find(0)
        return bytes(self.out[: end if end >= 0 else len(self.out)])

    def find(self, start: int) -> int:
        """Where the first empty line from ``start`` on begins, -1 if there is none; each byte is looked at once."""
        while (end := self.out.find(b"\r\n\r\n", start)) < 0 and not self.ended:
            start = max(start, len(self.out) - 3)
            self._more(1024)
        return end

    def body(self, start: int, size: int) -> bytes:
        """``size`` bytes from ``start`` on."""
        while not self.ended and len(self.out) < start + size:
            self._more(1 << 16)
        return bytes(self.out[start : start + size])

    def end(self) -> int:
        """Where the next member begins; without the extra field, the member has to be inflated to tell."""
        if self.size:
            return self.offset + self.size
        while not self.ended:
            self._more(1 << 16)
            self.out.clear()
        return self.next


def _first_member(source: _Input, start: int) -> int:
    """The first offset from ``start`` at which a record begins."""
    at = start
    while at < source.size:
        block = source.at(at, min(1 << 16, source.size - at))
        found = block.find(b"\x1f\x8b\x08")
        if found < 0:
            at += max(1, len(block) - 2)
            continue
        try:
            if _Member(source, at + found).head().startswith(b"WARC/1."):
                return at + found
        except (zlib.error, EOFError):
            pass
        at += found + 1
    return source.size


def _plain_head(source: _Input, at: int) -> bytes:
    n = 4096
    while b"\r\n\r\n" not in (data := source.at(at, min(n, source.size - at))):
        if at + n >= source.size:
            raise EOFError(f"a record is cut off at {at}")
        n *= 2
    return data.partition(b"\r\n\r\n")[0]


def read_records(path: str, start: int, end: int, wanted: dict[str, set], with_payload: bool) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` of the records that begin in [start, end). ``wanted``: allowed values by column."""
    source = _Input(path)
    zipped = source.at(0, 2) == b"\x1f\x8b"
    at = (_first_member(source, start) if start else 0) if zipped else start
    while at < min(end, source.size):
        if zipped:
            this = _Member(source, at)
            head = this.head()
        else:
            head = _plain_head(source, at)
        fields = _parse(head)
        values = [fields.get(h.lower()) for h in COLUMNS.values()]
        passes = all(values[i] in wanted[c] for i, c in enumerate(COLUMNS) if c in wanted)
        length = int(fields.get("content-length", 0))
        is_http = (fields.get("content-type") or "").startswith("application/http")
        payload, size = None, length
        if passes:
            if zipped:
                if is_http:
                    this.find(len(head) + 4)
                block = this.body(len(head) + 4, length) if with_payload else bytes(this.out[len(head) + 4 : len(head) + 4 + length])
            else:
                block = source.at(at + len(head) + 4, length if with_payload else min(length, 4096))
            if is_http:
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(_parse(http).get("content-length", length - len(http) - 4))
            else:
                payload = block
            yield (*values, size, payload if with_payload and values[0] != "revisit" else None, path, at)
        at = this.end() if zipped else at + len(head) + 4 + length + 4


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("splitbytes") or options.get("splitBytes") or SPLIT_BYTES)
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list) -> Iterator:
        """Take equality and IN on header columns; the rest goes back to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            column = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if column in COLUMNS:
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[_Range]:
        from pyarrow import fs

        system, at = filesystem(self.path)
        prefix = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else self.path[: self.path.find("://") + 3] if "://" in self.path else ""
        info = system.get_file_info(at)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        out = []
        for f in sorted((f for f in files if re.search(r"\.warc(\.gz)?$", f.path)), key=lambda f: f.path):
            step = self.split if f.path.endswith(".gz") else max(1, f.size)
            out += [_Range(prefix + f.path, i, min(i + step, f.size)) for i in range(0, f.size, step)]
        return out

    def read(self, partition: _Range | None) -> Iterator[tuple]:
        if partition is not None:  # without any file Spark asks for one partition of its own
            yield from read_records(partition.path, partition.start, partition.end, self.wanted, self.with_payload)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").option("payload", "false").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives below ``path``; filters on the header columns are pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of ``write_archives``' records, read back.

    Payloads are read for responses only, and their length and digest are compared with the headers'.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [c.to_pylist() for c in batch.columns]
            out: list[list] = [[], [], [], [], []]
            for kind, uri, digest, refers_to, size, payload in zip(*cells, strict=True):
                hexed = _hex(digest)
                if kind == "response" and (hashlib.sha1(payload).hexdigest() != hexed or len(payload) != size):
                    raise ValueError(f"the payload of {uri} is not the one that was written")
                for column, value in zip(out, (page_of(uri), size, hexed, kind, page_of(refers_to)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    needed = ["record_type", "record_id", "payload_digest", "refers_to", "payload_bytes", "payload"]
    responses = read_archives(spark, path).where("record_type = 'response'").select(*needed)
    revisits = read_archives(spark, path, payload=False).where("record_type = 'revisit'").select(*needed)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return map_batches(responses.union(revisits), run, schema)


#: The rows of ``page_records`` over pages, for DuckDB.
RECORDS_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS latest FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id < latest THEN latest END AS refers_to
FROM q
"""
