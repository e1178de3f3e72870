"""WARC archives and a two-level index of their captures.

Pages are written as gzip members, one per record, into archive files of the
shared folder. A page whose payload an earlier record holds becomes a revisit of
it: headers only.

The index sorts captures by reversed-host URL key and id. Each index file holds a
range of them as compressed blocks of lines, then a sparse directory, the first
key of every block, then the directory's size. A lookup finds its file among the
first keys of the files, its block by binary search in the directory, its lines by
binary search in the block, and reads the record's range of the archive.

Files are named at random by the attempt that writes them and listed by the rows
it returns, so a repeated task leaves at most files that nothing refers to. The
first keys of the index files, one per partition of the sort, are the only thing
broadcast.

Cases: a null html is an empty payload; a null url has the empty key. Payloads
below ``MIN_PAYLOAD`` bytes are never revisits. A page without id is written in
full and never referred to. Repeated rows are captures of their own; those with
the smallest id are responses all. No pages give no rows.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ship
from plumbline.session import scratch_path, written_table

MIN_PAYLOAD = 100
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 16 << 20
BLOCK_LINES = 1000
LEVEL = 4
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_ID = -(1 << 63)

CAPTURES = "url_key string, page_id long, archive string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: Column) -> Column:
    """Host reversed by labels, then the rest: ``com,example,www)/path?query``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.regexp_replace(url, "^[^:/?#]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    labels = F.array_join(F.reverse(F.split(host, "[.]")), ",")
    return F.when(rest == "", F.lit("")).otherwise(F.concat(labels, F.lit(")"), F.substr(rest, F.length(host) + 1)))


def record_types(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(url_key, page_id, url, html, digest, refers_to); ``refers_to`` is set for revisits."""
    own = pages.select(
        url_key(F.col("url")).alias("url_key"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    repeated = written_table(
        own.where(F.octet_length("html") >= min_payload)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where("first != last")
        .select("digest", "first"),
        "payloads",
    )
    joined = own.join(repeated, "digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).drop("first")


def _record_id(page_id) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _safe(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, uncompressed."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", DATE)]
    if url:
        headers.append(("WARC-Target-URI", _safe(url)))
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        block += payload
    else:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to))]
    headers.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _headers(data: bytes, at: int) -> tuple[str, dict[str, str], int]:
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    return first, {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}, end + 4


def parsed(data: bytes) -> tuple[int, str, str, int | None]:
    """Payload size, digest, type and referred page of an uncompressed record; fails if it is damaged."""
    version, warc, body = _headers(data, 0)
    _, http, start = _headers(data, body)
    end = body + int(warc["content-length"])
    if version != "WARC/1.1" or data[end:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    digest, size, kind = warc["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"]), warc["warc-type"]
    refers_to = None
    if kind == "revisit":
        refers_to = int(warc["warc-refers-to"].removeprefix("<urn:x-page:").removesuffix(">"))
    else:
        payload = data[start:end]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("the payload is not what its record says")
    return size, digest, kind, refers_to


def _open(uri: str):
    return FileSystem.from_uri(uri)


class _Writer:
    """Appends to files of bounded size in a shared folder."""

    def __init__(self, folder: str, suffix: str, limit: int):
        self.folder, self.suffix, self.limit = folder, suffix, limit
        self.file, self.uri, self.at = None, "", 0

    def append(self, data: bytes) -> tuple[str, int]:
        if self.file is None or self.at >= self.limit:
            self.close()
            self.uri, self.at = f"{self.folder}/{uuid.uuid4().hex}{self.suffix}", 0
            fs, path = _open(self.uri)
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.file = fs.open_output_stream(path, compression=None)
        self.file.write(data)
        self.at += len(data)
        return self.uri, self.at - len(data)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def write_archives(typed: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``record_types``; captures (url_key, page_id, archive, offset, length)."""
    ship(typed.sparkSession)
    folder = scratch_path(typed.sparkSession, "warc")

    def run(batches):
        writer = _Writer(folder, ".warc.gz", archive_bytes)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                raw = record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"])
                data = gzip.compress(raw, LEVEL, mtime=0)
                archive, at = writer.append(data)
                rows.append((r["url_key"], r["page_id"], archive, at, len(data)))
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = zip(*rows) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)],
                names=["url_key", "page_id", "archive", "offset", "length"],
            )
        writer.close()

    return written_table(typed.mapInArrow(run, CAPTURES), "captures")


def _order(key: str, page_id) -> tuple[bytes, int]:
    """As Spark sorts: strings by their bytes, null first."""
    return key.encode(), _NO_ID if page_id is None else page_id


def write_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the captures into index files; (file, url_key, page_id) of the first capture of each."""
    folder = scratch_path(captures.sparkSession, "index")
    ordered = captures.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id")

    def run(batches):
        # Sizes are bounded by the partitions of the sort.
        writer, directory, first, lines = _Writer(folder, ".idx", 1 << 62), [], None, []

        def flush():
            if lines:
                data = zlib.compress(json.dumps(lines).encode(), LEVEL)
                _, at = writer.append(data)
                directory.append((lines[0][0], lines[0][1], at, len(data)))
                lines.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if first is None:
                    first = (r["url_key"], r["page_id"])
                lines.append((r["url_key"], r["page_id"], r["archive"], r["offset"], r["length"]))
                if len(lines) == block_lines:
                    flush()
        flush()
        if first is not None:
            packed = zlib.compress(json.dumps(directory).encode(), LEVEL)
            writer.append(packed)
            uri, _ = writer.append(struct.pack("<Q", len(packed)))
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([uri]), pa.array([first[0]]), pa.array([first[1]], pa.int64())],
                names=["file", "url_key", "page_id"],
            )

    return written_table(ordered.mapInArrow(run, "file string, url_key string, page_id long"), "index-files")


class IndexFile:
    """One index file: its directory is read at once, blocks when they are asked for."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        (n,) = struct.unpack("<Q", self.file.read_at(8, size - 8))
        self.directory = json.loads(zlib.decompress(self.file.read_at(n, size - 8 - n)))
        self.firsts = [_order(k, i) for k, i, _, _ in self.directory]
        self.number, self.lines, self.keys = -1, [], []

    def block(self, number: int) -> None:
        if number != self.number:
            _, _, at, n = self.directory[number]
            self.lines = json.loads(zlib.decompress(self.file.read_at(n, at)))
            self.number, self.keys = number, [_order(k, i) for k, i, *_ in self.lines]

    def find(self, key: str, page_id) -> list[tuple[str, int, int]]:
        """(archive, offset, length) of the captures of a key and id."""
        wanted, out = _order(key, page_id), []
        # Captures of one key and id may go on over several blocks.
        number = max(0, bisect.bisect_left(self.firsts, wanted) - 1)
        while number < len(self.directory) and self.firsts[number] <= wanted:
            self.block(number)
            low, high = bisect.bisect_left(self.keys, wanted), bisect.bisect_right(self.keys, wanted)
            out += [tuple(x[2:]) for x in self.lines[low:high]]
            number += 1
        return out


def lookup(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(page_id, archive, offset, length): the captures of each distinct (url_key, page_id) asked for."""
    files = sorted(((_order(r.url_key, r.page_id), r.file) for r in index.collect()), key=lambda x: x[0])
    shared = asked.sparkSession.sparkContext.broadcast(files)

    def route(batches):
        firsts, names = [f for f, _ in shared.value], [n for _, n in shared.value]
        for batch in batches:
            rows = []
            for key, i in zip(batch.column("url_key").to_pylist(), batch.column("page_id").to_pylist()):
                wanted = _order(key, i)
                low, high = max(0, bisect.bisect_left(firsts, wanted) - 1), bisect.bisect_right(firsts, wanted)
                rows += [(n, key, i) for n in names[low:high]]
            types = [pa.string(), pa.string(), pa.int64()]
            columns = zip(*rows) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], names=["file", "url_key", "page_id"]
            )

    def find(batches):
        uri, opened = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["file"] != uri:
                    uri, opened = r["file"], IndexFile(r["file"])
                rows += [(r["page_id"], *x) for x in opened.find(r["url_key"], r["page_id"])]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = zip(*rows) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], names=["page_id", "archive", "offset", "length"]
            )

    keys = asked.select("url_key", "page_id").distinct()
    routed = keys.mapInArrow(route, "file string, url_key string, page_id long")
    near = routed.repartition("file").sortWithinPartitions("file", "url_key", "page_id")
    return near.mapInArrow(find, "page_id long, archive string, offset long, length long")


def read_records(places: DataFrame) -> DataFrame:
    """What each record says, read by range and checked: page_id, payload, digest, type, reference."""

    def run(batches):
        uri, opened = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["archive"] != uri:
                    uri = r["archive"]
                    fs, path = _open(uri)
                    opened = fs.open_input_file(path)
                rows.append((r["page_id"], *parsed(gzip.decompress(opened.read_at(r["length"], r["offset"])))))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = zip(*rows) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)],
                names=[c.split()[0] for c in RECORDS.split(", ")],
            )

    part = F.floor(F.col("offset") / READ_BYTES)
    near = places.withColumn("part", part).repartition("archive", "part").sortWithinPartitions("archive", "offset")
    return near.drop("part").mapInArrow(run, RECORDS)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages, index them, look every one up and read it back."""
    captures = write_archives(record_types(pages))
    places = lookup(write_index(captures), captures)
    return read_records(places)


SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {MIN_PAYLOAD} GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN p.page_id != first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id != first THEN first END AS refers_to
FROM p LEFT JOIN firsts f ON p.payload_digest = f.payload_digest
"""
