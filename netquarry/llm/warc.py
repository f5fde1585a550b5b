"""Operator 4: WARC archives of Zstandard frames, written and read.

An archive (.warc.zst) starts with a skippable frame that holds the compression
dictionary; each record after it is one frame. Of records with equal payloads the first
is a response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, with_group_min, written

#: Magic numbers: of the dictionary's skippable frame, of a Zstandard frame.
DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
#: The dictionary is trained on so many payloads at most, and on so many bytes of each.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 1_000, 16_384, 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(digits: Column) -> Column:
    """Base32 of a SHA-1 in hex: each 40 bits are ten hex digits and eight letters."""
    letters = []
    for k in range(4):
        number = F.conv(F.substring(digits, 10 * k + 1, 10), 16, 10).cast("long")
        letters += [F.substring(F.lit(BASE32), (F.shiftright(number, s).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for s in range(35, -1, -5)]
    return F.concat(*letters)


def train(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of payloads; none (empty) if they are too few to train on."""
    rows = pages.where(F.length("html") > 0).select(F.substring("html", 1, SAMPLE_BYTES).alias("html")).limit(SAMPLE_ROWS)
    samples = [r[0].encode() for r in rows.toLocalIterator()]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""  # too little text; archives then have no dictionary


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit of page refers_to's record, without the payload."""
    revisit = refers_to is not None
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join(c if c.isprintable() else '%20' for c in url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; raises ValueError if the record isn't well formed."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError(f"a header line without a colon: {line[:60]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"a record without {name}")
    length = headers["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("a record's length isn't what its header says")
    return headers, rest[:-4]


#: Types of records that hold no page.
OTHER_TYPES = ("warcinfo", "request", "metadata", "resource", "conversion", "continuation")


def _number(headers: dict[str, str], name: str) -> int | None:
    value = headers.get(name)
    if value is not None and not value.removeprefix("-").isdecimal():
        raise ValueError(f"{name} is no number: {value[:60]!r}")
    return None if value is None else int(value)


def check_record(headers: dict[str, str], block: bytes) -> dict | None:
    """What is read of a response or revisit, None for other types; raises ValueError if its payload isn't what the headers say.

    A record written elsewhere may lack a page id (null), the payload's length (a response's
    is counted, a revisit's is null) and its digest (likewise); what it has must be right.
    """
    kind = headers["warc-type"]
    if kind in OTHER_TYPES:
        return None
    head, gap, payload = block.partition(b"\r\n\r\n")
    algorithm, _, digest = headers.get("warc-payload-digest", "sha1:").partition(":")
    size, page, refers = (_number(headers, n) for n in ("x-payload-length", "x-page-id", "x-refers-to-page-id"))
    if not gap or not head.startswith(b"HTTP/") or algorithm != "sha1" or kind not in ("response", "revisit"):
        raise ValueError("not a response or revisit with an HTTP head and a SHA-1")
    if kind == "response":
        counted = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if size not in (None, len(payload)) or digest not in ("", counted):
            raise ValueError("a response's payload has another length or digest than its header says")
        size, digest = len(payload), counted
    elif payload or headers.get("warc-profile") != PROFILE or "warc-refers-to" not in headers:
        raise ValueError("a revisit with a payload, without its profile, or without what it refers to")
    return {"page_id": page, "payload_bytes": size, "payload_digest": digest or None, "record_type": kind, "refers_to": refers, "payload": payload if kind == "response" else None}


class ArchiveWriter:
    """An archive in memory: the dictionary's frame, then a frame for each record."""

    def __init__(self, dictionary: bytes):
        packed = zstandard.ZstdCompressor(level=3).compress(dictionary)
        self.parts = [struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed] if dictionary else []
        use = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=3, dict_data=use, write_checksum=True, write_content_size=True).compress
        self.size = 0

    def add(self, record: bytes) -> None:
        self.parts.append(self.compress(record))
        self.size += len(self.parts[-1])

    def data(self) -> bytes:
        return b"".join(self.parts)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive: loads the dictionary from the leading skippable frame, then decodes frame by frame."""
    view, at, use = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        (size,) = struct.unpack_from("<I", data, 4)
        if 8 + size > len(data):
            raise ValueError("the dictionary's frame is cut off")
        raw = bytes(view[8 : 8 + size])
        if raw[:4] == struct.pack("<I", ZSTD_FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        use, at = zstandard.ZstdCompressionDict(raw), 8 + size
    decompressor = zstandard.ZstdDecompressor(dict_data=use) if use else zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("bytes after the last frame")
        magic, size = struct.unpack_from("<II", data, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:  # skippable frames may stand anywhere
            at += 8 + size
            continue
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            piece = view[at : at + 65536]
            if not len(piece):
                raise ValueError("the last frame is cut off")
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def with_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html (never null), digest, refers_to: the smallest page_id of an equal payload of least_bytes or more, if another."""
    pages = pages.where(F.col("page_id").isNotNull()).select("page_id", "url", "html")
    html = F.coalesce("html", F.lit(""))
    sha1 = F.sha1(F.encode(html, "UTF-8"))
    slim = written(pages.select("page_id", sha1.alias("sha1"), F.octet_length(html).alias("size")), "payload-digests")
    first = with_group_min(slim.withColumn("key", F.when(F.col("size") >= least_bytes, F.col("sha1"))), "key", "page_id", "first")
    types = first.select(F.col("page_id").alias("p"), F.col("sha1").alias("of"), F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to")).dropDuplicates(["p", "of"])
    full = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), sha1.alias("sha1"))
    joined = full.join(types, (F.col("page_id") == F.col("p")) & (F.col("sha1") == F.col("of")), "left")
    return joined.select("page_id", "url", "html", sha1_base32(F.col("sha1")).alias("digest"), "refers_to")


def write_archives(typed: DataFrame, dictionary: bytes, archive_bytes: int = 8 << 20) -> tuple[str, DataFrame]:
    """Write the rows of with_types() as archives of about archive_bytes in the shared folder; returns it and their list.

    Each attempt of a task has files of its own; only those of attempts that ended are in the list.
    """
    folder = shared_dir(typed.sparkSession, "warc")
    shared = typed.sparkSession.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most
    schema = pa.schema([("file", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        part, nth, archive, n = TaskContext.get().partitionId(), 0, ArchiveWriter(shared.value), 0

        def flush() -> pa.RecordBatch:
            file = f"{path}/part-{part:07d}-{nth:05d}-{TaskContext.get().taskAttemptId()}.warc.zst"
            with store.open_output_stream(file) as out:
                out.write(archive.data())
            return pa.RecordBatch.from_pydict({"file": [file], "records": [n]}, schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                archive.add(make_record(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["refers_to"]))
                n += 1
                if archive.size >= archive_bytes:
                    yield flush()
                    archive, n, nth = ArchiveWriter(shared.value), 0, nth + 1
        if n:
            yield flush()

    return folder, written(typed.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "file string, records long"), "warc-list")


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
SCHEMA = pa.schema(zip(NAMES, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()], strict=True))
ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def rows_of(content: bytes, batch_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """An archive's responses and revisits, in batches of about batch_bytes."""
    rows, size = [], 0
    for data in read_archive(content):
        row = check_record(*parse_record(data))
        if row is not None:
            rows.append(row)
            size += len(data)
        if size > batch_bytes:
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


def read_archives(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of every response and revisit in the folder.

    An archive that isn't well formed, or a payload that isn't what its headers say, fails the query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from rows_of(content.as_buffer().to_pybytes())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    return files.mapInArrow(run, ROW)


def read_listed(folder: str, files: DataFrame, a_task: int = 4) -> DataFrame:
    """The same of the archives in a list that write_archives() returned, and no other file in the folder; so many archives a task."""
    spark = files.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-files.count() // a_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with store.open_input_stream(file) as archive:
                    content = archive.read()
                yield from rows_of(content)

    return files.select("file").repartition(parts, "file").mapInArrow(run, ROW)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, from the archives.

    A null html is an empty payload, a null url an empty address; rows without a page_id
    are left out. Rows of one page_id and
    equal payloads are each a response of their own (none is smaller). A payload of any
    length is one record, of an archive as long as it takes. Extra columns are ignored. An
    empty table gives no archives and no rows.
    """
    spark = pages.sparkSession
    folder, files = write_archives(with_types(pages, least_bytes), train(pages))
    if files.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_listed(folder, files).drop("payload")


ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p),
c AS (
  SELECT page_id, payload_bytes, hex, k, s, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 10 * k + 1, 10))::BIGINT >> s) & 31)::INT + 1, 1) AS letter
  FROM h, (SELECT unnest([0, 1, 2, 3]) AS k), (SELECT unnest([35, 30, 25, 20, 15, 10, 5, 0]) AS s)
), d AS (SELECT page_id, any_value(payload_bytes) AS payload_bytes, string_agg(letter, '' ORDER BY k, s DESC) AS payload_digest FROM c GROUP BY page_id),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN least < page_id THEN least END AS refers_to
FROM m
"""
