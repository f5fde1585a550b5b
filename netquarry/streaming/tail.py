"""Following a growing log file, through rotation and truncation, as a streaming source.

Spark's own file stream takes each file once and whole. This source reads what is
appended to one file, up to the last line end. Its offset lists the files there are, oldest
first, and how far each can be read; a file is known by a digest of its first bytes, so that
reading goes on in the renamed file and a restarted query reads every line once. What lies
between two offsets is planned as ranges of bytes that end at line ends; executors read
them, from a folder that they share with the driver. No line passes through the driver.
"""

from __future__ import annotations

import glob
import gzip
import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD_BYTES = 256
#: Longer lines are dropped.
LINE_BYTES = 8 << 20
#: Bytes that one task reads.
RANGE_BYTES = 8 << 20


def opened(path: str):
    """The file's bytes; a compressed one's as they were before."""
    return gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")


@lru_cache(maxsize=256)
def _unpacked(path: str, changed: int, size: int) -> int:
    n = 0
    try:
        with gzip.open(path, "rb") as file:
            while part := file.read(1 << 20):
                n += len(part)
    except (EOFError, OSError, zlib.error):  # still being written, or not what its name says
        return -1
    return n


def length(path: str) -> int:
    """Bytes in the file, in a compressed one those before compression; -1 for one that can't be read to its end."""
    if not path.endswith(".gz"):
        return os.path.getsize(path)
    at = os.stat(path)
    return _unpacked(path, at.st_mtime_ns, at.st_size)


def signature(path: str, upto: int) -> str:
    """A digest of the first bytes before ``upto``; '' for none."""
    size = min(upto, HEAD_BYTES)
    if not size:
        return ""
    try:
        with opened(path) as file:
            head = file.read(size)
    except (EOFError, OSError, zlib.error):
        if not path.endswith(".gz"):
            raise
        return ""
    return hashlib.sha256(head).hexdigest()[:16] if len(head) == size else ""


def siblings(path: str) -> list[str]:
    """Files named like the followed one, oldest change first, without itself and without compressed copies of others (whole or being written)."""
    found = {p for p in glob.glob(glob.escape(path) + "*") if os.path.isfile(p) and p != path}
    for p in found & {f"{p}.gz" for p in found}:
        n = length(p)
        if n < 0 or n == length(p[:-3]) and signature(p, n) == signature(p[:-3], n):
            found.discard(p)
    return sorted(found, key=lambda p: (os.path.getmtime(p), p))


def is_it(path: str, sign: str, head: int, at: int) -> bool:
    """Whether a file starts with the bytes of that digest and has so many bytes at least."""
    return os.path.exists(path) and signature(path, head) == sign and (at <= head or length(path) >= at)


def find(path: str, sign: str, head: int, at: int) -> str | None:
    """Where the file with this start now is: under its own name or that of a rotated one; None if it is gone or shorter."""
    return next((p for p in (path, *reversed(siblings(path))) if is_it(p, sign, head, at)), None)


def lines_between(path: str, start: int, end: int) -> Iterator[tuple[str, int]]:
    """Whole lines, and where they start, of a stretch that ends at a line end or at the file's end (-1)."""
    with opened(path) as file:
        file.seek(start)
        at = start
        while end < 0 or at < end:
            most = LINE_BYTES + 1 if end < 0 else min(end - at, LINE_BYTES + 1)
            line, began = file.readline(most), at
            if not line:
                return
            at += len(line)
            if len(line) <= LINE_BYTES:
                yield line.rstrip(b"\r\n").decode("utf-8", "replace"), began
                continue
            while line and not line.endswith(b"\n") and (end < 0 or at < end):
                line = file.readline(LINE_BYTES if end < 0 else min(end - at, LINE_BYTES))
                at += len(line)


def last_line_end(path: str, end: int) -> int:
    """The place behind the last line end before a place; 0 for none."""
    at = end
    with opened(path) as file:
        while at > 0:
            low = max(0, at - 65_536)
            file.seek(low)
            k = file.read(at - low).rfind(b"\n")
            if k >= 0:
                return low + k + 1
            at = low
    return 0


def next_line_end(path: str, at: int, end: int) -> int:
    """The place behind the first line end from a place on; the end for none before it."""
    with opened(path) as file:
        file.seek(at)
        while at < end:
            part = file.read(min(65_536, end - at))
            k = part.find(b"\n")
            if k >= 0:
                return at + k + 1
            if not part:
                break
            at += len(part)
    return end


def entry(path: str, live: bool) -> dict | None:
    """What an offset says of a file: the digest of its start, of how many bytes that is, how far it can be read, and its number in the file system.

    A compressed file is read to its end (-1); what can't be read yet is left out.
    """
    try:
        at = os.stat(path)
        if path.endswith(".gz"):
            head = HEAD_BYTES
            while head and not signature(path, head):
                head //= 2
            return {"sign": signature(path, head), "head": head, "end": -1, "node": at.st_ino} if head and length(path) > 0 else None
        head = min(HEAD_BYTES, at.st_size)
        end = last_line_end(path, at.st_size) if live else at.st_size
        return {"sign": signature(path, head), "head": head, "end": end, "node": at.st_ino} if live or at.st_size else None
    except FileNotFoundError:  # renamed meanwhile: seen the next time
        return None


def ranges(path: str, start: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """A stretch cut at line ends into ranges of about so many bytes; a compressed file can't be cut."""
    while end >= 0 and end - start > size and not path.endswith(".gz"):
        cut = next_line_end(path, start + size, end)
        yield start, cut
        start = cut
    if end < 0 or end > start:
        yield start, end


def standing(offset: dict) -> dict | None:
    """The last file of an offset that something had been written to: all after it is unread."""
    return next((f for f in reversed(offset["files"]) if f["head"]), None)


def between(path: str, start: dict, end: dict) -> list[tuple[dict, int]]:
    """The files to read between two offsets, and from which place each."""
    if not end["files"] or start == end:
        return []
    stood = standing(start)
    if stood:
        for k in range(len(end["files"]) - 1, -1, -1):
            f = end["files"][k]
            if 0 <= f["end"] < stood["end"] or f["head"] < stood["head"]:
                continue
            here = find(path, f["sign"], f["head"], max(f["end"], 0))
            if here and is_it(here, stood["sign"], stood["head"], stood["end"]):
                return [(f, stood["end"]), *((later, 0) for later in end["files"][k + 1 :])]
    return [(end["files"][-1], 0)]  # gone, or cut off: what is there now is read from its start


def turns(start: dict, end: dict) -> tuple[int, int]:
    """How often the file was renamed away, and whether it was cut off in place, between two offsets."""
    old = standing(start)
    if not old or not end["files"]:
        return 0, 0
    new = end["files"][-1]
    if old["node"] == new["node"]:
        other = old["head"] == new["head"] and old["sign"] != new["sign"]
        return 0, int(new["end"] < old["end"] or other)
    after = [k for k, f in enumerate(end["files"]) if f["node"] == old["node"]]
    return (len(end["files"]) - 1 - after[-1] if after else 1), 0


@dataclass
class Range(InputPartition):
    """Bytes of a file that one task reads; number gives their order."""

    sign: str
    head: int
    least: int
    start: int
    end: int
    number: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.begin = json.loads(options["begin"]) if options.get("begin") else None
        self.last: dict = {"files": []}

    def initialOffset(self) -> dict:
        """The start of the file as it is now, or where ``begin`` says."""
        if self.begin is None:
            now = entry(self.path, live=True)
            self.begin = {"files": [now | {"end": 0}] if now else []}
        self.last = self.begin
        return self.begin

    def latestOffset(self) -> dict:
        files = [f for p in siblings(self.path) if (f := entry(p, live=False))]
        now = entry(self.path, live=True)
        files += [now] if now else []
        if files:
            self.last = {"files": files}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out: list[Range] = []
        for f, at in between(self.path, start, end):
            here = find(self.path, f["sign"], f["head"], max(f["end"], 0))
            if here is None:
                raise FileNotFoundError(f"the file that was to be read from byte {at} to {f['end']} is gone")
            out += [Range(f["sign"], f["head"], max(f["end"], 0), a, b, len(out) + k) for k, (a, b) in enumerate(ranges(here, at, f["end"], self.size))]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        here = find(self.path, partition.sign, partition.head, partition.least)
        if here is None:
            raise FileNotFoundError(f"the file that bytes {partition.start} to {partition.end} are to be read from is gone")
        for text, at in lines_between(here, partition.start, partition.end):
            yield text, (partition.number << 40) + at


class TailSource(DataSource):
    """Format ``netquarry_tail``; options path, rangeBytes and begin (an offset); columns line and seq (its place in the batch, not dense)."""

    @classmethod
    def name(cls) -> str:
        return "netquarry_tail"

    def schema(self) -> str:
        return "line string, seq bigint"

    def streamReader(self, schema) -> TailReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})


def begin(path: str) -> dict:
    """The offset before the first byte of the file as it is now."""
    return TailReader({"path": path}).initialOffset()


def follow(spark: SparkSession, path: str, start: dict | None = None, size: int = RANGE_BYTES):
    """A streaming DataFrame of line and seq, from ``start`` or the start of the file."""
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("netquarry_tail").option("path", path).option("rangeBytes", str(size))
    return (reader.option("begin", json.dumps(start)) if start else reader).load()
