"""Operator 10: token ids in wavelet-matrix files, one compressed file per shard.

A shard's ids are stored as bit-planes from the highest bit down. Each plane is
packed to one bit an id, with the count of ones before every 512th bit, and the ids
are stably parted by the plane's bit for the next plane. Rank and select on the
planes give the id at a place, the count of an id before a place, and the places of
an id, without unpacking the ids.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, shared_dir, written
from .units import UnitTable

MAGIC = b"WAVELET1"
#: Bits between two stored counts of ones.
STEP = 512
#: Text that is encoded at once, beside one text; units that a worker keeps, and that are encoded as one text.
BLOCK_BYTES, KEPT_UNITS, UNITS = 8 << 20, 1_000_000, 5_000


class WaveletMatrix:
    """Ids as bit-planes; ``planes`` are packed bits, ``ranks`` the ones before each STEP bits, ``zeros`` the zeros of each plane."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        row = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, ranks, zeros = [], [], []
        for k in range(width - 1, -1, -1):
            bit = (row & row.dtype.type(1 << k)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            planes.append(packed)
            ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), STEP // 8)) if len(packed) else np.zeros(0)
            ranks.append(np.concatenate([[0], np.cumsum(ones, dtype=np.int64)]).astype(np.uint32))
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)
            zeros.append(len(low))
            if k == 8:  # what is left to tell apart fits in bytes
                row = row.astype(np.uint8)
            row = np.concatenate([row.take(low), row.take(high)])
        return cls(len(ids), planes, ranks, zeros)

    def _blocks(self, k: int, block: np.ndarray) -> np.ndarray:
        """The bytes of these blocks of STEP bits of plane k, a row each; zeros behind the plane's end."""
        plane, at = self.planes[k], block[:, None] * (STEP // 8) + np.arange(STEP // 8)
        return np.where(at < len(plane), plane[np.minimum(at, len(plane) - 1)], 0).astype(np.uint8)

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        """Ones of plane k before each place of i (rank)."""
        held, inside = self._blocks(k, i // STEP), i % STEP
        column = np.arange(STEP // 8)
        held[column > (inside // 8)[:, None]] = 0
        part = np.flatnonzero(column == (inside // 8)[:, None])
        held.reshape(-1)[part] &= ((1 << (inside % 8)) - 1).astype(np.uint8)
        return self.ranks[k][i // STEP].astype(np.int64) + np.bitwise_count(held).sum(axis=1, dtype=np.int64)

    def access(self, places) -> np.ndarray:
        """The ids at these places."""
        i = np.asarray(places, dtype=np.int64)
        if len(i) > 1 << 14:
            return np.concatenate([self.access(i[a : a + (1 << 14)]) for a in range(0, len(i), 1 << 14)])
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.planes)):
            bit = (self.planes[k][i // 8] >> (i % 8).astype(np.uint8)) & 1
            ones = self._ones(k, i)
            out = out << 1 | bit
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of token among the first ``end`` ids stand below the last plane."""
        ends = np.array([0, end], dtype=np.int64)
        if token >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            ones = self._ones(k, ends)
            ends = self.zeros[k] + ones if token >> (len(self.planes) - 1 - k) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, end: int | None = None) -> int:
        """How often token stands among the first ``end`` ids (all by default)."""
        a, b = self._range(token, self.n if end is None else end)
        return b - a

    def _select(self, k: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """The places in plane k of the nth (from 0) bits of this value."""
        before = self.ranks[k].astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before)) * STEP, self.n) - before
        block = np.searchsorted(before, nth, side="right") - 1
        bits = np.unpackbits(self._blocks(k, block), axis=1, bitorder="little")
        seen = np.cumsum(bits == bit, axis=1, dtype=np.int16)
        return block * STEP + (seen == (nth - before[block] + 1)[:, None]).argmax(axis=1)

    def occurrences(self, token: int) -> list[int]:
        """All places of token, ascending."""
        a, b = self._range(token, self.n)
        found = []
        for start in range(a, b, 1 << 14):
            i = np.arange(start, min(b, start + (1 << 14)))
            for k in range(len(self.planes) - 1, -1, -1):
                one = token >> (len(self.planes) - 1 - k) & 1
                i = self._select(k, one, i - self.zeros[k] if one else i)
            found += i.tolist()
        return sorted(found)

    def ids(self) -> np.ndarray:
        """All ids in order, unsigned 32-bit."""
        width = len(self.planes)
        row = np.zeros(self.n, dtype=np.uint8)
        for k in range(width - 1, -1, -1):
            if width - 1 - k == 8:  # the ninth bit from the last
                row = row.astype(np.uint16 if width <= 16 else np.uint32)
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(row)
            up[np.flatnonzero(~bit)] = row[: self.zeros[k]]
            up[np.flatnonzero(bit)] = row[self.zeros[k] :] | row.dtype.type(1 << (len(self.planes) - 1 - k))
            row = up
        return row.astype(np.uint32)


def to_bytes(matrix: WaveletMatrix, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A shard's file: counts, then zstd blocks, each behind its length: documents, then each plane and its ranks."""
    pack = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    docs = known.tobytes() + np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + np.array(lengths, dtype="<u4").tobytes()
    parts = [pack(docs)]
    for plane, ranks in zip(matrix.planes, matrix.ranks, strict=True):
        parts += [pack(plane.tobytes()), pack(ranks.astype("<u4").tobytes())]
    head = MAGIC + struct.pack("<QIH", matrix.n, len(doc_ids), len(matrix.planes)) + struct.pack(f"<{len(matrix.zeros)}Q", *matrix.zeros)
    return head + b"".join(struct.pack("<Q", len(p)) + p for p in parts)


def from_bytes(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    n, docs, width = struct.unpack_from("<QIH", data, 8)
    zeros = list(struct.unpack_from(f"<{width}Q", data, 22))
    at, parts = 22 + 8 * width, []
    for _ in range(1 + 2 * width):
        (size,) = struct.unpack_from("<Q", data, at)
        parts.append(zstandard.ZstdDecompressor().decompress(data[at + 8 : at + 8 + size]) if size else b"")
        at += 8 + size
    if at != len(data):
        raise ValueError("a wavelet-matrix file has bytes after its end")
    ids = np.frombuffer(parts[0], "<i8", docs, docs).tolist()
    doc_ids = [i if known else None for i, known in zip(ids, parts[0][:docs], strict=True)]
    planes = [np.frombuffer(p, np.uint8) for p in parts[1::2]]
    ranks = [np.frombuffer(p, "<u4") for p in parts[2::2]]
    return WaveletMatrix(n, planes, ranks, zeros), doc_ids, np.frombuffer(parts[0], "<u4", docs, 9 * docs)


@lru_cache(maxsize=2)
def _table(path: str) -> UnitTable:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on each core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each token: byte-level vocabularies write a letter for each
    sizes[list(vocabulary.values())] = [len(token) for token in vocabulary]

    def whole(texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Many units are encoded as one text, and its ids parted where the bytes of their tokens come to a unit's end."""
        ends = np.cumsum(pc.binary_length(units).to_numpy(), dtype=np.int64)
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        for i in range(0, len(units), UNITS):
            part, size = units[i : i + UNITS], ends[i : i + UNITS] - (ends[i - 1] if i else 0)
            (row,) = whole([b"".join(part.to_pylist()).decode()])
            held = np.cumsum(sizes[row])
            at = np.searchsorted(held, size)
            if at[-1] == len(row) - 1 and (held[at] == size).all():
                ids.append(row)
                counts.append(np.diff(at, prepend=-1))
            else:
                apart = whole([x.decode() for x in part.to_pylist()])
                ids += apart
                counts.append(np.array([len(x) for x in apart]))
        return np.concatenate(ids), np.concatenate(counts, dtype=np.int32, casting="unsafe")

    return UnitTable(encode, whole, KEPT_UNITS, tuple(x.content for x in tokenizer.get_added_tokens_decoder().values()))


def write_store(df: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 20, task_bytes: int = 32 << 20) -> DataFrame:
    """Encode each text, add ``end_id``, and write wavelet-matrix files in ascending id order; returns their manifest.

    The manifest has a row per file: file, part and nth (which order the files), n_docs,
    n_tokens. Null and empty texts have the end id alone; rows with a null id come first;
    rows with equal ids stay apart, ordered by a hash of their text. An empty table gives
    an empty manifest. A text longer than a shard makes a shard of its own.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(1, -(-total // task_bytes))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie")
    folder = shared_dir(spark, "token-store")
    schema = pa.schema([("file", pa.string()), ("part", pa.int64()), ("nth", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, store = _table(path), pyarrow.fs.FileSystem.from_uri(folder)
        part, nth, held = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            data = to_bytes(WaveletMatrix.of(np.concatenate(ids)), docs, lengths)
            file = f"{store[1]}/shard-{part:07d}-{nth:05d}.wm"
            store[0].create_dir(store[1], recursive=True)
            with store[0].open_output_stream(f"{file}.{TaskContext.get().taskAttemptId()}") as out:
                out.write(data)
            store[0].move(f"{file}.{TaskContext.get().taskAttemptId()}", file)  # whole files only; a task run again writes the same
            return pa.RecordBatch.from_pydict({"file": [file], "part": [part], "nth": [nth], "n_docs": [len(docs)], "n_tokens": [held]}, schema=schema)

        for block in blocks(batches, "text", BLOCK_BYTES):
            row, counts = table.packed(block.column("text"), end_id)
            begin = end = 0
            for doc, n in zip(block.column("id").to_pylist(), counts.tolist(), strict=True):
                if docs and held + n > shard_tokens:
                    ids.append(row[begin:end])
                    yield flush()
                    docs, lengths, ids, held, nth, begin = [], [], [], 0, nth + 1, end
                docs.append(doc)
                lengths.append(n)
                held += n
                end += n
            ids.append(row[begin:])
        if docs:
            yield flush()

    manifest = rows.select("id", "text").mapInArrow(run, "file string, part long, nth long, n_docs long, n_tokens long")
    out = written(manifest, "token-manifest")
    return out.withColumn("folder", F.lit(folder))


def read_store(manifest: DataFrame, end_id: int | None = None, task_tokens: int = 8 << 20) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and token_ids (binary) of every document in the files.

    A shard's ids come out of its planes all at once. With ``end_id``, its rank tables are
    held against that: the id at the end of each document, by access, must be ``end_id``, and
    its count by rank must be that in the ids; else the query fails. A task reads files of
    about ``task_tokens`` ids.
    """
    before = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = parts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    files = (
        manifest.withColumn("inner", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
        .join(base.select("part", "base"), "part")
        .select("folder", "file", (F.col("base") + F.col("inner")).alias("start"))
    )
    total = manifest.agg(F.sum("n_tokens")).first()[0] or 0
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = pyarrow.fs.FileSystem.from_uri(row["folder"])
                with store.open_input_stream(row["file"]) as file:
                    matrix, doc_ids, lengths = from_bytes(file.read())
                ends, ids = np.cumsum(lengths, dtype=np.int64), matrix.ids()
                if end_id is not None:
                    check_ends(matrix, ids, ends, end_id)
                packed = ids.astype("<u4").tobytes()
                starts = ends - lengths
                cut = [packed[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + row["start"]), pa.array(lengths.astype(np.int64)), pa.array(cut, pa.binary())], schema=schema)

    return files.repartition(max(1, -(-total // task_tokens))).mapInArrow(run, "doc_id long, start long, n_tokens long, token_ids binary")


def check_ends(matrix: WaveletMatrix, ids: np.ndarray, ends: np.ndarray, end_id: int) -> None:
    """Raises ValueError unless access gives ``end_id`` where documents end, and rank its count in the ids."""
    if len(ends) and ((matrix.access(ends - 1) != end_id).any() or matrix.count(end_id) != np.count_nonzero(ids == end_id)):
        raise ValueError("a file's rank tables don't lead to its documents' ends")


def summary(spark: SparkSession, documents: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    return read_store(write_store(documents, path, end_id), end_id).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))
