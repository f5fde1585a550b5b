"""Operator 1: byte-level BPE encoding and decoding by corpus-level merge replay.

All distinct pieces of a block of texts are laid end to end as one row of symbols.
An inverted index leads from each merge (the rank of the joined token) to the
positions where it applies. Merges are taken in rank order over the whole row; each
touches only the two neighbours of the place it joins. This gives each piece the
merges, in the order, that encoding it alone would give.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks
from .units import UnitCache

#: Text that is encoded at once, beside one text; and units whose ids a worker keeps.
BLOCK_BYTES, CACHED_UNITS = 2 << 20, 300_000


class MergeTable:
    """Ranks of a vocabulary, and which token two adjacent tokens join to."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.width = max(ranks.values()) + 1
        self.tokens = [b""] * self.width
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes_ = [ranks[bytes([b])] for b in range(256)]
        self.joins: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.joins[a * self.width + b] = rank
        # the rank that two adjacent bytes join to, -1 for none
        self.first = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], dtype=np.int64)

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit) of each of the distinct, non-empty pieces."""
        out: list[bytes | None] = []
        rest: list[bytes] = []
        for piece in pieces:
            rank = self.ranks.get(piece)
            if rank is None:
                out.append(None)
                rest.append(piece)
            else:
                out.append(rank.to_bytes(4, "little"))
        if rest:
            ids = iter(self._merge(rest))
            out = [next(ids) if x is None else x for x in out]
        return out

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        row = b"".join(pieces)
        n = len(row)
        ends = np.cumsum([len(p) for p in pieces])
        sym = list(map(self.bytes_.__getitem__, row))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for e in ends.tolist():
            after[e - 1] = -1
            if e < n:
                before[e] = -1
        raw = np.frombuffer(row, np.uint8)
        joined = self.first[raw[:-1], raw[1:]]
        joined[ends[:-1] - 1] = -1
        at = np.flatnonzero(joined >= 0)
        at = at[np.argsort(joined[at], kind="stable")]
        ranks, starts = np.unique(joined[at], return_index=True)
        index = {r: part.tolist() for r, part in zip(ranks.tolist(), np.split(at, starts[1:]), strict=False)} if len(at) else {}
        heap, find, width = list(index), self.joins.get, self.width
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for k, i in enumerate(places):
                j = after[i]
                if j < 0 or find(sym[i] * width + sym[j]) != rank:
                    continue  # a neighbour was joined since
                sym[i], sym[j] = rank, -1
                q = after[i] = after[j]
                lower = False
                if q >= 0:
                    before[q] = i
                    new = find(rank * width + sym[q])
                    if new is not None:
                        lower |= new < rank
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heapq.heappush(heap, new)
                p = before[i]
                if p >= 0:
                    new = find(sym[p] * width + rank)
                    if new is not None:
                        lower |= new < rank
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heapq.heappush(heap, new)
                if lower:  # an earlier merge applies now: it goes first, the rest of this one waits
                    index.setdefault(rank, []).extend(places[k + 1 :])
                    heapq.heappush(heap, rank)
                    break
        ids = np.array(sym, dtype=np.int64)
        live = ids >= 0
        bound = np.cumsum(live)[ends - 1].tolist()
        packed = ids[live].astype("<u4").tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip([0, *bound], bound, strict=False)]


@lru_cache(maxsize=4)
def load_merges(path: str) -> MergeTable:
    with open(path, "rb") as file:
        return MergeTable({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)})


class WholeTexts:
    """Encodes whole texts by the pattern, for patterns that may join characters across white space."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.packed = encode


@lru_cache(maxsize=4)
def _cache(path: str, pattern: str, cuts_at_space: bool) -> UnitCache | WholeTexts:
    table, find = load_merges(path), regex.compile(pattern).findall

    def encode(texts: list[str]) -> list[bytes]:
        cut = [[piece.encode() for piece in find(text)] for text in texts]
        pieces = list({piece for parts in cut for piece in parts})
        ids = dict(zip(pieces, table.replay(pieces), strict=True))
        return [b"".join(map(ids.__getitem__, parts)) for parts in cut]

    return UnitCache(encode, encode, most=CACHED_UNITS) if cuts_at_space else WholeTexts(encode)


def encode_texts(texts: list[str | None], path: str, pattern: str, cuts_at_space: bool = False) -> list[bytes]:
    return _cache(path, pattern, cuts_at_space).packed([t or "" for t in texts])


def decode_ids(ids: bytes, path: str) -> bytes:
    tokens = load_merges(path).tokens
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, decoded_sha256: bool = False, cuts_at_space: bool = False) -> DataFrame:
    """``id_col`` and ``token_ids`` (binary: little-endian unsigned 32-bit ids) of each row; other columns are left out.

    With ``decoded``, ``decoded`` (binary) has what those ids decode to; with
    ``decoded_sha256``, that column has its digest (hex). Null and empty texts give no ids.
    Equal rows give equal rows, an empty table gives none, nothing is shuffled, and a text
    of any length is one row. ``path``: a rank file, on every executor. ``cuts_at_space``
    says that the pattern never joins a character with white space after it, and at most one
    space with what follows; runs of other characters are then looked up, which is faster.
    """
    extra = [("decoded", pa.binary(), "binary")] * decoded + [("decoded_sha256", pa.string(), "string")] * decoded_sha256
    schema = pa.schema([pa.field(id_col, pa.int64()), pa.field("token_ids", pa.binary()), *[pa.field(n, t) for n, t, _ in extra]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            ids = encode_texts(block.column("text").to_pylist(), path, pattern, cuts_at_space)
            data = [block.column("id").cast(pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                data.append(pa.array([decode_ids(x, path) for x in ids], pa.binary()))
            if decoded_sha256:
                data.append(pa.array([hashlib.sha256(decode_ids(x, path)).hexdigest() for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(data, schema=schema)

    kinds = ", ".join([f"`{id_col}` long, token_ids binary", *[f"{n} {t}" for n, _, t in extra]])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, kinds)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``id_col`` and ``decoded`` (binary) of rows that ``encode`` gave; null ids decode to nothing."""
    schema = pa.schema([(id_col, pa.int64()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "ids"):
            data = [decode_ids(x or b"", path) for x in block.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("id").cast(pa.int64()), pa.array(data, pa.binary())], schema=schema)

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"{id_col} long, decoded binary")


def digests(df: DataFrame, path: str, pattern: str, cuts_at_space: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``documents``."""
    return encode(df, path, pattern, decoded_sha256=True, cuts_at_space=cuts_at_space).select(
        "doc_id",
        F.floor(F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        "decoded_sha256",
    )
