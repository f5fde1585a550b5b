"""Operator 5: removing repeated byte strings with longest-previous-factor arrays, in shards.

What must go are the bytes covered by a string of ``length`` bytes that also starts in a
document with a smaller id. Every such string holds an anchor: the place whose 20 bytes
hash lowest among its own; equal strings have equal anchors at equal places, so all
copies of a string meet under its anchor's hash. First only hashes are exchanged, to find
anchors of more than one document. Then these meet with the bytes around them: there a
suffix array over the bytes, the common prefixes of its neighbours, and for each suffix
the previous and next of a smaller document in suffix order give the longest previous
factor, as a number of bytes; where it reaches ``length``, an earlier document has the
string. Of rows with equal bytes only the first is laid out: the others' factors reach
the end of the row.

Documents are dealt to shards by a hash of their id. A string that a large part of the
corpus shares costs one row a shard in the first exchange and, with equal bytes around
it, in the second.

An anchor with many surroundings would fill a task by itself. Its strings are looked up
one by one: each shard keeps the smallest id of each of its distinct strings, and these
meet by a hash of the whole string, a row a shard at most, where their bytes are compared.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, LongType, MapType, StructField, StructType

from .common import quoted, release
from .suffixes import common_prefix, previous_factors, suffix_array

GRAM = 20
SHARD_BYTES = 8 << 20
#: Bytes hashed at once, beside the longest text.
STRETCH = 1 << 19
#: Anchors with more surroundings than this (equal ones of a shard count once) have their strings looked up one by one; and of those strings, how many at once.
MANY, AT_ONCE = 5_000, 1 << 20
#: Anchors whose bytes are laid out at once, and rows that meet at once (all of one anchor, at least).
ANCHORS, ROWS = 1 << 15, 1 << 16
_POWER = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 28) - 1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _POWER, np.uint64)
    down = np.full(n, pow(_POWER, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def totals(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the bytes' values before each place, and what makes a difference of two independent of its place."""
    size = max(STRETCH * 2, 1 << (len(row) - 1).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(row) + 1, np.uint64)
    np.cumsum(_BYTES[row] * up[: len(row)], out=total[1:])
    return total, down


def anchors(row: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, first_string: int = 0, last_string: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes (of GRAM bytes) and hashes of the surroundings of the anchors of all ``length``-byte strings inside the texts row[start:end].

    With first_string and last_string, only of strings that start from the first on and before the last.
    """
    width = length - GRAM + 1
    if len(row) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    total, down = totals(row)
    hashes = mixed((total[GRAM:] - total[:-GRAM]) * down[: len(row) - GRAM + 1])
    low = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)  # the first of equal hashes is lower
    have = 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    inside = np.zeros(len(row) + 1, np.int32)
    some = ends - starts >= length
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, ends[some] - length + 1, -1)
    wanted = np.cumsum(inside[: len(low)]) > 0
    wanted[:first_string] = False
    if last_string is not None:
        wanted[last_string:] = False
    place = (low[wanted] & _PLACE).astype(np.int64)
    place = place[np.r_[True, place[1:] != place[:-1]]] if len(place) else place
    doc = np.searchsorted(ends, place, side="right")
    first, last = np.maximum(starts[doc], place - (length - GRAM)), np.minimum(ends[doc], place + length)
    edge = (place - first) * 512 + last - place
    return place, hashes[place], mixed((total[last] - total[first]) * down[first] + edge.astype(np.uint64) * np.uint64(_POWER))


def anchors_of_long(text: bytes, length: int, stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchors() of a text of more than ``stretch`` bytes, some strings at a time."""
    found = []
    for a in range(0, len(text) - length + 1, stretch):
        base, end = max(0, a - length), min(len(text), a + stretch + 2 * length)
        row = np.frombuffer(text, np.uint8, end - base, base)
        place, hashes, around = anchors(row, np.array([0]), np.array([len(row)]), length, a - base, a + stretch - base)
        place = place + base
        new = place > found[-1][0][-1] if found and len(found[-1][0]) else np.ones(len(place), bool)  # the last may be the next's first
        found.append((place[new], hashes[new], around[new]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Shard:
    """The documents of a shard end to end, by id and then text."""

    def __init__(self, table: pa.Table):
        release()  # what the group before left
        ids = table.column("id").to_pylist()
        texts = [x.as_buffer() if x.is_valid else b"" for chunk in table.column("body").chunks for x in chunk]
        texts = [bytes(x) for x in texts]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in self.order], np.int64)
        self.texts = [texts[i] for i in self.order]
        self.ends = np.cumsum([len(t) for t in self.texts])
        self.starts = self.ends - np.array([len(t) for t in self.texts], np.int64)

    def anchors(self, length: int, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places (in the whole shard), hashes, documents and surroundings' hashes of all anchors, some texts at a time."""
        places, hashes, around, first = [], [], [], 0

        def add(base: int, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
            places.append(found[0] + base)
            hashes.append(found[1])
            around.append(found[2])

        for i in range(1, len(self.texts) + 1):
            base = self.starts[first]
            if len(self.texts[i - 1]) > stretch:
                if i - 1 > first:
                    row = np.frombuffer(b"".join(self.texts[first : i - 1]), np.uint8)
                    add(base, anchors(row, self.starts[first : i - 1] - base, self.ends[first : i - 1] - base, length))
                add(self.starts[i - 1], anchors_of_long(self.texts[i - 1], length, stretch))
                first = i
            elif i == len(self.texts) or self.ends[i - 1] - base >= stretch:
                row = np.frombuffer(b"".join(self.texts[first:i]), np.uint8)
                add(base, anchors(row, self.starts[first:i] - base, self.ends[first:i] - base, length))
                first = i
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        doc = np.searchsorted(self.ends, place, side="right")
        none = [np.zeros(0, np.uint64)]
        return place, np.concatenate(hashes or none), doc, np.concatenate(around or none)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as planes of equally significant bytes, compressed."""
    out = [struct.pack("<H", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(-1, a.dtype.itemsize).T if a.ndim == 1 else a
        out += [struct.pack("<10sQQ", a.dtype.str.encode(), len(a), a.shape[1] if a.ndim == 2 else 0), np.ascontiguousarray(planes).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    (count,), at, out = struct.unpack_from("<H", data), 2, []
    for _ in range(count):
        kind, n, columns = struct.unpack_from("<10sQQ", data, at)
        kind = np.dtype(kind.rstrip(b"\0").decode())
        size = n * (columns or 1) * kind.itemsize
        planes = np.frombuffer(data, np.uint8, size, at + 26)
        out.append(planes.reshape(n, columns) if columns else np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).reshape(-1).view(kind))
        at += 26 + size
    return out


def short_hash(hashes: np.ndarray) -> np.ndarray:
    """48 bits; what only these join is told apart by its bytes later."""
    return hashes >> np.uint64(16)


def _by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Order of the hashes by bucket and value, the ordered hashes, and (bucket, start, end) of each bucket that has some."""
    if not len(hashes):
        return np.zeros(0, np.int64), hashes, []
    bucket = hashes % np.uint64(buckets)
    order = np.lexsort((hashes, bucket))
    bucket = bucket[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(order) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(order)]
    return order, hashes[order], list(zip(bucket[starts].tolist(), starts.tolist(), ends.tolist(), strict=True))


def _sketch(shard: Shard, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors (place, short hash, document), and the distinct short hashes with whether two documents have them and how many surroundings of them go on (65,535 at most)."""
    place, hashes, doc, around = shard.anchors(length)
    short = short_hash(hashes)
    order = np.lexsort((around, short))
    s, ids = short[order], shard.ids[doc[order]]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts) if len(s) else np.zeros(0, bool)
    # as in contexts(): of equal surroundings, only those of the first document
    a = around[order]
    head = np.maximum.accumulate(np.where(np.r_[True, (s[1:] != s[:-1]) | (a[1:] != a[:-1])], np.arange(len(s)), 0)) if len(s) else starts
    times = np.minimum(np.add.reduceat(ids == ids[head], starts, dtype=np.int64), 65_535).astype(np.uint16) if len(s) else np.zeros(0, np.uint16)
    return place, short, doc, s[starts], several, times


def shared_anchors(shards: DataFrame, length: int, buckets: int, many: int = MANY) -> DataFrame:
    """shard, bucket, bits, often: which of the shard's distinct hashes in the bucket, ascending, more than one document has, and places of those with more than ``many`` surroundings."""

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, _, _, distinct, several, times = _sketch(Shard(table), length)
        order, distinct, cuts = _by_bucket(distinct, buckets)
        several, times = several[order], times[order]
        rows = [(key[0].as_py(), b, pack(np.diff(distinct[i:j] // np.uint64(buckets), prepend=np.uint64(0)), several[i:j].view(np.uint8), times[i:j])) for b, i, j in cuts]
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([r[1] for r in rows], pa.int64()), "data": pa.array([r[2] for r in rows], pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        release()
        hashes, several, times = zip(*[unpack(x.as_py()) for x in table.column("data")], strict=True)
        sizes = [len(h) for h in hashes]
        every = np.concatenate([np.cumsum(h) for h in hashes])
        order = np.argsort(every, kind="stable")
        value = every[order]
        same = value[1:] == value[:-1]
        wanted = np.zeros(len(every), bool)
        wanted[order] = np.r_[False, same] | np.r_[same, False]
        wanted |= np.concatenate(several).astype(bool)
        starts = np.flatnonzero(np.r_[True, ~same])
        total = np.add.reduceat(np.concatenate(times)[order].astype(np.int64), starts)
        often = np.zeros(len(every), bool)
        often[order] = np.repeat(total > many, np.diff(np.r_[starts, len(every)]))
        often &= wanted
        bits = [np.packbits(x).tobytes() for x in np.split(wanted, np.cumsum(sizes)[:-1])]
        found = [pack(np.flatnonzero(x)) for x in np.split(often, np.cumsum(sizes)[:-1])]
        return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary()), "often": pa.array(found, pa.binary())})

    sent = shards.groupBy("shard").applyInArrow(send, "shard long, bucket long, data binary")
    return sent.groupBy("bucket").applyInArrow(meet, "shard long, bucket long, bits binary, often binary")


def _windows(place: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings inside their text that hold the anchor."""
    return np.maximum(start, place - (length - GRAM)), np.minimum(end - length, place)


def _runs(doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of the spans that strings at these starts (ascending) make."""
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)] if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)][: len(first)] - 1
    return doc[first].astype(np.uint32), start[first].astype(np.uint32), (start[last] + length).astype(np.uint32)


def frequent_strings(shard: Shard, place: np.ndarray, doc: np.ndarray, length: int, cells: int) -> list[tuple[int, bytes]]:
    """Rows (bucket, data) of the strings that hold these anchors: -1 for spans that go, as the shard has an earlier one, else -2 less a cell."""
    row = np.frombuffer(b"".join(shard.texts), np.uint8)
    low, high = _windows(place, shard.starts[doc], shard.ends[doc], length)
    mark = np.zeros(len(row) + 1, np.int32)
    np.add.at(mark, low, 1)
    np.add.at(mark, high + 1, -1)
    every = np.flatnonzero(np.cumsum(mark[:-1], out=mark[:-1]) > 0)
    weights = np.random.default_rng(11).integers(0, 1 << 63, length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    hashes = np.zeros(len(every), np.uint64)
    for i in range(0, len(every), AT_ONCE):
        for k in range(length):
            hashes[i : i + AT_ONCE] += row[every[i : i + AT_ONCE] + k] * weights[k]
    hashes = mixed(hashes)
    cell = (hashes % np.uint64(cells)).astype(np.int64)
    rows: list[tuple[int, bytes]] = []
    gone = np.zeros(len(every), bool)
    passes = -(-len(every) // AT_ONCE)
    for q in range(passes):
        some = np.flatnonzero(cell % passes == q)
        some = some[np.lexsort((hashes[some], cell[some]))]  # stable: equal strings by id
        if not len(some):
            continue
        at, h = every[some], hashes[some]
        owner = np.searchsorted(shard.ends, at, side="right")
        head = np.maximum.accumulate(np.where(np.r_[True, h[1:] != h[:-1]], np.arange(len(h)), 0))
        same = np.ones(len(h), bool)
        for k in range(length):
            same &= row[at + k] == row[at[head] + k]
        later = same & (shard.ids[owner] > shard.ids[owner[head]])
        gone[some[later]] = True
        x = np.flatnonzero(~later)
        named = (x == head[x]) | ~same[x]  # strings of their own; the others are their head's once more
        index = np.where(named, np.cumsum(named) - 1, 0)
        of_head = np.zeros(len(h), np.int64)
        of_head[x[named]] = index[named]
        index = np.where(named, index, of_head[head[x]])
        c = cell[some[x]]
        cuts = np.flatnonzero(np.r_[True, c[1:] != c[:-1], True])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part, own = x[i:j], x[i:j][named[i:j]]
            strings = row[at[own][:, None] + np.arange(length)]
            start = at[part] - shard.starts[owner[part]]
            rows.append((-2 - int(c[i]), pack(strings, shard.ids[owner[own]], (index[i:j] - index[i]).astype(np.uint32), owner[part].astype(np.uint32), start.astype(np.uint32))))
    if gone.any():
        owner = np.searchsorted(shard.ends, every[gone], side="right")
        rows.append((-1, pack(*_runs(owner, every[gone] - shard.starts[owner], length))))
    return rows


def earlier_frequent(table: pa.Table, length: int) -> pa.Table:
    """shard, data: spans of the strings sent to one cell of which a document of another shard has a smaller id."""
    parts = [unpack(x.as_py()) for x in table.column("data")]
    strings, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((ids, np.ascontiguousarray(strings).view(f"S{length}").ravel()))
    head = np.r_[True, (strings[order][1:] != strings[order][:-1]).any(axis=1)]
    least = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    gone = np.zeros(len(order), bool)
    gone[order] = ids[order] > ids[least]
    rows, base = [], 0
    for shard, (_, own, index, doc, start) in zip(table.column("shard").to_pylist(), parts, strict=True):
        x = np.flatnonzero(gone[base + index.astype(np.int64)])
        base += len(own)
        if len(x):
            x = x[np.lexsort((start[x], doc[x]))]
            rows.append((shard, pack(*_runs(doc[x].astype(np.int64), start[x].astype(np.int64), length))))
    return _spans(rows)


def _spans(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"shard": pa.array([r[0] for r in rows], pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary())})


def contexts(shards: DataFrame, shared: DataFrame, length: int, buckets: int) -> DataFrame:
    """bucket, shard, data: the bytes around shared anchors; or bucket -1: spans known to go, as equal bytes stand in an earlier document of the shard; or below: strings of frequent anchors."""
    left, right = length - GRAM, length

    def send(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        shard, number = Shard(table), key[0].as_py()
        place, short, doc, distinct, _, _ = _sketch(shard, length)
        _, distinct, cuts = _by_bucket(distinct, buckets)
        bits = {b: np.frombuffer(x.as_buffer(), np.uint8) for b, x in zip(told.column("bucket").to_pylist(), told.column("bits"), strict=True)}
        keep = np.concatenate([np.unpackbits(bits[b], count=j - i) for b, i, j in cuts]).astype(bool) if cuts else np.zeros(0, bool)
        wanted = np.sort(distinct[keep])
        at = np.searchsorted(wanted, short)
        hit = (at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == short) if len(wanted) else np.zeros(len(short), bool)
        place, short, doc = place[hit], short[hit], doc[hit]
        starts = {b: i for b, i, _ in cuts}
        often = [distinct[starts[b] + unpack(x.as_py())[0]] for b, x in zip(told.column("bucket").to_pylist(), told.column("often"), strict=True)]
        often = np.isin(short, np.concatenate(often)) if often else np.zeros(len(short), bool)
        rows = frequent_strings(shard, place[often], doc[often], length, 4 * buckets) if often.any() else []
        place, short, doc = place[~often], short[~often], doc[~often]
        if len(place):
            start, end = shard.starts[doc], shard.ends[doc]
            row = np.frombuffer(b"".join([bytes(left), *shard.texts, bytes(right)]), np.uint8)
            windows, offset = np.lib.stride_tricks.sliding_window_view(row, left + right), np.arange(-left, right)
            low, high = _windows(place, start, end, length)
            edge = np.stack([low - place + left, high - place + left], axis=1).astype(np.uint8)

            def around(x: np.ndarray) -> np.ndarray:
                """The bytes around these anchors, a row each; 0 outside their text."""
                return windows[place[x]] * ((offset >= (start - place)[x, None]) & (offset < (end - place)[x, None]))

            # of equal surroundings in the shard, those of the first document go on; later documents' strings all go
            weights = np.random.default_rng(7).integers(0, 1 << 63, left + right + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            total = short * np.uint64(_POWER)
            for i in range(0, len(place), ANCHORS):
                x = np.arange(i, min(len(place), i + ANCHORS))
                columns = np.concatenate([around(x), edge[x]], axis=1).T.copy()
                for k, column in enumerate(columns):
                    total[x] += column * weights[k]
            order = np.lexsort((place, total))
            group = np.r_[True, total[order][1:] != total[order][:-1]]
            first = order[np.maximum.accumulate(np.where(group, np.arange(len(order)), 0))]
            later = shard.ids[doc[order]] > shard.ids[doc[first]]
            maybe = np.flatnonzero(later)
            for i in range(0, len(maybe), ANCHORS):
                x, y = order[maybe[i : i + ANCHORS]], first[maybe[i : i + ANCHORS]]
                later[maybe[i : i + ANCHORS]] = (around(x) == around(y)).all(axis=1) & (edge[x] == edge[y]).all(axis=1)
            gone = order[later]
            if len(gone):
                rows.append((-1, pack(doc[gone].astype(np.uint32), (low - start)[gone].astype(np.uint32), (high - start + length)[gone].astype(np.uint32))))
            sent = np.sort(order[~later])
            by, _, cuts = _by_bucket(short[sent], buckets)
            sent = sent[by]
            for b, i, j in cuts:
                x = sent[i:j]
                rows.append((b, pack(short[x], shard.ids[doc[x]], doc[x].astype(np.uint32), (place - start)[x].astype(np.uint32), edge[x], around(x))))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "shard": pa.array([number] * len(rows), pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary())})

    return shards.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(send, "bucket long, shard long, data binary")


def row_factors(around: np.ndarray, edge: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each row of surroundings and each start in it, the longest previous factor: bytes from there that also stand in a row of a smaller id.

    Suffix array over all rows end to end, each with ends of its own. Factors under
    ``length`` and starts outside the row's strings (``edge``) count as 0.
    """
    n, wide = around.shape
    edge, place, end = edge.astype(np.int64), np.arange(wide), 256 + np.arange(n)[:, None]
    inside = (place >= edge[:, :1]) & (place < edge[:, 1:] + length)  # of the text: a zero byte is no end
    row = np.concatenate([np.where(inside, around, end), end], axis=1).reshape(-1)
    order, _, levels = suffix_array(row, 1 << (wide - 1).bit_length())
    shared = np.zeros(len(order), np.int64)
    level = levels[-1 if len(levels) < 6 else 5]
    tied = np.flatnonzero(level[order[1:]] == level[order[:-1]]) + 1
    shared[tied] = common_prefix(order[tied - 1], order[tied], levels)
    run = np.r_[False, (shared >= length)[1:]]
    out = np.zeros(len(row), np.int64)
    starts = np.flatnonzero(~run & np.r_[run[1:], False])
    stops = np.flatnonzero(run & ~np.r_[run[1:], False]) + 1
    owner = ids[order // (wide + 1)]
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        docs = owner[a:b]
        if docs.min() < docs.max():
            out[order[a:b]] = previous_factors(docs.tolist(), shared[a:b].tolist())
    out = out.reshape(n, wide + 1)[:, : wide - length + 1]
    start = np.arange(out.shape[1])
    return np.where((out >= length) & (start >= edge[:, :1]) & (start <= edge[:, 1:]), out, 0)


def met_factors(short: np.ndarray, ids: np.ndarray, edge: np.ndarray, around: np.ndarray, length: int) -> np.ndarray:
    """Of rows that meet, each start's longest previous factor among rows of the same anchor hash; see row_factors()."""
    left, bounds = around.shape[1] - length, edge.astype(np.int64)
    start = np.arange(left + 1)
    factors = np.zeros((len(short), left + 1), np.int64)
    # of equal surroundings the smallest id is laid out; those of the others go on to the end of the row
    key = np.concatenate([np.ascontiguousarray(short.astype(">u8")).view(np.uint8).reshape(-1, 8), edge, around], axis=1)
    order = np.lexsort((ids, np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel()))
    first = np.r_[True, (key[order][1:] != key[order][:-1]).any(axis=1)]
    head_of = np.empty(len(order), np.int64)
    head_of[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    heads = order[first]
    heads = heads[np.argsort(short[heads], kind="stable")]
    s = short[heads]
    cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
    batch: list[np.ndarray] = []
    size = 0
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a > 1:
            batch.append(heads[a:b])
            size += b - a
        if size > 8_000 or (b == len(heads) and size):
            x = np.concatenate(batch)
            factors[x] = row_factors(around[x], edge[x], ids[x], length)
            batch, size = [], 0
    factors = factors[head_of]  # the smallest id may have them more than once
    inside = (start >= bounds[:, :1]) & (start <= bounds[:, 1:])
    return np.where((ids > ids[head_of])[:, None] & inside, bounds[:, 1:] + length - start, factors)


def met_spans(table: pa.Table, length: int) -> pa.Table:
    """shard, data: spans to remove of the rows that meet in one bucket."""
    left = length - GRAM
    parts = [unpack(x.as_py()) for x in table.column("data")]
    short, ids, doc, place, edge, around = (np.concatenate(x) for x in zip(*parts, strict=True))
    shard = np.repeat(table.column("shard").to_numpy(), [len(p[0]) for p in parts])
    del parts
    slices = -(-len(short) // ROWS)
    found: list[tuple[np.ndarray, ...]] = []
    turn = mixed(short.copy()) % np.uint64(slices)
    for q in range(slices):  # all rows of an anchor hash are in one slice
        some = np.flatnonzero(turn == q)
        if not len(some):
            continue
        at, k = np.nonzero(met_factors(short[some], ids[some], edge[some], around[some], length) >= length)
        # starts next to each other are one span
        new = np.r_[True, (at[1:] != at[:-1]) | (k[1:] != k[:-1] + 1)] if len(at) else np.zeros(0, bool)
        first, last = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(at)] - 1
        x = some[at[first]]
        begin = place[x].astype(np.int64) - left
        found.append((shard[x], doc[x], (begin + k[first]).astype(np.uint32), (begin + k[last] + length).astype(np.uint32)))
    rows = []
    if found:
        of, d, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.r_[True, of[by][1:] != of[by][:-1]]) if len(by) else np.zeros(0, np.int64)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)], strict=False):
            x = by[a:b]
            rows.append((int(of[x[0]]), pack(d[x], begin[x], end[x])))
    return _spans(rows)


def earlier_spans(sent: DataFrame, length: int) -> DataFrame:
    """shard, data: spans to remove, as document (its place in the shard), start and end.

    All that contexts() sent goes through one exchange: it is on disk once, and neither it
    nor the documents' exchange is made anew for each kind of row.
    """

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        release()
        bucket = key[0].as_py()
        if bucket == -1:
            return table.select(["shard", "data"])
        return met_spans(table, length) if bucket >= 0 else earlier_frequent(table, length)

    apart = F.when(F.col("bucket") == -1, F.col("shard")).otherwise(F.lit(0).cast("long"))  # spans known to go needn't meet
    return sent.withColumn("apart", apart).groupBy("bucket", "apart").applyInArrow(meet, "shard long, data binary")


def nullable(kind: pa.DataType) -> pa.DataType:
    """The type with every field and element nullable, as loose() declares it."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(kind.field(i).name, nullable(kind.field(i).type)) for i in range(kind.num_fields)])
    if pa.types.is_list(kind):
        return pa.list_(nullable(kind.value_type))
    if pa.types.is_map(kind):
        return pa.map_(kind.key_type, nullable(kind.item_type))
    return kind


def loose(kind: DataType) -> DataType:
    """The type with every field and element nullable."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, loose(f.dataType)) for f in kind])
    if isinstance(kind, ArrayType):
        return ArrayType(loose(kind.elementType))
    if isinstance(kind, MapType):
        return MapType(kind.keyType, loose(kind.valueType))
    return kind


def widened(text: bytes, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans with the rest of the characters that they cut, not overlapping."""
    out, last = [], 0
    for a, b in pairs:
        while a > last and text[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        a, last = max(a, last), max(b, last)
        if last > a:
            out.append((a, last))
    return out


def cut_texts(shards: DataFrame, spans: DataFrame, whole: bool = False) -> DataFrame:
    """The rows of shards without body, plus n_bytes, spans (start and end of each maximal removed run) and kept (binary; ``whole``: of whole characters)."""
    names = [c for c in shards.columns if c != "body"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        shard = Shard(table)
        removed = np.zeros(int(shard.ends[-1]) + 1 if len(shard.ends) else 1, np.int32)
        for x in told.column("data"):
            doc, start, end = unpack(x.as_py())
            np.add.at(removed, shard.starts[doc] + start, 1)
            np.add.at(removed, shard.starts[doc] + end, -1)
        gone = np.cumsum(removed[:-1], out=removed[:-1]) > 0
        kept, found = [], []
        for text, start, end in zip(shard.texts, shard.starts.tolist(), shard.ends.tolist(), strict=True):
            edges = np.flatnonzero(np.diff(np.r_[False, gone[start:end], False].astype(np.int8))).tolist()
            pairs = list(zip(edges[::2], edges[1::2], strict=True))
            found.append([{"start": i, "end": j} for i, j in pairs])
            cuts = widened(text, pairs) if whole else pairs
            kept.append(b"".join(text[i:j] for i, j in zip([0, *[b for _, b in cuts]], [*[a for a, _ in cuts], len(text)], strict=True)) if cuts else text)
        out = table.select(names).take(pa.array(shard.order, pa.int64()))
        out = out.cast(pa.schema([(f.name, nullable(f.type)) for f in out.schema]))
        out = out.append_column("n_bytes", pa.array([len(t) for t in shard.texts], pa.int64()))
        return out.append_column("spans", pa.array(found, span)).append_column("kept", pa.array(kept, pa.binary()))

    fields = [StructField(f.name, loose(f.dataType)) for f in shards.schema if f.name != "body"]
    spans_kind = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
    kind = StructType([*fields, StructField("n_bytes", LongType()), StructField("spans", spans_kind), StructField("kept", BinaryType())])
    return shards.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(cut, kind)


def repeats_removed(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", whole: bool = False, many: int = MANY) -> DataFrame:
    """``row`` (a struct of all columns but the text), n_bytes, spans and kept (the text's remaining bytes) of each row.

    A byte goes if a ``length``-byte string that covers it also starts in a row with a smaller
    id; strings don't cross rows and are judged on the input. Null texts are empty; texts
    under ``length`` bytes keep all. Rows with equal ids don't shorten each other; a null id is
    above all others. An empty table gives no rows. ``length`` is 32 to 200. With ``whole``,
    kept is without the characters that lost some of their bytes.
    """
    if not 32 <= length <= 200:
        raise ValueError("length must be 32 to 200")
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    count = max(16, -(-total // SHARD_BYTES))
    others = [F.col(quoted(c)) for c in df.columns if c != text_col]
    shards = df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"),
        F.struct(*others).alias("row"),
        F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("body"),
    ).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(count)).cast("long"))
    buckets = max(8, count // 2)
    shared = shared_anchors(shards, length, buckets, many)
    spans = earlier_spans(contexts(shards, shared, length, buckets), length)
    return cut_texts(shards, spans, whole).drop("shard", "id")


def deduplicated(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with repeats cut out of its texts; a character that lost some of its bytes goes whole, n_chars (if there) is set anew."""
    out = repeats_removed(df, length, id_col, text_col, whole=True)
    text = F.col("kept").cast("string")
    cols = []
    for name in df.columns:
        if name == text_col:
            cols.append(text.alias(name))
        elif name == "n_chars":
            cols.append(F.length(text).cast("long").alias(name))
        else:
            cols.append(F.col("row").getField(name).alias(name))
    return out.select(*cols)


def report(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``documents``."""
    out = repeats_removed(documents.select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = 50) -> list[tuple[int, int, int, int, str]]:
    """What report() gives, by looking up every string: for tests."""
    data = [(i, (t or "").encode()) for i, t in rows]
    least: dict[bytes, int] = {}
    for i, t in data:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            least[s] = min(i, least.get(s, i))
    out = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if least[t[p : p + length]] < i:
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((i, len(t), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return out
