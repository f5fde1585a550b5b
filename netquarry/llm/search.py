"""Operator 11: ranked lexical search over a tiered index of the documents.

The index is a table with a row for each term of each shard, a run of documents of a few MB.
The row holds the term's postings there (document, impact) from the highest impact down in
three tiers, each in columns of its own, and for each tier the residual bound: the highest
impact below it. An impact is what one occurrence count adds before it is weighted, so a score is
a sum of weights times impacts.

A search reads the first tier of all shards. What it has found are lower bounds of scores,
and the tenth highest of an item is a threshold; lower bound and residual bounds together
are an upper bound of every document, found or not. Where no document that isn't known
exactly can reach the threshold, an item is proven in a shard; where one can, the item falls
through to the shard's next tier, and last to all postings. So results are exact, and the
columns of the last tier are read only for shards in which some item needs them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, quoted, release, written
from .decontam import TABLE

#: Text of a shard; the postings of a term in its first tier, and in the first two together.
SHARD_BYTES, TIERS = 2 << 20, (4, 32)
TOP = 10
#: Item text that is with the driver and the executors at once, and sums of a shard that are held at once.
BLOCK_BYTES, SUMS = 4 << 20, 4 << 20
#: Shards of which the last tier is read alone; if more need it, it is read of all. So many ids are 8 MB at most.
DEEP_SHARDS = 1_000_000
#: Maximal runs of digits, letters and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PART = 1 << 20

INTS = pa.list_(pa.int32())
FIELDS = [("shard", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("ids", pa.list_(pa.int64()))]
FIELDS += [(f"{name}{t}", INTS) for t in (1, 2, 3) for name in ("docs", "impacts")] + [("rest1", pa.int32()), ("rest2", pa.int32())]
SCHEMA = ", ".join(f"{n} {pa_type}" for n, pa_type in [("shard", "bigint"), ("term", "string"), ("df", "int"), ("ids", "array<bigint>"), *[(n, "array<int>") for n, kind in FIELDS if kind == INTS], ("rest1", "int"), ("rest2", "int")])


class Vocabulary(dict):
    """Codes of terms, in order of their first use."""

    def __missing__(self, term: bytes) -> int:
        code = self[term] = len(self)
        return code


def term_parts(text: str | None) -> Iterator[list[bytes]]:
    """A text's terms part by part, so that a long text isn't held as words all at once."""
    data, at = (text or "").encode().translate(TABLE), 0
    while at < len(data):
        end = data.find(b" ", at + PART)
        yield data[at : end if end >= 0 else len(data)].split()
        at = end if end >= 0 else len(data)


def term_codes(text: str | None, vocabulary: Vocabulary) -> np.ndarray:
    """The codes of a text's terms."""
    return np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)) for words in term_parts(text))])


def impact(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What tf occurrences in a document of n terms add, before the term's weight: up to 1,000,000."""
    m = 25 + (75 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def shard_rows(key: int, ids: list, texts: list, documents: int, terms: int, tiers: tuple[int, int] = TIERS) -> pa.RecordBatch:
    """A shard's rows of the index: one without a term that has the ids of its documents, in their order, and one a term."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    ids = [ids[i] for i in order]
    vocabulary = Vocabulary()
    codes = [term_codes(texts[i], vocabulary) for i in order]
    n, v = np.array([len(c) for c in codes], np.int64), len(vocabulary)
    pairs, tf = np.unique(np.repeat(np.arange(len(n)), n) * max(1, v) + np.concatenate(codes), return_counts=True)
    doc, code = pairs // max(1, v), pairs % max(1, v)
    worth = impact(tf, n[doc], documents, terms)
    order = np.lexsort((doc, -worth, code))
    doc, code, worth = doc[order].astype(np.int32), code[order], worth[order].astype(np.int32)
    df = np.bincount(code, minlength=v)
    first = np.cumsum(df) - df
    place = np.arange(len(code)) - first[code]
    tier = 1 + (place >= tiers[0]) + (place >= tiers[1])
    row = {"shard": pa.array(np.full(v + 1, key)), "term": pa.array(["", *(t.decode() for t in vocabulary)]), "df": pa.array(np.r_[0, df].astype(np.int32)), "ids": pa.array([ids, *[None] * v], pa.list_(pa.int64()))}
    for t in (1, 2, 3):
        own = tier == t
        ends = np.r_[0, 0, np.cumsum(np.bincount(code[own], minlength=v))].astype(np.int32)
        row |= {f"docs{t}": pa.ListArray.from_arrays(ends, pa.array(doc[own])), f"impacts{t}": pa.ListArray.from_arrays(ends, pa.array(worth[own]))}
    for t in (1, 2):
        rest = np.zeros(v + 1, np.int32)
        more = np.flatnonzero(df > tiers[t - 1])
        rest[more + 1] = worth[first[more] + tiers[t - 1]]
        row[f"rest{t}"] = pa.array(rest)
    return pa.RecordBatch.from_arrays([row[n] for n, _ in FIELDS], schema=pa.schema(FIELDS))


@dataclass
class Index:
    """Documents with a term, the terms of all of them, and the shards' rows."""

    documents: int
    terms: int
    shards: DataFrame


def sliced(batch: pa.RecordBatch, rows: int = 5_000) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts have a term, and how many terms they have."""
    count = total = 0
    for block in blocks(batches, "text", SHARD_BYTES):
        n = [sum(map(len, term_parts(t))) for t in block.column("text").to_pylist()]
        count, total = count + sum(1 for x in n if x), total + sum(n)
    yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([total])], names=["documents", "terms"])


def build(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, tiers: tuple[int, int] = TIERS) -> Index:
    """Index all documents: one pass counts terms, one makes shards of whatever documents follow each other.

    Nothing is shuffled. Every row is a document, rows of one id too; texts without terms,
    null ones too, are never found; ids are whole numbers, or null. Other columns
    aren't read. A text longer than a shard is a shard by itself.
    """
    rows = documents.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    count, total = rows.select("text").mapInArrow(_sizes, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    count, total = int(count or 0), int(total or 0)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, k = TaskContext.get(), 0
        start = (context.partitionId() if context else 0) << 32
        ids, texts, size = [], [], 0
        for block in blocks(batches, "text", shard_bytes):
            for i, text in zip(block.column("id").to_pylist(), block.column("text").to_pylist(), strict=True):
                text = text or ""
                if size and size + len(text) > shard_bytes:
                    yield from sliced(shard_rows(start + k, ids, texts, count, total, tiers))
                    ids, texts, size, k = [], [], 0, k + 1
                ids.append(i)
                texts.append(text)
                size += len(text)
        if texts:
            yield from sliced(shard_rows(start + k, ids, texts, count, total, tiers))
        release()

    return Index(count, total, written(rows.mapInArrow(shards, SCHEMA), "search-index"))


@dataclass
class Block:
    """Items that are searched together, as triples: item, term, and how much an impact of that term counts for that item."""

    terms: int
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    size: int


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _looked_up(index: Index, vocabulary: DataFrame) -> DataFrame:
    """The rows of a block's terms, by their places in its vocabulary; the ids' rows have -1."""
    return index.shards.join(F.broadcast(vocabulary), "term")


def _block(index: Index, texts: list[str]) -> tuple[Block, DataFrame]:
    """The block, and the table of its terms (of items of a bounded size)."""
    counts = [Counter(w for part in term_parts(t) for w in part) for t in texts]
    terms = sorted({w for c in counts for w in c})
    vocabulary = index.shards.sparkSession.createDataFrame([("", -1), *((w.decode(), k) for k, w in enumerate(terms))], "term string, code int")
    df = {r["code"]: r["df"] for r in _looked_up(index, vocabulary).where("code >= 0").groupBy("code").agg(F.sum("df").alias("df")).collect()}  # a row a term of the block
    place = {w: k for k, w in enumerate(terms)}
    triples = [(k, place[w], n * weight(index.documents, df[place[w]])) for k, c in enumerate(counts) for w, n in c.items() if place[w] in df]
    item, term, worth = (np.array([t[j] for t in triples], np.int64) for j in range(3))
    return Block(len(terms), item, term, worth, len(texts)), vocabulary


def _shards(index: Index, vocabulary: DataFrame, depth: int) -> DataFrame:
    """The block's rows down to a tier, each shard's together in one task."""
    columns = ["shard", "code", "ids", *[f"{n}{k}" for k in range(1, depth + 1) for n in ("docs", "impacts")], *[f"rest{k}" for k in range(1, min(depth, 2) + 1)]]
    return _looked_up(index, vocabulary).select(*columns)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions("shard")


class Shard:
    """A shard's rows, met by a block of items."""

    def __init__(self, rows: pa.Table, block: Block):
        self.rows, code = rows.combine_chunks(), rows.column("code").to_numpy()
        self.key = rows.column("shard")[0].as_py()
        ids = self.rows.column("ids").filter(pa.array(code < 0)).combine_chunks().flatten()
        self.known, self.ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        self.n = len(self.ids)
        place = np.full(block.terms + 1, -1)  # the last is of the ids' row
        place[code] = np.arange(len(code))
        at = place[block.term]
        here = at >= 0
        self.item, self.term, self.weight = block.item[here], at[here], block.weight[here]

    def numbers(self, name: str) -> np.ndarray:
        return self.rows.column(name).to_numpy().astype(np.int64)

    def add(self, sums: np.ndarray, bounds: np.ndarray, items: np.ndarray, tier: int, rest: np.ndarray) -> None:
        """Add a tier's postings for the chosen items (their rows in sums, or -1), to the sums and to what is known of upper bounds."""
        own = np.flatnonzero(items[self.item] >= 0)
        docs, impacts = (self.rows.column(f"{n}{tier}").combine_chunks() for n in ("docs", "impacts"))
        ends = docs.offsets.to_numpy().astype(np.int64)
        first = ends[self.term[own]]
        n = ends[self.term[own] + 1] - first
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
        own = np.repeat(own, n)
        place = items[self.item[own]] * self.n + docs.values.to_numpy()[at]
        worth = impacts.values.to_numpy()[impacts.offsets[0].as_py() - docs.offsets[0].as_py() + at].astype(np.int64)
        np.add.at(sums, place, self.weight[own] * worth)
        np.add.at(bounds, place, self.weight[own] * (worth - rest[self.term[own]]))


def _groups(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[Shard]:
    """Shard after shard of rows that come in their order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and (b > a) and held[0].column("shard")[0].as_py() != shard[a]:
                yield Shard(pa.Table.from_batches(held), block)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield Shard(pa.Table.from_batches(held), block)


def _scored(shard: Shard, block: Block, thresholds: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some items at a time: their numbers, lower bounds by document, and the highest upper bound of a document that isn't known exactly (-1: all are).

    An item goes down to the next tier only if it isn't proven in the one before.
    """
    step = max(1, SUMS // max(1, shard.n))
    for low in range(0, block.size, step):
        chosen = np.arange(low, min(block.size, low + step))
        sums = np.zeros((len(chosen), shard.n), np.int64)
        open_, most = np.arange(len(chosen)), np.full(len(chosen), -1, np.int64)
        for tier in range(1, depth + 1):
            items = np.full(block.size, -1, np.int64)
            items[chosen[open_]] = np.arange(len(open_))
            # bounds are worked out anew from this tier's residual bounds, over the tiers so far
            rest = shard.numbers(f"rest{tier}").astype(np.int64) if tier < 3 else np.zeros(shard.rows.num_rows, np.int64)
            own, bounds = np.zeros(len(open_) * shard.n, np.int64), np.zeros(len(open_) * shard.n, np.int64)
            for t in range(1, tier + 1):
                shard.add(own, bounds, items, t, rest)
            own, bounds = own.reshape(len(open_), -1), bounds.reshape(len(open_), -1)
            sums[open_] = own
            wanted = np.flatnonzero(items[shard.item] >= 0)
            all_rest = np.zeros(len(open_), np.int64)
            np.add.at(all_rest, items[shard.item[wanted]], shard.weight[wanted] * rest[shard.term[wanted]])
            upper = bounds + all_rest[:, None]
            most[open_] = np.where(upper > own, upper, -1).max(axis=1, initial=-1)
            open_ = open_[most[open_] >= thresholds[chosen[open_]]]
            if not len(open_):
                break
        yield chosen, sums, most


def _highest(values: np.ndarray, top: int) -> np.ndarray:
    """The highest values of each row, 0 where there are fewer."""
    if values.shape[1] < top:
        values = np.c_[values, np.zeros((len(values), top - values.shape[1]), np.int64)]
    return np.partition(values, values.shape[1] - top, axis=1)[:, -top:]


def _thresholds(index: Index, vocabulary: DataFrame, shared, before: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, DataFrame]:
    """For each item the top-th highest of all lower bounds (1 at least), and the written pairs (shard, item, upper bound) that aren't proven by ``before``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        best = np.zeros((block.size, top), np.int64)
        for shard in _groups(batches, block):
            for chosen, sums, most in _scored(shard, block, before, depth):
                best[chosen] = _highest(np.c_[best[chosen], _highest(sums, top)], top)
                open_ = most >= before[chosen]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(open_.sum()), shard.key)), pa.array(chosen[open_]), pa.array(most[open_])], names=["shard", "item", "bound"])
        item, _ = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(item), pa.int64()), pa.array(item), pa.array(best[best > 0])], names=["shard", "item", "bound"])
        release()

    rows = written(_grouped(_shards(index, vocabulary, depth)).mapInArrow(run, "shard long, item long, bound long"), "search-bounds")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound")))
    found = rows.where("shard IS NULL").withColumn("place", place).where(F.col("place") == top).select("item", "bound").collect()  # one number an item of the block
    out = np.ones(len(before), np.int64)
    for r in found:
        out[r["item"]] = max(1, r["bound"])
    return np.maximum(out, before), rows.where("shard IS NOT NULL")


def _results(rows: DataFrame, shared, thresholds: np.ndarray, depth: int, top: int) -> DataFrame:
    """item, doc_id, score: of each task, the top documents of each item that reach its threshold."""

    def best_of(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        item, known, ids, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, ~known, -score, item))
        item = item[order]
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        keep = order[place < top]
        return [tuple(np.concatenate(x)[keep] for x in zip(*parts, strict=True))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, held = shared.value, [], 0
        for shard in _groups(batches, block):
            for chosen, sums, _ in _scored(shard, block, thresholds, depth):
                at, doc = np.nonzero(sums >= thresholds[chosen][:, None])
                parts.append((chosen[at], shard.known[doc], shard.ids[doc], sums[at, doc]))
                held += len(at)
                if held > 100_000 and len(parts) > 1:
                    parts = best_of(parts)
                    held = len(parts[0][0])
        if parts:
            item, known, ids, score = best_of(parts)[0]
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=~known), pa.array(score)], names=["item", "doc_id", "score"])
        release()

    return _grouped(rows).mapInArrow(run, "item long, doc_id long, score long")


def search(index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item that score over 0, equal scores by ascending id.

    Every row of ``items`` is an item, with its own ranks, rows of one id too. Items without
    terms, or none that a document has, get no rows. A null doc_id comes behind all others
    of its score. Of items over ``block_bytes`` of text, one block after the other is with
    the driver and the executors, and each reads the index anew.
    """
    spark = items.sparkSession
    rows = items.select(F.col(quoted(id_col)).alias("item_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()).where(F.regexp_count("text", F.lit(TERM)) > 0), "search-items")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, every = max(1, -(-total // block_bytes)), None
    for k in range(n):
        some = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("row"), F.lit(n)) == k)).select("row", "text").collect()
        found = _search_block(index, [r["text"] for r in some], top, spark) if some and index.documents else None
        if found is None:
            continue
        keys = spark.createDataFrame([(i, r["row"]) for i, r in enumerate(some)], "item long, row long")
        found = written(found.join(keys, "item").select("row", "doc_id", "score"), "search-results")
        every = found if every is None else every.unionByName(found)
    if every is None:
        every = spark.createDataFrame([], "row long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = every.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.join(rows.select("row", "item_id"), "row").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search_block(index: Index, texts: list[str], top: int, spark) -> DataFrame:
    block, vocabulary = _block(index, texts)
    shared = spark.sparkContext.broadcast(block)  # of one block of items
    thresholds = np.ones(len(texts), np.int64)
    for depth in (1, 2):
        thresholds, unproven = _thresholds(index, vocabulary, shared, thresholds, depth, top)
    limits = spark.createDataFrame([(i, int(t)) for i, t in enumerate(thresholds)], "item long, least long")
    deep = unproven.join(limits, "item").where("bound >= least").select("shard").distinct()
    if deep.limit(DEEP_SHARDS + 1).count() > DEEP_SHARDS:
        return _results(_shards(index, vocabulary, 3), shared, thresholds, 3, top)
    deep = F.broadcast(deep)
    shallow = _results(_shards(index, vocabulary, 2).join(deep, "shard", "left_anti"), shared, thresholds, 2, top)
    return shallow.unionByName(_results(_shards(index, vocabulary, 3).join(deep, "shard", "left_semi"), shared, thresholds, 3, top))


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the 10 best documents of each row of ``benchmark``; see build() and search() for odd rows."""
    return search(build(documents), benchmark)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x80-\x{10FFFF}0-9a-z]+', ' ', 'g'), '[^ ]+') AS ts FROM documents WHERE text IS NOT NULL
), c AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
p AS (SELECT doc_id, t, count(*) AS tf, any_value(len(ts))::BIGINT AS n FROM (SELECT doc_id, ts, unnest(ts) AS t FROM d) GROUP BY doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, c.n),
i AS (
  SELECT item_id, t, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x80-\x{10FFFF}0-9a-z]+', ' ', 'g'), '[^ ]+')) AS t FROM benchmark WHERE text IS NOT NULL
  ) GROUP BY item_id, t
), s AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * p.n * c.n) // c.l))))::BIGINT AS score
  FROM i JOIN p USING (t) JOIN w USING (t), c GROUP BY item_id, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
) WHERE rank <= 10
"""
