"""Operator 8: benchmark decontamination with suffix arrays of the training texts.

Documents are the training side. Each block of documents gets a suffix array over all
its words; every suffix of every benchmark item is looked up in it by binary search: the
interval of suffixes that share its first window says where it stands. Where suffixes
follow each other on both sides they make the longest verbatim matches, with their
places. Affected documents are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, quoted, written
from .suffixes import suffix_array

WINDOW = 10
#: Benchmark text that is sent to the executors at once; of a larger benchmark, one block after the other.
BLOCK_BYTES = 16 << 20
#: Word bytes as they are, A-Z in lower case, all else a space.
TABLE = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

MATCH = "array<struct<item_id:string, doc_start:int, item_start:int, n_words:int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


class Queries:
    """The suffixes of benchmark items, as far as their first window: that many words, or all of an item of fewer."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.ids = [item_id for item_id, _ in items]
        rows, item, start, sizes = [], [], [], []
        for k, (_, text) in enumerate(items):
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(codes))
            for i in range(len(codes) - size + 1 if codes else 0):
                rows.append(codes[i : i + size] + [0] * (window - size))
                item.append(k)
                start.append(i)
                sizes.append(size)
        self.window = window
        self.rows = np.array(rows, dtype=np.int64).reshape(-1, window)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.item, self.start = np.array(item, dtype=np.int64), np.array(start, dtype=np.int64)

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, place) where a query's words stand in ``codes``; 0 in codes is a word of no item, or an end."""
        none = np.zeros(0, np.int64)
        if not len(self.rows) or not len(codes):
            return none, none
        other = codes == 0  # each a symbol of its own, so that no suffixes tie beyond it
        row = np.where(other, len(self.vocabulary) + 1 + np.arange(len(codes)), codes)
        order, _, _ = suffix_array(row)
        heads = np.lib.stride_tricks.sliding_window_view(np.r_[row, np.zeros(self.window, row.dtype)], self.window)
        low = self._bound(heads, order, upper=False)
        high = self._bound(heads, order, upper=True)
        n = high - low
        query = np.repeat(np.arange(len(n)), n)
        at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return query, order[at]

    def _bound(self, heads: np.ndarray, order: np.ndarray, upper: bool) -> np.ndarray:
        """For each query, the first suffix in order that is not below it, or with upper that is above it."""
        low, high = np.zeros(len(self.rows), np.int64), np.full(len(self.rows), len(order), np.int64)
        ignored = np.arange(self.window) >= self.sizes[:, None]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            differ = heads[order[mid]] - self.rows[open_]
            differ[ignored[open_]] = 0
            first = (differ != 0).argmax(axis=1)
            sign = differ[np.arange(len(open_)), first]
            right = sign <= 0 if upper else sign < 0
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        return low


def find_matches(texts: list[str | None], queries: Queries) -> tuple[list[int], list[list[tuple[str, int, int, int]]]]:
    """Words of each text, and its longest verbatim matches: (item_id, doc_start, item_start, n_words), sorted."""
    find = queries.vocabulary.get
    parts, counts = [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        parts.append([find(w, 0) for w in words])
        parts.append([0])
    codes = np.fromiter((c for p in parts for c in p), dtype=np.int32, count=sum(map(len, parts)))
    query, place = queries.search(codes)
    out: list[list[tuple[str, int, int, int]]] = [[] for _ in texts]
    if len(query):
        item, start, size = queries.item[query], queries.start[query], queries.sizes[query]
        order = np.lexsort((place, place - start, item))
        item, start, size, place = item[order], start[order], size[order], place[order]
        follows = (item[1:] == item[:-1]) & (start[1:] - start[:-1] == 1) & (place[1:] - place[:-1] == 1)
        first = np.flatnonzero(np.r_[True, ~follows])
        last = np.r_[first[1:], len(item)] - 1
        begins = np.r_[0, np.cumsum(np.array(counts) + 1)]
        doc = np.searchsorted(begins, place[first], side="right") - 1
        for d, i, p, s, n in zip(doc.tolist(), item[first].tolist(), (place[first] - begins[doc]).tolist(), start[first].tolist(), (start[last] + size[last] - start[first]).tolist(), strict=True):
            out[d].append((queries.ids[i], p, s, n))
    return counts, [sorted(set(x)) for x in out]


def matcher(shared):
    """A column function: struct of n_words and matches of a text with the items of a broadcast."""
    kind = pa.struct([("n_words", pa.int64()), ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("n_words", pa.int32())])))])
    held: list[Queries] = []

    def run(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Queries(shared.value))
        rows = []
        values = texts.to_pylist()
        start = size = 0
        for i, text in enumerate([*values, None]):
            if i == len(values) or (size and size + len(text or "") > 2 << 20):
                counts, found = find_matches(values[start:i], held[0])
                rows += [{"n_words": n, "matches": [dict(zip(("item_id", "doc_start", "item_start", "n_words"), m, strict=True)) for m in x]} for n, x in zip(counts, found, strict=True)]
                start, size = i, 0
            size += len(text or "")
        return pa.array(rows, kind)

    return F.arrow_udf(run, f"struct<n_words:bigint, matches:{MATCH}>").asNondeterministic()  # so it is run once a row


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items with words and an id, in blocks of about block_bytes; each block is read from the table by itself."""
    rows = benchmark.where(F.col(quoted(text_col)).isNotNull() & F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).cast("string").alias("i"), F.col(quoted(text_col)).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        yield [tuple(r) for r in (rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)).collect()]


def with_matches(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, out_col: str = "contamination") -> DataFrame:
    """``documents`` with all its columns and rows, plus ``out_col``: struct of n_words and matches (item ids as strings).

    A window is 10 words of an item in a row; an item of fewer words, but not none, is one
    window. Null and empty texts have no words and no matches; null items are left out; an
    empty benchmark matches nothing. Copies of an item under one id count once, equal items
    under two ids are both named. An existing column ``out_col`` (in any case) raises
    ValueError. Nothing is shuffled. Of a benchmark over ``block_bytes``, one block at a time
    is with the driver and the executors: its matches are written before the next is read.
    """
    if free_name(documents, out_col) != out_col:
        raise ValueError(f"there is a column {out_col} already: name another with out_col")
    context, text = documents.sparkSession.sparkContext, F.col(quoted(text_col))
    found, table, key = [], None, free_name(documents, "__row")
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    items, following = next(blocks), next(blocks, None)
    if following is None:
        return documents.withColumn(out_col, matcher(context.broadcast(items))(text))  # at most block_bytes and one item
    table = written(documents.withColumn(key, F.monotonically_increasing_id()), "decontamination-rows")
    while items is not None:
        shared = context.broadcast(items)
        found.append(written(table.select(key, matcher(shared)(text).alias(out_col)).where(F.size(f"{out_col}.matches") > 0).select(key, f"{out_col}.matches"), "decontamination-matches"))
        shared.unpersist()
        items, following = following, next(blocks, None)
    every = found[0]
    for some in found[1:]:
        every = every.unionByName(some)
    every = every.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("matches")))).alias("matches"))
    counted = table.withColumn(out_col, matcher(context.broadcast([]))(text)["n_words"]).join(every.withColumnRenamed("matches", f"{key}_matches"), key, "left")
    none = F.array().cast(MATCH)
    return counted.select(*[F.col(quoted(n)) for n in documents.columns], F.struct(F.col(out_col).alias("n_words"), F.coalesce(F.col(f"{key}_matches"), none).alias("matches")).alias(out_col))


def hit_words(matches: Column) -> Column:
    """Words of the document inside any match: the length of the union of the spans."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_start"].cast("long").alias("a"), (m["doc_start"] + m["n_words"]).cast("long").alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["reach"]))).alias("n"), F.greatest(acc["reach"], s["b"]).alias("reach"))
    return F.aggregate(spans, start, step)["n"]


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``documents``.

    Null and empty texts have zeros; ids of items are compared as strings; repeated rows
    come out as often as they came in, an empty table gives no rows.
    """
    found = F.col("contamination.matches")
    items = F.array_sort(F.array_distinct(F.transform(found, lambda m: m["item_id"])))
    rows = with_matches(documents.select("doc_id", "text"), benchmark)
    out = rows.select("doc_id", F.col("contamination.n_words").alias("n_words"), hit_words(found).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def removed(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the rows that hold a window of an item."""
    names, found = [F.col(quoted(n)) for n in documents.columns], free_name(documents, "contamination")
    return with_matches(documents, benchmark, out_col=found).where(F.size(f"{found}.matches") == 0).select(*names)


ORACLE = r"""
WITH i AS (
  SELECT item_id, ws, least(10, len(ws)) AS m FROM (
    SELECT item_id, regexp_extract_all(regexp_replace(lower_az, '[^\x80-\x{10FFFF}0-9a-z]+', ' ', 'g'), '[^ ]+') AS ws
    FROM (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark WHERE text IS NOT NULL)
  ) WHERE len(ws) > 0
), iw AS (SELECT DISTINCT item_id, m, array_to_string(ws[k:k+m-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS k FROM i)),
d AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x80-\x{10FFFF}0-9a-z]+', ' ', 'g'), '[^ ]+') AS ws
  FROM documents
), dw AS (
  SELECT doc_id, m, p, array_to_string(ws[p:p+m-1], ' ') AS g
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM i))
), hit AS (SELECT doc_id, dw.m, p, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.m = iw.m),
n AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM (SELECT doc_id, p, unnest(range(0, m)) AS k FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
