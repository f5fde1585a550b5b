"""Operator 7: documents whose sets of word shingles are similar, by an exact prefix-filtered join.

Shingles are put in one order, rare ones first. Two similar sets must share a shingle in
a short prefix of each, so only prefixes are shuffled. Where sizes and positions in the
prefixes allow a link, documents that share a prefix shingle meet under the smallest of
their ids (the leader). A pair that has several leaders in common is looked at under the
smallest of them alone. There it passes length, suffix and positional filters before its
sets are compared, once, and only if the two aren't already connected. Links then give
connected components. Copies are joined as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, join_hot, with_group_min, written

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingle counts are kept in this many buckets: what is broadcast is 4 MB whatever the input.
BUCKET_BITS = 20
SLICE = 1 << 14
#: Counts of a set's shingles in so many parts: the suffix filter's bounds.
PARTS = 64
#: Bits of the filter that tells which texts are needed again (4 MB), and of a slice of it.
FILTER_BITS, FILTER_SLICE = 25, 1 << 14
#: Shingles of documents that meet in one task; larger meetings are dealt out as pairs of blocks.
MEETING = 1 << 21
#: Where a bucket has this many shingles, those who share one of its shingles are found by a join that splits, not in one task.
FREQUENT = 2_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], k: int) -> tuple[list[np.ndarray], list[bytes | None]]:
    """Each text's distinct shingles as sorted 64-bit hashes, and a digest of its words (None without words).

    A text of fewer than k words, but not none, has one shingle: all its words.
    """
    codes: dict[bytes, int] = {}
    new = codes.setdefault
    words = [(t or "").encode().translate(LOWER).split() for t in texts]
    rows = [[new(w, len(codes)) for w in ws] for ws in words]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in codes), np.uint64, len(codes))
    sets, digests = [], []
    for ws, row in zip(words, rows, strict=True):
        if not row:
            sets.append(np.zeros(0, np.uint64))
            digests.append(None)
            continue
        h, n = hashes[row], min(k, len(row))
        total = np.full(len(row) - n + 1, n, np.uint64)
        for j in range(n):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[j : len(row) - n + 1 + j])
        sets.append(np.unique(total))
        digests.append(hashlib.md5(b" ".join(ws)).digest())
    return sets, digests


def part_counts(shingles: np.ndarray) -> bytes:
    counts = np.bincount(((shingles >> np.uint64(11)) % np.uint64(PARTS)).astype(np.int64), minlength=PARTS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def rare_first(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    order = np.lexsort((shingles, counts[(shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))
    return shingles[order]


def least_overlap(n: int, m: int, t: Fraction) -> int:
    """Shared shingles that sets of n and m need: overlap >= t / (1 + t) * (n + m), rounded up."""
    return -((-t.numerator * (n + m)) // (t.numerator + t.denominator))


def prefix_size(n: int, t: Fraction) -> int:
    return n + 1 + (-n * t.numerator) // t.denominator


def short_prefix_size(n: int, t: Fraction) -> int:
    """Of a pair, the set that isn't larger has their first shared shingle within so many."""
    return n + 1 + (-2 * n * t.numerator) // (t.numerator + t.denominator)


def linked(sets: list[np.ndarray], parts: np.ndarray, sides: np.ndarray, t: Fraction, verify: bool, earlier: list[set[int]] | None = None, compared: list | None = None) -> list[tuple[int, int]]:
    """With verify, links, no more than connect what links connect; without, each row that passes the length and suffix filters with another, as a pair with itself.

    sets: in rare-first order (or only their sizes matter, without verify); parts: the
    counts by part; sides: pairs are of two different sides, or any if there is one side;
    earlier: the smaller leaders of each: who shares one met there. compared: gets the
    pairs whose sets are compared, for tests.
    """
    sizes = np.array([len(s) for s in sets]) if verify else np.array(sets)
    order = np.argsort(sizes, kind="stable")
    sizes, parts, sides = sizes[order], parts[order].astype(np.int16), sides[order]
    two = sides.min() != sides.max()
    root = list(range(len(order)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found, kept = [], np.zeros(len(order), bool)
    plain = [np.sort(sets[i]) for i in order] if verify else []
    where: list[dict[int, int] | None] = [None] * len(order)
    for i in range(len(order) - 1):
        n = int(sizes[i])
        end = int(np.searchsorted(sizes, n * t.denominator // t.numerator, side="right"))  # length filter
        if end <= i + 1:
            continue
        other = np.arange(i + 1, end)
        if two:
            other = other[sides[other] != sides[i]]
        need = -((-t.numerator * (n + sizes[other])) // (t.numerator + t.denominator))
        apart = np.abs(parts[other] - parts[i]).sum(axis=1)  # suffix filter: the sets differ in so many shingles at least
        other = other[apart <= n + sizes[other] - 2 * need]
        if not verify:
            if len(other):
                kept[i] = kept[other] = True
            continue
        met = earlier[order[i]] if earlier else ()
        for j in other.tolist():
            if find(i) == find(j) or (met and not met.isdisjoint(earlier[order[j]])):
                continue
            need = least_overlap(n, int(sizes[j]), t)
            for x in (i, j):
                if where[x] is None:
                    s = sets[order[x]]
                    where[x] = {h: p for p, h in enumerate(s[: prefix_size(len(s), t)].tolist())}
            shared = where[i].keys() & where[j].keys()
            if not shared:
                continue
            p, q = min((where[i][h], where[j][h]) for h in shared)
            if 1 + min(n - p - 1, int(sizes[j]) - q - 1) < need:  # positional filter
                continue
            if compared is not None:
                compared.append((int(order[i]), int(order[j])))
            if len(np.intersect1d(plain[i], plain[j], assume_unique=True)) >= need:
                found.append((int(order[i]), int(order[j])))
                root[find(j)] = find(i)
    return found if verify else [(x, x) for x in order[kept].tolist()]


def _by_text(df: DataFrame, run, kinds: str) -> DataFrame:
    return df.select("id", "text").mapInArrow(run, kinds)


def first_pass(df: DataFrame, k: int) -> DataFrame:
    """Of every row id, digest, n and parts; and from every task slices (at, counts) of how many rows hold a shingle of each bucket."""
    names = ["id", "digest", "n", "parts", "at", "counts"]
    schema = pa.schema(zip(names, [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary()], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.uint32)
        for block in blocks(batches, "text", 2 << 20):
            sets, digests = shingle_sets(block.column("text").to_pylist(), k)
            np.add.at(total, (np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.uint32(1))
            size = len(sets)
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([part_counts(s) for s in sets], pa.binary()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], schema=schema)
        for at in range(0, len(total), SLICE):
            if total[at : at + SLICE].any():
                yield pa.RecordBatch.from_pydict(dict(zip(names, [[None], [None], [None], [None], [at], [total[at : at + SLICE].tobytes()]], strict=True)), schema=schema)

    return _by_text(df, run, "id long, digest binary, n int, parts binary, at int, counts binary")


def bucket_counts(first: DataFrame) -> np.ndarray:
    """Over all rows, how many hold a shingle of each bucket (as far as 32 bits count); a fixed size, whatever the input."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for chunk in table.column("counts").chunks for x in chunk)
        return pa.table({"at": table.column("at").slice(0, 1), "counts": pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})

    deal = lambda n: F.pmod(F.xxhash64("counts"), F.lit(n)).cast("int").alias("deal")
    slices = first.where("at is not null").select("at", "counts")
    some = slices.groupBy("at", deal(64)).applyInArrow(lambda key, table: add(table.select(["at", "counts"])), "at int, counts binary")
    out = np.zeros(1 << BUCKET_BITS, np.uint32)
    for at, counts in some.groupBy("at").applyInArrow(add, "at int, counts binary").collect():
        out[at : at + SLICE] = np.frombuffer(counts, "<u4")
    return out


def prefixes(df: DataFrame, k: int, t: Fraction, counts) -> DataFrame:
    """h, id, n (the set's size), short (inside the short prefix) and often (its bucket is full) of each shingle in each row's prefix; of rows with equal words, one for each task does."""
    schema = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("short", pa.bool_()), ("often", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for block in blocks(batches, "text", 2 << 20):
            sets, digests = shingle_sets(block.column("text").to_pylist(), k)
            hs, ids, sizes, short = [], [], [], []
            for i, s, digest in zip(block.column("id").to_pylist(), sets, digests, strict=True):
                if digest is None or digest in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(digest)
                hs.append(rare_first(s, counts.value)[: prefix_size(len(s), t)])
                ids.append(np.full(len(hs[-1]), i))
                sizes.append(np.full(len(hs[-1]), len(s), np.int32))
                short.append(np.arange(len(hs[-1])) < short_prefix_size(len(s), t))
            if hs:
                h = np.concatenate(hs)
                often = counts.value[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] >= FREQUENT
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *[pa.array(np.concatenate(x)) for x in (ids, sizes, short)], pa.array(often)], schema=schema)

    return _by_text(df, run, "h long, id long, n int, short boolean, often boolean")


def met_by_shingle(prefixed: DataFrame, t: Fraction) -> DataFrame:
    """leader, id of the rows that another row with the same shingle may link with: by their sizes, and by where in its prefix the smaller set has the shingle.

    Of shingles in full buckets, all rows that share one.
    """
    rare, often = prefixed.where("not often"), prefixed.where("often").select("h", "id").distinct()
    by, up = Window.partitionBy("h"), Window.partitionBy("h").orderBy("n", "id")
    smaller = F.max(F.when(F.col("short"), F.col("n"))).over(up.rowsBetween(Window.unboundedPreceding, -1))
    rows = rare.select("h", "id", "n", "short", smaller.alias("below"), F.lead("n").over(up).alias("above")).withColumn("leader", F.min("id").over(by))
    num, den = F.lit(t.numerator), F.lit(t.denominator)
    near = (F.col("below") * den >= F.col("n") * num) | (F.col("short") & (F.col("above") * num <= F.col("n") * den))
    least = often.groupBy("h").agg(F.min("id").alias("leader"), F.count("id").alias("rows")).where("rows > 1").drop("rows")
    return rows.where(near).select("leader", "id").unionByName(often.join(least, "h").select("leader", "id")).distinct()


def id_filter(ids: DataFrame) -> np.ndarray:
    """Which hashes some of the ids have, as packed bits; a fixed size, whatever the input. It may let others pass, never stop one of these."""

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bits = np.zeros(FILTER_SLICE, np.uint8)
        bits[table.column("place").to_numpy()] = 1
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    places = ids.select(_id_hash().alias("p")).distinct()
    slices = places.select(F.floor(F.col("p") / FILTER_SLICE).alias("at"), (F.col("p") % FILTER_SLICE).alias("place"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for at, bits in slices.groupBy("at").applyInArrow(pack, "at long, bits binary").collect():
        out[at * FILTER_SLICE // 8 : (at + 1) * FILTER_SLICE // 8] = np.frombuffer(bits, np.uint8)
    return out


def _id_hash() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))


def texts_of(df: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the rows of these ids, each text once; rows that the filter stops aren't shuffled."""
    bits = df.sparkSession.sparkContext.broadcast(id_filter(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").to_numpy()
            some = batch.filter(pa.array((bits.value[p // 8] >> (p % 8).astype(np.uint8)) & 1 == 1))
            if some.num_rows:
                yield some.select(["id", "text"])

    passed = df.select("id", "text", _id_hash().alias("p")).mapInArrow(run, "id long, text string")
    return passed.withColumn("hash", F.xxhash64("text")).dropDuplicates(["id", "hash"]).drop("hash")


KEY = ["leader", "b1", "b2"]


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of each KEY, of batches sorted by it."""
    key, held = None, {}
    for batch in batches:
        rows = batch.to_pydict()
        keys = list(zip(*[rows[c] for c in KEY], strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if keys[start] != key:
                if held:
                    yield held
                key, held = keys[start], {c: [] for c in rows}
            for c, values in rows.items():
                held[c] += values[start:i]
            start = i
    if held:
        yield held


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*KEY).sortWithinPartitions(*KEY)


def earlier_leaders(meeting: dict[str, list]) -> list[set[int]]:
    """Of each row of a meeting, its leaders smaller than the meeting's: who shares one of them has met it there."""
    return [{x for x in row if x < leader} for row, leader in zip(meeting["leaders"], meeting["leader"], strict=True)]


def candidates(meetings: DataFrame, t: Fraction) -> DataFrame:
    """KEY, b, id, leaders of the rows that pass the length and suffix filters with another of their meeting."""
    schema = pa.schema([("leader", pa.int64()), ("b1", pa.int32()), ("b2", pa.int32()), ("b", pa.int32()), ("id", pa.int64()), ("leaders", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _meetings(batches):
            parts = np.frombuffer(b"".join(m["parts"]), np.uint8).reshape(-1, PARTS)
            kept = sorted({x for pair in linked(m["n"], parts, np.array(m["b"]), t, verify=False) for x in pair})
            if kept:
                yield pa.RecordBatch.from_pydict({c: [m[c][i] for i in kept] for c in schema.names}, schema=schema)

    return _dealt(meetings).mapInArrow(run, "leader long, b1 int, b2 int, b int, id long, leaders array<long>").dropDuplicates([*KEY, "id"])


def links(meetings: DataFrame, t: Fraction, k: int, counts) -> DataFrame:
    """u, v: links of each meeting (KEY, b, id, leaders, text), as many as connect what its links connect."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _meetings(batches):
            plain, _ = shingle_sets(m["text"], k)
            parts = np.frombuffer(b"".join(map(part_counts, plain)), np.uint8).reshape(-1, PARTS)
            found = linked([rare_first(s, counts.value) for s in plain], parts, np.array(m["b"]), t, verify=True, earlier=earlier_leaders(m))
            if found:
                yield pa.RecordBatch.from_pydict({"u": [m["id"][i] for i, _ in found], "v": [m["id"][j] for _, j in found]}, schema=schema)

    return _dealt(meetings).mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of an edge u-v, by alternating large and small stars.

    Every step moves edges towards smaller nodes and is written to the shared folder; the
    number of steps grows with the logarithm of the nodes. An empty table gives no rows.
    """
    step = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    step, before = written(step, "links"), None
    least = lambda edges: edges.groupBy("u").agg(F.min("v").alias("m"))  # noqa: E731  a node may have any number of edges: minima are combined first, and the join back splits
    while True:
        state = step.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
        if state == before:
            break
        before = state
        both = step.unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(least(both), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = written(large, "links")
        low = large.join(least(large), "u")
        small = low.select("u", F.col("m").alias("v")).unionByName(low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        step = written(small.distinct(), "links")
    return step.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(step.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def similar(documents: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row: components of links of a Jaccard similarity of percent/100 or more.

    Words are runs without ASCII white space, A-Z in lower case; a text of fewer than k words,
    but not none, has all of them as its one shingle. Null and empty texts, and texts of white
    space, have no shingles and link with nothing. component_id is the smallest id reachable
    by links. Rows with equal words are linked. Rows with a null id are left out; repeated
    rows come out as often as they came in; of an id with several texts, each links for it;
    an empty table gives no rows. Extra columns don't matter.
    """
    t = Fraction(percent, 100)
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    first = written(first_pass(rows, k), "first-pass")
    counts = spark.sparkContext.broadcast(bucket_counts(first))
    summary = first.where("at is null").select("id", "digest", "n", "parts")
    reps = written(with_group_min(summary, "digest", "id", "rep").select("id", "digest", "n", "parts", F.coalesce("rep", "id").alias("rep")), "representatives")
    prefixed = written(prefixes(rows, k, t, counts), "prefixes")  # read twice
    met = met_by_shingle(prefixed, t).groupBy("id").agg(F.collect_list("leader").alias("leaders"))
    one = reps.where("digest is not null").select("id", "digest", "n", "parts", "rep").dropDuplicates(["id", "digest"])
    met = met.join(one, "id").groupBy(F.col("rep").alias("id")).agg(F.collect_set(F.struct("digest", "n", "parts")).alias("texts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("leaders")))).alias("leaders"))
    met = met.select("id", "leaders", F.explode("texts").alias("text"))  # one, unless an id has several
    met = written(met.select("id", "text.n", "text.parts", "leaders", F.explode("leaders").alias("leader")), "meetings")
    # a meeting of too many shingles for one task becomes pairs of blocks
    sizes = met.groupBy("leader").agg(F.count("id").alias("rows"), F.sum("n").alias("size")).where("rows > 1")
    met = met.join(sizes, "leader")
    met = met.withColumn("nb", F.ceil(F.col("size") / MEETING).cast("int")).withColumn("b", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    met = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    met = met.select("leader", F.least("b", "j").alias("b1"), F.greatest("b", "j").alias("b2"), "b", "id", "n", "parts", "leaders")
    chosen = written(candidates(met, t), "candidates")
    edges = links(chosen.join(texts_of(rows, chosen), "id"), t, k, counts)
    # an id with several texts is one node: it links their representatives
    several = one.groupBy("id").agg(F.count("digest").alias("texts")).where("texts > 1")
    edges = edges.unionByName(one.join(several, "id").select(F.col("id").alias("u"), F.col("rep").alias("v")))
    groups = components(edges).withColumnRenamed("node", "rep")
    out = join_hot(reps.select("id", "n", "rep"), groups, "rep", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def report(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id by three-word shingles at 0.9."""
    return similar(documents, 3, 90)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+2], ' ') END AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)
  )
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * o >= 90 * (na.n + nb.n - o)
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id WHERE r.c < l.b
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = w.doc_id
"""
