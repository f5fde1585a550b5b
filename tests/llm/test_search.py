"""Operators 11 to 13 against brute force, and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.llm import clustering, neighbours, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, top=10):
    """item's place, rank, doc_id, score by the formula, over lists of (id, text)."""
    rows = [(i, Counter(terms(t))) for i, t in docs]
    rows = [(i, c) for i, c in rows if c]
    n, total, df = len(rows), sum(sum(c.values()) for _, c in rows), Counter(t for _, c in rows for t in c)
    out = []
    for place, (_, text) in enumerate(items):
        scores = []
        for i, c in rows:
            m = 25 + (75 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            scores += [(-s, i is None, i or 0, i)] * (s > 0)
        out += [(place, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return out


@pytest.fixture(scope="module")
def corpus(texts):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(30_000)]
    more = [" ".join(rng.sample(words, rng.randrange(1, 120))) for _ in range(300)]
    return [*enumerate([*texts, *more, *more[:20]]), (7, more[0]), (7, more[0]), (None, more[1]), (None, None)]


@pytest.fixture(scope="module")
def items(corpus):
    rng = random.Random(6)
    found = [" ".join(rng.sample([w for _, t in corpus for w in terms(t)], 12)) for _ in range(25)]
    return [*enumerate(found), (3, found[3]), (90, corpus[30][1]), (91, None), (92, "?!"), (93, "unheard"), (None, "alpha1 alpha1 Echo2")]


@pytest.mark.parametrize("tiers", [(1, 2), (2, 8), (4, 32), (10_000, 20_000)])
@pytest.mark.parametrize("shard_bytes", [200, 4_000, 1 << 20])
def test_search(spark, corpus, items, clashing, tiers, shard_bytes):
    docs = clashing(spark.createDataFrame(corpus, "doc_id long, text string").repartition(3))
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = search.search(search.build(docs, shard_bytes=shard_bytes, tiers=tiers), clashing(asked)).collect()
    want = Counter((items[p][0], r, i, s) for p, r, i, s in ranked(corpus, items))
    assert Counter(map(tuple, got)) == want


def test_search_in_blocks(spark, corpus, items, monkeypatch):
    """Items over the block size, shards over the limit of those read alone, few sums at a time."""
    monkeypatch.setattr(search, "DEEP_SHARDS", 1)
    monkeypatch.setattr(search, "SUMS", 50)
    docs, asked = spark.createDataFrame(corpus, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = search.search(search.build(docs, shard_bytes=3_000, tiers=(1, 3)), asked, top=4, block_bytes=600).collect()
    assert Counter(map(tuple, got)) == Counter((items[p][0], r, i, s) for p, r, i, s in ranked(corpus, items, 4))


def test_search_of_nothing(spark, docs, empty):
    asked = spark.createDataFrame([(1, "alpha1")], "item_id long, text string")
    assert search.report(empty, asked).isEmpty() and search.report(docs, asked.limit(0)).isEmpty()
    assert search.report(docs.withColumn("text", F.lit(None).cast("string")), asked).isEmpty()


def test_items_fall_through_only_if_unproven(spark):
    """A rare term's documents stand in the first tier whole; a common one is proven by what the others reach."""
    rng = random.Random(1)
    rows = [(k, " ".join(["common"] * rng.randrange(1, 9) + [f"x{rng.randrange(50)}" for _ in range(20)] + (["rare"] * 3 if k < 12 else []))) for k in range(400)]
    index = search.build(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), shard_bytes=10_000, tiers=(4, 12))
    block, vocabulary = search._block(index, ["rare rare common", "common x1 x2 x3"])
    shared = spark.sparkContext.broadcast(block)
    first, _ = search._thresholds(index, vocabulary, shared, np.ones(2, np.int64), 1, 10)
    second, unproven = search._thresholds(index, vocabulary, shared, first, 2, 10)
    open_ = {r["item"] for r in unproven.collect()}
    assert (second >= first).all() and 0 not in open_ or index.shards.where("term = ''").count() > len({r["shard"] for r in unproven.where("item = 0").collect()})
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in search.search(index, spark.createDataFrame([(0, "rare rare common"), (1, "common x1 x2 x3")], "item_id long, text string")).collect()) == Counter((p, r, i, s) for p, r, i, s in ranked(rows, [(0, "rare rare common"), (1, "common x1 x2 x3")]))


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(search, "PART", 7)
    vocabulary = search.Vocabulary()
    text = "One two, three two one " * 20
    codes = search.term_codes(text, vocabulary)
    assert [list(vocabulary)[c].decode() for c in codes] == terms(text)


def lloyd(rows, k=40, rounds=5, seed="2:", dims=64, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), i, q) for i, q in kept if i is not None)[:k]
    centres = [q for _, _, q in start]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centres)]
    return [(i, near(q)[1], near(q)[0]) for i, q in kept], centres


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(9)
    rows = [(k, [rng.gauss(k % 5, 1) for _ in range(8)]) for k in range(120)]
    same = rows[3][1]
    rows += [(200 + k, same) for k in range(60)] + [(3, same), (3, rows[4][1]), (None, same), (None, None), (301, None), (302, [1.0] * 7), (303, [1.0] * 7 + [None]), (304, [1.0] * 7 + [math.inf]), (305, [1.0] * 7 + [math.nan]), (306, [])]
    return rows


@pytest.mark.parametrize("k", [1, 6, 40, 500])
def test_clustering(spark, vectors, clashing, k):
    table = clashing(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4))
    rows, centres = clustering.cluster(table, dims=8, centroids=k, rounds=3)
    want, final = lloyd(vectors, k, 3, dims=8)
    assert Counter(map(tuple, rows.collect())) == Counter(want) and centres.tolist() == final


def test_clustering_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert clustering.report(make([])).isEmpty() and clustering.report(make([(None, [0.5] * 64)])).isEmpty()
    huge = clustering.report(make([(1, [3e38] * 64), (2, [-3e38] * 64), (2, [-3e38] * 64)])).collect()
    assert [r["distance"] for r in huge] == [0, 0, 0] and {r["inertia"] for r in huge} == {0}
    # nothing is near: an empty centroid stays where it was
    rows, centres = clustering.cluster(make([(1, [0.0] * 64), (2, [0.0] * 64)]), centroids=2)
    assert {r["cluster"] for r in rows.collect()} == {0} and centres.tolist() == [[0] * 64] * 2


def test_hot_vector(spark, monkeypatch):
    """Half of all rows are one vector: they are dealt out when assignments are joined back."""
    from netquarry.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = [(k, [float(k % 7 if k % 2 else 1)] * 4) for k in range(400)]
    got, _ = clustering.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dims=4, centroids=5)
    assert Counter(map(tuple, got.collect())) == Counter(lloyd(rows, 5, dims=4)[0])


def test_neighbours_held_out(spark):
    """Of the rows held out, poor ones are found and good ones kept, in each language."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").where("quality IS NOT NULL")
    rows = neighbours.report(spark, docs.join(labels, "doc_id", "left_semi"), labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    got = rows.groupBy("lang", "quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).collect()
    assert len(got) == 8 and all(r[2] > 0.9 for r in got), got


def test_votes_by_brute_force(spark, docs, clashing):
    """Features, rarity, cosines and votes, worked out anew from the model's space."""
    labels = spark.createDataFrame([(r["doc_id"], int(k % 3 > 0)) for k, r in enumerate(docs.collect())], "doc_id long, quality int")
    model = neighbours.fit(docs, labels)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    places = neighbours.Places()
    counted = lambda t: dict(zip(*(x.tolist() for x in neighbours.counted([t], places)[1:]), strict=True))
    seen = Counter(f for t in rows.values() for f in counted(t))
    assert np.allclose(model.rarity, np.log((1 + len(rows)) / (1 + np.array([seen[k] for k in range(neighbours.PLACES)]))) + 1e-3)

    def latent(text):
        row = np.zeros(neighbours.PLACES)
        for place, n in counted(text).items():
            row[place] = (1 + math.log(n)) * model.rarity[place]
        v = row / np.linalg.norm(row) @ model.space
        return v / np.linalg.norm(v) if np.linalg.norm(v) > 1e-6 else v * 0

    compared = 0
    for r in neighbours.with_votes(clashing(docs), model, out_col="vote").collect():
        near = [(float(latent(r["text"]) @ v), y) for v, y in zip(model.vectors.astype(float), model.labels, strict=True)]
        last = sorted((s for s, _ in near), reverse=True)[10]
        votes = [(s**4, y) for s, y in near if s >= max(0, last - 1e-4)]
        if not any(abs(s - max(0, last - 1e-4)) < 1e-5 for s, _ in near):
            want = sum(w * y for w, y in votes) / sum(w for w, _ in votes) if votes else float(model.labels.mean())
            assert abs(r["vote"] - want) < 1e-3
            compared += 1
    assert compared > 40
    trained = {r["doc_id"] for r in neighbours.report(spark, docs, labels).where("held_out").collect()}
    assert trained and len(model.labels) == len(rows) - len(trained)


def test_latent_space_is_of_the_leading_singular_vectors(spark):
    """What iteration finds holds as much of the sample as the exact decomposition's vectors do."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model, places = neighbours.fit(docs, labels, dims=16), neighbours.Places()
    kept = [r["text"] for r in neighbours._labelled(docs.withColumnRenamed("doc_id", "id"), labels, "quality", neighbours.MAX_LABELLED).collect()]
    sizes, at, weights = neighbours.matrix(kept, places, model.rarity)
    dense = np.zeros((len(kept), neighbours.PLACES), np.float32)
    dense[np.repeat(np.arange(len(kept)), sizes), at] = weights
    exact = np.linalg.svd(dense, compute_uv=False)[:16]
    assert np.allclose(model.space.T @ model.space, np.eye(16), atol=1e-3)
    assert np.linalg.norm(dense @ model.space) ** 2 > 0.98 * (exact**2).sum()


def test_votes_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(r["doc_id"], 1) for r in docs.collect()] + [(None, 0), (5_000, 0)], "doc_id long, quality int")
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "x"), (9_001, None), (9_001, None), (9_002, "")], "doc_id long, text string"))
    got = neighbours.report(spark, odd, labels).collect()
    assert len(got) == odd.count() and all(r["score"] == 1 and r["predicted"] == 1 for r in got) and not [r for r in got if r["doc_id"] is None][0]["held_out"]
    assert neighbours.report(spark, empty, labels).isEmpty()
    assert {r["score"] for r in neighbours.report(spark, odd, labels.limit(0)).collect()} == {0.5}
    with pytest.raises(ValueError):
        neighbours.with_votes(docs.withColumn("Quality", F.lit(1)), neighbours.Model())


def test_features(monkeypatch):
    """Words, shapes and repetition of several texts together, as they are of each by itself; long texts in parts."""
    rng = random.Random(3)
    texts = ["a b a b a b c c c d e " * 9, None, "", "One TWO #3 x#y#z", " ".join(rng.choice("ab cd EF g1".split()) for _ in range(60)), "  "]
    count = lambda ts: [x.tolist() for x in neighbours.counted(ts, neighbours.Places())]
    sizes, at, n = count(texts)
    alone = [count([t]) for t in texts]
    assert sizes == [a[0][0] for a in alone] and at == [p for a in alone for p in a[1]] and n == [x for a in alone for x in a[2]]
    monkeypatch.setattr(neighbours, "PART", 5)
    assert count(texts) == [sizes, at, n]
    for text, (_, places, counts) in zip(texts, alone, strict=True):
        w, got = (text or "").split(), dict(zip(places, counts, strict=True))
        if not w:
            assert got == {neighbours.PLACES - 1: 1}
            continue
        assert sum(c for p, c in got.items() if p < neighbours.SHAPES) == len(w) == sum(c for p, c in got.items() if neighbours.SHAPES <= p < neighbours.SHAPES + neighbours.WORDS)
        for k, back in enumerate(neighbours.BEFORE):
            same = sum(w[i] == w[i - back] for i in range(back, len(w)))
            marks = [s for j, s in enumerate(neighbours.SHARES) if neighbours.SHAPES + neighbours.WORDS + k * len(neighbours.SHARES) + j in got]
            assert marks == [s for s in neighbours.SHARES if same >= s * len(w)]
