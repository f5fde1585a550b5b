"""Operator 9: toxicity by maximum-scoring segments of token log-odds.

Each word and each start of a word has a log-odds of toxic against other texts, smoothed
by a Dirichlet prior (their overall shares); a word scores as the surest of its own. What
is counted are the distinct words before it, so a passage that is copied a hundred times
counts once. A linear scan finds every maximal segment of a text whose scores sum high.
What the best segment of so long a harmless text may reach follows an extreme-value law,
so segment scores become comparable across lengths; a logistic curve turns them into a
score from 0 to 1. Log-odds are fitted on one part of the labelled rows, the law and the
curve on the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, free_name, written
from .decontam import words_of

#: Labelled rows used to fit at most (those of the smallest hashes).
MAX_LABELLED = 20_000
#: Of the labelled rows, one in so many calibrates; the others give the log-odds.
CALIBRATES = 3
#: Of the prior: counts dealt over the words by their overall shares, and what each word gets besides.
PRIOR_WORDS, PRIOR_EACH = 2_000.0, 0.5
MIN_Z = 3.0
MIN_ODDS = 1.5
DRIFT = -0.12
#: Lengths in characters of the starts of words that are scored beside whole words.
STARTS = (4, 5, 6, 7, 8)
START_CAP = 3


def parts_of(word: bytes) -> list[bytes]:
    """A word, and its starts (marked by a trailing *)."""
    text = word.decode("utf-8", "replace")
    return [word, *[text[:n].encode() + b"*" for n in STARTS if n < len(text)]]


class WordScores(dict):
    """Scores of words, worked out from those of their parts when first met; kept for a bounded number of words."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) > 300_000:
            self.clear()
        known = [x for x in map(self.model.scores.get, parts_of(word)) if x]
        score = self[word] = max(known, key=lambda x: abs(x[1]))[0] if known else self.model.drift
        return score


@dataclass
class Model:
    scores: dict[bytes, tuple[float, float]] = field(default_factory=dict)  # log-odds and its z of a word or a start
    drift: float = DRIFT
    rate: float = 1.0  # lambda of the extreme-value law
    log_k: float = 0.0
    weights: tuple[float, ...] = (-3.0, 1.0, 0.0)  # of a logistic curve: constant, best segment, number of segments


def segments(values: np.ndarray, places: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score): those that no part or extension beats; one pass.

    values: the score of each word; places: where scores are over 0.
    """
    total = np.r_[0.0, np.cumsum(values)]
    held: list[tuple[int, int, float, float]] = []  # start, end, total before start, total after end
    for i in places.tolist():
        a, b, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while held:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j -= 1
            if j < 0 or held[j][3] >= right:
                break
            a, left = held[j][0], held[j][2]
            del held[j:]
        held.append((a, b, left, right))
    return [(a, b, right - left) for a, b, left, right in held]


def passages(text: str | None, scores: WordScores) -> tuple[int, list[tuple[int, int, float]]]:
    """Words of a text, and its maximal segments with normalised scores: nats over what chance reaches in so many words."""
    words = words_of(text)
    if not words:
        return 0, []
    values = np.array(list(map(scores.__getitem__, words)))
    found, model = segments(values, np.flatnonzero(values > 0)), scores.model
    chance = model.log_k + math.log(len(words))
    return len(words), [(a, b, model.rate * s - chance) for a, b, s in found]


def features(n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
    """Best segment's normalised score (floored), and the sum over the significant ones, damped."""
    best = max((s for _, _, s in found), default=-10.0)
    return max(-10.0, min(30.0, best)), math.log1p(sum(s for _, _, s in found if s > 0))


def probability(model: Model, n: int, found: list[tuple[int, int, float]]) -> float:
    x, y = features(n, found)
    w = model.weights
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, w[0] + w[1] * x + w[2] * y))))


def _labelled(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text, toxic, calibrates of at most ``most`` labelled training rows, those of the smallest hashes of their id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = rows.withColumn("hash", F.xxhash64("doc_id")).orderBy("hash", "doc_id").limit(most)  # most rows of 20 bytes: a proven bound
    chosen = chosen.select("doc_id", "toxic", (F.pmod("hash", F.lit(CALIBRATES)) == 0).alias("calibrates"))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "calibrates")


def held_out(doc_id):
    """Whether a row's label is kept from fitting; a null id isn't held out, but has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _log_odds(counts: DataFrame, n0: int, n1: int) -> DataFrame:
    """Adds s, the log-odds with the prior, and z, s over its standard deviation; keeps those far enough from 0."""
    prior = F.lit(PRIOR_WORDS) * (F.col("n0") + F.col("n1")) / F.lit(float(max(1, n0 + n1))) + F.lit(PRIOR_EACH)
    odds = lambda c, n: F.log((F.col(c) + prior) / (F.lit(n + PRIOR_WORDS) - F.col(c) - prior))
    z = F.col("s") / F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    return counts.withColumn("s", odds("n1", n1) - odds("n0", n0)).withColumn("z", z).where((F.abs("z") >= MIN_Z) & (F.abs("s") >= MIN_ODDS))


def _contexts(sample: DataFrame) -> DataFrame:
    """word, n0, n1: behind how many distinct words it stands in harmless and in toxic texts."""
    schema = pa.schema([("word", pa.binary()), ("before", pa.int64()), ("toxic", pa.int32())])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = xxhash.xxh3_64_intdigest
        for block in blocks(batches, "text", 2 << 20):
            seen: tuple[set, set] = (set(), set())
            for text, toxic in zip(block.column("text").to_pylist(), block.column("toxic").to_pylist(), strict=True):
                words = words_of(text)
                seen[toxic].update(zip(words, [b"", *words], strict=False))
            for toxic, found in enumerate(seen):
                hashes = np.fromiter((number(b) for _, b in found), np.uint64, len(found)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array(hashes), pa.array(np.full(len(found), toxic, np.int32))], schema=schema)

    found = sample.mapInArrow(pairs, "word binary, before long, toxic int").distinct()
    return found.groupBy(F.decode("word", "UTF-8").alias("word")).agg(F.count_if(F.col("toxic") == 0).alias("n0"), F.count_if(F.col("toxic") == 1).alias("n1"))


def fit(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Fit on a bounded sample of the labelled rows that aren't held out; labels are used for nothing else.

    Counts are summed on the executors; the driver gets the words of a clear log-odds (so
    many only as the sample has, which ``most`` bounds) and three numbers a calibrating row.
    Rows without an id or a label are left out; of several labels of an id the higher
    counts; null texts have no words. With no rows of one of the labels in either part,
    the model gives low scores to all.
    """
    sample = written(_labelled(documents, labels, most), "toxicity-sample")
    words = written(_contexts(sample.where("not calibrates")), "toxicity-words")
    n0, n1 = (int(x or 0) for x in words.agg(F.sum("n0"), F.sum("n1")).first())
    if not n0 or not n1:
        return Model()
    # a start counts each of its words a few times at most: what marks a start is that many words have it
    few = lambda c: F.least(F.col(c), F.lit(START_CAP))
    starts = words.select(F.explode(F.filter(F.array(*[F.lit(n) for n in STARTS]), lambda n: n < F.length("word"))).alias("n"), "word", few("n0").alias("n0"), few("n1").alias("n1"))
    starts = starts.groupBy(F.concat(F.expr("substring(word, 1, n)"), F.lit("*")).alias("word")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    scored = _log_odds(words, n0, n1).unionByName(_log_odds(starts, *(int(x or 0) for x in starts.agg(F.sum("n0"), F.sum("n1")).first())))
    rows = scored.select("word", "s", "n0", "z").orderBy("word").collect()
    model = Model(scores={r[0].encode(): (float(np.clip(r[1], -3.0, 5.0)), float(r[3])) for r in rows})
    # lambda: the root of sum(share * exp(lambda * score)) = 1 over harmless texts
    shares = [(r[2] / n0, model.scores[r[0].encode()][0]) for r in rows if not r[0].endswith("*")]
    rest = max(0.0, 1.0 - sum(p for p, _ in shares))
    model.drift = min(DRIFT, -0.05 - 1.5 * sum(max(0.0, p * s) for p, s in shares) / max(rest, 1e-9))

    def excess(rate: float) -> float:
        return rest * math.exp(rate * model.drift) + sum(p * math.exp(min(50.0, rate * s)) for p, s in shares) - 1.0

    low, high = 0.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if excess(mid) > 0 else (mid, high)
    model.rate = max(low, 0.05)
    others = sample.where("calibrates")
    best = [x for _, x, _, toxic in _apply(others, model).collect() if not toxic and x > -10.0]
    if best:  # mean of the law: (log K + Euler's constant) / lambda
        model.log_k = float(np.mean(best)) - 0.5772
    rows = _apply(others, model).collect()  # a bounded sample: three numbers and a label a row
    if len({t for _, _, _, t in rows}) < 2:
        return Model()
    model.weights = _logistic(np.array([[x, y] for _, x, y, _ in rows]), np.array([t for _, _, _, t in rows]))
    return model


def _apply(sample: DataFrame, model: Model) -> DataFrame:
    schema = pa.schema([("n", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("toxic", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = None
        for block in blocks(batches, "text"):
            scores = scores or WordScores(model)
            found = [passages(t, scores) for t in block.column("text").to_pylist()]
            got = [features(n, f) for n, f in found]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), block.column("toxic").cast(pa.int32())], schema=schema)

    return sample.select("text", "toxic").mapInArrow(run, "n long, x double, y double, toxic int")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small ridge, by Newton's steps; the rarer label counts more, by the root of how rare it is."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    share = np.sqrt(len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y <= 0).sum())))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (share * (p - y)) + 1e-2 * w
        bend = (a * (share * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return tuple(float(v) for v in w)


def with_toxicity(documents: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``documents`` with all columns and rows, plus ``out_col``: struct of score and passages (start, end in words, nats).

    Passages are those of a normalised score over 0. Null and empty texts, and texts
    without scored words, have none and the lowest score. Equal texts get equal scores.
    A column of that name (in any case) raises ValueError: none is replaced.
    """
    if free_name(documents, out_col) != out_col:
        raise ValueError(f"there is a column {out_col} already: name another with out_col")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("score", pa.float64()), ("passages", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("nats", pa.float64())])))])

    held: list[WordScores] = []

    def run(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(WordScores(shared.value))
        rows = []
        for text in texts:
            n, found = passages(text.as_py(), held[0])
            rows.append({"score": probability(shared.value, n, found), "passages": [{"start": a, "end": b, "nats": s} for a, b, s in found if s > 0]})
        return pa.array(rows, kind)

    score = F.arrow_udf(run, "struct<score:double, passages:array<struct<start:int, end:int, nats:double>>>").asNondeterministic()
    return documents.withColumn(out_col, score(F.col(text_col)))


def report(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, n_passages, predicted of each row of ``documents``.

    Null and empty texts get the lowest score; a null doc_id isn't held out; repeated rows
    come out as often as they came in, an empty table gives no rows.
    """
    rows = with_toxicity(documents.select("doc_id", "text"), fit(documents, labels))
    out = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity.score").alias("score"), F.size("toxicity.passages").cast("long").alias("n_passages"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
