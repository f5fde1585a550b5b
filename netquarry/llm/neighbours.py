"""Operator 12: quality by the votes of the nearest labelled documents in a latent-semantic space.

A text's features are its words, their shapes (runs of letters, digits and each other
character) and how much of it repeats what stands one, two or three words before, hashed to
a fixed number of places and weighted by how rare they are in all documents. The leading
right singular vectors of a bounded sample of labelled documents span the latent space;
they are found by subspace iteration, whose products run where the sample's rows are. Those
labelled vectors are broadcast; every document's exact cosines with all of them are worked
out block by block, and the labels of the nearest are averaged by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, free_name, quoted, release, written
from .toxicity import held_out

#: Labelled rows used to fit at most (those of the smallest hashes): the labelled vectors are 2.5 MB then.
MAX_LABELLED = 10_000
#: Places of features: shapes, words, and marks of repetition.
SHAPES, WORDS, MARKS = 1_024, 7_168, 16
PLACES = SHAPES + WORDS + MARKS
#: Dimensions of the latent space; directions that are iterated besides; iterations.
DIMS, EXTRA, TURNS = 64, 8, 6
#: Neighbours that vote (and all as near as the last), and the power of the similarity that a vote weighs.
NEIGHBOURS, POWER = 11, 4
#: Similarities that differ by less tie: as vectors of four-byte numbers, equal texts differ in the last digits.
TIE = 1e-4
#: A mark for each share of words from which on they repeat the one 1, 2 or 3 places before; it counts as so many words.
SHARES, BEFORE, MARK_COUNT = (0.02, 0.05, 0.1, 0.2, 0.4), (1, 2, 3), 20
#: Nonzero weights, and texts, that are worked on at once; bytes of a long text.
NONZERO, TEXTS, PART = 1 << 16, 256, 1 << 20
CLASSES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else b for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Places(dict):
    """Numbers of words; shape and own are the two places of each."""

    def __init__(self):
        super().__init__()
        self.shape: list[int] = []
        self.own: list[int] = []

    def __missing__(self, word: bytes) -> int:
        shape = bytearray()
        for b in word.translate(CLASSES):
            if not shape or shape[-1] != b:
                shape.append(b)
        number = xxhash.xxh3_64_intdigest
        self.shape.append(number(bytes(shape)) % SHAPES)
        self.own.append(SHAPES + number(word.translate(LOWER)) % WORDS)
        found = self[word] = len(self.own) - 1
        return found

    def bound(self) -> None:
        """Forget all words if there are many."""
        if len(self) > 300_000:
            self.clear()
            self.shape.clear()
            self.own.clear()


def numbers(text: str | None, places: Places) -> np.ndarray:
    """The numbers of a text's words, taken part by part, so that a long text isn't held as words all at once."""
    data, at, out = (text or "").encode(), 0, [np.zeros(0, np.int32)]
    while at < len(data):
        end = data.find(b" ", at + PART)
        some = data[at : end if end >= 0 else len(data)].split()
        out.append(np.fromiter(map(places.__getitem__, some), np.int32, len(some)))
        at = end if end >= 0 else len(data)
    return np.concatenate(out)


def counted(texts: list, places: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each feature stands in each text: numbers of features by text, places and counts. A text without words has one of its own."""
    places.bound()
    words = [numbers(t, places) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    word, row = np.concatenate([np.zeros(0, np.int32), *words]), np.repeat(np.arange(len(n)), n)
    keys = [row * PLACES + np.array(p, np.int64)[word] for p in (places.shape, places.own)]
    found, count = np.unique(np.concatenate(keys), return_counts=True)
    marks = [np.flatnonzero(n == 0) * PLACES + PLACES - 1]
    for k, back in enumerate(BEFORE):
        again = np.bincount(row[back:][(word[back:] == word[:-back]) & (row[back:] == row[:-back])], minlength=len(n))
        for j, share in enumerate(SHARES):
            marks.append(np.flatnonzero((again >= share * n) & (n > 0)) * PLACES + SHAPES + WORDS + k * len(SHARES) + j)
    marked = np.concatenate(marks)
    order = np.argsort(every := np.r_[found, marked], kind="stable")
    count = np.r_[count, np.where(marked % PLACES == PLACES - 1, 1, MARK_COUNT)][order]
    return np.bincount(every // PLACES, minlength=len(n)), every[order] % PLACES, count


def matrix(texts: list, places: Places, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' features as a sparse matrix of rows of length 1: sizes of the rows, places and weights."""
    sizes, at, n = counted(texts, places)
    weights = (1 + np.log(n)) * rarity[at]
    if len(sizes):
        weights /= np.maximum(np.repeat(np.sqrt(np.add.reduceat(weights**2, np.cumsum(sizes) - sizes)), sizes), 1e-9)
    return sizes, at, weights.astype(np.float32)


def pieces(sizes: np.ndarray, most: int = NONZERO) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many nonzero weights, a row at least."""
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes)


def times(sizes: np.ndarray, at: np.ndarray, weights: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sparse matrix times ``right``."""
    ends = np.cumsum(sizes)
    out = [np.zeros((0, right.shape[1]), np.float32)]
    for low, high in pieces(sizes):
        a, b = ends[low] - sizes[low], ends[high - 1]
        out.append(np.add.reduceat(right[at[a:b]] * weights[a:b, None], ends[low:high] - sizes[low:high] - a))
    return np.concatenate(out)


def transposed_times(sizes: np.ndarray, at: np.ndarray, weights: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The transposed sparse matrix times ``left``."""
    out, ends = np.zeros((PLACES, left.shape[1]), np.float32), np.cumsum(sizes)
    for low, high in pieces(sizes):
        a, b = ends[low] - sizes[low], ends[high - 1]
        order = np.argsort(at[a:b], kind="stable")
        row = np.repeat(np.arange(low, high), sizes[low:high])[order]
        where, first = np.unique(at[a:b][order], return_index=True)
        out[where] += np.add.reduceat(left[row] * weights[a:b][order][:, None], first)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.where(size > 1e-6, rows / np.maximum(size, 1e-6), 0).astype(np.float32)


@dataclass
class Model:
    """What voting needs; all of a size that parameters bound."""

    rarity: np.ndarray = field(default_factory=lambda: np.ones(PLACES))
    space: np.ndarray = field(default_factory=lambda: np.zeros((PLACES, DIMS), np.float32))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS), np.float32))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    neighbours: int = NEIGHBOURS

    def latent(self, texts: list, places: Places) -> np.ndarray:
        return unit(times(*matrix(texts, places, self.rarity), self.space))

    def votes(self, vectors: np.ndarray) -> np.ndarray:
        """The mean label of each vector's nearest neighbours, weighted by similarity; of all labels, where none is similar."""
        if not len(self.labels):
            return np.full(len(vectors), 0.5)
        near = vectors @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        row, voter = np.nonzero(near >= np.maximum(last - TIE, 0)[:, None])
        weights = near[row, voter].astype(np.float64) ** POWER
        total = np.bincount(row, weights, len(near))
        return np.where(total > 0, np.bincount(row, weights * self.labels[voter], len(near)) / np.maximum(total, 1e-12), self.labels.mean())


def _rarity(documents: DataFrame) -> np.ndarray:
    """The logarithm of how many documents there are to one that has a feature, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, places, rows = np.zeros(PLACES, np.int64), Places(), 0
        for block in blocks(batches, "text", 1 << 20):
            _, at, _ = counted(block.column("text").to_pylist(), places)
            total += np.bincount(at, minlength=PLACES)
            rows += block.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[rows, total[some]])], names=["place", "n"])

    rows = documents.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # a row a place
    out = np.zeros(PLACES + 1)
    for r in rows:
        out[r["place"]] = r["n"]
    return np.log((1 + out[-1]) / (1 + out[:-1])) + 1e-3


def _labelled(documents: DataFrame, labels: DataFrame, label_col: str, most: int) -> DataFrame:
    """hash, id, text, label of at most ``most`` labelled rows that aren't held out, those of the smallest hashes of their id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(quoted(label_col)).isNotNull()).select(F.col("doc_id").cast("long").alias("id"), (F.col(quoted(label_col)) > 0).cast("int").alias("label"))
    rows = rows.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    chosen = rows.withColumn("hash", F.xxhash64("id")).orderBy("hash", "id").limit(most)  # most rows of 20 bytes: a proven bound
    return documents.join(F.broadcast(chosen), "id").select("hash", "id", "text", "label")


def fit(documents: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", most: int = MAX_LABELLED, dims: int = DIMS, seed: int = 1) -> Model:
    """Fit on a bounded sample of labelled rows that aren't held out; labels are used for nothing else.

    Which features are rare is counted over all documents. Rows without an id or a label are
    left out; of several labels of an id the higher counts; every row of a repeated id
    votes. Without any labels all texts get 0.5.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    rarity = _rarity(texts.select("text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for block in blocks(batches, "text", 1 << 20):
            sizes, at, weights = matrix(block.column("text").to_pylist(), places, rarity)
            ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at.astype(np.int32), weights)]
            yield pa.RecordBatch.from_arrays([block.column("hash"), block.column("id"), block.column("label"), *lists], names=["hash", "id", "label", "at", "weights"])

    sample = written(_labelled(texts, labels, label_col, most).mapInArrow(sparse, "hash long, id long, label int, at array<int>, weights array<float>"), "quality-sample").coalesce(8)
    space, context = np.random.default_rng(seed).standard_normal((PLACES, dims + EXTRA)).astype(np.float32), documents.sparkSession.sparkContext

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = batch.column("at")
        return np.diff(at.offsets.to_numpy()), at.flatten().to_numpy().astype(np.int64), batch.column("weights").flatten().to_numpy()

    for turn in range(TURNS):
        shared = context.broadcast(space)

        def product(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((PLACES, dims + EXTRA), np.float32)
            for batch in batches:
                rows = read(batch)
                total += transposed_times(*rows, times(*rows, shared.value))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        parts = sample.select("at", "weights").mapInArrow(product, "total binary").toLocalIterator()  # 8 rows of 2.4 MB, whatever the input
        total = sum((np.frombuffer(r["total"], np.float32).reshape(PLACES, -1) for r in parts), np.zeros((PLACES, dims + EXTRA)))
        if turn + 1 < TURNS:
            space = np.linalg.qr(total)[0].astype(np.float32)
    _, turned = np.linalg.eigh(space.T @ total)
    model = Model(rarity, (space @ turned[:, ::-1][:, :dims]).astype(np.float32))
    shared = context.broadcast(model.space)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = unit(times(*read(batch), shared.value))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("id"), batch.column("label"), pa.array([v.tobytes() for v in vectors], pa.binary())], names=["hash", "id", "label", "vector"])

    rows = sample.mapInArrow(project, "hash long, id long, label int, vector binary").orderBy("hash", "id", "label").collect()  # most rows of 256 bytes
    if rows:
        model.vectors = np.array([np.frombuffer(r["vector"], np.float32) for r in rows])
        model.labels = np.array([r["label"] for r in rows], np.float32)
    return model


def with_votes(documents: DataFrame, model: Model, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """``documents`` with all columns and rows, plus ``out_col``: from 0 to 1, how surely the label is 1.

    Null and empty texts are one kind of text with a feature of its own; what resembles no
    labelled text gets the mean label. Equal texts get equal scores. A column of that name
    (in any case) raises ValueError: none is replaced.
    """
    if free_name(documents, out_col) != out_col:
        raise ValueError(f"there is a column {out_col} already: name another with out_col")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    places = Places()

    def run(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for block in blocks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text", 1 << 20):
            for k in range(0, block.num_rows, TEXTS):
                out.append(shared.value.votes(shared.value.latent(block.column("text")[k : k + TEXTS].to_pylist(), places)))
        release()
        return pa.array(np.round(np.concatenate(out), 6))

    score = F.arrow_udf(run, "double").asNondeterministic()  # so it is run once a row
    return documents.withColumn(out_col, score(F.col(quoted(text_col)).cast("string")))


def report(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``documents``.

    A null doc_id isn't held out; repeated rows come out as often as they came in, an empty
    table gives no rows. See fit() and with_votes() for odd texts.
    """
    rows = with_votes(documents.select("doc_id", "text"), fit(documents, labels), out_col="score")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score").withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
