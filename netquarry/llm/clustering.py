"""Operator 13: centroid clustering of distinct quantised vectors with their multiplicities.

Vectors become whole numbers, and equal ones become one row that says how many there are.
Lloyd's rounds run over those rows: each goes to its nearest centroid, and a centroid
becomes the floor of the weighted mean of its rows, from sums of whole numbers that don't
depend on any order. Last, assignments are joined back to the ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, join_hot, quoted, written

DIMS, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5
#: Quantised components are held between minus this and this, so that squared distances are 64-bit numbers.
MOST = 1 << 27


def quantised(vector: Column, dims: int = DIMS, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as an array of int; null unless there are ``dims`` components, all finite numbers."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x.cast("double") * scale))).cast("int")
    return F.when((F.size(vector) == dims) & F.forall(vector, good), F.transform(vector, whole))


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid (of equally near ones the first) and its squared distance, in whole numbers."""
    away = (centroids**2).sum(axis=1) - 2 * (rows @ centroids.T)
    at = away.argmin(axis=1)
    return at, away[np.arange(len(rows)), at] + (rows**2).sum(axis=1)


def starting(kept: DataFrame, seed: str, centroids: int) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes, in that order; of rows of one id, in the order of their vectors."""
    rows = kept.where(F.col("id").isNotNull()).select(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("hash"), "id", "q")
    return [list(r["q"]) for r in rows.orderBy("hash", "id", "q").limit(centroids).collect()]  # as many as there are centroids


def _sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sum of the vectors nearest to each centroid."""
    shared, dims = distinct.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(shared.value), np.int64), np.zeros((len(shared.value), dims), np.int64)
        for batch in batches:
            rows, count = _rows(batch.column("q"), dims), batch.column("n").to_numpy()
            at, _ = nearest(rows, shared.value)
            np.add.at(n, at, count)
            np.add.at(total, at, rows * count[:, None])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = distinct.select("q", "n").mapInArrow(run, "cluster long, n long, total array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(dims)]).alias("total")).collect()  # a row a centroid
    return {r["cluster"]: (r["n"], r["total"]) for r in rows}


def lloyd(distinct: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after some rounds; one that no vector is nearest to stays as it is."""
    now = np.array(centroids, np.int64)
    for _ in range(rounds):
        for k, (n, total) in _sums(distinct, now).items():
            now[k] = [x // n for x in total]
    return now


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """q, n, cluster, distance of each distinct vector."""
    shared, dims = distinct.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, distance = nearest(_rows(batch.column("q"), dims), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("n"), pa.array(at.astype(np.int32)), pa.array(distance)], names=["q", "n", "cluster", "distance"])

    return distinct.select("q", "n").mapInArrow(run, "q array<int>, n long, cluster int, distance long")


def cluster(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """id, cluster, distance of every kept vector, and the final centroids.

    Rows whose vector is null, of another length, or has a null or non-finite component are
    left out. Components beyond MOST / scale count as that. Rows without an id are clustered
    but don't start a centroid; repeated rows come out as often as they came in. With fewer
    kept vectors than centroids there are as many centroids as vectors with an id; with none,
    no rows. ``centroids`` vectors are with the driver and each task.
    """
    vector = F.col(quoted(vector_col))
    kept = written(embeddings.select(F.col(quoted(id_col)).cast("long").alias("id"), quantised(vector, dims, scale).alias("q")).where("q IS NOT NULL"), "clustering-vectors")
    start = starting(kept, seed, centroids)
    if not start:
        return kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), np.zeros((0, dims), np.int64)
    distinct = written(kept.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "clustering-distinct")
    final = lloyd(distinct, start, rounds)
    found = written(assigned(distinct, final), "clustering-assigned")
    key = F.array_join("q", ",").alias("key")
    return join_hot(written(kept.select("id", key), "clustering-keys"), found.select(key, "cluster", "distance"), "key", "id").select("id", "cluster", "distance"), final


def report(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector; see cluster() for odd rows."""
    rows, final = cluster(embeddings)
    rows = written(rows, "clustering-rows")
    spark = embeddings.sparkSession
    names = spark.createDataFrame([(k, ",".join(map(str, c))) for k, c in enumerate(final.tolist())], "cluster int, text string")  # a row a centroid
    total = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(2**63 - 1)).cast("long")
    sums = rows.groupBy("cluster").agg(total("distance").alias("cluster_inertia"))
    sums = sums.join(sums.agg(total("cluster_inertia").alias("inertia")))  # one row
    sums = sums.join(names, "cluster").select("cluster", "cluster_inertia", "inertia", F.sha2("text", 256).alias("centroid_sha256"))
    return rows.join(F.broadcast(sums), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds one after the other, over components as rows."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"n{k} AS MATERIALIZED (SELECT vec_id, q, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, v.q, m.c, list_sum(list_transform(list_zip(v.q, m.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, m{k} m) GROUP BY vec_id, q)")
        if k < ROUNDS:
            steps.append(f"s{k} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT c, unnest(q) AS x, unnest(range(1, {DIMS + 1})) AS i FROM n{k}) GROUP BY c, i) GROUP BY c)")
            steps.append(f"m{k + 1} AS MATERIALIZED (SELECT c, coalesce(s.m, o.m) AS m FROM m{k} o LEFT JOIN s{k} s USING (c))")
    good = f"len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE {good}),
m0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS c, q AS m FROM (SELECT q, sha256('2:' || vec_id::VARCHAR) AS h FROM v ORDER BY h LIMIT {CENTROIDS})),
{', '.join(steps)},
i AS (SELECT c, sum(d)::BIGINT AS e FROM n{ROUNDS} GROUP BY c)
SELECT vec_id, c AS cluster, d AS distance, e AS cluster_inertia, (SELECT sum(e)::BIGINT FROM i) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM n{ROUNDS} JOIN m{ROUNDS} USING (c) JOIN i USING (c)"""


ORACLE = _oracle()
