"""Centroids of integer vectors: float products screen with error intervals, whole numbers decide.

A vector of ``dims`` finite components becomes one of whole numbers, floor(scale * x). It goes to its nearest centroid by squared Euclidean distance, ties to the
smaller number, and nothing of the result depends on rounding:

* |x - c|^2 = |x|^2 + g, where g = |c|^2 - 2 x.c. A float32 matrix product gives x.c for a block of vectors and all centroids. In whatever order it is
  summed, its error is below ``gamma(dims + 2)`` |x| |c| (the two for the rounding of x and c themselves, with gamma(k) = k u / (1 - k u), u = 2^-24). Hence an interval for each g.
* Centroids whose interval begins at or below the least upper end remain. Where more than one does, their distances are computed in 64-bit whole numbers.
* Before that all is shifted by one whole-number vector near the middle of the centroids, which changes no distance and makes the norms, and so the intervals, small.

The vectors are written once as bytes. A round reads them, each task adds up its own sums per centroid, and Spark adds those of the tasks; the driver gets no more than
the k centroids. So a centroid that has a third of all vectors costs no task more than others.

Defined results: vectors of another length, null ones, and those with a null, NaN or infinite component are not kept, nor those with a component beyond +-2^27 after scaling, whose distances don't fit
in 64 bits. Repeated rows are vectors of their own. The first centroids are the vectors of the least digests, a null key last, equal keys by their components. Fewer vectors
than k give as many centroids, none an empty result. Sums of distances beyond 64 bits are null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

#: Bound of a component's absolute value: (2^28)^2 * 64 is below 2^63.
LIMIT = 1 << 27
#: Vectors that are multiplied at once.
BLOCK = 4096
_UNIT = 2.0**-24
_RAISED = 1 << 31


def whole_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """key and v, the kept vectors as dims big-endian integers of 32 bits, each raised by 2^31: the order of the bytes is that of the components."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            lists = lists.cast(pa.large_list(lists.type.value_type))
            full = np.asarray(lists.is_valid()) & (np.asarray(lists.value_lengths().fill_null(-1)) == dims)
            rows = np.flatnonzero(full)
            values = lists.take(pa.array(rows)).flatten()
            x = np.asarray(values.cast(pa.float64()).fill_null(np.nan)).reshape(len(rows), dims)
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(x * scale)
                fit = (np.abs(x) <= LIMIT).all(axis=1)
            data = (x[fit].astype(np.int64) + _RAISED).astype(">u4").tobytes()
            out = pa.Array.from_buffers(pa.binary(4 * dims), int(fit.sum()), [None, pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(rows[fit])), out.cast(pa.binary())], ["k", "v"])

    found = vectors.select(F.col(key).alias("k"), F.col(column).alias("v")).mapInArrow(run, f"k {kind}, v binary")
    return found.withColumnRenamed("k", key)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return _numbers(b"".join(column.to_pylist())).reshape(len(column), dims)


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=">u4").astype(np.int64) - _RAISED


@dataclass
class Centroids:
    """k centroids (whole numbers) and what the screening of vectors against them needs."""

    at: np.ndarray

    def __post_init__(self) -> None:
        k, dims = self.at.shape
        self.middle = (self.at.sum(axis=0) // max(k, 1)).astype(np.int64)
        moved = self.at - self.middle
        self.moved, self.single = moved, moved.astype(np.float32)
        self.squares = (moved * moved).sum(axis=1)
        # Norms rounded up by far more than float64 can lose.
        self.norms = np.sqrt(self.squares.astype(np.float64)) * (1 + 1e-9)
        self.gamma = (dims + 2) * _UNIT / (1 - (dims + 2) * _UNIT)

    def screened(self, x: np.ndarray) -> np.ndarray:
        """Which centroids (columns) may be the nearest of each vector (rows; moved by middle)."""
        products = (x.astype(np.float32) @ self.single.T).astype(np.float64)
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        squares = self.squares.astype(np.float64)
        g = squares - 2 * products
        # The product's error twice, and a bound of what these float64 lines themselves round off.
        wide = 2.000001 * self.gamma * norms[:, None] * self.norms + (squares + 2 * np.abs(products)) * 2.0**-50
        return g - wide <= (g + wide).min(axis=1, keepdims=True)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The centroid of each vector, the squared distance, and how many vectors the screening left undecided."""
        x = vectors - self.middle
        may = self.screened(x)
        cluster, open_ = may.argmax(axis=1), np.flatnonzero(may.sum(axis=1) > 1)
        if len(open_):
            row, c = np.nonzero(may[open_])
            exact = ((x[open_[row]] - self.moved[c]) ** 2).sum(axis=1)
            order = np.lexsort((c, exact, row))  # nonzero lists rows in order, so the first of each row is the nearest, of the smallest number
            cluster[open_] = c[order[np.searchsorted(row, np.arange(len(open_)))]]
        return cluster, ((x - self.moved[cluster]) ** 2).sum(axis=1), len(open_)


def first_centroids(vectors: DataFrame, k: int, key: str, seed: str, dims: int) -> np.ndarray:
    """The k vectors whose keys have the least digests."""
    digest = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    rows = vectors.select(digest.alias("digest"), "v").orderBy(F.col("digest").asc_nulls_last(), "v").limit(k).collect()
    return _numbers(b"".join(bytes(r["v"]) for r in rows)).reshape(len(rows), dims)


def moved_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid moved to floor(sum / count) of its vectors; those without vectors as they are."""
    k, dims = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Centroids(shared.value)
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column("v").slice(lo, BLOCK), dims)
                cluster = at.nearest(x)[0]
                order = np.argsort(cluster, kind="stable")
                some, begin = np.unique(cluster[order], return_index=True)
                sums[some] += np.add.reduceat(x[order], begin, axis=0)
                counts += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), pa.array(list(sums[some]), type=pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = vectors.select("v").mapInArrow(run, "cluster bigint, n bigint, sums array<bigint>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(28,0)")).alias(f"s{i}") for i in range(dims)]).collect()
    out = centroids.copy()
    for r in total:
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    shared.unpersist()
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray, key: str = "vec_id") -> DataFrame:
    """key, cluster and distance (squared) of each vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    kind = vectors.schema[key].dataType.simpleString()
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Centroids(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                cluster, distance, _ = at.nearest(_matrix(batch.column("v").slice(lo, BLOCK), dims))
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(lo, BLOCK), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["k", "cluster", "distance"])

    found = vectors.select(F.col(key).alias("k"), "v").mapInArrow(run, f"k {kind}, cluster int, distance bigint")
    return found.withColumnRenamed("k", key)


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, key: str = "vec_id", column: str = "embedding", dims: int = 64, scale: int = 256, seed: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """The kept vectors with their cluster, distance, cluster_inertia and inertia, and the centroids."""
    kept = written(whole_vectors(vectors, key, column, dims, scale), "vectors")
    centroids = first_centroids(kept, k, key, seed, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved_centroids(kept, centroids)
    found = written(assigned(kept, centroids, key), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    long = lambda n: n if n < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, long(s), long(sum(sums.values())), digests[c]) for c, s in sums.items()]
    each = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")  # k rows at most
    return found.join(F.broadcast(each), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector with its centroid after five rounds."""
    return clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))[0]


def _sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256) -> str:
    def near(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (
  SELECT r, first(cluster ORDER BY dist, cluster) AS cluster, min(dist) AS dist FROM (
    SELECT r, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM v CROSS JOIN c{n}
  ) GROUP BY r
)"""

    def move(n: int) -> str:
        return f"""m{n} AS MATERIALIZED (
  SELECT cluster, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
    SELECT cluster, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN v USING (r), range(1, {dims + 1}) AS t(i) GROUP BY cluster, i
  )
), c{n + 1} AS MATERIALIZED (
  SELECT c{n}.cluster, coalesce(m.c, c{n}.c) AS c FROM c{n} LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS c FROM m{n} GROUP BY cluster) m USING (cluster)
)"""

    steps = [x for n in range(rounds) for x in (near(n), move(n))] + [near(rounds)]
    return f"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
), v AS MATERIALIZED (
  SELECT r, vec_id, list_transform(embedding, lambda y: CAST(floor({scale} * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM e
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y) AND abs(floor({scale} * CAST(y AS DOUBLE))) <= {LIMIT})) = {dims}
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS INTEGER) AS cluster, x AS c FROM v ORDER BY cluster LIMIT {k}
), {", ".join(steps)}
SELECT vec_id, cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (cluster)
"""


ORACLE_SQL = _sql()
