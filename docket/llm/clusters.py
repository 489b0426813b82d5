"""Centroid clustering of integer vectors by Lloyd's rounds under Hamerly's bounds.

Every vector keeps one upper bound of the distance to its own centroid and one lower bound of the distance to the second
nearest. When centroids move, the bounds loosen by the drift: the upper one by that of its own centroid, the lower one by the
largest of any other. A vector whose upper bound lies strictly below its lower bound, or below half the way from its
centroid to the nearest other one, can't have changed its cluster; the rest get their exact distance and, if still
ambiguous, a scan of all centroids in exact integers. Bounds are rounded outwards, so the result is that of full scans.

The state (id, vector, cluster, cluster before, bounds) is a table in the shared folder, one a round, so a lost executor
costs one round at most; the table before it is deleted then. Sums move by the vectors that changed cluster
only, in 64-bit partial sums by task. The driver holds centroids, sums and counts: k x dimensions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import removed, written_at
from docket.llm.vectors import finite, floors, packed, squares, unpacked

STATE = pa.schema([("vec_id", pa.int64()), ("x", pa.binary()), ("cluster", pa.int32()), ("was", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64())])
STATE_SQL = "vec_id long, x binary, cluster int, was int, upper double, lower double"


def integer_vectors(vectors: DataFrame, size: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): the rows whose vector has exactly ``size`` components, none null or non-finite; x is floor(scale * component), packed."""
    schema = pa.schema([("vec_id", pa.int64()), ("x", pa.binary())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = finite(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), packed(floors(x, scale))], schema=schema)

    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return picked.mapInArrow(of, "vec_id long, x binary")


def first_centroids(rows: DataFrame, k: int, size: int, salt: int) -> np.ndarray:
    """The vectors of the k smallest hashes, in their order; rows of one id, whose hashes tie, go by their packed bytes."""
    chosen = rows.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([np.frombuffer(bytes(r.x), "<i4") for r in chosen], np.int64).reshape(-1, size)


def _outwards(d2: np.ndarray, up: bool) -> np.ndarray:
    """Square roots of exact integers, rounded up or down past any error of doubles."""
    root = np.sqrt(d2.astype(np.float64))
    return root * (1 + 1e-12) + 1e-9 if up else np.maximum(root * (1 - 1e-12) - 1e-9, 0)


def _scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (smaller number on ties), exact squared distance to it, lower bound of the second nearest."""
    d2 = squares(x, centroids)
    best = d2.argmin(1)
    at = np.arange(len(x))
    near = d2[at, best]
    if len(centroids) == 1:
        return best, near, np.full(len(x), np.inf)
    d2[at, best] = np.iinfo(np.int64).max
    return best, near, _outwards(d2.min(1), up=False)


def _own(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector to the centroid of its cluster."""
    return ((x - centroids[cluster]) ** 2).sum(1)


def _state(batch: pa.RecordBatch, cluster: np.ndarray, was: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), pa.array(lower)], schema=STATE)


def first_round(centroids: np.ndarray) -> Callable:
    """All vectors against all centroids: the first state."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, near, lower = _scan(unpacked(batch.column(1), centroids.shape[1]), centroids)
            yield _state(batch, cluster, np.full(len(cluster), -1), _outwards(near, up=True), lower)

    return of


def next_round(before: np.ndarray, centroids: np.ndarray) -> Callable:
    """One round from the state under the centroids ``before`` to that under ``centroids``."""
    k = len(centroids)
    drift = _outwards(((centroids - before) ** 2).sum(1), up=True) * (centroids != before).any(1)
    order = np.argsort(-drift, kind="stable")
    others = np.full(k, drift[order[0]])  # the largest drift of any other centroid
    others[order[0]] = drift[order[1]] if k > 1 else 0.0
    between = squares(centroids, centroids)
    np.fill_diagonal(between, np.iinfo(np.int64).max)
    half = _outwards(between.min(1), up=False) / 2 if k > 1 else np.full(k, np.inf)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column(1), centroids.shape[1])
            cluster = batch.column(2).to_numpy().astype(np.int64)
            was = cluster.copy()
            upper = batch.column(4).to_numpy() + drift[cluster]
            lower = np.maximum(batch.column(5).to_numpy() - others[cluster] - 1e-9, 0)
            safe = np.maximum(lower, half[cluster])
            open_ = np.flatnonzero(upper >= safe)
            upper[open_] = _outwards(_own(x[open_], centroids, cluster[open_]), up=True)
            open_ = open_[upper[open_] >= safe[open_]]
            cluster[open_], near, lower[open_] = _scan(x[open_], centroids)
            upper[open_] = _outwards(near, up=True)
            yield _state(batch, cluster, was, upper, lower)

    return of


def moved_sums(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) by cluster of what came less what left, from the rows that changed cluster."""
    schema = pa.schema([("cluster", pa.int32()), ("part", pa.int32()), ("v", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, size + 1), np.int64)
        for batch in batches:
            x = unpacked(batch.column(0), size)
            ones = np.concatenate([x, np.ones((len(x), 1), np.int64)], 1)
            came, left = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for c in np.unique(came):
                sums[c] += ones[came == c].sum(0)
            for c in np.unique(left[left >= 0]):
                sums[c] -= ones[left == c].sum(0)
        c, p = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(p, pa.int32()), pa.array(sums[c, p])], schema=schema)

    out = np.zeros((k, size + 1), object)
    parts = state.where("cluster <> was").select("x", "cluster", "was").mapInArrow(of, "cluster int, part int, v long")
    for r in parts.groupBy("cluster", "part").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        out[r.cluster, r.part] = int(r.v)
    return out[:, :size], out[:, size]


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, salt: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256.

    Kept are vectors of exactly ``size`` components, none null or non-finite, turned into floor(scale * component); components
    whose integer is over 2 ** 27 in size raise an error. Centroids start as the k kept vectors with the smallest hash of
    "salt:vec_id"; with fewer than k vectors there are as many centroids. Ties go to the smaller number; a centroid becomes the exact
    floor of its vectors' mean, an empty one stays. Repeated ids are rows of their own; a null id is hashed as empty text. Without any kept vector
    the result is empty. Other columns are ignored, whatever their names.
    """
    rows, rows_path = written_at(integer_vectors(vectors, size, scale, id_col, vector_col), "vectors")
    now = first_centroids(rows, k, size, salt)
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    spark = vectors.sparkSession
    if not len(now):
        return spark.createDataFrame([], names)
    k, before = len(now), now
    sums, counts = np.zeros((k, size), object), np.zeros(k, object)
    path = rows_path
    for turn in range(rounds):
        step = first_round(now) if turn == 0 else next_round(before, now)
        source = rows if turn == 0 else state  # noqa: F821  (the state of the turn before)
        state, new = written_at(source.mapInArrow(step, STATE_SQL), f"clusters{turn}")
        removed(spark, path)
        path = new
        came, more = moved_sums(state, k, size)
        sums, counts = sums + came, counts + more
        before, now = now, now.copy()
        for c in range(k):
            if counts[c]:
                now[c] = [s // counts[c] for s in sums[c]]
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
    last = next_round(before, now) if rounds else first_round(now)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in last(batches):
            cluster = b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(_own(unpacked(b.column(1), size), now, cluster))], schema=schema)

    found, _ = written_at((state if rounds else rows).mapInArrow(final, "vec_id long, cluster int, distance long"), "clusters")
    removed(spark, path)
    inertia = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    of_cluster = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, now[c].tolist())).encode()).hexdigest()) for c in range(k)]
    told = spark.createDataFrame(of_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
