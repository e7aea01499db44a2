"""Clusters of integer vectors around centroids, with Elkan's bounds and exact distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

CLUSTERS, ROUNDS, DIMENSION, SCALE = 8, 10, 64, 1024.0
#: Vectors of a pack, the row in which vectors and their bounds travel.
PACK = 4096
#: Whole components up to this size, as squared distances over up to 64 of them must fit a long.
MOST = 2**27
#: Bounds are widened by this share, far more than the rounding of the few operations behind them.
SLACK = 1e-12

STATE = "ids array<bigint>, v binary, own binary, upper binary, lower binary, distance binary, counts binary, sums binary, measured bigint"


def above(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float)) * (1 + SLACK)


def below(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float)) * (1 - SLACK)


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors to one centroid, or to one each."""
    return ((v - c) ** 2).sum(-1)


def first_bounds(v: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(own cluster, upper bound, lower bounds, distances measured) of vectors of which nothing is known."""
    far = np.stack([squares(v, c) for c in centers], axis=1)
    own = far.argmin(1)
    return own, above(far[np.arange(len(v)), own]), below(far), far.size


def next_bounds(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centers: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the centroids have moved, from the bounds before.

    A centroid is passed over only if a bound puts it strictly farther than the own one, so equal distances are always
    measured and go to the smaller number: the upper bound is below the lower bound to it, or below half the way from the
    own centroid to it.
    """
    k = len(centers)
    upper, lower = (upper + moved[own]) * (1 + SLACK), np.maximum(lower - moved, 0) * (1 - SLACK)
    half = np.stack([below(squares(centers, c)) for c in centers], axis=1) / 2
    nearest = np.where(np.eye(k, dtype=bool), np.inf, half).min(1)
    open_ = np.flatnonzero(~(upper < nearest[own]))
    measured = len(open_)
    if measured:
        w, at, low = v[open_], own[open_], lower[open_]
        best = squares(w, centers[at])
        high = above(best)
        low[np.arange(len(w)), at] = below(best)
        for j in range(k):
            go = np.flatnonzero((at != j) & ~(high < low[:, j]) & ~(high < half[at, j]))
            if not len(go):
                continue
            measured += len(go)
            far = squares(w[go], centers[j])
            low[go, j] = below(far)
            nearer = (far < best[go]) | ((far == best[go]) & (j < at[go]))
            to = go[nearer]
            at[to], best[to] = j, far[nearer]
            high[to] = above(best[to])
        own, upper, lower = own.copy(), upper.copy(), lower.copy()
        own[open_], upper[open_], lower[open_] = at, high, low
    return own, upper, lower, measured


def elkan_clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: float = SCALE, seed: str = "3:") -> tuple[DataFrame, DataFrame]:
    """Two tables for vectors(vec_id, embedding): members (vec_id, cluster, distance) and centroids (cluster, n, inertia, centroid).

    Components become floor(scale * x). Centroids start as the k vectors with the smallest sha256 of seed and vec_id. Each round
    assigns every vector to its nearest centroid, by squared distance and then number, and moves each centroid that has
    vectors to their mean, rounded down; then vectors are assigned once more.

    A vector keeps an upper bound of its distance to its own centroid and a lower one to each, which the moves of centroids
    widen; only where they leave a choice open are distances measured, in whole numbers. Vectors travel in packs of
    bounded size that never meet each other: a round reads the packs of the one before, writes them with their new bounds
    and sums as a table in spark.checkpoint.dir, and deletes the former. What comes to the driver is a row a cluster and
    task-summed, the centroids.

    Vectors that are null, of another length or hold null or non-finite components take no part; nor do those with a
    component beyond 2**27 once scaled, whose distances need not fit a long. A null vec_id is drawn by the empty text
    and stays null; rows that repeat each count; fewer than k vectors give fewer centroids; no rows give none; other columns
    are ignored. An inertia beyond a long is null.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.size("embedding") == dimension)
    rows = rows.where(~F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(F.floor(x * scale)) > MOST) | (F.abs(x) == float("inf")), F.lit(True))))
    drawn = rows.orderBy(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "vec_id", "embedding").limit(k).collect()
    centers = np.array([np.floor(scale * np.array(r.embedding)) for r in drawn], np.int64).reshape(len(drawn), dimension)
    k = len(drawn)
    members, centroids = "vec_id long, cluster int, distance long", "cluster int, n long, inertia long, centroid array<bigint>"
    if not k:
        return spark.createDataFrame([], members), spark.createDataFrame([], centroids)

    def packed(ids: pa.Array, v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centers: np.ndarray, measured: int, last: bool) -> pa.RecordBatch:
        counts, sums = np.bincount(own, minlength=k), np.stack([v[own == j].sum(0) for j in range(k)])
        distance = squares(v, centers[own]).tobytes() if last else b""
        blobs = [v.astype("<i4"), own.astype("<i4"), upper.astype("<f8"), lower.astype("<f8"), distance, counts.astype("<i8"), sums.astype("<i8")]
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([lists, *(pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in blobs), pa.array([int(measured)], pa.int64())], [f.split()[0] for f in STATE.split(", ")])

    def begin(centers: np.ndarray, last: bool):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, PACK):
                    part = batch.slice(at, PACK)
                    v = np.floor(scale * part["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)).astype(np.int64)
                    yield packed(part["vec_id"], v, *first_bounds(v, centers)[:3], centers, len(v) * k, last)

        return of

    def go_on(centers: np.ndarray, moved: np.ndarray, last: bool):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    blob = lambda c, kind: np.frombuffer(batch[c][r].as_py(), kind)  # noqa: B023, E731
                    v = blob("v", "<i4").astype(np.int64).reshape(-1, dimension)
                    own, upper, lower, measured = next_bounds(v, blob("own", "<i4"), blob("upper", "<f8"), blob("lower", "<f8").reshape(-1, k), centers, moved)
                    yield packed(batch["ids"][r].values, v, own, upper, lower, centers, measured, last)

        return of

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimension), np.int64)
        for batch in batches:
            for a, b in zip(batch["counts"], batch["sums"], strict=True):
                counts += np.frombuffer(a.as_py(), "<i8")
                sums += np.frombuffer(b.as_py(), "<i8").reshape(k, dimension)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    state, path = stored(rows.mapInArrow(begin(centers, rounds == 0), STATE), "clusters")
    for r in range(rounds):
        parts = state.select("counts", "sums").mapInArrow(summed, "cluster int, n long, s array<bigint>")
        total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dimension)]).alias("s")).collect()  # a row a cluster
        new = centers.copy()
        for t in total:
            if t.n:
                new[t.cluster] = [x // t.n for x in t.s]
        moved = above(squares(new, centers))
        centers, before = new, path
        state, path = stored(state.mapInArrow(go_on(centers, moved, r == rounds - 1), STATE), "clusters")
        dropped(spark, before)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                blob = lambda c, kind: np.frombuffer(batch[c][r].as_py(), kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch["ids"][r].values, pa.array(blob("own", "<i4")), pa.array(blob("distance", "<i8"))], ["vec_id", "cluster", "distance"])

    found = state.select("ids", "own", "distance").mapInArrow(unpacked, members)
    whole = {r.cluster: r for r in found.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()}
    inertia = lambda j: int(whole[j].inertia) if j in whole else 0
    table = [(j, whole[j].n if j in whole else 0, inertia(j) if inertia(j) < 2**63 else None, [int(x) for x in centers[j]]) for j in range(k)]
    return found, spark.createDataFrame(table, centroids)
