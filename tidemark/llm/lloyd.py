"""Centroid clustering by delta Lloyd: a round touches only what the round before has changed.

Vectors are quantised to integers, so sums are exact and signed transfers between clusters can replace sums over everything.
State is a table (vec_id, q, cluster, distance, was) in the shared folder, one row a vector, written again by every round: the
assignments persist, and a lost executor costs a part of one round. Beside it, every centroid's sum and count persist, 64 numbers
and one for each of ``k`` clusters, on the driver.

1. Assign. A vector whose own centroid has not changed keeps its distance to it and is compared with the changed centroids
   only; one whose own centroid has changed is compared with all. If nothing has changed, nothing is read or written.
2. Transfer. Rows that have moved (``was`` is not ``cluster``) are summed in each task, plus for where they are and minus for
   where they were, and the tasks' sums meet in one grouping by cluster: at most ``k`` rows leave it.
3. Update. The transfers are added to the persisted sums; every centroid that has rows becomes floor(sum / count).

Nothing is shuffled but those sums, so a cluster may hold any share of the vectors.

Defined cases: vectors that are null, of another length, or hold a null, NaN or infinity give no row; a null id is kept, and begins
a cluster only after all others; rows that repeat an id are vectors of their own (with equal hashes, the smaller vector begins a cluster
first); with fewer vectors than clusters there are as many clusters as vectors; an empty table gives no rows; other columns are not read.
A component beyond ``MOST_COMPONENT``, whose squares would not fit a long, raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import cut, discard
from tidemark.llm.vectors import matrix

CLUSTERS, ROUNDS, SCALE, DIM = 16, 3, 64, 64
#: Largest absolute integer component: 64 squares of differences twice as large fit a long.
MOST_COMPONENT = 1 << 27
#: Up to here, products and their sums are exact in double precision, and BLAS can make them.
EXACT_IN_DOUBLE = 1 << 21
#: Vectors compared at once inside a task.
SLICE = 8192

STATE = "vec_id long, q array<int>, cluster int, distance long, was int"
TRANSFERS = "cluster int, n long, total array<long>"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): vectors of ``dim`` finite components as integers floor(scale * x)."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    whole = rows.where((F.size("v") == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    scaled = lambda x: F.floor(x * scale)
    small = F.when(F.exists(v, lambda x: F.abs(x * scale) > MOST_COMPONENT), F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(F.transform(v, lambda x: scaled(x).cast("int")))
    return whole.select("vec_id", small.alias("q"))


def seeds(rows: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The vectors that come first by sha256 of ``seed:vec_id``, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(order.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()
    return np.array([r["q"] for r in first], dtype=np.int64)


def distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``q`` to every centroid."""
    if max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT_IN_DOUBLE:
        a, b = q.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((q - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(q: np.ndarray, centroids: np.ndarray, changed: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector, of several the smaller cluster. A cluster below 0: not assigned yet."""
    cluster, distance = cluster.copy(), distance.copy()
    stays = (cluster >= 0) & ~changed[cluster]
    anew = np.flatnonzero(~stays)
    if len(anew):
        every = distances(q[anew], centroids)
        cluster[anew] = every.argmin(axis=1)
        distance[anew] = every[np.arange(len(anew)), cluster[anew]]
    at, other = np.flatnonzero(stays), np.flatnonzero(changed)
    if len(at) and len(other):
        some = distances(q[at], centroids[other])
        best = some.argmin(axis=1)
        found, name = some[np.arange(len(at)), best], other[best]
        moves = (found < distance[at]) | ((found == distance[at]) & (name < cluster[at]))
        cluster[at[moves]], distance[at[moves]] = name[moves], found[moves]
    return cluster, distance


def assign(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """``STATE`` after one round of comparing; ``was`` is the cluster before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                was, held = (part.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "distance"))
                cluster, distance = nearest(matrix(part.column("q"), centroids.shape[1]).astype(np.int64), centroids, changed, was, held)
                columns = [part.column("vec_id"), part.column("q"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(was.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "q", "cluster", "distance", "was"])

    return state.select("vec_id", "q", "cluster", "distance").mapInArrow(run, STATE)


def transfers(state: DataFrame, k: int, dim: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, rows, sum of vectors) that each cluster has won less what it has lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for batch in batches:
            q = matrix(batch.column("q"), dim).astype(np.int64)
            for column, sign in (("cluster", 1), ("was", -1)):
                own = batch.column(column).to_numpy()
                at = own >= 0
                np.add.at(count, own[at], sign)
                np.add.at(total, own[at], sign * q[at])
        at = np.flatnonzero((count != 0) | (total != 0).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at]), pa.array(total[at].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = state.where("cluster <> was").select("q", "cluster", "was").mapInArrow(run, TRANSFERS)
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[j]).alias(f"s{j}") for j in range(dim)])
    return [(r["cluster"], r["n"], list(r)[2:]) for r in sums.collect()]


def delta_lloyd(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, q, cluster, distance) of every vector after ``rounds`` rounds and a last assignment, and the centroids.

    The table lies in the shared folder. Ties go to the smaller cluster; a cluster without vectors keeps its centroid.
    """
    fresh = cut(quantised(vectors, id_col, vec_col, dim, scale).select("vec_id", "q", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(-1).alias("was")))
    centroids = seeds(fresh, k, seed).reshape(-1, dim)
    k = len(centroids)
    if not k:
        return fresh.drop("was"), centroids
    state, changed = fresh, np.ones(k, dtype=bool)
    count, total = [0] * k, [[0] * dim for _ in range(k)]
    for done in range(rounds + 1):
        old, state = state, cut(assign(state, centroids, changed))
        discard(old)
        if done == rounds:
            break
        for cluster, n, moved in transfers(state, k, dim):
            count[cluster] += n
            total[cluster] = [a + b for a, b in zip(total[cluster], moved, strict=True)]
        now = np.array([[s // n for s in own] if n else old_.tolist() for own, n, old_ in zip(total, count, centroids, strict=True)], dtype=np.int64)
        changed, centroids = (now != centroids).any(axis=1), now
        if not changed.any():
            break
    return state.drop("was"), centroids


def digests(centroids: np.ndarray) -> list[str]:
    """sha256 of each centroid's components as decimal integers between commas."""
    return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]


def cluster_report(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): what each cluster sums to, beside each vector."""
    sums = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row for each cluster
    names = digests(centroids)

    def by_cluster(values: list, kind: str) -> Column:
        return F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))

    own = by_cluster([sums.get(c, 0) for c in range(len(names))], "bigint")
    return state.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), by_cluster(names, "string").alias("centroid_sha256"))
