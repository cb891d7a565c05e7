"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors of length one with a cosine of at least t are at most sqrt(2 - 2t) apart. A random rotation spreads that distance over
all coordinates, which are split into blocks of ``BLOCK_DIMS``; if the squared distance is at most D, then in some block it is
at most D times the block's share of the coordinates. Each block has a range join of its own under that budget: a k-d
tree with splits at the medians of a bounded sample divides the block's space into leaves, every vector lies in one
leaf and visits the later leaves that the ball of its budget touches. The union of all blocks' pairs is verified by
the cosine of the original vectors in double precision.

A leaf's vectors are cut into tiles (``HOME_ROWS`` by ``VISIT_ROWS``), so a leaf of any size spreads over tasks of bounded
memory and no pair is lost. Equal vectors are one class and are counted, never paired.

Defined cases: vectors that are null, empty, zero or hold nulls or non-finite numbers link with nothing; vectors of different length
never link; each row counts as a vector, also when rows repeat; rows with a null id are returned unlinked; other columns are not read,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.store import cut, least_by_hash
from tidemark.llm.vectors import by_dim, classes, matrix, unit, usable, with_cosine

THRESHOLD = 0.95
BLOCK_DIMS = 8
#: Distinct vectors that the trees' splits are taken from, and vectors wanted in a leaf.
SAMPLE_ROWS = 8192
LEAF_ROWS = 2048
HOME_ROWS, VISIT_ROWS = 2048, 8192
#: Squared distances are compared in single precision with this much room; the verification is exact.
ROOM = 1e-5

HOME, VISIT_OWN, VISIT_OTHER = 0, 1, 2


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(dim)).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int) -> list[slice]:
    return [slice(k, min(k + BLOCK_DIMS, dim)) for k in range(0, dim, BLOCK_DIMS)]


def median_tree(points: np.ndarray, depth: int) -> np.ndarray:
    """Split values of a complete tree, node k's children at 2k + 1 and 2k + 2; level l splits coordinate l modulo the width."""
    tree = np.zeros(2**depth - 1)
    groups = [points]
    for level in range(depth):
        axis, following = level % points.shape[1], []
        for k, group in enumerate(groups):
            at = float(np.median(group[:, axis])) if len(group) else 0.0
            tree[2**level - 1 + k] = at
            following += [group[group[:, axis] < at], group[group[:, axis] >= at]]
        groups = following
    return tree


def visits(points: np.ndarray, tree: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home leaf) for every leaf, from the own one on, that comes within ``budget`` (squared) of a point."""
    depth, width = (len(tree) + 1).bit_length() - 1, points.shape[1]
    row, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
    off, home = np.zeros_like(points), np.ones(len(points), dtype=bool)
    for level in range(depth):
        axis = level % width
        delta = points[row, axis] - tree[node]
        right = delta >= 0
        cross = off.copy()
        cross[:, axis] = np.maximum(cross[:, axis], np.abs(delta))
        near = (cross * cross).sum(axis=1) <= budget
        row, off, home, node = (
            np.concatenate([row, row[near]]),
            np.concatenate([off, cross[near]]),
            np.concatenate([home, np.zeros(int(near.sum()), dtype=bool)]),
            np.concatenate([2 * node + 1 + right, 2 * node[near] + 1 + ~right[near]]),
        )
    leaf = node - (2**depth - 1)
    own = np.zeros(len(points), dtype=np.int64)
    own[row[home]] = leaf[home]
    keep = leaf >= own[row]
    return row[keep], leaf[keep], own[row[keep]]


def join_tile(home: np.ndarray, home_id: np.ndarray, visit: np.ndarray, visit_id: np.ndarray, own: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pairs of a tile within ``budget``; pairs of one leaf come once."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    h2 = (home * home).sum(axis=1)
    for k in range(0, len(visit), 1024):
        v = visit[k : k + 1024]
        d2 = v @ (-2 * home.T)
        d2 += h2
        i, j = np.nonzero(d2 <= (budget + ROOM - (v * v).sum(axis=1))[:, None])
        i += k
        ok = ~own[i] | (visit_id[i] < home_id[j])
        left.append(visit_id[i[ok]])
        right.append(home_id[j[ok]])
    return np.concatenate(left), np.concatenate(right)


def candidate_pairs(distinct: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b), a < b: pairs of classes that come within some block's budget."""
    spark = distinct.sparkSession
    distance = 2 - 2 * threshold
    sizes = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    sample: dict[int, np.ndarray] = {}
    for r in least_by_hash(distinct, ["rep"], SAMPLE_ROWS).groupBy("dim").agg(F.collect_list("v").alias("v")).collect():
        sample[r["dim"]] = unit(np.array(r["v"], dtype=np.float64)) @ rotation(r["dim"])
    trees = {}
    for dim, n in sizes.items():
        own = sample.get(dim, np.zeros((0, dim)))
        depth = min(max(0, int(np.ceil(np.log2(max(1, n / LEAF_ROWS))))), max(0, int(np.log2(max(1, len(own) / 16)))))
        for k, block in enumerate(blocks_of(dim)):
            trees[dim, k] = median_tree(own[:, block], depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dim", "block", "leaf", "role", "rep", "x"]
        for whole in batches:
            for dim, batch in by_dim(whole, "v") if whole.num_rows else ():
                turned = unit(matrix(batch.column("v"), dim)) @ rotation(dim)
                rep = batch.column("rep").to_numpy()
                for k, block in enumerate(blocks_of(dim)):
                    points = np.ascontiguousarray(turned[:, block])
                    budget = distance * points.shape[1] / dim
                    row, leaf, own = visits(points, trees[dim, k], budget * (1 + 1e-9) + 1e-12)
                    at_home = leaf == own
                    role = np.where(at_home, VISIT_OWN, VISIT_OTHER)
                    row, leaf, role = np.concatenate([row, row[at_home]]), np.concatenate([leaf, leaf[at_home]]), np.concatenate([role, np.full(int(at_home.sum()), HOME)])
                    flat = pa.py_buffer(np.ascontiguousarray(points[row].astype("<f4")))
                    wide = 4 * points.shape[1]
                    x = pa.Array.from_buffers(pa.binary(wide), len(row), [None, flat]).cast(pa.binary())
                    n = len(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim), pa.int32()), pa.array(np.full(n, k), pa.int32()), pa.array(leaf, pa.int32()), pa.array(role, pa.int32()), pa.array(rep[row]), x], names)

    def tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim, k = int(key[0]), int(key[1])
        width = blocks_of(dim)[k].stop - blocks_of(dim)[k].start
        x = np.frombuffer(b"".join(rows["x"]), dtype="<f4").reshape(-1, width)
        role, rep = rows["role"].to_numpy(), rows["rep"].to_numpy()
        h, v = role == HOME, role != HOME
        a, b = join_tile(x[h], rep[h], x[v], rep[v], role[v] == VISIT_OWN, distance * width / dim)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    placed = cut(distinct.select("rep", "v").mapInArrow(place, "dim int, block int, leaf int, role int, rep long, x binary"))
    # at most one row for each leaf of the trees, whose number the sample bounds
    count = placed.groupBy("dim", "block", "leaf").agg(F.count(F.when(F.col("role") == HOME, 1)).alias("h"), F.count(F.when(F.col("role") != HOME, 1)).alias("w"))
    count = count.where("h > 0").select("dim", "block", "leaf", F.ceil(F.col("h") / HOME_ROWS).cast("int").alias("hs"), F.ceil(F.col("w") / VISIT_ROWS).cast("int").alias("vs"))
    count = spark.createDataFrame(count.collect(), count.schema)
    both = placed.join(F.broadcast(count), ["dim", "block", "leaf"])
    share = F.xxhash64("rep", F.lit(1))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tiles = both.withColumn("i", F.when(F.col("role") == HOME, F.array(F.pmod(share, F.col("hs")).cast("int"))).otherwise(every("hs")))
    tiles = tiles.withColumn("j", F.when(F.col("role") == HOME, every("vs")).otherwise(F.array(F.pmod(share, F.col("vs")).cast("int"))))
    tiles = tiles.withColumn("i", F.explode("i")).withColumn("j", F.explode("j")).select("dim", "block", "leaf", "i", "j", "role", "rep", "x")
    return tiles.groupBy("dim", "block", "leaf", "i", "j").applyInPandas(tile, "a long, b long").distinct()


def similar_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (smallest id that links reach)."""
    rows = usable(vectors, id_col, vec_col)
    distinct = classes(rows)
    pairs = candidate_pairs(distinct, threshold)
    left = distinct.select(F.col("rep").alias("a"), F.col("v").alias("va"), F.col("n").alias("na"))
    right = distinct.select(F.col("rep").alias("b"), F.col("v").alias("vb"), F.col("n").alias("nb"))
    links = cut(with_cosine(pairs.join(left, "a").join(right, "b"), ["a", "b", "na", "nb"], threshold))
    degree = links.select(F.col("a").alias("rep"), F.col("nb").alias("k")).union(links.select("b", "na")).groupBy("rep").agg(F.sum("k").alias("k"))
    found = distinct.select("rep", "n", "v").join(degree, "rep", "left").join(components(links.select("a", "b")).withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("v", (F.coalesce("k", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("_v"))
    known = F.col("vec_id").isNotNull() & F.col("n_links").isNotNull()
    return ids.join(found, F.col("_v") == F.col("v"), "left").select(
        "vec_id", F.when(known, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(known, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")
    )
