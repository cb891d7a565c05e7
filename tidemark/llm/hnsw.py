"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors are one class. Classes are dealt by hash to shards; each shard's graph is built in one task and stored as one
row of flat neighbour arrays. Shards grow with the table, from ``SHARD_ROWS`` up to what a task holds (``SHARD_BYTES`` of
vectors), so that their number stays near ``SHARDS`` as long as it can. Every query visits every shard: a task opens a shard once and the
queries stream by, in Arrow batches. The shards' results are merged by cosine in double precision on the original vectors,
and classes become their members again.

Inside a task all work is in NumPy over many vectors at a time: insertions run in batches whose beam searches advance
together, and so do the searches of a block.

Defined cases: vectors that are null, empty, zero or hold nulls or non-finite numbers take no part, neither do rows with a null id;
vectors of different length are never neighbours; with fewer candidates than asked all are returned; ties go to the smaller
id; an id names one row: of rows that share it the first by vector is the query, and all of them are the query's own, so none is
its neighbour (for other queries each is a candidate); other columns are not read, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.store import cut
from tidemark.llm.vectors import classes, matrix, unit, usable, with_cosine

SHARDS, SHARD_ROWS, SHARD_BYTES = 64, 8192, 1 << 26
#: A table of few shards deals the queries of each over several tasks, of so many queries at least.
QUERY_ROWS = 2048
#: Links of a node above the lowest layer (twice as many there), beam widths of insertion and of search.
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 96, 128
BATCH = 256
EXPAND = 4


def beam_search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes that a best-first walk finds from ``entry``, for all queries in step; -1 where fewer."""
    n, q = len(x), len(queries)
    every = np.arange(q)
    seen = np.zeros((q, n + 1), dtype=bool)
    seen[:, n] = True
    seen[every, entry] = True
    ids = np.full((q, beam), n, dtype=np.int64)
    sims = np.full((q, beam), -np.inf, dtype=np.float32)
    done = np.ones((q, beam), dtype=bool)
    ids[:, 0], sims[:, 0], done[:, 0] = entry, np.einsum("ij,ij->i", queries, x[entry]), False
    take = min(EXPAND, beam)
    live = every
    while len(live):
        waiting = np.where(done[live], -np.inf, sims[live])
        at = np.argpartition(-waiting, take - 1, axis=1)[:, :take] if beam > take else np.broadcast_to(np.arange(beam), (len(live), beam))
        picked = np.isfinite(np.take_along_axis(waiting, at, axis=1))
        some = picked.any(axis=1)
        live, at, picked = live[some], at[some], picked[some]
        if not len(live):
            break
        done[live[:, None], at] = True
        nodes = np.where(picked, ids[live[:, None], at], n)
        near = np.sort(links[nodes].reshape(len(live), -1), axis=1)  # node n has no links
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        fresh = ~seen[live[:, None], near]
        near = np.where(fresh, near, n)
        width = int(fresh.sum(axis=1).max())
        if not width:
            continue
        near = np.sort(near, axis=1)[:, :width]
        seen[live[:, None], near] = True
        sim = np.einsum("qkd,qd->qk", x[np.minimum(near, n - 1)], queries[live])
        sim[near == n] = -np.inf
        all_ids, all_sims = np.concatenate([ids[live], near], axis=1), np.concatenate([sims[live], sim], axis=1)
        all_done = np.concatenate([done[live], near == n], axis=1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[live], sims[live], done[live] = (np.take_along_axis(a, best, axis=1) for a in (all_ids, all_sims, all_done))
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
    return np.where(np.isfinite(sims), ids, -1), sims


def choose(x: np.ndarray, centre: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (-1: none), nearest first, those nearer to the centre than to any one chosen; then the rest as room allows."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
    rows, c = ids.shape
    v = x[np.maximum(ids, 0)]
    among = np.einsum("rcd,red->rce", v, v)
    chosen, passed = np.zeros((rows, c), dtype=bool), np.zeros((rows, c), dtype=bool)
    for k in range(c):
        valid = ids[:, k] >= 0
        blocked = (chosen & (among[:, k, :] > sims[:, k, None])).any(axis=1)
        good = valid & ~blocked & (chosen.sum(axis=1) < most)
        chosen[:, k], passed[:, k] = good, valid & ~good
    rank = np.where(chosen, 0, np.where(passed, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(np.where(chosen | passed, ids, -1), order, axis=1)
    return np.pad(out, ((0, 0), (0, max(0, most - out.shape[1]))), constant_values=-1)


@dataclass
class Graph:
    """``layers[l]`` is (nodes + 1, links) of node numbers; the count of nodes stands for none, and is the last row."""

    x: np.ndarray
    layers: list[np.ndarray]
    entry: int

    def search(self, queries: np.ndarray, beam: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full(len(queries), self.entry)
        for links in self.layers[:0:-1]:
            entry = beam_search(self.x, links, queries, entry, 1)[0][:, 0]
        return beam_search(self.x, self.layers[0], queries, entry, beam)


def build(x: np.ndarray, seed: int = 0) -> Graph:
    """Insert all rows of ``x`` (length one, single precision), in batches that are never larger than what the graph holds."""
    n = len(x)
    rng = np.random.Generator(np.random.PCG64(seed))
    level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(np.int64), 12)
    order = rng.permutation(n)
    top = int(level.max())
    first = int(order[np.argmax(level[order] == top)])
    order = np.concatenate([[first], order[order != first]])
    layers = [np.full((n + 1, LINKS * (2 if k == 0 else 1)), n, dtype=np.int64) for k in range(top + 1)]
    graph, at = Graph(x, layers, first), 1
    while at < n:
        batch = order[at : at + min(BATCH, at)]
        at += len(batch)
        entry = np.full(len(batch), first)
        for k in range(top, -1, -1):
            links, inserts = layers[k], level[batch] >= k
            most = links.shape[1]
            if not inserts.all():
                entry_next = beam_search(x, links, x[batch], entry, 1)[0][:, 0]
            else:
                entry_next = entry.copy()
            if inserts.any():
                own = batch[inserts]
                ids, sims = beam_search(x, links, x[own], entry[inserts], BUILD_BEAM)
                entry_next[inserts] = ids[:, 0]
                ids, sims = ids[:, :48], sims[:, :48]
                mates = x[own] @ x[own].T
                np.fill_diagonal(mates, -np.inf)
                few = min(8, len(own))
                near = np.argpartition(-mates, few - 1, axis=1)[:, :few]
                mate_sims = np.take_along_axis(mates, near, axis=1)
                ids = np.concatenate([ids, np.where(np.isfinite(mate_sims), own[near], -1)], axis=1)
                to = choose(x, own, ids, np.concatenate([sims, mate_sims], axis=1), LINKS)
                links[own, :LINKS] = np.where(to < 0, n, to)
                _link_back(x, links, own, to, n, most)
            entry = entry_next
    return graph


def _link_back(x: np.ndarray, links: np.ndarray, own: np.ndarray, to: np.ndarray, n: int, most: int) -> None:
    """Add the links to ``own`` at the nodes they point at, and thin out the lists that overflow."""
    u, v = np.repeat(own, to.shape[1]), to.ravel()
    u, v = u[v >= 0], v[v >= 0]
    order = np.argsort(v, kind="stable")
    u, v = u[order], v[order]
    nodes, start, count = np.unique(v, return_index=True, return_counts=True)
    for a in range(0, len(nodes), 512):
        some, s, c = nodes[a : a + 512], start[a : a + 512], count[a : a + 512]
        wide = int(c.max())
        place = s[:, None] + np.arange(wide)
        new = np.where(np.arange(wide) < c[:, None], u[np.minimum(place, len(u) - 1)], n)
        both = np.concatenate([links[some], new], axis=1)
        both = np.sort(both, axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = n
        sims = np.einsum("rcd,rd->rc", x[np.minimum(both, n - 1)], x[some])
        sims[both == n] = -np.inf
        keep = min(both.shape[1], most + 16)
        best = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
        ids, sims = np.take_along_axis(both, best, axis=1), np.take_along_axis(sims, best, axis=1)
        kept = choose(x, some, np.where(ids == n, -1, ids), sims, most)
        links[some] = np.where(kept < 0, n, kept)


INDEX = "dim int, shard int, ids binary, x binary, links array<binary>, entry int"


def shards_of(rows: int, dim: int) -> int:
    """Shards for so many vectors of length ``dim``."""
    most = max(SHARD_ROWS, SHARD_BYTES // (4 * dim))
    return -(-rows // min(most, max(SHARD_ROWS, -(-rows // SHARDS))))


def build_index(distinct: DataFrame) -> DataFrame:
    """One row per shard: ids, vectors of length one, and the neighbour arrays of each layer. distinct: (rep, v, dim)."""
    spark = distinct.sparkSession
    sizes = [(r["dim"], shards_of(r["n"], r["dim"])) for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()]
    shards = spark.createDataFrame(sizes, "dim int, shards long")
    dealt = distinct.join(F.broadcast(shards), "dim").select("dim", F.pmod(F.xxhash64("rep"), "shards").cast("int").alias("shard"), "rep", "v")

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        x = unit(np.stack(rows["v"].to_numpy()).astype(np.float64)).astype(np.float32)
        graph = build(x)
        links = [layer.astype("<i4").tobytes() for layer in graph.layers]
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "ids": [rows["rep"].to_numpy().astype("<i8").tobytes()], "x": [x.tobytes()], "links": [links], "entry": [graph.entry]})

    return dealt.groupBy("dim", "shard").applyInPandas(make, INDEX)


def open_index(ids: bytes, x: bytes, links: list[bytes], entry: int) -> tuple[np.ndarray, Graph]:
    own = np.frombuffer(ids, dtype="<i8")
    layers = [np.frombuffer(b, dtype="<i4").reshape(len(own) + 1, -1).astype(np.int64) for b in links]
    return own, Graph(np.frombuffer(x, dtype=np.float32).reshape(len(own), -1), layers, entry)


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rep): each query's ``k`` nearest classes in every shard. queries: (query_id, v, dim)."""
    spark = index.sparkSession
    counts = {r["dim"]: r["n"] for r in queries.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    shards = {r["dim"]: r["n"] for r in index.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    blocks = {d: min(-(-n // QUERY_ROWS), -(-SHARDS // shards[d])) for d, n in counts.items() if d in shards}
    sizes = F.broadcast(spark.createDataFrame([(d, n, shards[d]) for d, n in blocks.items()], "dim int, blocks int, shards int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys, parts = ["dim", "shard", "block"], {"ids": "binary", "x": "binary", "links": "array<binary>", "entry": "int", "query_id": "long", "v": queries.schema["v"].dataType.simpleString()}
    own = lambda *names: [F.col(c) if c in names else F.lit(None).cast(t).alias(c) for c, t in parts.items()]
    held = index.join(sizes, "dim").select("dim", "shard", every("blocks").alias("block"), F.lit(0).alias("turn"), *own("ids", "x", "links", "entry"))
    asked = queries.join(sizes, "dim").select("dim", every("shards").alias("shard"), F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), F.lit(1).alias("turn"), *own("query_id", "v"))
    # a shard, then its queries
    dealt = held.union(asked).repartition(*keys).sortWithinPartitions(*keys, "turn")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, graph = None, None
        for batch in batches:
            turn = batch.column("turn").to_numpy()
            opens = np.flatnonzero(turn == 0).tolist()
            for a, b in zip([0, *opens], [*opens, batch.num_rows], strict=True):
                if a < b and turn[a] == 0:
                    ids, graph = open_index(*(batch.column(c)[a].as_py() for c in ("ids", "x", "links", "entry")))
                    a += 1
                if a == b:
                    continue
                asked = batch.slice(a, b - a)
                q = unit(matrix(asked.column("v"), graph.x.shape[1])).astype(np.float32)
                found = np.concatenate([graph.search(q[i : i + BATCH], max(beam, k))[0][:, :k] for i in range(0, len(q), BATCH)])
                at, to = np.nonzero(found >= 0)
                yield pa.RecordBatch.from_arrays([asked.column("query_id").take(pa.array(at)), pa.array(ids[found[at, to]].astype(np.int64))], ["query_id", "rep"])

    return dealt.mapInArrow(look, "query_id long, rep long")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each row whose id is divisible by ``every``, its own row apart."""
    rows = usable(vectors, id_col, vec_col)
    distinct = classes(rows)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    index = cut(build_index(distinct))
    # one class may be the query's own, and k + 1 of its smallest ids are enough wherever it stands
    first = cut(search_index(index, queries, k + 1))
    scored = first.join(queries.select("query_id", F.col("v").alias("va")), "query_id").join(distinct.select("rep", F.col("v").alias("vb")), "rep")
    scored = with_cosine(scored, ["query_id", "rep"])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    scored = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    turn = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(turn)).where(F.col("r") <= k + 1).select("v", "vec_id")
    few = few.join(distinct.select("v", "rep"), "v").select("rep", "vec_id")
    out = scored.join(few, "rep").where("vec_id != query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
