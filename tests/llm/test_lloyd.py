"""Centroid clustering against plain Lloyd rounds, and what each round touches."""

import hashlib
import math

import numpy as np
import pytest

from tests.conftest import SF, same_rows
from tidemark.llm import lloyd, queries
from tidemark.llm.oracles import OP13_SQL


def plain(rows, k, rounds):
    """(vec_id, cluster, distance) and centroids, in Python integers."""
    vectors = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(vectors, key=lambda r: (name(r[0]), r[1]))[:k]]
    for done in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in vectors]
        if done < rounds:
            for n in range(len(centroids)):
                some = [v for (_, v), o in zip(vectors, own, strict=True) if o[1] == n]
                if some:
                    centroids[n] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    return sorted(((i, o[1], o[0]) for (i, _), o in zip(vectors, own, strict=True)), key=repr), centroids


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")


def odd_rows(n, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(rng.integers(0, 4), 0.4, 64).tolist()) for i in range(n)]
    rows += [(7, rows[3][1]), (8, rows[3][1]), (None, rows[-1][1]), (900, None), (901, []), (902, [1.0] * 63), (903, [0.0] * 64), (904, [0.0] * 63 + [None]), (905, [float("nan")] * 64), (906, [float("inf")] * 64)]
    return rows


@pytest.mark.parametrize("n, k, rounds", [(200, 16, 3), (40, 16, 3), (4, 16, 3), (120, 5, 12), (50, 3, 0)])
def test_delta_rounds_equal_plain_rounds(spark, n, k, rounds):
    rows = odd_rows(n, n)
    state, centroids = lloyd.delta_lloyd(table(spark, rows), k, rounds)
    want, means = plain(rows, k, rounds)
    assert centroids.tolist() == means
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in state.collect()), key=repr) == want


def test_only_changed_centroids_are_compared(spark, monkeypatch):
    rng = np.random.default_rng(2)
    q = rng.integers(-50, 50, (300, 64))
    centroids = q[:6].copy()
    every = lloyd.distances(q, centroids)
    cluster, distance = lloyd.nearest(q, centroids, np.ones(6, bool), np.full(300, -1), np.zeros(300, np.int64))
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    moved = centroids.copy()
    moved[2] += 9
    compared = []
    real = lloyd.distances
    monkeypatch.setattr(lloyd, "distances", lambda a, b: compared.append((len(a), len(b))) or real(a, b))
    changed = (moved != centroids).any(axis=1)
    now, far = lloyd.nearest(q, moved, changed, cluster, distance)
    assert sorted(compared) == sorted([(int((cluster == 2).sum()), 6), (int((cluster != 2).sum()), 1)])
    every = real(q, moved)
    assert (now == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()


def test_transfers_are_signed(spark):
    rows = [(1, [1] * 64, 2, 0, 0), (2, [3] * 64, 0, 0, -1), (3, [5] * 64, 1, 0, 1)]
    got = {c: (n, t[0]) for c, n, t in lloyd.transfers(spark.createDataFrame(rows, lloyd.STATE), 3, 64)}
    assert got == {0: (0, 2), 2: (1, 1)}


def test_large_components_stay_exact_and_larger_ones_are_refused(spark):
    rows = [(i, [(i * 700_001.5) * (-1) ** i] * 64) for i in range(3)]
    state, _ = lloyd.delta_lloyd(table(spark, rows), 2, 1)
    want, _ = plain(rows, 2, 1)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in state.collect()), key=repr) == want
    with pytest.raises(Exception, match="too large"):
        lloyd.delta_lloyd(table(spark, [(1, [1e9] * 64)]), 2, 1)


def test_empty_tables(spark):
    state, centroids = lloyd.delta_lloyd(table(spark, [(1, None)]))
    assert lloyd.cluster_report(state, centroids).count() == 0


def test_centroids_equal_sql(spark, duck):
    assert same_rows(queries.op13_centroids(spark, SF), duck, OP13_SQL) > 100
