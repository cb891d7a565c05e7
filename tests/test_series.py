import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cells, hopping, joins, series, similarity, summaries


def test_labels_hold_until_the_next_and_equal_neighbours_stay_apart(spark):
    rows = [("a", 0.0, "x"), ("a", 1.0, "x"), ("a", 2.0, None), ("a", 3.0, "y"), ("a", 3.0, "z")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, t double, label string, i int")
    got = [tuple(r) for r in series.label_spans(df, ["k"], ["t", "i"], "t", "label", F.lit(5.0)).orderBy("start", "label").collect()]
    assert got == [("a", 0.0, 1.0, "x"), ("a", 1.0, 3.0, "x"), ("a", 3.0, 5.0, "z")]


def test_snap_takes_the_earlier_of_two_and_its_reach_is_inclusive(spark):
    left = spark.createDataFrame([("a", 10), ("a", 20), ("a", 35), ("b", 5)], "k string, p long")
    right = spark.createDataFrame([("a", 8), ("a", 12), ("a", 25)], "k string, t long")
    got = {(r["k"], r["p"]): r["snapped"] for r in joins.snap(left, right, ["k"], "p", "t", 5).collect()}
    assert got == {("a", 10): 8, ("a", 20): 25, ("a", 35): 35, ("b", 5): 5}


def test_point_on_a_boundary_takes_the_earlier_span(spark):
    spans = spark.createDataFrame([("a", 0.0, 4.0, "x"), ("a", 4.0, 9.0, "y")], "k string, start double, end double, label string")
    points = spark.createDataFrame([("a", -1.0), ("a", 4.0), ("a", 4.1), ("a", 99.0), ("b", 1.0)], "k string, t double")
    got = {(r["k"], r["t"]): r["in_force"] for r in joins.in_force(points, spans, ["k"], "t").collect()}
    assert got == {("a", -1.0): "x", ("a", 4.0): "x", ("a", 4.1): "y", ("a", 99.0): "y", ("b", 1.0): None}


def test_minimum_gap_compares_with_the_last_kept(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 30, 60, 100, 140)], "k string, t long")
    assert sorted(r["t"] for r in series.min_gap(df, ["k"], "t", 50).collect()) == [0, 60, 140]


def test_window_plans():
    assert [p.start for p in hopping.plan_windows(255)] == [0]
    assert hopping.plan_windows(255)[0].stop is None
    assert hopping.plan_windows(360) == [hopping.WindowPlan(0, 300, 0, 200, 0, 200), hopping.WindowPlan(60, 360, 200, 360, 200, None)]
    assert [p.start for p in hopping.plan_windows(650)] == [0, 100, 200, 300, 350]


def test_overlap_add_of_the_identity_is_the_identity(spark):
    df = spark.createDataFrame([("a", t, float(t * t % 17)) for t in range(100)], "k string, t long, v double")
    parts = hopping.into_windows(df, "t", 16, 12)
    got = hopping.overlap_add(parts, ["k"], "t", "v", hopping.triangle(F.col("offset"), 16))
    assert [round(r["value"], 9) for r in got.orderBy("t").collect()] == [float(t * t % 17) for t in range(100)]


@pytest.mark.parametrize(
    ("vectors", "expected"),
    [([[0, 0], [1, 0], [10, 10], [0, 1], [10, 11]], [[0, 1, 3], [2, 4]]), ([[0, 0], [3, 0], [1.5, 0]], [[0, 1, 2]])],
)
def test_grouping_by_similarity(vectors, expected):
    assert [sorted(g) for g in similarity.group_in_order(np.array(vectors, dtype=float), 2.0)] == [sorted(g) for g in expected]


def test_ties_and_medians(spark):
    df = spark.createDataFrame([("a", "y", 2.0), ("a", "x", 2.0), ("a", "z", 1.0), ("b", None, 1.0)], "k string, l string, w double")
    assert [r["label"] for r in summaries.dominant(df, ["k"], "l", F.col("w")).collect()] == ["x"]
    v = spark.createDataFrame([(1, float(x)) for x in (4, 1, 3, 2)], "k int, v double")
    assert summaries.upper_median(v, ["k"], "v").first()["upper_median"] == 3.0
    assert summaries.true_median(v, ["k"], "v").first()["median"] == 2.5
    assert summaries.mean_tempo(v, ["k"], "v", 1.0).first()["bpm"] == 60.0


def test_interpolation_and_its_ends(spark):
    anchors = spark.createDataFrame([("a", 4.0, 0.35), ("a", 8.0, 0.71), ("a", 12.0, 1.06)], "k string, s double, v double")
    points = spark.createDataFrame([("a", 4.0), ("a", 6.0), ("a", 16.0), ("b", 16.0)], "k string, s double")
    got = {(r["k"], r["s"]): round(r["value_at"], 3) for r in joins.interpolate(points, anchors, ["k"], "s", "s", "v", 0.125).collect()}
    assert got == {("a", 4.0): 0.35, ("a", 6.0): 0.53, ("a", 16.0): 1.415, ("b", 16.0): 2.0}


def brute_groups(vectors, threshold):
    """Every distance anew at each merge."""
    members, means = [], []
    for i, v in enumerate(vectors):
        apart = [np.sqrt(((m - v) ** 2).mean()) for m in means]
        if apart and min(apart) < threshold:
            k = int(np.argmin(apart))
            members[k].append(i)
            means[k] = means[k] + (v - means[k]) / len(members[k])
        else:
            members.append([i])
            means.append(v)
    while True:
        pairs = [(np.sqrt(((means[a] - means[b]) ** 2).mean()), a, b) for a in range(len(means)) for b in range(a + 1, len(means))]
        if not pairs or not min(pairs)[0] < threshold:
            return members
        _, a, b = min(pairs)
        n, m = len(members[a]), len(members[b])
        means[a] = (n * means[a] + m * means[b]) / (n + m)
        members[a] += members.pop(b)
        means.pop(b)


def test_grouping_equals_brute_force_and_its_memory_is_linear():
    import tracemalloc

    for seed in range(12):
        rng = np.random.default_rng(seed)
        vectors = rng.integers(0, 9, (70, 2)).astype(float) if seed % 2 else rng.normal(size=(70, 3))
        for threshold in (0.4, 1.2):
            assert similarity.group_in_order(vectors, threshold) == [sorted(g) for g in brute_groups(vectors, threshold)]
    assert similarity.group_in_order(np.zeros((0, 4)), 1.0) == []
    far = np.random.default_rng(1).normal(size=(1500, 64))
    tracemalloc.start()
    try:
        assert len(similarity.group_in_order(far, 0.01)) == 1500
        assert tracemalloc.get_traced_memory()[1] < 32e6
    finally:
        tracemalloc.stop()


def test_cells_carry_what_crosses_them(spark, monkeypatch):
    monkeypatch.setattr(cells.cell_of, "__defaults__", (8,))
    rng = np.random.default_rng(5)
    rows = [(None if i % 17 == 0 else "hot" if i % 3 else f"k{i % 5}", i, None if i % 29 == 0 else float(rng.integers(0, 12)), float(rng.integers(1, 9))) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i long, v double, w double")
    groups = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0.0, r[1])):
        groups.setdefault(r[0], []).append(r)
    got = {r["i"]: r["n"] for r in cells.numbered(df, ["k"], ["v", "i"], "n").collect()}
    assert got == {r[1]: n for g in groups.values() for n, r in enumerate(g, 1)}
    share = {r["i"]: r["done"] for r in summaries.running_share(df, ["k"], ["i"], "w").collect()}
    for g in groups.values():
        g.sort(key=lambda r: r[1])
        upto = np.cumsum([r[3] for r in g])
        assert np.allclose([share[r[1]] for r in g], upto / upto[-1])
    kept = {r["i"] for r in series.changed_deciles(df.withColumn("f", df["v"] / 12), ["k"], ["i"], "f").collect()}
    tenth = lambda r: -1 if r[2] is None else int(np.floor(r[2] / 12 * 10))
    assert kept == {r[1] for g in groups.values() for n, r in enumerate(g) if n == 0 or tenth(g[n - 1]) != tenth(r)}
    z = {r["i"]: r["z"] for r in summaries.standardise(df, ["k"], "w").collect()}
    for g in groups.values():
        w = np.array([r[3] for r in g])
        assert np.allclose([z[r[1]] for r in g], (w - w.mean()) / (1e-5 + w.std(ddof=1)))
    assert cells.numbered(df.where("i < 0"), ["k"], ["v"], "n").count() == 0


def test_only_small_tables_are_paired(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MOST_PAIRED", 3)
    with pytest.raises(ValueError, match="pair"):
        similarity.pairs(spark.createDataFrame([(i, [1.0]) for i in range(4)], "i long, v array<double>"), "i", "v")


@pytest.fixture
def many_cells(monkeypatch):
    monkeypatch.setattr(cells, "SMALL", 0)


def kept_one_by_one(times, gap):
    kept = []
    for k, t in enumerate(times):
        if not kept or t - times[kept[-1]] >= gap:
            kept.append(k)
    return kept


@pytest.mark.parametrize("gap", [0.0, 0.75, 13.0, 5000.0])
def test_minimum_gap_over_cells_equals_one_pass(spark, many_cells, gap):
    rng = np.random.default_rng(int(gap))
    hot = np.sort(np.round(np.concatenate([rng.uniform(0, 1000, 3000), rng.uniform(300, 310, 2000), rng.uniform(5000, 9000, 50)]) * 64) / 64)
    rows = [("hot", float(t), "x") for t in hot] + [("b", float(t), "y") for t in range(40)] + [(None, 1.0, "z"), (None, 2.0, "z"), ("hot", None, "w")]
    df = spark.createDataFrame(rows, "k string, t double, label string").repartition(5)
    got = series.min_gap(df, ["k"], "t", gap)
    assert got.columns == df.columns
    found = [(r["k"], r["t"]) for r in got.collect()]
    for key in ("hot", "b", None):
        own = sorted(t for k, t, _ in rows if k == key and t is not None)
        assert sorted(t for k, t in found if k == key) == [own[i] for i in kept_one_by_one(own, gap)]


def test_minimum_gap_on_one_series_of_a_million_rows(spark, many_cells):
    df = spark.range(1_000_000).select(F.lit("s").alias("k"), (F.col("id") * 3 + F.pmod(F.hash("id"), F.lit(30))).alias("t"))
    got = sorted(r["t"] for r in series.min_gap(df.repartition(8), ["k"], "t", 50).select("t").collect())
    times = np.sort(np.array([r["t"] for r in df.collect()]))
    assert got == times[kept_one_by_one(times, 50)].tolist()
    marked = df.withColumn("_cell", cells.cell_of(df, "t"))
    sizes = [r["count"] for r in marked.groupBy("_cell").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 10_000


def test_gaps_of_each_key(spark):
    df = spark.createDataFrame([(k, t, g) for k, g in (("a", 2), ("b", 5)) for t in range(20)], "k string, t int, g int")
    got = series.min_gap(df, ["k"], "t", "g").groupBy("k").agg(F.sort_array(F.collect_list("t")).alias("t")).collect()
    assert {r["k"]: r["t"] for r in got} == {"a": list(range(0, 20, 2)), "b": [0, 5, 10, 15]}


@pytest.mark.parametrize("small", [0, 1 << 30])
def test_thinned_labels_equal_one_pass(spark, monkeypatch, small):
    monkeypatch.setattr(cells, "SMALL", small)
    rng = np.random.default_rng(3)
    rows = [("s", float(k), str(rng.choice(["a", "b", "N", None]))) for k in range(600)]
    rows = [(k, t, None if label == "None" else label) for k, t, label in rows]
    want, last, before = [], None, "?"
    for _, t, label in rows:
        if label is not None and label != "N" and label != before and (last is None or t - last >= 3):
            want.append(t)
            last = t
        before = label
    got = series.thin_labels(spark.createDataFrame(rows, "k string, t double, label string"), ["k"], "t", "label", 3.0)
    assert sorted(r["t"] for r in got.collect()) == want


@pytest.mark.parametrize("small", [0, 1 << 30])
def test_passes_are_the_same_in_one_cell_and_in_many(spark, monkeypatch, small):
    monkeypatch.setattr(cells, "SMALL", small)
    rng = np.random.default_rng(6)
    rows = [(["hot", "b", None][min(2, k % 9 // 4)], int(rng.integers(0, 300)), k, float(rng.integers(0, 100)) / 100 if k % 7 else None) for k in range(900)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v double")
    got = {(r["k"], r["i"]): r["n"] for r in cells.numbered(df, ["k"], ["t", "i"], "n").collect()}
    share = {(r["k"], r["i"]): r["done"] for r in summaries.running_share(df, ["k"], ["t", "i"], "v").collect()}
    deciles = {(r["k"], r["i"]) for r in series.changed_deciles(df, ["k"], ["t", "i"], "v").collect()}
    for key in ("hot", "b", None):
        own = sorted((t, i, v) for k, t, i, v in rows if k == key)
        total, upto, before, changed = sum(v or 0 for _, _, v in own), 0.0, None, set()
        for n, (_, i, v) in enumerate(sorted(own, key=lambda r: r[:2]), 1):
            upto += v or 0
            tenth = -1 if v is None else math.floor(v * 10)
            if tenth != before:
                changed.add((key, i))
            before = tenth
            assert got[key, i] == n and abs(share[key, i] - upto / total) < 1e-9
        assert {d for d in deciles if d[0] == key} == changed


@pytest.mark.parametrize("few", [0, similarity.MeanGrid.FEW])
@pytest.mark.parametrize("seed", range(6))
def test_a_grid_of_means_finds_what_a_look_at_all_finds(seed, few, monkeypatch):
    monkeypatch.setattr(similarity.MeanGrid, "FEW", few)
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 10, (40, 5))
    x = middles[rng.integers(0, 40, 900)] + rng.normal(0, 0.4 + seed / 3, (900, 5))
    x[100:140] = x[7]
    assert similarity.group_in_order(x[:300], 1.5) == [sorted(g) for g in brute_groups(list(x[:300]), 1.5)]
    centres, grid, _ = similarity.place_in_order(x, 2.0)
    for v in [*rng.normal(0, 10, (50, 5)), *x[:50]]:
        live = np.flatnonzero(centres.rows[: centres.used] > 0)
        apart = centres.apart(v, live)
        assert {k for _, k in grid.within(v)} == {int(k) for k, d in zip(live, apart, strict=True) if d < 2}
        assert grid.nearest(v) == (int(live[apart.argmin()]) if apart.min() < 2 else -1)


def test_rows_do_not_meet_every_group_of_clustered_data():
    rng, made = np.random.default_rng(1), {}
    for groups in (500, 2000):
        middles = rng.normal(0, 50, (groups, 8))
        x = middles[rng.integers(0, groups, 4 * groups)] + rng.normal(0, 0.1, (4 * groups, 8))
        centres, _, _ = similarity.place_in_order(x, 2.0)
        made[groups] = centres.compared / len(x)
    assert made[2000] < 0.02 * 2000 and made[500] < 0.02 * 500


def plan_of(frame):
    """Plan of a frame, as text."""
    return frame._jdf.queryExecution().executedPlan().toString()


def test_many_short_series_are_thinned_without_a_group_for_each_series_and_cell(spark, monkeypatch):
    monkeypatch.setattr(cells, "expected_bytes", lambda df: cells.SMALL + 1)  # large input
    rng = np.random.default_rng(5)
    rows = [(k, int(t), "abN"[rng.integers(3)]) for k in range(300) for t in rng.choice(1000, 30, replace=False)]
    df = spark.createDataFrame(rows, "k long, t long, label string").repartition(5)
    got = series.thin_labels(df, ["k"], "t", "label", 40)
    assert "FlatMapGroupsInPandas" not in plan_of(got)
    assert "FlatMapGroupsInPandas" not in plan_of(series.min_gap(df, ["k"], "t", 40))
    want = []
    for key in range(300):
        last, before = None, "?"
        for _, t, label in sorted(r for r in rows if r[0] == key):
            if label not in ("N", before) and (last is None or t - last >= 40):
                want.append((key, t))
                last = t
            before = label
    assert sorted((r["k"], r["t"]) for r in got.collect()) == want


@pytest.mark.parametrize("row", [1, 1 << 20, 1 << 40])  # no series is long, one is, all are
def test_long_and_short_series_are_thinned_alike(spark, monkeypatch, row):
    monkeypatch.setattr(cells, "expected_bytes", lambda df: cells.SMALL + 1)
    monkeypatch.setattr(cells, "ROW", row)
    rng = np.random.default_rng(8)
    rows = [(key, float(t), "abcN"[rng.integers(4)]) for key, n in (("hot", 700), ("b", 50), (None, 20)) for t in rng.choice(2000, n, replace=False)]
    rows += [("b", None, "a"), (None, None, "b"), ("one", 3.0, "a")]
    df = spark.createDataFrame(rows, "k string, t double, label string").repartition(3)
    gaps = [(r["k"], r["t"]) for r in series.min_gap(df, ["k"], "t", 7.0).collect()]
    thinned = [(r["k"], r["t"]) for r in series.thin_labels(df, ["k"], "t", "label", 7.0).collect()]
    for key in ("hot", "b", None, "one"):
        own = sorted((t, label) for k, t, label in rows if k == key and t is not None)
        times = [t for t, _ in own]
        assert sorted(t for k, t in gaps if k == key) == [times[i] for i in kept_one_by_one(times, 7.0)]
        changed = [t for i, (t, label) in enumerate(own) if label != "N" and (i == 0 or own[i - 1][1] != label)]
        assert sorted(t for k, t in thinned if k == key) == [changed[i] for i in kept_one_by_one(changed, 7.0)]


@pytest.mark.parametrize("row", [64, 1 << 40])
def test_labels_at_one_time_are_drawn_together_if_asked(spark, monkeypatch, row):
    monkeypatch.setattr(cells, "expected_bytes", lambda df: cells.SMALL + 1)
    monkeypatch.setattr(cells, "ROW", row)
    df = spark.createDataFrame([("s", t, label) for t, label in ((0, "a"), (2, "b"), (5, "c"), (5, "d"), (6, "a"), (11, "b"))], "k string, t long, label string")
    drawn = lambda **more: sorted(r["t"] for r in series.thin_labels(df, ["k"], "t", "label", 5, **more).collect())
    assert drawn() == [0, 5, 11] and drawn(ties=True) == [0, 5, 5, 11]
