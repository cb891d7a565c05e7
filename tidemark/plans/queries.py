"""The registered queries: each kernel on one of the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import arrays as A
from tidemark.functions import music as M
from tidemark.functions import text as X
from tidemark.operators import hopping, joins, series, similarity, summaries
from tidemark.plans import chord_queries, song_queries  # noqa: F401  (register their queries)
from tidemark.plans.registry import EVENTS_SQL, HOURLY_SQL, QUERIES, SQL, events, hourly, query, r6, table  # noqa: F401

# Windows over series


@query(f"""WITH {EVENTS_SQL}, last AS (SELECT user_id, max(us) AS fin FROM ev GROUP BY user_id),
sp AS (SELECT user_id, us AS s0, coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id), fin) AS e0, event_type FROM ev JOIN last USING (user_id))
SELECT user_id, s0 AS start_us, e0 AS end_us, event_type AS label FROM sp WHERE e0 > s0""")
def label_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("fin", F.max("us").over(Window.partitionBy("user_id")))
    spans = series.label_spans(e, ["user_id"], ["us", "event_id"], "us", "event_type", "fin")
    return spans.select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "label")


@query(f"""WITH {EVENTS_SQL} SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM ev""")
def locf_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    return series.carry_forward(events(spark, sf_dir), ["user_id"], ["us", "event_id"], bought, "last_purchase").select("event_id", "user_id", "last_purchase")


@query(f"""WITH {EVENTS_SQL} SELECT event_id, user_id, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) - us AS gap_us FROM ev""")
def consecutive_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.differences(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "us", "gap_us").select("event_id", "user_id", "gap_us")


@query(f"""WITH {HOURLY_SQL} SELECT event_type, t, round(greatest(v - lag(v, 1, 0.0) OVER (PARTITION BY event_type ORDER BY t), 0.0), 6) AS rise FROM hourly""")
def rising_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.rises(hourly(spark, sf_dir), ["event_type"], ["t"], "v", "rise").select("event_type", "t", r6("rise"))


@query(f"""WITH {HOURLY_SQL}, w AS (SELECT *, max(v) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN 5 PRECEDING AND 2 FOLLOWING) AS top,
avg(v) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN 17 PRECEDING AND 12 FOLLOWING) AS lev FROM hourly)
SELECT event_type, t, round(v, 6) AS v FROM w WHERE v > 10 AND v >= top AND v >= lev + 10""")
def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.local_peaks(hourly(spark, sf_dir), ["event_type"], ["t"], "v", delta=10.0).select("event_type", "t", r6("v"))


@query(f"""WITH {HOURLY_SQL}, w AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY t) AS a, lead(v) OVER (PARTITION BY event_type ORDER BY t) AS b FROM hourly)
SELECT event_type, t, round(v, 6) AS v FROM w WHERE v > a AND v >= b""")
def turning_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.turning_points(hourly(spark, sf_dir), ["event_type"], ["t"], "v").select("event_type", "t", r6("v"))


@query(f"""WITH {HOURLY_SQL} SELECT event_type, t, round(v / greatest(max(v) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0.0001), 6) AS jump FROM hourly""")
def block_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = series.frame(hourly(spark, sf_dir), ["event_type"], ["t"], F.max("v"), 4, -1, "before")
    return level.select("event_type", "t", F.round(F.col("v") / F.greatest("before", F.lit(1e-4)), 6).alias("jump"))


@query(f"""WITH {HOURLY_SQL}, k AS (SELECT unnest(range(-6, 7)) AS o), kw AS (SELECT o, exp(-0.5 * (o / 2.0) ** 2) AS w FROM k), s AS (SELECT sum(w) AS total FROM kw)
SELECT a.event_type, a.t, round(sum(coalesce(b.v, 0.0) * kw.w / s.total), 6) AS smoothed FROM hourly a CROSS JOIN kw CROSS JOIN s
LEFT JOIN hourly b ON b.event_type = a.event_type AND b.t = a.t + kw.o GROUP BY a.event_type, a.t""")
def smooth_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.smooth(hourly(spark, sf_dir), ["event_type"], "t", "v", 2.0).select("event_type", "t", r6("smoothed"))


@query(f"""WITH RECURSIVE {EVENTS_SQL}, first AS (SELECT user_id, min(us) AS us FROM ev GROUP BY user_id),
keep AS (SELECT user_id, us FROM first UNION ALL
SELECT k.user_id, (SELECT min(e.us) FROM ev e WHERE e.user_id = k.user_id AND e.us >= k.us + 14400000000) FROM keep k
WHERE EXISTS (SELECT 1 FROM ev e WHERE e.user_id = k.user_id AND e.us >= k.us + 14400000000))
SELECT user_id, us FROM keep""")
def min_gap_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.min_gap(events(spark, sf_dir).select("user_id", "us"), ["user_id"], "us", 4 * 3600e6)


@query(f"""WITH RECURSIVE {EVENTS_SQL}, chg AS (SELECT user_id, us, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY us) AS b FROM ev),
c AS (SELECT user_id, us, event_type FROM chg WHERE event_type IS DISTINCT FROM b AND event_type <> 'error'),
keep AS (SELECT user_id, min(us) AS us FROM c GROUP BY user_id UNION ALL
SELECT k.user_id, (SELECT min(e.us) FROM c e WHERE e.user_id = k.user_id AND e.us >= k.us + 21600000000) FROM keep k
WHERE EXISTS (SELECT 1 FROM c e WHERE e.user_id = k.user_id AND e.us >= k.us + 21600000000))
SELECT user_id, us, event_type FROM keep JOIN c USING (user_id, us)""")
def label_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("user_id IS NOT NULL").select("user_id", "us", "event_type")
    return series.thin_labels(e, ["user_id"], "us", "event_type", 6 * 3600e6, ignore="error", ties=True)


@query(f"""WITH {HOURLY_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t) AS i, 1.5 * sqrt(avg(v * v) OVER (PARTITION BY event_type)) AS weak FROM hourly),
e AS (SELECT event_type, min(CASE WHEN v >= weak THEN i END) AS a, max(CASE WHEN v >= weak THEN i END) AS b FROM n GROUP BY event_type)
SELECT event_type, t, round(v, 6) AS v FROM n JOIN e USING (event_type) WHERE i BETWEEN a AND b""")
def trim_weak_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.strong_range(hourly(spark, sf_dir), ["event_type"], ["t"], "v", 1.5).select("event_type", "t", r6("v"))


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT user_id, row_number() OVER w AS bar, us AS start_us, lead(us, 4) OVER w AS end_us FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us))
SELECT user_id, CAST(bar AS INTEGER) AS bar, start_us, end_us FROM n WHERE (bar - 1) % 4 = 0 AND end_us IS NOT NULL""")
def every_nth_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = series.every_nth_span(events(spark, sf_dir), ["user_id"], "us", 4)
    return spans.select("user_id", "bar", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(f"""WITH {HOURLY_SQL}, p AS (SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY t) - 1) % 4 AS phase,
max(v) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM hourly),
s AS (SELECT event_type, phase, avg(top) AS strength FROM p GROUP BY ALL)
SELECT event_type, CAST(phase AS INTEGER) AS phase, round(strength, 6) AS strength, row_number() OVER (PARTITION BY event_type ORDER BY strength DESC, phase) = 1 AS best FROM s""")
def phase_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.phase_strength(hourly(spark, sf_dir), ["event_type"], ["t"], "v", 4).select("event_type", "phase", r6("strength"), "best")


@query(f"""WITH {EVENTS_SQL}, d AS (SELECT event_id, event_type, us, CASE WHEN value > 100 THEN -1 ELSE CAST(floor(least(value / 100, 1) * 10) AS INTEGER) END AS decile FROM ev),
l AS (SELECT *, lag(decile) OVER (PARTITION BY event_type ORDER BY us, event_id) AS b FROM d)
SELECT event_id, event_type, decile FROM l WHERE b IS NULL OR b <> decile""")
def decile_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("fraction", F.when(F.col("value") <= 100, F.least(F.col("value") / 100, F.lit(1))))
    return series.changed_deciles(e, ["event_type"], ["us", "event_id"], "fraction").select("event_id", "event_type", "decile")


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT user_id, max(us) + 60000000 AS fin FROM ev GROUP BY user_id), s AS (SELECT event_id, user_id, us, greatest(us - 3000000, 0) AS a FROM ev)
SELECT event_id, user_id, a AS hit_start, least(coalesce(lead(a) OVER (PARTITION BY user_id ORDER BY us), fin), us + 7200000000) AS hit_end FROM s JOIN f USING (user_id)""")
def hit_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("fin", F.max("us").over(Window.partitionBy("user_id")) + 60_000_000)
    return series.hit_ends(e, ["user_id"], "us", 3_000_000, 7_200_000_000, "fin").select("event_id", "user_id", "hit_start", "hit_end")


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT event_id, user_id, s, value, lag(value, 1, 0.0) OVER w AS tail, coalesce(lead(s) OVER w, s + 1) - s AS room FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY s))
SELECT event_id, user_id, round(20 * log10(greatest(tail, 1e-9) / greatest(value, 1e-9)) - 6 * log2(least(greatest(room / 10000, 0.05), 0.4) / 0.05), 5) AS mess FROM n""")
def mess_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("s")
    e = events(spark, sf_dir).withColumn("tail", F.lag("value", 1, 0.0).over(w)).withColumn("at", F.col("s") / 10000).withColumn("fin", F.col("at") + 1e-4)
    return series.mess_score(e, ["user_id"], "at", "tail", "value", "fin").select("event_id", "user_id", F.round("mess", 5).alias("mess"))


_CORR = f"""WITH {HOURLY_SQL}, c AS (SELECT event_type, t, v - avg(v) OVER (PARTITION BY event_type) AS x, count(*) OVER (PARTITION BY event_type) AS n FROM hourly),
lags AS (SELECT unnest(range(2, 13)) AS lag), corr AS (SELECT a.event_type, lag, sum(a.x * b.x) / (first(a.n) - lag) AS corr FROM c a CROSS JOIN lags JOIN c b ON b.event_type = a.event_type AND b.t = a.t + lag GROUP BY a.event_type, lag)"""


@query(_CORR + " SELECT event_type, CAST(lag AS INTEGER) AS lag, round(corr, 5) AS corr, round(corr * exp(-0.5 * log2(480.0 / lag / 120) ** 2), 5) AS weighted FROM corr")
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    corr = series.autocorrelation(hourly(spark, sf_dir), ["event_type"], "t", "v", range(2, 13))
    return corr.select("event_type", "lag", F.round("corr", 5).alias("corr"), F.round(F.col("corr") * series.tempo_prior(F.lit(480.0) / F.col("lag")), 5).alias("weighted"))


@query(_CORR + """, w AS (SELECT *, corr * exp(-0.5 * log2(480.0 / lag / 120) ** 2) AS w, lag - 2 AS i FROM corr),
b AS (SELECT event_type, i AS bi, corr AS bc FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY w DESC, i) AS k FROM w) WHERE k = 1 AND w > 0),
h AS (SELECT *, (bi + 2) // 2 - 2 AS half FROM b),
f AS (SELECT * FROM (SELECT h.event_type, w.i AS fi, w.corr AS fc, row_number() OVER (PARTITION BY h.event_type ORDER BY w.corr DESC, w.i) AS k FROM h JOIN w ON w.event_type = h.event_type AND w.i BETWEEN half - 1 AND half + 1 WHERE half >= 1 AND half + 1 < 11) WHERE k = 1),
p AS (SELECT h.event_type, CASE WHEN fc >= 0.8 * bc THEN fi ELSE bi END AS i FROM h LEFT JOIN f USING (event_type)),
q AS (SELECT p.event_type, p.i, m.corr AS m, l.corr AS l, r.corr AS r FROM p JOIN w m ON m.event_type = p.event_type AND m.i = p.i LEFT JOIN w l ON l.event_type = p.event_type AND l.i = p.i - 1 LEFT JOIN w r ON r.event_type = p.event_type AND r.i = p.i + 1)
SELECT event_type, round(i + 2 + CASE WHEN l IS NOT NULL AND r IS NOT NULL AND l - 2 * m + r < 0 THEN 0.5 * (l - r) / (l - 2 * m + r) ELSE 0 END, 5) AS period FROM q""")
def tempo_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    corr = series.autocorrelation(hourly(spark, sf_dir), ["event_type"], "t", "v", range(2, 13))
    return series.tempo_period(corr, ["event_type"], 480.0, 2).select("event_type", F.round("period", 5).alias("period"))


# Joins in time


@query(f"""WITH {EVENTS_SQL}, p AS (SELECT event_id, user_id, us FROM ev WHERE event_type = 'view'), a AS (SELECT DISTINCT user_id, us AS hit FROM ev WHERE event_type = 'click'),
near AS (SELECT event_id, hit, row_number() OVER (PARTITION BY event_id ORDER BY abs(hit - us), hit) AS k FROM p JOIN a USING (user_id))
SELECT event_id, user_id, CASE WHEN abs(hit - us) <= 43200000000 THEN hit ELSE us END AS snapped FROM p LEFT JOIN (SELECT * FROM near WHERE k = 1) USING (event_id)""")
def nearest_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    views, clicks = e.where("event_type = 'view'").select("event_id", "user_id", "us"), e.where("event_type = 'click'").select("user_id", F.col("us").alias("hit"))
    return joins.snap(views, clicks, ["user_id"], "us", "hit", 43_200_000_000).select("event_id", "user_id", "snapped")


_SPANS = f"""WITH {EVENTS_SQL}, fin AS (SELECT user_id, max(us) + 3600000000 AS fin FROM ev GROUP BY user_id), lab AS (SELECT * FROM ev WHERE event_type IN ('signup', 'purchase')),
sp AS (SELECT user_id, us AS a, coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us), fin) AS b, event_type AS label FROM lab JOIN fin USING (user_id))"""


def _spans(e: DataFrame) -> DataFrame:
    e = e.withColumn("fin", F.max("us").over(Window.partitionBy("user_id")) + 3_600_000_000)
    return series.label_spans(e.where(F.col("event_type").isin("signup", "purchase")), ["user_id"], ["us"], "us", "event_type", "fin")


@query(_SPANS + """, num AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM sp),
q AS (SELECT event_id, user_id, us FROM ev WHERE event_type = 'view'),
pos AS (SELECT q.event_id, q.user_id, 1 + count(*) FILTER (WHERE num.b < q.us AND num.k < num.n) AS k FROM q JOIN num USING (user_id) GROUP BY q.event_id, q.user_id)
SELECT q.event_id, q.user_id, num.label AS in_force FROM q LEFT JOIN pos USING (event_id) LEFT JOIN num ON num.user_id = q.user_id AND num.k = pos.k""")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    views = e.where("event_type = 'view'").select("event_id", "user_id", "us")
    return joins.in_force(views, _spans(e), ["user_id"], "us").select("event_id", "user_id", "in_force")


@query(_SPANS + """, c AS (SELECT user_id, us FROM ev WHERE event_type = 'click'),
e AS (SELECT user_id, a, b, label, a AS x FROM sp UNION ALL SELECT sp.user_id, a, b, label, us FROM sp JOIN c ON c.user_id = sp.user_id AND us > a AND us < b),
n AS (SELECT user_id, label, a, CAST(row_number() OVER w - 1 AS INTEGER) AS piece, x, coalesce(lead(x) OVER w, b) AS y FROM (SELECT DISTINCT * FROM e) WINDOW w AS (PARTITION BY user_id, a, b, label ORDER BY x))
SELECT user_id, label, piece, x AS start_us, y AS end_us FROM n WHERE y > x""")
def range_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    pieces = joins.cut_spans(_spans(e), e.where("event_type = 'click'").select("user_id", "us"), ["user_id"], "us", 86_400e6)
    return pieces.select("user_id", "label", "piece", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(f"""WITH {EVENTS_SQL}, q AS (SELECT event_id, user_id, us FROM ev WHERE event_type = 'error')
SELECT q.event_id, q.user_id, max_by(e.value, e.us) FILTER (WHERE e.event_type = 'purchase') AS purchase, coalesce(max_by(e.value, e.us) FILTER (WHERE e.event_type = 'click'), -1.0) AS click
FROM q LEFT JOIN ev e ON e.user_id = q.user_id AND e.us <= q.us GROUP BY q.event_id, q.user_id""")
def state_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    states = e.select("user_id", "us", *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in ("purchase", "click")])
    asked = e.where("event_type = 'error'").select("event_id", "user_id", "us")
    return joins.as_of(asked, states, ["user_id"], "us", "us", ["purchase", "click"]).select("event_id", "user_id", "purchase", F.coalesce("click", F.lit(-1.0)).alias("click"))


@query(f"""WITH {EVENTS_SQL}, a AS (SELECT user_id, s - 1704067200 AS step, row_number() OVER (PARTITION BY user_id ORDER BY s) * 1.0 AS y FROM ev WHERE event_type = 'purchase'),
p AS (SELECT event_id, user_id, s - 1704067200 AS x FROM ev WHERE event_type = 'view'),
pr AS (SELECT *, lead(step) OVER (PARTITION BY user_id ORDER BY step) AS s2, lead(y) OVER (PARTITION BY user_id ORDER BY step) AS y2 FROM a),
r AS (SELECT user_id, coalesce(CASE WHEN median((y2 - y) / greatest(s2 - step, 1)) > 0 THEN median((y2 - y) / greatest(s2 - step, 1)) END, 0.001) AS rate, min(step) AS s0, min(y) AS y0, max(step) AS s9, max(y) AS y9 FROM pr GROUP BY user_id)
SELECT p.event_id, p.user_id, round(CASE WHEN r.user_id IS NULL THEN x * 0.001 WHEN x <= s0 THEN y0 + (x - s0) * rate WHEN x >= s9 THEN y9 + (x - s9) * rate
ELSE pr.y + (pr.y2 - pr.y) / (pr.s2 - pr.step) * (x - pr.step) END, 6) AS value_at
FROM p LEFT JOIN r USING (user_id) LEFT JOIN pr ON pr.user_id = p.user_id AND pr.step <= x AND x < pr.s2""")
def time_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("x", F.col("s") - 1704067200)
    w = Window.partitionBy("user_id").orderBy("s")
    anchors = e.where("event_type = 'purchase'").select("user_id", F.col("x").alias("step"), F.row_number().over(w).cast("double").alias("y"))
    points = e.where("event_type = 'view'").select("event_id", "user_id", "x")
    return joins.interpolate(points, anchors, ["user_id"], "x", "step", "y", 0.001).select("event_id", "user_id", r6("value_at"))


@query("SELECT p_partkey, p_brand FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_returnflag = 'R' AND l.l_quantity > 45)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return joins.missing(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), returned, ["p_partkey"])


# Summaries


@query(_SPANS + """, d AS (SELECT user_id, label, sum(b - a) AS w FROM sp WHERE b > a GROUP BY ALL)
SELECT user_id, label, CAST(w AS BIGINT) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, label) AS k FROM d) WHERE k = 1""")
def dominant_label_by_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.dominant(_spans(events(spark, sf_dir)), ["user_id"], "label", F.col("end") - F.col("start"))


@query("""WITH d AS (SELECT user_id, event_type AS label, count(*) AS weight FROM events GROUP BY ALL)
SELECT user_id, label, weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, label) AS k FROM d) WHERE k = 1""")
def dominant_label_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.dominant(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT user_id, lead(s) OVER (PARTITION BY user_id ORDER BY s) - s AS gap FROM ev) SELECT user_id, round(median(60 / gap), 6) AS bpm FROM g WHERE gap > 0 GROUP BY user_id""")
def tempo_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.tempo(events(spark, sf_dir), ["user_id"], "s").select("user_id", r6("bpm"))


@query("SELECT user_id, list_sort(list(value))[count(*) // 2 + 1] AS upper_median, median(value) AS median FROM events WHERE value IS NOT NULL GROUP BY user_id")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return summaries.upper_median(e, ["user_id"], "value").join(summaries.true_median(e, ["user_id"], "value"), "user_id")


@query(f"WITH {EVENTS_SQL} SELECT user_id, CASE WHEN max(s) > min(s) THEN round(60.0 * 10 * (count(*) - 1) / (max(s) - min(s)), 6) END AS bpm FROM ev GROUP BY user_id")
def mean_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.mean_tempo(events(spark, sf_dir), ["user_id"], "s", 10.0).select("user_id", r6("bpm"))


@query("SELECT event_type, max(abs(value)) AS peak, round(sqrt(avg(value * value)), 6) AS rms, round(avg(value), 6) AS mean, round(10 * log10(greatest(sum(value * value), 1e-12)), 6) AS energy_db FROM events GROUP BY event_type")
def signal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.levels(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "peak", r6("rms"), r6("mean"), F.round(summaries.decibels(F.col("energy"), power=True), 6).alias("energy_db"))


@query("""SELECT user_id, max(abs(value - k)) < 60 AS mono, round(max(abs(value - k)), 6) AS apart FROM (SELECT user_id, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY user_id""")
def mono_fold_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.get_json_object("props", "$.k").cast("double")
    apart = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.abs(F.col("value") - other)).alias("apart"))
    return apart.select("user_id", (F.col("apart") < 60).alias("mono"), r6("apart"))


@query("""WITH p AS (SELECT l_returnflag AS part, l_linestatus AS track, 10 * log10(sum(l_extendedprice ** 2) / greatest(sum((l_extendedprice * l_discount) ** 2), 1e-20)) AS sdr FROM lineitem GROUP BY ALL HAVING avg(l_extendedprice ** 2) > 1e-6),
s AS (SELECT part, avg(sdr) AS sdr FROM p GROUP BY part) SELECT part, round(sdr, 6) AS sdr FROM s UNION ALL SELECT 'average', round(avg(sdr), 6) FROM s""")
def sdr_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("part"), F.col("l_linestatus").alias("track"), "l_extendedprice", "l_discount")
    loud = rows.groupBy("part", "track").agg(F.avg(F.col("l_extendedprice") ** 2).alias("e")).where("e > 1e-6")
    scores = summaries.sdr(rows.join(loud, ["part", "track"], "left_semi"), ["part", "track"], "l_extendedprice", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    parts = scores.groupBy("part").agg(F.avg("sdr").alias("sdr"))
    return parts.union(parts.agg(F.lit("average").alias("part"), F.avg("sdr").alias("sdr"))).select("part", r6("sdr"))


@query("""WITH g AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT max(n) AS m FROM g) SELECT p_brand, p_size, n FROM g, t WHERE n >= 3 OR m < 3""")
def having_unless_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.having_unless_none(table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n")), "n", 3)


@query("""SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / (1e-5 + stddev_samp(o_totalprice) OVER w), 6) AS z FROM orders WINDOW w AS (PARTITION BY o_orderstatus)""")
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.standardise(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice").select("o_orderkey", r6("z"))


@query("""WITH m AS (SELECT *, abs(p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand)) AS d FROM part),
k AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY round(d, 6), p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM m) SELECT p_partkey, p_brand FROM k WHERE i <= (n + 1) // 2""")
def nearest_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    off = parts.join(parts.groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean")), "p_brand").withColumn("d", F.round(F.abs(F.col("p_retailprice") - F.col("mean")), 6))
    return summaries.nearest_half(off, ["p_brand"], "d", "p_partkey").select("p_partkey", "p_brand")


@query("""SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS k FROM part) WHERE k = 1""")
def first_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.first_extreme(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", "p_partkey").select("p_brand", "p_partkey", "p_size")


@query("""WITH g AS (SELECT p_brand, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_brand), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, first) AS k, count(*) OVER () AS c FROM g)
SELECT p_brand, n, lpad(CAST(k AS VARCHAR), CAST(greatest(2, length(CAST(c AS VARCHAR))) AS INTEGER), '0') AS name FROM r""")
def rank_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one row for each brand reaches the unpartitioned window
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    r = g.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).withColumn("c", F.count("*").over(Window.partitionBy()))
    return r.select("p_brand", "n", X.zero_padded(F.col("k"), F.col("c"), 2).alias("name"))


@query("""SELECT p_brand, p_partkey, round(sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) / sum(p_retailprice) OVER (PARTITION BY p_brand), 6) AS done FROM part""")
def download_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.running_share(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], "p_retailprice").select("p_brand", "p_partkey", r6("done"))


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20""")
def last_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.last_rows(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id")


@query("""WITH d AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, url, max(length(html)) AS n, bool_or(contains(html, '<article>')) AS hit FROM pages GROUP BY ALL)
SELECT host, count(*) AS files, CAST(sum(n) AS BIGINT) AS total, round(sum(CASE WHEN hit THEN n ELSE 0 END) / sum(n), 6) AS covered FROM d GROUP BY host""")
def coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), "url", F.length("html").alias("n"), F.contains("html", F.lit("<article>")).alias("hit"))
    files = pages.groupBy("host", "url").agg(F.max("n").alias("n"), F.bool_or("hit").alias("hit"))
    return files.groupBy("host").agg(F.count("*").alias("files"), F.sum("n").cast("long").alias("total"), F.round(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("covered"))


# Hopping windows


@query(f"""WITH {HOURLY_SQL}, w AS (SELECT *, unnest(range(greatest(CAST(floor((t - 24) / 6.0) AS BIGINT) + 1, 0), t // 6 + 1)) * 6 AS start FROM hourly),
x AS (SELECT *, t - start AS o, avg(v) OVER (PARTITION BY event_type, start) AS m FROM w)
SELECT event_type, t, round(sum((v + m) / 2 * (CASE WHEN o < 12 THEN o + 1 ELSE 24 - o END / 12.0)) / greatest(sum(CASE WHEN o < 12 THEN o + 1 ELSE 24 - o END / 12.0), 1e-8), 9) AS value FROM x GROUP BY event_type, t""")
def hopping_overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = hopping.into_windows(hourly(spark, sf_dir), "t", 24, 6)
    heard = (F.col("v") + F.avg("v").over(Window.partitionBy("event_type", "window_start"))) / 2
    return hopping.overlap_add(parts.withColumn("x", heard), ["event_type"], "t", "x", hopping.triangle(F.col("offset"), 24)).select("event_type", "t", F.round("value", 9).alias("value"))


@query(f"""WITH {EVENTS_SQL}, d AS (SELECT user_id, round((max(s) - min(s)) / 3600, 6) AS d FROM ev GROUP BY user_id), n AS (SELECT user_id, d, greatest(d - 300, 0) AS last, CAST(ceil(greatest(d - 300, 0) / 100) AS INTEGER) AS n FROM d),
k AS (SELECT *, unnest(range(0, n + 1)) AS k FROM n), s AS (SELECT *, CASE WHEN k = n THEN last ELSE k * 100 END AS st FROM k)
SELECT user_id, CAST(k AS INTEGER) AS window_no, round(st, 6) AS start, round(least(d, st + 300), 6) AS "end", CAST(CASE WHEN k = 0 THEN 0 ELSE (k - 1) * 100 + 200 END AS DOUBLE) AS accept_start, round(CASE WHEN k = n THEN d ELSE least(d, st + 300) - 100 END, 6) AS accept_end FROM s""")
def window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).groupBy("user_id").agg(F.round((F.max("s") - F.min("s")) / 3600, 6).alias("d"))
    return hopping.window_table(d, ["user_id"], "d").select("user_id", "window_no", r6("start"), r6("end"), "accept_start", r6("accept_end"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 - 1e-4 AND l_quantity < 40 - 1e-4 AND l_quantity < l_tax * 600 - 1e-4""")
def accept_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("a", F.lit(10.0)).withColumn("b", F.lit(40.0)).withColumn("d", F.col("l_tax") * 600)
    return hopping.accepted(rows, "l_quantity", "a", "b", "d").select("l_orderkey", "l_linenumber")


# Vectors


_MEANS = "m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i)"


@query(f"WITH {_MEANS} SELECT a.label AS a, b.label AS b, round(sqrt(avg((a.x - b.x) ** 2)), 6) AS rms FROM m a JOIN m b ON a.label < b.label AND a.i = b.i GROUP BY ALL")
def rms_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = similarity.group_means(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return similarity.pairs(means, "label", "mean").select("a", "b", r6("rms"))


@query(f"WITH {_MEANS} SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x) / sqrt(sum(a.x ** 2) * sum(b.x ** 2)), 6) AS cosine FROM m a JOIN m b ON a.label < b.label AND a.i = b.i GROUP BY ALL")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = similarity.group_means(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return similarity.pairs(means, "label", "mean", "cosine").select("a", "b", r6("cosine"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 100) AS x FROM embeddings), c AS (SELECT vec_id, list_transform(x, lambda v: greatest(v, list_max(x) - 30)) AS x FROM e)
SELECT vec_id, list_transform(x, lambda v: round(v - list_avg(x), 4) + 0.0) AS levels FROM c""")
def normalise_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("embedding", lambda v: v.cast("double") * 100)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(A.levelled(scaled, 30.0), lambda v: F.round(v, 4) + 0.0).alias("levels"))


def groups_sql(near: float) -> str:
    """Row after row into each label's groups, then merge after merge."""
    return f"""WITH RECURSIVE v AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
placed AS (
  SELECT DISTINCT label, CAST(0 AS BIGINT) AS i, n, CAST([] AS STRUCT(m DOUBLE[], n BIGINT, who BIGINT[])[]) AS g FROM v
  UNION ALL
  SELECT label, i, n, CASE WHEN best.d < {near} THEN list_transform(g, lambda e, k: CASE WHEN k = best.k THEN {{'m': list_transform(range(1, 65), lambda j: e.m[j] + (x[j] - e.m[j]) / (e.n + 1)), 'n': e.n + 1, 'who': list_append(e.who, vec_id)}} ELSE e END)
    ELSE list_append(g, {{'m': x, 'n': CAST(1 AS BIGINT), 'who': [vec_id]}}) END
  FROM (SELECT p.label, v.i, v.n, g, x, vec_id, list_min(list_transform(g, lambda e, k: {{'d': sqrt(list_sum(list_transform(range(1, 65), lambda j: (e.m[j] - x[j]) * (e.m[j] - x[j]))) / 64), 'k': k}})) AS best FROM placed p JOIN v ON v.label = p.label AND v.i = p.i + 1)
), merged AS (
  SELECT label, g, CAST(0 AS BIGINT) AS step FROM placed WHERE i = n
  UNION ALL
  SELECT label, list_filter(list_transform(g, lambda e, k: CASE WHEN k = best.a THEN {{'m': list_transform(range(1, 65), lambda j: (e.n * e.m[j] + g[best.b].n * g[best.b].m[j]) / (e.n + g[best.b].n)), 'n': e.n + g[best.b].n, 'who': list_concat(e.who, g[best.b].who)}} ELSE e END), lambda e, k: k <> best.b), step + 1
  FROM (SELECT label, g, step, list_min(flatten(list_transform(range(1, len(g)), lambda a: list_transform(range(a + 1, len(g) + 1), lambda b: {{'d': sqrt(list_sum(list_transform(range(1, 65), lambda j: (g[a].m[j] - g[b].m[j]) * (g[a].m[j] - g[b].m[j]))) / 64), 'a': a, 'b': b}})))) AS best FROM merged)
  WHERE best.d < {near}
), last AS (SELECT label, arg_max(g, step) AS g FROM merged GROUP BY label),
each AS (SELECT label, unnest(range(0, len(g))) AS group_id, unnest(g) AS e FROM last)
SELECT unnest(e.who) AS vec_id, label, CAST(group_id AS INTEGER) AS group_id FROM each"""


@query(groups_sql(0.15))
def similarity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups within each label in the order of ids."""
    return similarity.similarity_groups(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), ["label"], "vec_id", "embedding", 0.15).select("vec_id", "label", "group_id")


@query("""SELECT vec_id, list_transform(range(1, 33), lambda i: round((embedding[i] + CAST(embedding[i + 32] AS DOUBLE)) / 2, 5) + 0.0) AS mono,
list_transform(range(1, 33), lambda i: round(CAST(embedding[i] AS DOUBLE) - embedding[i + 32], 5) + 0.0) AS rest FROM embeddings""")
def downmix_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda at: F.transform(F.slice("embedding", at, 32), lambda x: x.cast("double"))
    r5 = lambda c: F.transform(c, lambda x: F.round(x, 5) + 0.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", r5(A.downmix(half(1), half(33))).alias("mono"), r5(A.residual(half(1), half(33))).alias("rest"))


@query("""SELECT vec_id, list_transform(range(0, 64), lambda i: round(embedding[i + 1] * CASE WHEN vec_id % 7 <> 0 AND i < 16 THEN i / 16.0 ELSE 1 END * CASE WHEN 63 - i < 8 THEN (63 - i) / 8.0 ELSE 1 END, 5) + 0.0) AS faded FROM embeddings""")
def fade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(A.fade(x, 16, 8, F.col("vec_id") % 7 == 0), lambda v: F.round(v, 5) + 0.0).alias("faded"))  # no negative zeros


@query("""SELECT vec_id, list_transform(range(-5, 69), lambda i: embedding[CASE WHEN abs(i) <= 63 THEN abs(i) ELSE 126 - i END + 1]) AS padded FROM embeddings""")
def reflect_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", A.reflect_pad(F.col("embedding"), 5, 5).alias("padded"))


# Names, text and tokens


@query("""SELECT doc_id, coalesce(nullif(substr(regexp_replace(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 20), ''), 'song') AS prefix FROM documents""")
def title_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.title_prefix(F.col("text")).alias("prefix"))


@query(r"""WITH c AS (SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(url, '^https?:(//[^?#]*)', 1), '[/:\\\n\r]', '-', 'g'), '^[ .]+|[ .]+$', '', 'g'), ''), 'untitled') AS clean FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY clean ORDER BY page_id) AS k FROM c) SELECT page_id, CASE WHEN k = 1 THEN clean ELSE clean || ' ' || k END AS folder FROM n""")
def clean_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "pages").select("page_id", X.clean_title(F.regexp_extract("url", r"^https?:(//[^?#]*)", 1)).alias("clean"))
    return X.unique_names(named, "clean", ["page_id"]).select("page_id", "folder")


@query("""SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(4, length(CAST((SELECT max(o_custkey) FROM orders) AS VARCHAR)), length(CAST(o_custkey AS VARCHAR))) AS INTEGER), '0') AS name FROM orders""")
def zero_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    top = orders.agg(F.max("o_custkey").alias("top"))
    return orders.crossJoin(F.broadcast(top)).select("o_orderkey", X.zero_padded(F.col("o_custkey"), F.col("top"), 4).alias("name"))


@query("""WITH l AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'progress' || chr(9) || value || chr(9) || '200' WHEN 'click' THEN 'title' || chr(9) || props WHEN 'error' THEN 'progress' || chr(9) || value || chr(9) || 'NA' ELSE event_type END AS line, event_type, value, props FROM events)
SELECT event_id, CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'title' END AS kind, CASE WHEN event_type = 'click' THEN props END AS text, CASE WHEN event_type = 'view' THEN round(least(value / 200, 1), 6) END AS fraction FROM l""")
def tool_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value").cast("string")
    line = F.when(kind == "view", F.concat_ws("\t", F.lit("progress"), value, F.lit("200"))).when(kind == "click", F.concat_ws("\t", F.lit("title"), "props"))
    line = line.when(kind == "error", F.concat_ws("\t", F.lit("progress"), value, F.lit("NA"))).otherwise(kind)
    parsed = table(spark, sf_dir, "events").select("event_id", X.tool_line(line).alias("p"))
    return parsed.select("event_id", "p.kind", "p.text", F.round("p.fraction", 6).alias("fraction"))


@query("""SELECT l_orderkey, l_linenumber, CAST(least(50000, round(l_partkey * 48 / 44.1)) AS BIGINT) AS start, CAST(least(50000, round((l_partkey + l_suppkey) * 48 / 44.1)) AS BIGINT) AS "end" FROM lineitem""")
def rescale_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = lambda c: F.least(F.lit(50_000), F.round(c * 48 / 44.1).cast("long"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", edge(F.col("l_partkey")).alias("start"), edge(F.col("l_partkey") + F.col("l_suppkey")).alias("end"))


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT event_id, user_id, s - 1704067200 AS s FROM ev) SELECT event_id, user_id, round(s - 3600, 6) AS s FROM f WHERE s >= 3600 AND s < 90000""")
def lab_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources.lab import excerpt

    rows = events(spark, sf_dir).select("event_id", "user_id", (F.col("s") - 1704067200).alias("s"))
    return excerpt(rows, "s", 3600.0, 86_400.0).select("event_id", "user_id", r6("s"))


_QUALITIES_SQL = ", ".join(f"({k}, '{q}', [{', '.join(repr(b) for b in (*bs, ''))}])" for k, (q, (bs, _)) in enumerate(M.QUALITIES.items()))
_ROOTS_SQL = ", ".join(f"({k}, '{r}')" for k, r in enumerate(M.SHARPS))


@query(f"""WITH q(k, quality, basses) AS (VALUES {_QUALITIES_SQL}), r(p, root) AS (VALUES {_ROOTS_SQL}), c AS (SELECT k, p, generate_subscripts(basses, 1) AS b, root || ':' || quality || unnest(basses) AS name FROM q CROSS JOIN r), v AS (SELECT 0 AS place, 'N' AS name UNION ALL SELECT CAST(row_number() OVER (ORDER BY k, p, b) AS INTEGER), name FROM c)
SELECT place, name, count(l_partkey) AS lines FROM v LEFT JOIN lineitem ON l_partkey % 361 = place GROUP BY place, name""")
def chord_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualities, roots and basses crossed and numbered, and how many lines name each chord by its number."""
    qualities = spark.createDataFrame([(k, q, [*bs, ""]) for k, (q, (bs, _)) in enumerate(M.QUALITIES.items())], "k int, quality string, basses array<string>")
    roots = spark.createDataFrame(list(enumerate(M.SHARPS)), "p int, root string")
    each = qualities.crossJoin(roots).select("k", "p", F.posexplode("basses").alias("b", "bass"), F.concat_ws(":", "root", "quality").alias("stem"))
    # a few hundred rows whatever the data
    named = each.select(F.row_number().over(Window.orderBy("k", "p", "b")).alias("place"), F.concat("stem", "bass").alias("name"))
    every = spark.createDataFrame([(0, "N")], "place int, name string").union(named)
    said = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 361).cast("int").alias("place")).agg(F.count("*").alias("_n"))
    return every.join(said, "place", "left").select("place", "name", F.coalesce("_n", F.lit(0)).alias("lines"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, 30517 + l_partkey % 1161 AS token FROM lineitem)
SELECT l_orderkey, l_linenumber, token, CASE WHEN token < 30965 THEN 'rhythm' WHEN token < 30988 THEN 'structure' WHEN token < 31012 THEN 'key' WHEN token < 31398 THEN 'chord' ELSE 'melody' END AS field,
CASE WHEN token < 30709 THEN CAST((token - 30517) // 6 + 1 AS INTEGER) END AS numerator, CASE WHEN token < 30709 THEN CAST(2 ** ((token - 30517) % 6) AS INTEGER) END AS denominator FROM t""")
def token_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.col("l_partkey") % 1161 + 30517
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", token.alias("token"))
    return rows.select("l_orderkey", "l_linenumber", "token", M.field_of(F.col("token")).alias("field"), M.meter_of(F.col("token")).alias("m")).select("l_orderkey", "l_linenumber", "token", "field", "m.numerator", "m.denominator")


_STEPS_SQL = f"WITH {EVENTS_SQL}, q AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us) AS n, CAST(floor((us - min(us) OVER (PARTITION BY user_id)) / 900000000) AS BIGINT) AS step, CAST(floor(value * 10) AS BIGINT) % 361 AS c FROM ev)"


@query(_STEPS_SQL + "SELECT user_id, step AS subbeat, list(31037 + c ORDER BY n) AS chord_tokens FROM q GROUP BY user_id, step")
def token_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as tokens and parsed again."""
    from tidemark.plans.transcription import parse_events

    parsed = parse_events(event_tokens(spark, sf_dir), ["user_id"])
    return parsed.select("user_id", F.col("subbeat").cast("long").alias("subbeat"), F.transform(F.element_at("tokens", F.lit("chord")), lambda t: t.cast("long")).alias("chord_tokens"))


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, pos, token): a prompt, then a shift where the quarter of an hour changes, and a chord for each event."""
    w = Window.partitionBy("user_id")
    e = events(spark, sf_dir).select("user_id", "us", F.floor((F.col("us") - F.min("us").over(w)) / 900_000_000).cast("int").alias("step"), (F.floor(F.col("value") * 10) % 361).cast("int").alias("c"))
    shift = F.col("step") - F.lag("step", 1, 0).over(w.orderBy("us"))
    chord = F.array((F.col("c") + M.CHORD.start).cast("int"))
    said = F.when(shift > 0, F.concat(M.shift_tokens(shift), chord)).otherwise(chord)
    spoken = e.select("user_id", F.row_number().over(w.orderBy("us")).alias("n"), said.alias("t"))
    heads = e.select("user_id").distinct().select("user_id", F.lit(0).alias("n"), F.array(*map(F.lit, M.PROMPT)).alias("t"))
    return spoken.union(heads).select("user_id", "n", F.posexplode("t").alias("i", "token")).select("user_id", (F.col("n").cast("long") * 1000 + F.col("i")).alias("pos"), "token")
