"""Registered queries over songs and signals that are made from the driver's tables: a user's events are a song, an embedding a signal."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import arrays as A
from tidemark.functions import levels as L
from tidemark.functions import music as M
from tidemark.operators import hopping, series
from tidemark.operators.cells import numbered
from tidemark.plans.registry import EVENTS_SQL, HOURLY_SQL, events, hourly, query, r6, table
from tidemark.plans.transcription import Transcription, describe, encode_events, parse_events
from tidemark.sources.coverage import coverage
from tidemark.sources.lab import lab_text
from tidemark.sources.midi import messages


def _sql_list(values: object) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"  # type: ignore[attr-defined]


_KEYS, _CHORDS, _SECTIONS = _sql_list(M.key_names()), _sql_list(M.chord_names()), _sql_list(M.SECTIONS)

#: Signups state a meter, purchases a key, views and clicks a chord, errors a section; all but errors have a place in the bar, and a note or two sound.
SONG_SQL = f"""{EVENTS_SQL}, song AS (SELECT user_id AS track_id, s - min(s) OVER w AS time, row_number() OVER (PARTITION BY user_id ORDER BY us) AS g, max(s) OVER w - min(s) OVER w + 60 AS duration, event_id, value,
CASE WHEN event_type = 'signup' THEN 3 + event_id % 2 END AS num, CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 < 2 THEN 4 ELSE 8 END END AS den, CASE WHEN event_type <> 'error' THEN event_id % 8 END AS eighth,
CASE WHEN event_type = 'purchase' THEN {_KEYS}[event_id % 24 + 1] END AS key, CASE WHEN event_type IN ('view', 'click') THEN {_CHORDS}[event_id % 361 + 1] END AS chord, CASE WHEN event_type = 'error' THEN {_SECTIONS}[event_id % 23 + 1] END AS section
FROM ev WINDOW w AS (PARTITION BY user_id))"""
BEATS_SQL = SONG_SQL + """, held AS (SELECT track_id, time, g, eighth, last_value(num IGNORE NULLS) OVER w AS num, last_value(den IGNORE NULLS) OVER w AS den FROM song WINDOW w AS (PARTITION BY track_id ORDER BY time, g ROWS UNBOUNDED PRECEDING)),
beats AS (SELECT track_id, time, g, CAST(eighth * den // 8 + 1 AS INTEGER) AS number, CAST(num AS INTEGER) AS numerator, CAST(den AS INTEGER) AS denominator FROM held WHERE eighth IS NOT NULL AND num IS NOT NULL AND eighth * den % 8 = 0 AND eighth * den // 8 < num)"""


def song(spark: SparkSession, sf_dir: str) -> Transcription:
    e, i, w = events(spark, sf_dir), F.col("event_id"), Window.partitionBy("user_id")
    kind = lambda *names: F.col("event_type").isin(*names)
    pick = lambda names, by: F.get(F.array(*map(F.lit, names)), (i % by).cast("int"))
    first = F.struct((i % 40 + 40).cast("int").alias("pitch"), (i % 2).cast("int").alias("track"), F.lit(1).alias("subbeats"))
    second = F.struct((i % 12 + 60).cast("int").alias("pitch"), F.lit(1).alias("track"), F.lit(2).alias("subbeats"))
    loud = F.col("value") > 50
    time = F.col("s") - F.min("s").over(w)
    return Transcription(
        e.select(
            F.col("user_id").alias("track_id"), "event_id", time.alias("time"), F.row_number().over(w.orderBy("us")).alias("global_subbeat"), (F.max("s").over(w) - F.min("s").over(w) + 60).alias("duration"),
            F.when(kind("signup"), F.struct((i % 2 + 3).cast("int").alias("numerator"), F.when(i % 3 < 2, 4).otherwise(8).alias("denominator"))).alias("meter"),
            F.when(~kind("error"), (i % 8).cast("int")).alias("eighth"),
            F.when(kind("purchase"), pick(M.key_names(), 24)).alias("key"), F.when(kind("view", "click"), pick(M.chord_names(), 361)).alias("chord"), F.when(kind("error"), pick(M.SECTIONS, 23)).alias("section"),
            F.when(loud, F.array(first, second)).otherwise(F.array(first)).alias("notes"),
            F.when(loud, F.array(time + F.col("value"), time + 2 * F.col("value"))).otherwise(F.array(time + F.col("value"))).alias("note_ends"),
        )
    )


@query(f"WITH {BEATS_SQL} SELECT track_id, round(time, 6) AS time, number, numerator, denominator FROM beats")
def song_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return song(spark, sf_dir).beats.select("track_id", r6("time"), "number", "numerator", "denominator")


@query(f"WITH {BEATS_SQL} SELECT track_id, round(time, 6) AS time FROM beats WHERE number = 1")
def song_downbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return song(spark, sf_dir).downbeats.select("track_id", r6("time"))


@query(f"WITH {BEATS_SQL}, t AS (SELECT track_id, denominator, lead(time) OVER (PARTITION BY track_id ORDER BY time) - time AS gap FROM beats) SELECT track_id, round(median(60 / gap * (4 / denominator)), 6) AS bpm FROM t WHERE gap > 0 GROUP BY track_id")
def song_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return song(spark, sf_dir).bpm.select("track_id", r6("bpm"))


_SPAN_SQL = "SELECT track_id, time AS a, coalesce(lead(time) OVER (PARTITION BY track_id ORDER BY time, g), duration) AS b, {0} AS label FROM song WHERE {0} IS NOT NULL"


@query(f"WITH {SONG_SQL}, sp AS ({_SPAN_SQL.format('section')}) SELECT track_id, round(a, 6) AS start, round(b, 6) AS \"end\", label FROM sp WHERE b > a")
def song_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return song(spark, sf_dir).spans("section").select("track_id", r6("start"), r6("end"), "label")


@query(f"""WITH {BEATS_SQL}, sp AS ({_SPAN_SQL.format('key')}), k AS (SELECT track_id, label, row_number() OVER (PARTITION BY track_id ORDER BY sum(b - a) DESC, label) AS i FROM sp WHERE b > a GROUP BY track_id, label),
m AS (SELECT track_id, numerator || '/' || denominator AS label, row_number() OVER (PARTITION BY track_id ORDER BY count(*) DESC, numerator || '/' || denominator) AS i FROM beats GROUP BY track_id, numerator, denominator),
t AS (SELECT track_id, denominator, lead(time) OVER (PARTITION BY track_id ORDER BY time) - time AS gap FROM beats), p AS (SELECT track_id, round(median(60 / gap * (4 / denominator))) AS bpm FROM t WHERE gap > 0 GROUP BY track_id),
n AS (SELECT track_id, count(*) AS bars FROM beats WHERE number = 1 GROUP BY track_id)
SELECT s.track_id, concat_ws(', ', replace(k.label, ':', ' '), m.label, CAST(p.bpm AS INTEGER) || ' bpm', coalesce(n.bars, 0) || ' bars') AS summary FROM (SELECT DISTINCT track_id FROM song) s
LEFT JOIN (SELECT * FROM k WHERE i = 1) k USING (track_id) LEFT JOIN (SELECT * FROM m WHERE i = 1) m USING (track_id) LEFT JOIN p USING (track_id) LEFT JOIN n USING (track_id)""")
def song_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return song(spark, sf_dir).summary


NOTES_SQL = SONG_SQL + """, n AS (SELECT track_id, time AS st, least(duration, time + value) AS en, 40 + event_id % 40 AS pitch, event_id % 2 AS track FROM song
UNION ALL SELECT track_id, time, least(duration, time + 2 * value), 60 + event_id % 12, 1 FROM song WHERE value > 50), notes AS (SELECT * FROM n WHERE en > st)"""


@query(f"""WITH {NOTES_SQL} SELECT track_id, round(st, 6) AS start, round(en, 6) AS "end", CAST(pitch AS INTEGER) AS pitch, CAST(track AS INTEGER) AS track,
CAST(row_number() OVER (PARTITION BY track_id ORDER BY st, en, pitch, track) AS INTEGER) AS note_no FROM notes""")
def song_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return song(spark, sf_dir).ordered_notes.select("track_id", r6("start"), r6("end"), "pitch", "track", "note_no")


@query(f"WITH {NOTES_SQL} SELECT track_id, round(st, 6) AS start, CAST(pitch AS INTEGER) AS pitch FROM notes WHERE track = 0")
def song_vocal_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return song(spark, sf_dir).melody.where("part = 'Vocal'").select("track_id", r6("start"), "pitch")


@query(f"""WITH {NOTES_SQL}, m AS (SELECT track_id, CASE WHEN track = 0 THEN 'Vocal' ELSE 'Ins' END AS part, CAST(floor(st * 1920 + 0.5) AS BIGINT) AS tick, 1 AS on_, pitch, 100 AS velocity FROM notes
UNION ALL SELECT track_id, CASE WHEN track = 0 THEN 'Vocal' ELSE 'Ins' END, CAST(floor(en * 1920 + 0.5) AS BIGINT), 0, pitch, 0 FROM notes)
SELECT track_id, part, tick, on_ AS "on", CAST(pitch AS INTEGER) AS pitch, velocity, CAST(row_number() OVER (PARTITION BY track_id, part ORDER BY tick, on_, pitch, velocity) AS INTEGER) AS message_no FROM m""")
def midi_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(song(spark, sf_dir).melody)


@query(f"WITH {EVENTS_SQL} SELECT user_id, string_agg(event_id || chr(9) || event_type || chr(10), '' ORDER BY us) AS text FROM ev GROUP BY user_id")
def lab_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab_text(events(spark, sf_dir), ["user_id"], ["us"], ["event_id", "event_type"])


# Names of notes, keys and chords

_QUALITY_ROWS = ", ".join(f"('{q}', {list(steps)}, {_sql_list((*bs, ''))}, {[M.BASS.get(b[1:], 0) for b in (*bs, '')]})" for q, (bs, steps) in M.QUALITIES.items())
_KEY_ROWS = ", ".join(f"('{k}', {M.place_of(M.MAJOR_KEYS[(i + (0 if i < 12 else 3)) % 12])})" for i, k in enumerate(M.key_names()))
#: Every chord in every key: seven letters for the root, the cheapest on the line of fifths, the first of equals from C to B.
SPELL_SQL = f"""q(quality, steps, basses, degrees) AS (VALUES {_QUALITY_ROWS}), r(p, root) AS (VALUES {", ".join(f"({p}, '{n}')" for p, n in enumerate(M.SHARPS))}), k(key, sig) AS (VALUES {_KEY_ROWS}),
l(o, letter, nat) AS (VALUES (0, 'C', 0), (1, 'D', 2), (2, 'E', 4), (3, 'F', -1), (4, 'G', 1), (5, 'A', 3), (6, 'B', 5)),
c AS (SELECT p, root, quality, steps, unnest(basses) AS bass, unnest(degrees) AS degree FROM q CROSS JOIN r),
a AS (SELECT c.*, k.key, k.sig, o, letter, ((p - 7 * nat + 6) % 12 + 12) % 12 - 6 AS acc, nat + 7 * (((p - 7 * nat + 6) % 12 + 12) % 12 - 6) AS place FROM c CROSS JOIN k CROSS JOIN l),
w AS (SELECT *, list_sum(list_transform(steps, lambda s: greatest(abs(place + s - sig - 2) - 3, 0))) + greatest(abs(place - sig - 2) - 3, 0) AS cost FROM a),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root, quality, bass, key ORDER BY cost, o) AS i FROM w) WHERE i = 1),
spelled AS (SELECT root || ':' || quality || bass AS raw, key, letter || repeat('#', greatest(acc, 0)::INTEGER) || repeat('b', greatest(-acc, 0)::INTEGER) AS name, quality || bass AS rest,
list_sort(list_distinct(list_concat(list_transform(list_append(steps, degree), lambda s: CAST(48 + p + (s * 7 % 12 + 12) % 12 AS INTEGER)), [CAST(36 + (p + degree * 7 % 12 + 12) % 12 AS INTEGER)]))) AS pitches FROM b)"""


@query(f"""WITH {SONG_SQL}, {SPELL_SQL}, every AS (SELECT raw, key, name || ':' || rest AS label, pitches, name || CASE rest WHEN 'maj' THEN '' WHEN 'min' THEN 'm' WHEN 'min7' THEN 'm7' ELSE rest END AS short FROM spelled
UNION ALL SELECT 'N', key, 'N', CAST([] AS INTEGER[]), 'N' FROM k),
said AS (SELECT x.chord AS raw, y.key, count(*) AS songs FROM (SELECT DISTINCT track_id, chord FROM song WHERE chord IS NOT NULL) x JOIN (SELECT DISTINCT track_id, key FROM song WHERE key IS NOT NULL) y USING (track_id) GROUP BY x.chord, y.key)
SELECT raw, key, label, pitches, short, songs FROM every JOIN said USING (raw, key)""")
def chord_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chord of a song in every key of the song, with its pitches and the number of such songs."""
    events_ = song(spark, sf_dir).events
    chords, keys = (events_.where(F.col(c).isNotNull()).select("track_id", c).distinct() for c in ("chord", "key"))
    said = chords.join(keys, "track_id").groupBy(F.col("chord").alias("raw"), "key").agg(F.count("*").alias("songs"))
    spelled = said.join(F.broadcast(M.spelling_table(spark)), ["raw", "key"]).join(F.broadcast(M.pitch_table(spark)), "label")
    return spelled.select("raw", "key", "label", "pitches", M.short_chord(F.col("label")).alias("short"), "songs")


@query(f"""WITH {SONG_SQL}, {SPELL_SQL}, cs AS ({_SPAN_SQL.format('chord')}), ks AS ({_SPAN_SQL.format('key')}), kn AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY a) AS n, count(*) OVER (PARTITION BY track_id) AS c FROM ks WHERE b > a),
m AS (SELECT *, (a + b) / 2 AS mid FROM cs WHERE b > a), f AS (SELECT m.track_id, m.a, 1 + count(*) FILTER (WHERE kn.b < mid AND kn.n < kn.c) AS n FROM m JOIN kn USING (track_id) GROUP BY m.track_id, m.a)
SELECT m.track_id, round(m.a, 6) AS start, round(m.b, 6) AS "end", coalesce(s.name || ':' || s.rest, m.label) AS label FROM m LEFT JOIN f ON f.track_id = m.track_id AND f.a = m.a LEFT JOIN kn ON kn.track_id = m.track_id AND kn.n = f.n
LEFT JOIN spelled s ON s.raw = m.label AND s.key = kn.label""")
def song_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return song(spark, sf_dir).chords.select("track_id", r6("start"), r6("end"), "label")


@query("""WITH n AS (SELECT o_orderkey, substr('ABCDEFGHx', CAST(o_orderkey % 9 + 1 AS INTEGER), 1) || repeat('#', CAST(o_custkey % 4 AS INTEGER)) || CASE WHEN o_custkey % 5 = 0 THEN 'bb' ELSE '' END || CASE WHEN o_custkey % 11 = 0 THEN '7' ELSE '' END AS name, o_custkey FROM orders)
SELECT o_orderkey, name, CASE WHEN o_orderkey % 9 < 7 AND o_custkey % 11 <> 0 THEN CAST(([9, 11, 0, 2, 4, 5, 7][o_orderkey % 9 + 1] + o_custkey % 4 - CASE WHEN o_custkey % 5 = 0 THEN 2 ELSE 0 END + 12) % 12 AS INTEGER) END AS pitch_class FROM n""")
def note_pitch_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(F.substring(F.lit("ABCDEFGHx"), (k % 9 + 1).cast("int"), F.lit(1)), F.repeat(F.lit("#"), (c % 4).cast("int")), F.when(c % 5 == 0, "bb").otherwise(""), F.when(c % 11 == 0, "7").otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name")).withColumn("pitch_class", M.pitch_class_of(F.col("name")))


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(30709 + l_partkey % 689 AS INTEGER) AS token, l_quantity FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN token < 30965 THEN token - 30709 END AS eighth,
CASE WHEN token BETWEEN 30965 AND 30987 THEN {_SECTIONS}[token - 30964] END AS section, CASE WHEN token BETWEEN 30988 AND 31011 THEN {_KEYS}[token - 30987] END AS key,
CASE WHEN token BETWEEN 31012 AND 31036 THEN {_sql_list(M.triad_names())}[token - 31011] WHEN token > 31036 THEN {_CHORDS}[token - 31036] END AS chord, CAST(least(greatest(round(l_quantity * 7.5 * 100), 0), 29999) + 517 AS INTEGER) AS time_token FROM t""")
def token_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 689 + 30_709).cast("int").alias("token"), "l_quantity")
    t = F.col("token")
    return rows.select("l_orderkey", "l_linenumber", M.eighth_of(t).alias("eighth"), M.section_name(t).alias("section"), M.key_name(t).alias("key"), M.chord_name(t).alias("chord"), M.time_token(F.col("l_quantity") * 7.5).alias("time_token"))


@query(f"""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS a, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 24 END AS x, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey % 256 END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, list_filter([CAST(a % 128 AS INTEGER), CAST(b % 128 AS INTEGER)], lambda p: p IS NOT NULL) AS pitches, list_filter([CAST(a // 128 AS INTEGER), CAST(b // 128 AS INTEGER)], lambda p: p IS NOT NULL) AS tracks,
list_filter([coalesce({list(M.DURATIONS)}[x + 1], 1), CASE WHEN b IS NOT NULL THEN 1 END], lambda p: p IS NOT NULL) AS subbeats FROM d""")
def note_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Melody tokens, a pitch with or without a length, read as notes."""
    a, x, b = F.col("l_partkey") % 256 + M.PITCH.start, F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey") % 24 + M.DURATION.start), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey") % 256 + M.PITCH.start)
    said = F.filter(F.array(a.cast("int"), x.cast("int"), b.cast("int")), lambda t: t.isNotNull())
    rows = describe(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.create_map(F.lit("melody"), said).alias("tokens")))
    return rows.select("l_orderkey", "l_linenumber", F.col("notes.pitch").alias("pitches"), F.col("notes.track").alias("tracks"), "notes.subbeats")


@query(f"""WITH {EVENTS_SQL}, q AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us) AS n, CAST(floor((us - min(us) OVER (PARTITION BY user_id)) / 900000000) AS BIGINT) AS step, CAST(floor(value * 10) AS BIGINT) % 361 AS c FROM ev),
e AS (SELECT user_id, step, list(CAST(31037 + c AS INTEGER) ORDER BY n) AS said FROM q GROUP BY user_id, step), d AS (SELECT *, step - lag(step, 1, 0) OVER (PARTITION BY user_id ORDER BY step) AS gap FROM e),
t AS (SELECT user_id, step, list_concat(list_transform(range(0, (greatest(gap, 1) - 1) // 256), lambda i: CAST(516 AS INTEGER)), [CAST(260 + gap - 256 * ((greatest(gap, 1) - 1) // 256) AS INTEGER)], said) AS tokens FROM d)
SELECT user_id, list_concat({list(M.PROMPT)}, flatten(list(tokens ORDER BY step))) AS tokens FROM t GROUP BY user_id""")
def tokens_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are written as tokens, parsed, and written again."""
    from tidemark.plans.queries import event_tokens

    return encode_events(parse_events(event_tokens(spark, sf_dir), ["user_id"]), ["user_id"])


# Signals


@query("""SELECT l_orderkey, l_linenumber, round(2595 * log10(1 + l_extendedprice / 700), 6) AS mel, round(700 * (10 ** (l_quantity * 50 / 2595) - 1), 6) AS hz FROM lineitem""")
def mel_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(L.mel_of(F.col("l_extendedprice")), 6).alias("mel"), F.round(L.hz_of(F.col("l_quantity") * 50), 6).alias("hz"))


@query("""SELECT vec_id, list_transform(range(-10, 30), lambda i: CASE WHEN i >= 0 THEN CAST(embedding[i + 1] AS DOUBLE) ELSE 0.0 END) AS head, list_transform(range(44, 84), lambda i: CASE WHEN i < 64 THEN CAST(embedding[i + 1] AS DOUBLE) ELSE 0.0 END) AS tail FROM embeddings""")
def centred_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last twenty numbers in the middle of forty."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", A.centred_segment(x, 0, 20, 40).alias("head"), A.centred_segment(x, 54, 20, 40).alias("tail"))


@query("""SELECT vec_id, list_transform(range(0, 100), lambda i: CASE WHEN i < 40 THEN CAST(embedding[i + 1] AS DOUBLE) WHEN 78 - i >= 0 THEN CAST(embedding[79 - i] AS DOUBLE) ELSE 0.0 END) AS whole FROM embeddings""")
def mirrored_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform(F.slice("embedding", 1, 40), lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", A.mirrored_tail(x, 100).alias("whole"))


@query("""WITH p AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, 64)) AS i FROM embeddings)
SELECT vec_id, CAST(arg_max(i, (v, -i)) AS INTEGER) AS place FROM p WHERE i BETWEEN 3 AND 9 OR i BETWEEN 30 AND 49 GROUP BY vec_id""")
def masked_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", A.masked_argmax(F.col("embedding"), [range(3, 10), range(30, 50)]).alias("place"))


@query(f"""SELECT vec_id, list_transform(range(0, 64), lambda i: round(embedding[i + 1] * (0.5 - 0.5 * cos(2 * {math.pi} * i / 64)), 6) + 0.0) AS windowed, list_transform(range(0, 64), lambda i: round(ln(1 + 100 * 4 / 128.0 * abs(embedding[i + 1])), 6) + 0.0) AS compressed FROM embeddings""")
def windowed_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.transform(c, lambda v: F.round(v, 6) + 0.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", r(L.hann_windowed(F.col("embedding"), 64)).alias("windowed"), r(L.compressed(F.col("embedding"), 128)).alias("compressed"))


@query("""WITH m AS (SELECT label, vec_id, unnest(range(0, 64)) AS k, ln(1 + 100 * 4 / 128.0 * abs(CAST(unnest(embedding) AS DOUBLE))) AS v FROM embeddings),
d AS (SELECT label, vec_id, k, greatest(v - lag(v, 1, 0.0) OVER (PARTITION BY label, k ORDER BY vec_id), 0) AS g FROM m)
SELECT label, vec_id, round(sum(g * CASE WHEN k = 0 THEN 0 ELSE 1 / greatest(1.0, k * (2 ** (1 / 6.0) - 1)) END), 6) AS flux FROM d GROUP BY label, vec_id""")
def spectral_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as the magnitudes of a label's frames."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    return series.magnitude_flux(rows, ["label"], ["vec_id"], "embedding", 128).select("label", "vec_id", r6("flux"))


@query("""SELECT vec_id, list_transform([(0, 8), (8, 16), (16, 32), (32, 64)], lambda e: round(10 * log10(list_sum(list_transform(embedding[e[1] + 1:e[2]], lambda v: CAST(v AS DOUBLE) * v)) + 1e-12), 5)) AS bands FROM embeddings""")
def band_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(L.band_decibels(F.col("embedding"), [0, 8, 16, 32, 64]), lambda v: F.round(v, 5)).alias("bands"))


@query("""WITH p AS (SELECT label, max(list_max(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))) AS top FROM embeddings GROUP BY label)
SELECT vec_id, list_transform(embedding, lambda v: round(greatest(10 * log10(greatest(CAST(v AS DOUBLE) * v, 1e-30) / top), -80.0), 5) + 0.0) AS levels FROM embeddings JOIN p USING (label)""")
def display_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of each frame in dB under the loudest of its label, which stands for the mix."""
    frames = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double") * v).alias("power"))
    tops = frames.groupBy("label").agg(F.max(F.array_max("power")).alias("top"))
    return frames.join(tops, "label").select("vec_id", F.transform("power", lambda p: F.round(L.below_peak(p, F.col("top")), 5) + 0.0).alias("levels"))


@query(f"""WITH {HOURLY_SQL}, w AS (SELECT *, unnest(range(greatest(CAST(floor((t - 24) / 12.0) AS BIGINT) + 1, 0), t // 12 + 1)) * 12 AS start FROM hourly), f AS (SELECT *, max(start) OVER (PARTITION BY event_type) AS last, t - start AS o FROM w),
x AS (SELECT *, CASE WHEN o < 4 AND start > 0 THEN o / 3.0 ELSE 1 END * CASE WHEN 23 - o < 4 AND start <> last THEN (23 - o) / 3.0 ELSE 1 END AS wt FROM f)
SELECT event_type, t, round(sum((v + start) * wt) / greatest(sum(wt), 1e-8), 6) AS value FROM x GROUP BY event_type, t""")
def hopping_fades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day every half day with linear fades, the outer edges of a series without."""
    parts = hopping.into_windows(hourly(spark, sf_dir), "t", 24, 12)
    final = F.col("window_start") == F.max("window_start").over(Window.partitionBy("event_type"))
    weight = hopping.faded(F.col("offset"), 24, 4, F.col("window_start"), final)
    marked = parts.withColumn("weight", weight).withColumn("x", F.col("v") + F.col("window_start"))
    return hopping.overlap_add(marked, ["event_type"], "t", "x", "weight").select("event_type", "t", r6("value"))


@query(f"""WITH {HOURLY_SQL}, w AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY t) AS a, lead(v) OVER (PARTITION BY event_type ORDER BY t) AS b FROM hourly), p AS (SELECT event_type, t, v FROM w WHERE v > a AND v >= b),
m AS (SELECT event_type, list_sort(list(v))[count(*) // 2 + 1] AS level FROM p GROUP BY event_type) SELECT event_type, max(t) AS t FROM p JOIN m USING (event_type) WHERE v >= level * 1.2 GROUP BY event_type""")
def last_strong_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.last_strong_turn(hourly(spark, sf_dir), ["event_type"], "t", "v", 1.2).select("event_type", "t")


@query("""SELECT user_id, CAST(row_number() OVER (ORDER BY round(sqrt(avg(value * value)), 6) DESC, user_id) AS INTEGER) AS turn FROM events GROUP BY user_id""")
def loudest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = table(spark, sf_dir, "events").groupBy("user_id").agg((-F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6)).alias("quiet"))
    return numbered(loud, [], ["quiet", "user_id"], "turn").select("user_id", F.col("turn").cast("int").alias("turn"))


# Sets, maps and reports


@query("""WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS said FROM events GROUP BY user_id), u AS (SELECT user_id, list_filter(said, lambda x: x NOT IN ('view', 'click', 'signup')) AS other FROM s)
SELECT user_id, other, other[1] AS first FROM u""")
def unknown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's labels have beside the known ones, and the first of it."""
    said = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("said"))
    other = F.array_sort(F.array_except("said", F.array(*map(F.lit, ("view", "click", "signup")))))
    return said.select("user_id", other.alias("other")).select("user_id", "other", F.get("other", F.lit(0)).alias("first"))


@query("""SELECT 'c' AS registry, c_custkey AS key, c_nationkey AS nation FROM customer UNION ALL SELECT 's', s_suppkey, s_nationkey FROM supplier WHERE s_nationkey < 20""")
def bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registries as one, repeats kept."""
    own = table(spark, sf_dir, "customer").select(F.lit("c").alias("registry"), F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    return own.unionByName(table(spark, sf_dir, "supplier").where("s_nationkey < 20").select(F.lit("s").alias("registry"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation")))


@query("""WITH l AS (SELECT user_id, event_type, max(value) AS v FROM events WHERE value < 50 GROUP BY ALL), r AS (SELECT user_id, event_type, min(value) AS v FROM events WHERE value >= 100 GROUP BY ALL),
m AS (SELECT user_id, event_type, coalesce(r.v, l.v) AS v FROM l FULL JOIN r USING (user_id, event_type)) SELECT user_id, list(event_type ORDER BY event_type) AS names, list(v ORDER BY event_type) AS vals FROM m GROUP BY user_id""")
def merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps for each user, the right one wins."""
    e = table(spark, sf_dir, "events")
    entries = lambda rows, agg: rows.groupBy("user_id", "event_type").agg(agg.alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    left, right = entries(e.where("value < 50"), F.max("value")).withColumnRenamed("m", "a"), entries(e.where("value >= 100"), F.min("value")).withColumnRenamed("m", "b")
    none = F.create_map().cast("map<string,double>")
    both = left.join(right, "user_id", "full").select("user_id", A.merged(F.coalesce("a", none), F.coalesce("b", none)).alias("m"))
    sorted_ = F.array_sort(F.map_entries("m"))
    return both.select("user_id", F.transform(sorted_, lambda x: x["key"]).alias("names"), F.transform(sorted_, lambda x: x["value"]).alias("vals"))


@query("""WITH f AS (SELECT l_suppkey, 'part' || (l_partkey % 5) AS path, max((CAST(floor(l_quantity) AS BIGINT), CAST(floor(l_quantity * l_discount) AS BIGINT))) AS m FROM lineitem GROUP BY ALL)
SELECT l_suppkey, count(*) AS files, CAST(sum(m[2]) AS BIGINT) AS covered, CAST(sum(m[1]) AS BIGINT) AS total, round(CASE WHEN sum(m[1]) > 0 THEN sum(m[2]) / sum(m[1]) END, 6) AS share FROM f GROUP BY l_suppkey""")
def coverage_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports in JSON, one for each order of a supplier, read and added up."""
    one = F.struct(F.concat(F.lit("part"), (F.col("l_partkey") % 5).cast("string")).alias("path"), F.floor(F.col("l_quantity") * F.col("l_discount")).alias("covered"), F.floor("l_quantity").alias("total"))
    reports = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.to_json(F.struct(F.collect_list(one).alias("files"))).alias("report"))
    return coverage(reports, ["l_suppkey"], "report").select("l_suppkey", "files", "covered", "total", r6("share"))
