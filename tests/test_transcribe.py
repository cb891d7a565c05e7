"""Audio to events: windows of several tracks against a plain serial loop, models that do not fit, decoders that fail."""

import math
import statistics
from pathlib import Path

import numpy as np
import pytest

from tidemark.functions import music as M
from tidemark.operators import blocks as B
from tidemark.operators.hopping import plan_windows
from tidemark.plans.models import Model, require, session
from tidemark.plans.transcribe import transcribe, windows_of
from tidemark.plans.transcription import greedy_decode
from tidemark.sources import wav

RATE, LENGTH, OVERLAP, LOOKAHEAD = 400, 6.0, 4.0, 2.0


class Decoder:
    """Says a shift, a time, a place in the bar, at times a meter, section, key or chord, and notes that follow from what is heard then."""

    def __init__(self, context, log):
        self.context, self.log, self.seconds, self.said, self.steps = context, log, 0.0, "", 0

    def step(self, token):
        self.steps += 1
        if token in M.TIME:
            self.seconds = (token - M.TIME.start) / 100
        at = min(int(self.seconds * 4), len(self.context) - 1)
        heard = int(self.context[at])
        scores = np.zeros(M.DURATION.stop)
        scores[M.EOS] = 0.1

        def want(token, much):
            scores[token] = much

        if token in M.TIME and heard % 5 == 0:
            want(M.METER.start + 6 * (2 + heard % 3) + 2, 9)
        want(M.EIGHTH.start + 2 * (heard % 4), 8 if token in M.TIME or token in M.METER else 0)
        if token in M.EIGHTH:
            want(M.SECTION.start + heard % 23, 7 * (heard % 3 == 0))
        if token in M.EIGHTH or token in M.SECTION:
            want(M.KEY.start + heard % 24, 6 * (heard % 4 == 0))
        if token in M.EIGHTH or token in M.SECTION or token in M.KEY:
            want(M.CHORD.start + heard % 361, 5 * (heard % 2))
        if token not in M.SHIFT and token not in M.TIME and token not in M.METER and token not in M.PITCH and token not in M.DURATION:
            want(M.PITCH.start + heard % 256, 4)
        if token in M.PITCH:
            want(M.DURATION.start + heard % 6, 3)
        if token in M.SHIFT:
            want(M.TIME.start + int(self.seconds * 100) + 40 + heard % 30, 9)
        want(M.SHIFT.start + 1 + heard % 4, 2)
        return scores

    def close(self):
        if self.log:
            with open(self.log, "a") as f:
                f.write(f"{self.steps}\n")


class Ear:
    def __init__(self, log=None):
        self.log = log

    def encode(self, samples):
        assert samples.dtype == np.float32 and len(samples) == LENGTH * RATE
        return [round(float(np.abs(samples[k : k + RATE // 4]).sum()) * 1000) for k in range(0, len(samples), RATE // 4)]

    def open(self, context):
        return Decoder(context, self.log)


def songs():
    rng = np.random.default_rng(8)
    return {name: (rng.uniform(-1, 1, (2, n)) * np.sin(np.arange(n) / 900)).astype(np.float32) for name, n in (("long", 11_330), ("short", 3000), ("exact", 6000))}


def blocks_of(spark, tracks, size, rate=1000):
    rows = [(name, rate, k, at, x[0, at : at + size].tolist(), x[1, at : at + size].tolist()) for name, x in tracks.items() for k, at in enumerate(range(0, x.shape[1], size))]
    return spark.createDataFrame(rows, wav.AUDIO_BLOCK)


# a plain serial version


def field_of(t):
    for name, ranges in (("timestamp", [M.TIME]), ("rhythm", [M.METER, M.EIGHTH]), ("structure", [M.SECTION]), ("key", [M.KEY]), ("chord", [M.TRIAD, M.CHORD]), ("melody", [M.PITCH, M.DURATION])):
        if any(t in r for r in ranges):
            return name
    return None


def parsed(tokens):
    out, at, fresh = [], 0, True
    for t in tokens[tokens.index(M.OUT) + 1 :]:
        if t == M.EOS:
            break
        if t in M.SHIFT:
            at, fresh = at + t - M.SHIFT.start, True
        elif field := field_of(t):
            if fresh:
                out.append((at, {}))
            fresh = False
            out[-1][1].setdefault(field, []).append(t)
    return out


def notes_of(fields):
    own = fields.get("melody", [])
    return [((t - M.PITCH.start) % 128, M.DURATIONS[own[i + 1] - M.DURATION.start] if i + 1 < len(own) and own[i + 1] in M.DURATION else 1) for i, t in enumerate(own) if t in M.PITCH]


def clock(events):
    points = dict(sorted((at, (f["timestamp"][0] - M.TIME.start) / 100) for at, f in events if "timestamp" in f))
    steps = sorted(points)
    rates = [(points[b] - points[a]) / max(b - a, 1) for a, b in zip(steps[:-1], steps[1:], strict=True)]
    rate = statistics.median(rates) if rates and statistics.median(rates) > 0 else 0.125

    def when(x):
        if not steps:
            y = x * 0.125
        elif x <= steps[0]:
            y = points[steps[0]] + (x - steps[0]) * rate
        elif x >= steps[-1]:
            y = points[steps[-1]] + (x - steps[-1]) * rate
        else:
            a = max(s for s in steps if s <= x)
            b = steps[steps.index(a) + 1]
            y = points[a] + (points[b] - points[a]) / (b - a) * (x - a)
        return min(max(y, 0.0), LENGTH)

    return when


def prefix_of(kept, start, until):
    inside = sorted((e for e in kept if start - 1e-4 <= e["time"] < until - 1e-4), key=lambda e: (e["g"], e["time"]))
    k = next((i for i, e in enumerate(inside) if "timestamp" in e["f"] or "rhythm" in e["f"]), None)
    if k is None:
        return list(M.PROMPT), 0
    inside = inside[k:]
    base, past = inside[0]["g"], sorted((e for e in kept if e["time"] <= inside[0]["time"] + 1e-6), key=lambda e: (e["time"], e["g"]))
    out, before = list(M.PROMPT), 0
    for i, e in enumerate(inside):
        f = dict(e["f"])
        if "timestamp" in f:
            f["timestamp"] = [M.TIME.start + min(max(math.floor((e["time"] - start) * 100 + 0.5), 0), 29_999)]
        if i == 0:
            for name in ("structure", "key", "chord"):
                known = [p["f"][name] for p in past if name in p["f"]]
                if known and name not in f:
                    f[name] = known[-1]
            meters = [t for p in past for t in p["f"].get("rhythm", [])[:1] if t in M.METER]
            if meters and "rhythm" in f and not any(t in M.METER for t in f["rhythm"]):
                f["rhythm"] = [meters[-1], *f["rhythm"]]
        step, before = e["g"] - base - before, e["g"] - base
        while step > 256:
            out, step = [*out, M.SHIFT.stop - 1], step - 256
        out.append(M.SHIFT.start + step)
        for name in M.FIELDS:
            out += f.get(name, [])
    return out, base


def serial(mix, rate):
    mono = wav.resample(((mix[0] + mix[1]) / 2)[None], rate, RATE)[0]
    duration, kept = len(mono) / RATE, []
    for k, w in enumerate(plan_windows(duration, LENGTH, OVERLAP, LOOKAHEAD)):
        prefix, base = prefix_of(kept, w.start, w.prefix_end) if k else (list(M.PROMPT), 0)
        heard = np.zeros(int(LENGTH * RATE), dtype=np.float32)
        own = mono[math.floor(w.start * RATE + 0.5) :][: len(heard)]
        heard[: len(own)] = own
        with session(Ear(), heard) as decoder:
            events = parsed(greedy_decode(decoder, prefix, w.stop if w.stop is not None else min(duration - w.start, LENGTH)))
        when = clock(events)
        for at, f in events:
            t = w.start + when(at)
            if w.accept_start - 1e-4 <= t < w.accept_end - 1e-4 and t < duration - 1e-4:
                ends = [min(duration, max(min(max(t, 0.0), duration) + 0.04, w.start + when(at + n))) for _, n in notes_of(f)]
                kept.append({"time": min(max(t, 0.0), duration), "g": base + at, "f": f, "ends": ends})
    return sorted((e["g"], round(e["time"], 6), sorted((k, list(v)) for k, v in e["f"].items()), [round(x, 6) for x in e["ends"]]) for e in kept)


def rows_of(song, name):
    rows = song.events.where(f"track_id = '{name}'").collect()
    return sorted((r["global_subbeat"], round(r["time"], 6), sorted((k, list(v)) for k, v in r["tokens"].items()), [round(x, 6) for x in r["note_ends"] or []]) for r in rows)


def test_windows_of_several_tracks_equal_a_serial_loop(spark, tmp_path):
    tracks, log = songs(), str(tmp_path / "steps")
    model = Model(lambda: Ear(log), {"samples": (int(LENGTH * RATE),), "token": ()}, {"scores": (M.DURATION.stop,)})
    song = transcribe(blocks_of(spark, tracks, 1000), model, RATE, LENGTH, OVERLAP, LOOKAHEAD, block=512)
    for name, x in tracks.items():
        want = serial(x, 1000)
        assert len(want) > 3 and rows_of(song, name) == want, name
    plans = [len(plan_windows(math.floor(x.shape[1] * RATE / 1000 + 0.5) / RATE, LENGTH, OVERLAP, LOOKAHEAD)) for x in tracks.values()]
    # a decoder for each window, closed once
    assert max(plans) == 4 and len(Path(log).read_text().split()) == sum(plans)
    assert song.beats.count() > 0 and song.chords.count() > 0


def test_window_plans(spark):
    tracks = {name: np.zeros((2, int(seconds * 10)), np.float32) for name, seconds in (("a", 255), ("b", 360), ("c", 650))}
    plan = windows_of(B.mono(blocks_of(spark, tracks, 2000, 10))).orderBy("track_id", "window_no").collect()
    starts = {name: [r["start"] for r in plan if r["track_id"] == name] for name in "abc"}
    assert starts == {"a": [0.0], "b": [0.0, 60.0], "c": [0.0, 100.0, 200.0, 300.0, 350.0]}
    assert [r["stop"] for r in plan if r["track_id"] == "b"] == [200.0, 300.0]


def test_resampling_in_blocks_equals_the_whole(spark):
    tracks = {name: x[:, :5000] for name, x in songs().items()}
    for rate in (1000, 400, 1480):
        for block in (333, 4096):
            got = B.resampled(B.mono(blocks_of(spark, tracks, 700)), rate, block).toPandas()
            for name, x in tracks.items():
                own = np.concatenate(list(got[got["track_id"] == name].sort_values("block_no")["x"]))
                whole = wav.resample(((x[0] + x[1]) / 2)[None], 1000, rate)[0]
                assert np.array_equal(own, whole), (rate, block, name)


def test_blocks_with_what_is_around_them(spark):
    x = np.arange(2000, dtype=np.float32)
    for size, behind, ahead, block in ((300, 50, 20, 128), (64, 500, 700, 100), (5000, 0, 0, 999)):
        rows = B.haloed(B.mono(blocks_of(spark, {"t": np.vstack([x, x])}, size)), behind, ahead, block=block).collect()
        assert sorted(r["block_no"] for r in rows) == list(range(-(-2000 // block)))
        for r in rows:
            a, b = max(0, r["block_no"] * block - behind), min(2000, (r["block_no"] + 1) * block + ahead)
            assert r["begin"] == a and r["x"] == x[a:b].tolist() and r["n"] == 2000


def test_models_that_do_not_fit_are_refused_before_anything_runs(spark):
    wants = {"samples": (2400,), "token": ()}
    gives = {"scores": (M.DURATION.stop,)}
    load = lambda: 1 / 0
    assert require(load, wants, gives) is load and require(Model(load, {"samples": (None,), "token": ()}, gives), wants, gives) is load
    for inputs, outputs, said in (
        ({"samples": (2400,)}, gives, "no input 'token'"),
        (wants, {}, "no output 'scores'"),
        (wants | {"mask": (1,)}, gives, "asks for an input 'mask'"),
        (wants | {"samples": (2401,)}, gives, "samples"),
        (wants | {"samples": (1, 2400)}, gives, "samples"),
    ):
        with pytest.raises(ValueError, match=said):
            transcribe(blocks_of(spark, songs(), 1000), Model(load, inputs, outputs), RATE, LENGTH, OVERLAP, LOOKAHEAD)


def test_decoders_are_closed_when_they_fail():
    class Bad(Ear):
        def open(self, context):
            self.last = Decoder(context, None)
            self.last.closed = False
            self.last.close = lambda: setattr(self.last, "closed", True)
            return self.last

    ear = Bad()
    with pytest.raises(RuntimeError), session(ear, np.zeros(int(LENGTH * RATE), np.float32)):
        raise RuntimeError
    assert ear.last.closed


def test_a_prefix_that_leaves_no_room_is_an_error(spark):
    with pytest.raises(Exception, match="fill the decoder's context"):
        transcribe(blocks_of(spark, songs(), 4096), lambda: Ear(), RATE, LENGTH, OVERLAP, LOOKAHEAD, most=150, block=512)
