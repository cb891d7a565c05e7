import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import onsets as O
from tidemark.operators import signal as S
from tidemark.plans import stems
from tidemark.sources import wav

RATE = 44_100


def noise(n, amount=0.5, seed=1):
    return np.random.default_rng(seed).uniform(-amount, amount, n)


def burst(at, amount=0.8, decay=0.05, seconds=0.25):
    t = np.arange(int(seconds * RATE)) / RATE
    return int(at * RATE), amount * np.exp(-t / decay) * noise(len(t), 1.0, int(at * 1000) + 3)


def kick(at, amount=1.0):
    t = np.arange(int(0.25 * RATE)) / RATE
    x = np.sin(2 * np.pi * np.cumsum(45 + 75 * np.exp(-t / 0.03)) / RATE) * np.exp(-t / 0.08)
    x[:88] += noise(88, 0.3, 5)
    return int(at * RATE), amount * x


def snare(at, amount=1.0):
    t = np.arange(int(0.2 * RATE)) / RATE
    return int(at * RATE), amount * (0.6 * np.exp(-t / 0.05) * noise(len(t), 1.0, 7) + 0.4 * np.exp(-t / 0.03) * np.sin(2 * np.pi * 190 * t))


def hat(at, amount=1.0):
    t = np.arange(int(0.06 * RATE)) / RATE
    return int(at * RATE), amount * np.exp(-t / 0.012) * np.diff(noise(len(t) + 1, 1.0, 9)) / 2


def song(seconds, parts):
    x = noise(int(seconds * RATE), 1e-4, 2)
    for at, sound in parts:
        end = min(len(x), at + len(sound))
        x[at:end] += sound[: end - at]
    return x


def groove(bars, bpm):
    beat = 60 / bpm
    parts = []
    for b in range(bars * 4):
        parts += [kick(b * beat, 1.0 if b % 4 == 0 else 0.5)] if b % 2 == 0 else [snare(b * beat)]
        parts.append(hat((b + 0.5) * beat, 0.5))
    return song(bars * 4 * beat + 1, parts)


def blocks_of(spark, tracks, size=wav.BLOCK):
    rows = [(name, RATE, k, at, x[at : at + size].astype(np.float32)) for name, x in tracks.items() for k, at in enumerate(range(0, len(x), size))]
    columns = [[r[i] for r in rows] for i in (0, 1, 2, 3, 4, 4)]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.float32())] * 2]
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], wav.AUDIO_BLOCK.names))


def grid_of(spark, x, bpm=None):
    found = stems.grids(blocks_of(spark, {"s": x}), bpm).collect()
    return (found[0]["bpm"], found[0]["downbeats"]) if found else None


def hits_of(spark, x, at=None, size=wav.BLOCK):
    given = None if at is None else spark.createDataFrame([("s", a) for a in at], "track_id string, attack long")
    blocks = blocks_of(spark, {"s": x}, size)
    return [(r["attack"], r["start"], r["end"]) for r in stems.hits(blocks, given, size).orderBy("attack").collect()]


def test_onsets_of_bursts():
    at = (0.2, 0.55, 0.8, 1.1, 1.6)
    found = O.onsets(song(2, [burst(t) for t in at]), RATE)
    assert len(found) == 5 and all(abs(f - t * RATE) <= 88 for f, t in zip(found, at, strict=True))


def test_silence_tone_and_flam():
    assert O.onsets(np.zeros(RATE), RATE) == []
    tone = np.zeros(int(1.2 * RATE))
    tone[int(0.2 * RATE) : RATE] = 0.5 * np.sin(2 * np.pi * 440 * np.arange(int(0.8 * RATE)) / RATE)
    assert len(O.onsets(tone, RATE)) >= 1
    assert len(O.onsets(song(1, [burst(0.3), burst(0.325)]), RATE)) == 1
    assert len(O.onsets(song(1.5, [burst(0.3), burst(0.9, 0.004)]), RATE)) == 1


def test_hits_end_before_silence(spark):
    x = song(2, [burst(0.2), burst(0.6)])
    found = hits_of(spark, x)
    assert [a for a, _, _ in found] == O.onsets(x, RATE) and all(s == a - 132 < e <= s + 132 + 2 * RATE for a, s, e in found)


def test_tempo_and_bar_lines(spark):
    found = grid_of(spark, groove(16, 128))
    assert found is not None and abs(found[0] - 128) < 0.5 and len(found[1]) >= 14
    bar = 4 * 60 / 128 * RATE
    assert all(min(p % bar, bar - p % bar) <= 441 for p in found[1])
    assert grid_of(spark, np.zeros(RATE * 10)) is None


def test_period_prefers_the_faster_octave():
    fps = RATE / S.HOP
    step = 60 * fps / 170
    x = np.zeros(4000)
    for k in range(int(4000 / step)):
        x[int(k * step)] = 1.0 if k % 2 == 0 else 0.8
    assert abs(S.beat_period(S.smoothed(x, 2), fps) - step) < 0.5


def test_kit_finds_three_sounds(spark):
    rng, parts = np.random.default_rng(5), []
    for step in range(8 * 16):
        at, v = 0.25 + step / 8, rng.uniform(0.5, 1)
        if step % 8 == 0:
            parts.append(kick(at, 0.9 * v))
        elif step % 8 == 4:
            parts.append(snare(at, 0.8 * v))
        elif step % 4 == 2:
            parts.append(hat(at, 0.8 * v))
    x = song(17, parts)
    pieces = stems.kits(blocks_of(spark, {"s": x, "silent": np.zeros(RATE)})).orderBy("name").collect()
    assert [(p["track_id"], p["name"]) for p in pieces] == [("s", "01"), ("s", "02"), ("s", "03")]
    # hats come most often, and each piece begins just before an attack of its sound
    places = {round((p["start"] + 132) / RATE * 8) - 2 for p in pieces}
    assert {k % 8 for k in places} in ({0, 4, 2}, {0, 4, 6}) and round((pieces[0]["start"] + 132) / RATE * 8) % 4 == 0
    few = song(2, [kick(0.3), kick(0.8), hat(1.2), hat(1.6)])
    assert stems.kits(blocks_of(spark, {"s": few})).count() == 2


def test_loops_keep_what_is_new(spark):
    bar = [kick(0), hat(0.25), snare(0.5), hat(0.75), kick(1), hat(1.25), snare(1.5), hat(1.75)]
    sparse = [hat(t / 4) for t in range(8)]
    parts = [(at + b * 2 * RATE, x) for b in range(6) for at, x in bar] + [(at + b * 2 * RATE, x) for b in (6, 7) for at, x in sparse]
    x = song(20, parts)
    x[16 * RATE :] = 0
    grid = spark.createDataFrame([("s", 120.0, [b * 2 * RATE for b in range(11)])], "track_id string, bpm double, downbeats array<long>")
    found = stems.loops(blocks_of(spark, {"s": x}), grid, 2).orderBy("start").collect()
    assert [(p["folder"], p["name"], p["start"], p["end"]) for p in found] == [("loops_120bpm", "bar001", 0, 176_400), ("loops_120bpm", "bar007", 529_200, 705_600)]


@pytest.mark.parametrize("size", [1024, 30_000])
def test_attacks_and_hits_do_not_depend_on_blocks(spark, size):
    rng = np.random.default_rng(size)
    parts, t = [], 0.02
    while t < 3.5:
        parts.append([kick, snare, hat, burst][rng.integers(4)](t, rng.uniform(0.05, 1)))
        t += rng.choice([0.02, 0.055, 0.12, 0.4])
    x = song(4, parts).astype(np.float32).astype(np.float64)
    tracks = {"a": x, "b": x[: 4 * size], "c": x[: 4 * 256 * 40], "d": x[:3], "e": x[RATE : 3 * RATE]}
    got = stems.attacks(blocks_of(spark, tracks, size), size).toPandas()
    for name, own in tracks.items():
        assert sorted(got["attack"][got["track_id"] == name]) == O.onsets(own, RATE), name
    assert len(O.onsets(x, RATE)) > 10
    assert hits_of(spark, x, size=size) == hits_of(spark, x)


def test_attacks_equal_one_look_at_a_time():
    """Frame after frame and sample after sample, on a song with flams, soft sounds and a sound in its first samples."""
    x = song(2.5, [(0, burst(0)[1]), burst(0.31, 0.9), burst(0.33, 0.9), burst(0.7, 0.01), kick(0.9), hat(0.96, 0.2), snare(1.3), burst(2.4)])
    flux = S.spectral_flux(x, [range(S.FRAME // 2)])[0]
    flux, kept, loudest = flux / flux.max(), [], np.abs(x).max()
    for t, v in enumerate(flux):
        near = flux[max(0, t - 5) : t + 3]
        wide = flux[max(0, t - 17) : t + 13]
        if not (v > 0.07 and v >= near.max() and v >= wide.mean() + 0.07):
            continue
        low, high = max(0, t * 256 - 768), min(len(x), t * 256 + 768)
        base = max(0, low - 256)
        peaks = [np.abs(x[a : min(high, a + 64)]).max() for a in range(base, high, 64)]
        jumps = {b: peaks[b] / max([1e-4, *peaks[max(0, b - 4) : b]]) for b in range((low - base) // 64, len(peaks))}
        b = min(jumps, key=lambda k: (-jumps[k], k))
        at = next(i for i in range(base + 64 * b, len(x)) if abs(x[i]) >= peaks[b] / 10)
        before, behind = x[max(0, at - 441) : at], x[at : at + 441]
        rising = at == 0 or (behind**2).mean() ** 0.5 > 1.2 * (before**2).mean() ** 0.5
        if np.abs(x[at : at + 2205]).max() >= 0.01 * loudest and rising and (not kept or at - kept[-1] >= 2205):
            kept.append(at)
    assert O.onsets(x, RATE) == kept and len(kept) >= 5


def test_stft_round_trip():
    t = np.arange(RATE) / RATE
    x = sum(np.sin(2 * np.pi * f * t) for f in (55, 1234.5, 9876))
    assert np.abs(S.istft(S.stft(x), len(x)) - x)[5000:-5000].max() < 1e-4
    spectrum = np.abs(S.stft(np.sin(2 * np.pi * 100 / 4096 * np.arange(40_960))))
    assert spectrum[:, 20].argmax() == 100 and abs(spectrum[100, 20] - 16) < 0.01


@pytest.mark.parametrize("frame, hop", [(2048, 441), (2048, 512), (64, 13), (4096, 1024)])
def test_frames_of_any_hop_give_the_signal_back(frame, hop):
    x = noise(20 * hop, 1.0, hop)
    frames = S.framed(x, frame, hop)
    assert frames.shape == (20 + 1, frame)
    padded = np.pad(x, frame // 2, mode="reflect")
    assert all((frames[t] == padded[t * hop : t * hop + frame]).all() for t in range(21))
    # a model that gives windowed frames back as they were
    again = S.overlap_added(frames * S.periodic_hann(frame) ** 2, hop, len(x))
    assert np.abs(again - x).max() < 1e-9
    assert np.abs(S.istft(S.stft(x, frame, hop), len(x), frame, hop) - x).max() < 1e-9
    short = noise(5)
    assert (S.framed(short, 64, 13)[0] == short[S.mirrored(np.arange(-32, 32), 5)]).all()


def test_frames_led_by_less_than_half():
    x = noise(10_000, 1.0, 3)
    spectrum = S.stft(x, 4096, 1024, 1536, 10)
    assert spectrum.shape == (2049, 10)
    assert np.abs(S.istft(spectrum, len(x), 4096, 1024, 1536, 2) - x)[2048:-4096].max() < 1e-9


def test_separators_over_frames_and_spectra(spark):
    from tidemark.plans import spectral
    from tidemark.plans.models import Model

    x = noise(30_000, 0.5, 4)
    blocks = blocks_of(spark, {"s": x}, 4096)
    keep = lambda: lambda frames: frames * S.periodic_hann(2048) ** 2 * 0.5
    half = stems.separate(blocks, spectral.from_frames(keep, 12_000, 2048, 441), 12_000, 4096)
    assert np.abs(wav.joined(half.toPandas())[0] - x / 2).max() < 1e-5
    wrong = Model(keep, {"frames": (2, 28, 2048)}, {"recon": (2, 28, 2048)})
    assert spectral.from_frames(wrong, 12_000, 2048, 441) is not None
    with pytest.raises(ValueError, match="frames"):
        spectral.from_frames(wrong, 12_000, 2048, 512)
    load = lambda: lambda mix, spec: (np.stack([mix * 0.25, mix * 0]), np.stack([spec * 0.5, spec]))
    core = stems.Core(spectral.from_spectra(load, 12_000, 2), ("drums", "other"), 12_000)
    heard = stems.separate_all(blocks, core, 4096).toPandas()
    own = {name: wav.joined(rows)[0] for name, rows in heard.groupby("stem")}
    # the highest bin is left out, and a segment's first and last frames count silent ones among the windows: noise comes back nearly
    assert np.abs(own["drums"] - 0.75 * x)[3000:-3000].max() < 0.02 and np.abs(own["other"] - x)[3000:-3000].max() < 0.02


def test_display_of_stems_against_the_mix(spark):
    from pyspark.sql import functions as F

    from tidemark.plans.display import display

    x = song(1.5, [kick(0.2), hat(0.7)])
    filters = S.mel_filters(RATE, 128, 4096)
    assert filters.shape == (128, 2049) and (filters.max(axis=1) > 0).all()
    for size in (3000, wav.BLOCK):
        blocks = blocks_of(spark, {"s": x}, size)
        both = blocks.withColumn("stem", F.lit("mix")).union(blocks.withColumn("stem", F.lit("drums")).withColumn("left", F.transform("left", lambda v: v / 10)).withColumn("right", F.transform("right", lambda v: v / 10)))
        got = display(both, block=size).orderBy("frame_no").toPandas()
        padded = np.pad(x.astype(np.float32).astype(np.float64), 2048)
        power = np.stack([np.abs(np.fft.rfft(padded[t * 1024 : t * 1024 + 4096] * S.periodic_hann(4096))) ** 2 @ filters.T for t in range(len(x) // 1024 + 1)])
        want = np.maximum(10 * np.log10(np.maximum(power / power.max(), 1e-12)), -80)
        mix, drums = (np.stack(got[got["stem"] == name]["levels"].to_list()) for name in ("mix", "drums"))
        assert mix.shape == want.shape and np.abs(mix - want).max() < 0.01 and mix.max() == 0
        assert np.abs(drums - np.maximum(want - 20, -80))[want > -55].max() < 0.05


def test_levels():
    edges = S.mel_edges(RATE)
    assert len(edges) == 25 and all(b > a for a, b in zip(edges[:-1], edges[1:], strict=True))
    assert S.levelled(np.array([0.0, -10.0, -100.0])) == pytest.approx([70 / 3, 40 / 3, -110 / 3])


def test_dense_sixteenths_are_all_found_and_their_hits_abut(spark):
    step = 60 / 170 / 4
    at = [0.1 + k * step for k in range(int(9.5 / step))]
    x = song(10, [burst(t, 0.8, 0.02, 0.08) for t in at])
    found = O.onsets(x, RATE)
    assert len(found) == len(at) and all(abs(f - t * RATE) <= 88 for f, t in zip(found, at, strict=True))
    spans = hits_of(spark, x, found)
    assert all(a[2] == b[1] for a, b in zip(spans[:-1], spans[1:], strict=True))


def test_long_tones_end_after_two_seconds(spark):
    x = 0.5 * np.sin(2 * np.pi * 440 * np.arange(5 * RATE) / RATE)
    assert hits_of(spark, x, [44_100]) == [(44_100, 43_968, 132_300)]
    spans = hits_of(spark, song(2, [burst(0.2, 0.8, 0.02), burst(0.6, 0.8, 0.02)]))
    assert len(spans) == 2 and all(0.3 < (e - s) / RATE + t < 0.9 for (_, s, e), t in zip(spans, (0.2, 0.6), strict=True))


def test_given_tempo_and_drift(spark):
    found = grid_of(spark, groove(16, 128), 64)
    assert found is not None and abs(found[0] - 64) < 0.5
    gaps = np.diff(found[1])
    assert np.abs(gaps / (8 * 60 / 128 * RATE) - 1).max() < 0.02
    at, parts, bars = 0.0, [], []
    for b in range(14 * 4):
        if b % 4 == 0:
            bars.append(at * RATE)
        parts += [kick(at, 1.0 if b % 4 == 0 else 0.5)] if b % 2 == 0 else [snare(at)]
        step = 60 / (120 + 8 * b / 56)
        parts.append(hat(at + step / 2, 0.5))
        at += step
    found = grid_of(spark, song(at + 1, parts))
    assert found is not None and len(found[1]) >= 12
    assert all(min(abs(p - b) for b in bars) <= 441 for p in found[1])
