import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.functions import text as X
from tidemark.plans import stems
from tidemark.sources import lab, midi, wav


def test_wav_round_trip_dither_and_resampling():
    x = np.random.default_rng(1).uniform(-1, 1, (2, 1000)).astype(np.float32)
    rate, again = wav.decode_wav(wav.encode_wav(x, 44_100))
    assert rate == 44_100 and np.array_equal(x, again)
    _, low = wav.decode_wav(wav.encode_wav(x, 48_000, 16, "a"))
    assert np.abs(low - x).max() <= 1.5 / 32767 + 1 / 32768
    quarter = np.full((1, 20_000), 0.25 / 32767)
    _, dithered = wav.decode_wav(wav.encode_wav(quarter, 48_000, 16, "b"))
    assert abs(dithered.mean() * 32768 - 0.25) < 0.05
    t = np.arange(4410) / 44_100
    tone = np.sin(2 * np.pi * 440 * t)[None].astype(np.float32)
    up = wav.resample(tone, 44_100, 48_000)
    want = np.sin(2 * np.pi * 440 * np.arange(up.shape[1]) / 48_000)
    assert up.shape[1] == 4800 and np.abs(up[0] - want)[200:-200].max() < 1e-2
    with pytest.raises(ValueError):
        wav.decode_wav(b"nothing of the kind")


def test_read_blocks_and_separate(spark, tmp_path):
    x = np.random.default_rng(2).uniform(-1, 1, (2, 50_000)).astype(np.float32)
    (tmp_path / "one.wav").write_bytes(wav.encode_wav(x, 44_100))
    (tmp_path / "two.wav").write_bytes(wav.encode_wav(x[:1, :777], 44_100))
    blocks = wav.read_wav(spark, f"file://{tmp_path}", block=4096).cache()
    assert blocks.where("track_id = 'one'").count() == 13
    for many in (blocks, blocks.repartition(7)):
        same = stems.separate(many, lambda: lambda a: a, chunk=12_000, block=4096).where("track_id = 'one'").toPandas()
        assert np.abs(wav.joined(same) - x).max() < 1e-6
    rest = stems.subtract(blocks, blocks).toPandas()
    assert all(np.abs(np.concatenate(list(rest[c]))).max() == 0 for c in ("left", "right"))
    part = blocks.withColumn("stem", F.lit("drums"))
    half = part.withColumn("left", F.transform("left", lambda v: v / 2)).withColumn("right", F.transform("right", lambda v: v / 2))
    scores = stems.score_stems(part, half)
    assert scores.first()["sdr"] == pytest.approx(10 * np.log10(4), abs=1e-4)
    assert stems.mean_scores(scores).where("stem = 'average'").count() == 1
    back = {r["track_id"]: bytes(r["content"]) for r in wav.encoded(blocks).collect()}
    assert np.array_equal(wav.decode_wav(back["one"])[1], x)
    device = {r["track_id"]: wav.decode_wav(bytes(r["content"]))[1].shape for r in stems.device_files(blocks).collect()}
    assert device["one"] == (2, 54_422) and device["two"][0] == 1
    with pytest.raises(Exception, match="the separator gave"):
        stems.separate(blocks, lambda: lambda a: a[:, 1:], chunk=12_000, block=4096).count()


def test_a_sampler_gets_pieces_at_the_times_of_its_copy(spark, tmp_path):
    x = np.random.default_rng(5).uniform(-0.5, 0.5, (2, 44_100)).astype(np.float32)
    (tmp_path / "a.wav").write_bytes(wav.encode_wav(x, 44_100))
    (tmp_path / "b.wav").write_bytes(wav.encode_wav(np.vstack([x[0], x[0] + 5e-5]), 44_100))
    blocks = wav.read_wav(spark, f"file://{tmp_path}", block=4096)
    rows = [(t, "kit", n, a, b, 0.003, 0.005) for t in "ab" for n, a, b in (("01", 4410, 22_050), ("02", 22_050, 44_100))]
    pieces = spark.createDataFrame([*rows, ("silent", "kit", "01", 0, 10, 0.0, 0.0)], stems.PIECES)
    got = {(r["track_id"], r["name"]): wav.decode_wav(bytes(r["content"])) for r in stems.device_files(blocks, pieces).collect()}
    assert {k: v[1].shape for k, v in got.items()} == {
        (t, n): (2 if t == "a" else 1, size) for t in "ab" for n, size in (("", 48_000), ("kit/01.wav", 19_200), ("kit/02.wav", 24_000))
    }
    whole, first = got["a", ""][1], got["a", "kit/01.wav"][1]
    assert got["a", ""][0] == 48_000 and first[0, 0] == pytest.approx(0, abs=1e-4)
    assert np.abs(first[:, 200:18_900] - whole[:, 5000:23_700]).max() < 2e-4  # two ditherings apart
    assert stems.device_files(blocks).count() == 2


@pytest.mark.parametrize("segment", [1000, 1001])
def test_a_core_gives_all_its_sources(spark, tmp_path, segment):
    ramp = np.linspace(0.5, 1, segment, dtype=np.float32)  # hears places apart, so a segment in the wrong place shows
    core = stems.Core(lambda: lambda a: np.stack([a * ramp, a - a * ramp, a * 0 + 1]), ("drums", "other", "vocals"), segment)
    rng = np.random.default_rng(6)
    songs = {name: rng.uniform(-1, 1, (2, n)).astype(np.float32) for name, n in (("long", 3333), ("exact", 2 * segment), ("short", 77), ("one", 1))}
    for name, x in songs.items():
        (tmp_path / f"{name}.wav").write_bytes(wav.encode_wav(x, 44_100))
    heard = stems.separate_all(wav.read_wav(spark, f"file://{tmp_path}", block=256), core, 256).toPandas()
    for name, x in songs.items():
        n = x.shape[1]
        sums, total = np.zeros((2, n)), np.zeros(n)
        for offset in range(0, n, segment * 3 // 4):
            count = min(segment, n - offset)
            trim = (segment - count) // 2
            for k in range(count):
                w = (k + 1 if k < segment // 2 else segment - k) / (segment // 2)
                sums[:, offset + k] += w * x[:, offset + k] * ramp[trim + k]
                total[offset + k] += w
        own = {stem: wav.joined(rows) for stem, rows in heard[heard["track_id"] == name].groupby("stem")}
        assert np.abs(own["drums"] - sums / total).max() < 1e-5
        assert np.abs(own["drums"] + own["other"] - x).max() < 1e-5
        assert own["vocals"].shape == x.shape and np.abs(own["vocals"] - 1).max() < 1e-5


def test_pieces_are_cut_with_ramps(spark):
    one = [1.0] * 6000
    blocks = spark.createDataFrame([("s", 44_100, 0, 0, one, one)], wav.AUDIO_BLOCK)
    pieces = spark.createDataFrame([("s", "kit", "01", 1000, 3000, 0.003, 0.005), ("s", "kit", "02", 0, 3000, 0.003, 0.005)], stems.PIECES)
    cut = {r["name"]: wav.decode_wav(bytes(r["content"]))[1][0] for r in stems.cut_pieces(blocks, pieces).collect()}
    first = cut["kit/01.wav"]
    assert first[0] == 0 and first[66] == pytest.approx(0.5) and first[132] == 1 and first[-1] == 0
    assert cut["kit/02.wav"][0] == 1
    wide = pieces.withColumn("start", F.lit(4410)).withColumn("end", F.lit(44_100)).withColumn("frames", F.lit(47_999))
    assert stems.scaled(wide, 48 / 44.1, "frames").first()[3:5] == (4800, 47_999)


def test_options():
    stems.Options(kit=frozenset({"drums"}), loops=frozenset({"bass"}), bars=2, bpm=128)
    for bad in ({"kit": frozenset({"x"})}, {"loops": frozenset({"bass"}), "bars": 0}, {"loops": frozenset({"bass"}), "bpm": 10}, {"bpm": 100.0}, {"bars": 2}):
        with pytest.raises(ValueError):
            stems.Options(**bad)


def test_midi_bytes(spark):
    notes = spark.createDataFrame([("s", "Vocal", 60, 0.5, 1.0, 100)], midi.NOTES)
    data = bytes(midi.midi_files(notes, ["Vocal"]).first()["content"])
    assert data[:14] == b"MThd\x00\x00\x00\x06\x00\x01\x00\x02\x03\xc0"
    assert data.endswith(midi.quantity(960) + b"\x90\x3c\x64" + midi.quantity(960) + b"\x80\x3c\x00" + b"\x00\xff\x2f\x00")


def test_lab_text_and_reading(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1.0, 2.5, "b"), ("s", 0.0, 1.0, "a")], "track_id string, start double, end double, label string")
    text = lab.lab_text(rows, ["track_id"], ["start"], ["start", "end", "label"]).first()["text"]
    assert text == "0.0\t1.0\ta\n1.0\t2.5\tb\n"
    (tmp_path / "key.lab").write_text(text)
    again = lab.read_lab(spark, f"file://{tmp_path}/key.lab", "key")
    assert [tuple(r) for r in lab.excerpt(again, "start", 1.0, 5.0).collect()] == [(0.0, 2.5, "b")]


def test_names_and_lines(spark):
    df = spark.createDataFrame([("Big Buck Bunny 60fps 4K - Official",), ("Café Live!",), ("...",)], "t string")
    assert [r[0] for r in df.select(X.title_prefix(F.col("t"))).collect()] == ["Big_Buck_Bunny_60fps", "Caf_Live", "song"]
    names = spark.createDataFrame([(1, "AC/DC: Live."), (2, "AC/DC: Live."), (3, " ... ")], "i int, t string").withColumn("n", X.clean_title(F.col("t")))
    assert [r["folder"] for r in X.unique_names(names, "n", ["i"]).orderBy("i").collect()] == ["AC-DC- Live", "AC-DC- Live 2", "untitled"]
    lines = spark.createDataFrame([("x-title\tSong",), ("x-file\t/tmp/s.wav",), ("x-progress\t50\t200",), ("x-progress\t50\tNA",), ("[site] page",)], "l string")
    got = [r["p"] for r in lines.select(X.tool_line(F.col("l"), "x-").alias("p")).collect()]
    assert [None if p is None else (p["kind"], p["text"], p["fraction"]) for p in got] == [("title", "Song", None), ("file", "/tmp/s.wav", None), ("progress", None, 0.25), None, None]


def test_array_functions(spark):
    one = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    get = lambda c: one.select(c.alias("c")).first()["c"]
    assert get(A.reflect_pad(F.col("x"), 2, 2)) == [3, 2, 1, 2, 3, 2, 1]
    assert get(A.reflect_pad(F.col("x"), 4, 4)) == [1, 2, 3, 2, 1, 2, 3, 2, 1, 2, 3]
    assert get(A.centred_segment(F.col("x"), 1, 2, 4)) == [1, 2, 3, 0]
    assert get(A.split_steps(F.lit(600), 256, 260)) == [516, 516, 348]
    assert get(A.split_steps(F.lit(0), 256, 260)) == [260] and get(A.split_steps(F.lit(256), 256, 260)) == [516]
    assert get(A.levelled(F.array(F.lit(0.0), F.lit(-10.0), F.lit(-100.0)))) == pytest.approx([70 / 3, 40 / 3, -110 / 3])


def test_songs_from_mix_to_files(spark, tmp_path):
    from tests.test_signal import groove
    from tidemark.plans import songs

    x = groove(10, 120).astype(np.float32)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "My Song.wav").write_bytes(wav.encode_wav(np.vstack([x, x]), 44_100))
    mix = wav.read_wav(spark, f"file://{tmp_path}/in")
    options = stems.Options(kit=frozenset({"drums"}), loops=frozenset({"drums"}), bars=2)
    made = songs.split(mix, lambda: lambda a: a * 0, lambda: lambda a: a * 0, {"drums": lambda: lambda a: a}, options)
    assert abs(made.grid.first()["bpm"] - 120) < 0.5
    core = stems.Core(lambda: lambda a: np.stack([a, a * 0, a]), ("drums", "bass", "vocals"), 40_000)
    again = songs.split(mix, lambda: lambda a: a * 0, lambda: lambda a: a * 0, core)
    sizes = {r["stem"]: r["n"] for r in again.stems.groupBy("stem").agg(F.sum(F.size("left")).alias("n")).collect()}
    assert sizes == dict.fromkeys(("mix", "vocals", "instrumental", "horns", "drums", "bass"), len(x))
    songs.write(made, f"file://{tmp_path}/out", device=True)
    names = {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.wav")}
    assert {"My Song/drums.wav", "My Song/vocals.wav", "My Song/horns.wav", "My Song/device/My_Song_drums.wav"} <= names
    native = {n for n in names if "/drums_" in n}
    assert any("/drums_kit/drums_01" in n for n in native) and any("/drums_loops_120bpm/drums_bar001" in n for n in native)
    copies = {n for n in names if "/device/My_Song_drums_" in n}
    assert copies == {n.replace("/drums_", "/device/My_Song_drums_", 1).replace("/drums_", "/My_Song_drums_") for n in native}
    rate, again = wav.decode_wav((tmp_path / "out" / "My Song" / "drums.wav").read_bytes())
    assert rate == 44_100 and np.abs(again[0] - x).max() < 1e-5


def test_model_inventory(spark):
    from tidemark.sources import models

    own, extra = [("r", "1", "a", "x", 10), ("r", "1", "a", "y", 30)], [("r", "1", "b", "z", 60)]
    wanted = models.needed(spark, own, extra, True)
    assert wanted.count() == 3 and models.needed(spark, own, extra).count() == 2
    have = wanted.where("path = 'x'")
    assert [(r["path"], round(r["done"], 3)) for r in models.pending(wanted, have).orderBy("path").collect()] == [("y", 0.333), ("z", 1.0)]
