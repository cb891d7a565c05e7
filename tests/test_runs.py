"""Runs over folders: all files or none, numbered names, events, cancellation; the WAV data source and dither in blocks."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import runs, songs, stems
from tidemark.sources import wav, wav_source


def noise(n, seed=1, channels=2):
    return np.random.default_rng(seed).uniform(-0.9, 0.9, (channels, n)).astype(np.float32)


def tree(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*")}


# dither


def test_noise_of_blocks_is_that_of_the_file():
    state, drawn = np.array([wav.Dither("x", 50).seed], dtype=np.uint64), []
    for _ in range(200):
        state = wav.Dither.step(state)
        drawn.append(int(state[0] >> np.uint64(40)) / (1 << 24))
    whole = [wav.Dither("x", 50).noise(c, 0, 50) for c in (0, 1)]
    assert np.array_equal(np.concatenate(whole), np.array(drawn[::2]) + np.array(drawn[1::2]) - 1)
    for a, n in ((0, 7), (13, 1), (30, 20)):
        assert np.array_equal(wav.Dither("x", 50).noise(1, a, n), whole[1][a : a + n])
    assert not np.array_equal(wav.Dither("y", 50).noise(0, 0, 50), whole[0])
    many = wav.Dither("z", 10**7).noise(1, 9 * 10**6, 100_000)
    assert abs(many.mean()) < 0.01 and abs(many.var() - 1 / 6) < 0.01 and np.abs(many).max() < 1


# data source


@pytest.fixture(scope="module")
def session(spark):
    spark.dataSource.register(wav_source.WavSource)
    return spark


def rows_of(df):
    return sorted((r["track_id"], r["rate"], r["block_no"], r["start_sample"], r["left"], r["right"]) for r in df.collect())


def test_a_long_file_is_read_in_several_tasks(session, tmp_path):
    (tmp_path / "long.wav").write_bytes(wav.encode_wav(noise(50_001), 44_100))
    (tmp_path / "mono.wav").write_bytes(wav.encode_wav(noise(777, 2, 1), 22_050, 16, "mono"))
    (tmp_path / "none.wav").write_bytes(wav.encode_wav(noise(0), 8000))
    odd = wav.encode_wav(noise(10, 3), 8000)
    (tmp_path / "odd.wav").write_bytes(odd[:12] + b"junk\x03\x00\x00\x00abc\x00" + odd[12:])
    (tmp_path / "notes.txt").write_text("no sound")
    df = session.read.format("wav").option("block", 1000).option("blocks", 4).load(f"file://{tmp_path}")
    assert df.rdd.getNumPartitions() == 13 + 1 + 1 and df.where("track_id = 'long'").select(F.spark_partition_id()).distinct().count() == 13
    assert rows_of(df) == rows_of(wav.read_wav(session, f"file://{tmp_path}", block=1000))
    assert session.read.format("wav").load(f"file://{tmp_path}/odd.wav").count() == 1
    with pytest.raises(Exception, match="not a WAV file"):
        session.read.format("wav").load(f"file://{tmp_path}/notes.txt").count()


@pytest.mark.parametrize("bits", [32, 16])
def test_blocks_from_many_tasks_become_whole_files(session, tmp_path, bits):
    songs_ = {"a": noise(9000, 4), "b b": noise(1, 5), "c": noise(4096, 6)}
    (tmp_path / "in").mkdir()
    for name, x in songs_.items():
        (tmp_path / "in" / f"{name}.wav").write_bytes(wav.encode_wav(x, 44_100))
    blocks = session.read.format("wav").option("block", 512).load(f"file://{tmp_path}/in").repartition(9)
    (tmp_path / "out").mkdir()
    wav_source.write(blocks, f"file://{tmp_path}/out", bits)
    assert tree(tmp_path / "out") == {f"{name}.wav" for name in songs_}
    for name, x in songs_.items():
        assert (tmp_path / "out" / f"{name}.wav").read_bytes() == wav.encode_wav(x, 44_100, bits, name)
    with pytest.raises(Exception, match="FileExistsError|out/"):
        wav_source.write(blocks, f"file://{tmp_path}/out", bits)
    wav_source.write(blocks.where("track_id = 'a'"), f"file://{tmp_path}/out", bits, overwrite=True)
    assert tree(tmp_path / "out") == {f"{name}.wav" for name in songs_}


def test_an_aborted_write_leaves_nothing(session, tmp_path):
    (tmp_path / "out").mkdir()
    one = [0.5] * 100
    rows = [("good", 8000, k, 100 * k, one, one) for k in range(5)] + [("holes", 8000, k, 100 * k, one, one) for k in (0, 1, 3)]
    with pytest.raises(Exception, match="a block begins at 300, not at 200"):
        wav_source.write(session.createDataFrame(rows, wav.AUDIO_BLOCK), f"file://{tmp_path}/out")
    assert tree(tmp_path / "out") == set()


# runs


def silence():
    return lambda a: a * 0


def test_a_run_gives_all_files_and_numbers_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("one", "two"):
        (tmp_path / "in" / f"{name}.wav").write_bytes(wav.encode_wav(noise(5000), 44_100))
    go = lambda: runs.split_folder(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", lambda: lambda a: a / 2, silence, {"drums": silence}, chunk=4000)
    said = list(go().events())
    assert [e.stage for e in said if e.stage != "done"] == ["read", "vocals", "horns", "drums", "write", "write"]
    assert sorted(e.folder for e in said if e.stage == "done") == [f"file://{tmp_path}/out/{name}" for name in ("one", "two")]
    own = {"mix.wav", "vocals.wav", "instrumental.wav", "horns.wav", "drums.wav"}
    assert tree(tmp_path / "out") == {"one", "two", *(f"{name}/{f}" for name in ("one", "two") for f in own)}
    rate, half = wav.decode_wav((tmp_path / "out" / "one" / "instrumental.wav").read_bytes())
    assert rate == 44_100 and np.abs(half - noise(5000) / 2).max() < 1e-6
    go().wait()
    assert {p for p in tree(tmp_path / "out") if "/" not in p} == {"one", "two", "one 2", "two 2"}


def broken():
    def fail(audio):
        raise ArithmeticError("the model broke")

    return fail


def test_a_failing_separator_leaves_no_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.wav").write_bytes(wav.encode_wav(noise(5000), 44_100))
    (tmp_path / "out").mkdir()
    run = runs.split_folder(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", silence, silence, {"drums": broken}, chunk=4000)
    with pytest.raises(Exception, match="the model broke"):
        list(run.events())
    assert tree(tmp_path / "out") == set()
    # and if it fails while files are being written
    mix = wav.read_wav(spark, f"file://{tmp_path}/in")
    with pytest.raises(Exception, match="the model broke"):
        songs.write(songs.split(mix, silence, silence, {"drums": broken}, chunk=4000), f"file://{tmp_path}/out")
    assert tree(tmp_path / "out") == set()
    with pytest.raises(ValueError, match="transcriber"):
        runs.split_folder(spark, "", "", silence, silence, {}, stems.Options(transcribe=True))


def slow():
    def hear(audio):
        time.sleep(60)
        return audio

    return hear


def test_a_cancelled_run_ends_and_leaves_no_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.wav").write_bytes(wav.encode_wav(noise(5000), 44_100))
    run, began = runs.split_folder(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", slow, silence, {"drums": silence}, chunk=4000), time.time()
    events = run.events()
    while next(events).stage != "vocals":
        pass
    threading.Timer(3, run.cancel).start()
    with pytest.raises(runs.Cancelled):
        list(events)
    assert time.time() - began < 45 and not (tmp_path / "out").exists()
    assert spark.range(10).count() == 10  # other jobs are left alone
