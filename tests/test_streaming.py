from tests.conftest import SF
from tidemark.operators import series
from tidemark.streaming.progress import watch
from tidemark.streaming.windows import hopping_totals, min_gap_stream


def run(stream, name, mode, folder):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{folder}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"file://{tmp_path}/in")
    args = ("ts", ["event_type"], "value", "6 hours", "3 hours", "60 days")
    log = watch(spark)
    got = run(hopping_totals(stream, *args), "totals", "complete", tmp_path / "c1")
    spark.streams.removeListener(log)
    assert any(stage == "started" for _, stage, *_ in log.rows)
    norm = lambda df: sorted((r["event_type"], r["start"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert norm(got) == norm(hopping_totals(batch, *args))


def test_min_gap_state(spark, tmp_path):
    rows = spark.createDataFrame([("a", t) for t in (0, 30, 60, 100, 140)], "k string, t long")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    got = run(min_gap_stream(stream, "k", "t", 50), "gaps", "append", tmp_path / "c2")
    assert sorted(r["t"] for r in got.collect()) == sorted(r["t"] for r in series.min_gap(rows, ["k"], "t", 50).collect())
