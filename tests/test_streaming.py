"""Streaming runs give what batch runs give."""

from __future__ import annotations

from rowloom.operators import library  # noqa: F401
from rowloom.streaming.stateful import run_stateful, sample_range, sample_stride, windowed_counts


def _run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_rows_out_of_order_wait(spark, tmp_path):
    for k, ids in enumerate([[0, 2, 4], [3, 1], [5]]):
        spark.createDataFrame([(0, i, float(i)) for i in ids], "stream_id long, row_id long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("stream_id long, row_id long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _run(spark, run_stateful(source, "MovingAverage", "v", "double", alpha=0.5), "average").orderBy("row_id").collect()
    want, state = [], None
    for i in range(6):
        state = float(i) if state is None else 0.5 * state + 0.5 * i
        want.append(state)
    assert [r["value"] for r in got] == want


def test_sampling_and_windows(spark, tmp_path):
    spark.range(20).selectExpr("0L AS stream_id", "id AS row_id", "timestamp_seconds(id * 60) AS ts", "'k' AS key").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("stream_id long, row_id long, ts timestamp, key string").parquet(str(tmp_path / "in"))
    assert sorted(r["row_id"] for r in _run(spark, sample_stride(source, 3), "strided").collect()) == list(range(7))
    assert sorted(r["row_id"] for r in _run(spark, sample_range(source, 5, 9), "ranged").collect()) == [0, 1, 2, 3]
    counts = _run(spark, windowed_counts(source, "ts", "key", "5 minutes", "1 minute"), "counted", "complete")
    assert sorted(r["count"] for r in counts.collect()) == [5, 5, 5, 5]
