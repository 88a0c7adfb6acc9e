from datetime import datetime, timedelta

from sextant.streaming.usage import refresh, session_stream, sessions


def log(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, t), (1, t + timedelta(seconds=10)), (1, t + timedelta(seconds=100)), (2, t), (2, t + timedelta(seconds=45))]
    return spark.createDataFrame(rows, "user_id long, ts timestamp")


def test_sessions(spark):
    got = {(r.user_id, r.session, r.n_events) for r in sessions(log(spark), 30).collect()}
    assert got == {(1, 1, 2), (1, 2, 1), (2, 1, 1), (2, 2, 1)}


def test_stream_and_refresh(spark, tmp_path):
    log(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = session_stream(stream, "30 seconds", "1 minute").writeStream.format("memory").queryName("s").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.user_id, r.n_events) for r in spark.table("s").collect()) == [(1, 1), (1, 2), (2, 1), (2, 1)]
    seen = []
    refresh(stream, lambda df, batch: seen.append((batch, df.count())), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert seen == [(0, 5)]
