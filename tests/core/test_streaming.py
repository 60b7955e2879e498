import datetime as dt

from rookery.streaming import events

SCHEMA = "event_id long, ts timestamp, key long, gone string"


def folder(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return f"file://{tmp_path}/in/*"


def test_windows_count_each_event_once(spark, tmp_path):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    path = folder(spark, tmp_path, [[(1, at(1, 1), 1, "ok"), (2, at(1, 2), 1, "ok"), (2, at(1, 2), 1, "ok"), (3, at(9, 1), 1, "ok")]])
    q = events.counts_by_window(events.source(spark, path, SCHEMA), "ts", "key").writeStream.outputMode("append").format("memory").queryName("w").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.start.day, r.n) for r in spark.table("w").collect()] == [(1, 2)]


def test_boards_die_over_batches(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    path = folder(spark, tmp_path, [[(1, t, 7, "miss"), (2, t, 7, "miss"), (3, t, 8, "miss")], [(4, t, 7, "miss"), (5, t, 8, "ok")], [(6, t, 7, "other")]])
    q = events.dead_boards(events.source(spark, path, SCHEMA)).writeStream.outputMode("update").foreachBatch(events.upsert_sink(f"file://{tmp_path}/out", "key")).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.key: r.misses for r in sorted(spark.read.parquet(f"file://{tmp_path}/out").collect(), key=lambda r: r.batch)}
    assert last == {7: 3, 8: 0}
