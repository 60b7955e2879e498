import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rookery.operators import checks, funds, migration, retention
from rookery.streaming import negative_cache, outbox

DAY = dt.timedelta(days=1)
NOW = dt.datetime(2026, 3, 1)


def now():
    return F.lit(str(NOW)).cast("timestamp")


def test_lists_of_funds(spark):
    cached = spark.createDataFrame([("fresh", "a", "A", NOW - DAY, NOW - DAY / 2), ("old", "a", "A", NOW - DAY, NOW - DAY), ("old", "gone", "G", NOW - 61 * DAY, NOW - DAY), ("old", "kept", "K", NOW - 59 * DAY, NOW - DAY), ("failed", "a", "A", NOW - 99 * DAY, NOW - DAY)], "fund string, key string, name string, last_seen timestamp, fetched_at timestamp")
    listed = spark.createDataFrame([("fresh", "b", "B"), ("old", "a", None), ("old", "b", "B"), ("old", "b", "A"), ("old", None, "x"), ("new", "n", "N"), (None, "n", "N")], "fund string, key string, name string")
    got = {(r.fund, r.key): (r.name, r.last_seen, r.fetched_at) for r in funds.merged_lists(cached, listed, now()).collect()}
    assert got == {
        ("fresh", "a"): ("A", NOW - DAY, NOW - DAY / 2), ("old", "a"): ("A", NOW, NOW), ("old", "b"): ("B", NOW, NOW), ("old", "kept"): ("K", NOW - 59 * DAY, NOW), ("failed", "a"): ("A", NOW - 99 * DAY, NOW - DAY), ("new", "n"): ("N", NOW, NOW),
    }
    again = funds.merged_lists(spark.createDataFrame([(*k, *v) for k, v in got.items()], cached.schema), listed, now())
    assert {(r.fund, r.key) for r in again.collect()} == set(got)


def test_sites(spark):
    schema = f"site string, status string, checked_at timestamp, careers_url string, rejected {funds.REJECTED}"
    proof = lambda url, status, days: (url, status, None if days is None else NOW - days * DAY)
    cache = spark.createDataFrame([("found", "found", NOW - 40 * DAY, "https://B.example/x/", None), ("cut", "found", NOW - DAY, None, None), ("untouched", "none", NOW - 13 * DAY, None, None)], schema)
    results = spark.createDataFrame(
        [("found", "error", None, None, None), ("cut", "none", True, None, None), ("cutnew", "none", True, None, None), ("new", "none", False, None, [proof("https://A.example/", "404", 3), proof("https://a.example", "410", 2), proof("https://c.example", "500", 1), proof("https://d.example", "empty", 91), proof("https://e.example", "404", None), proof(None, "404", 1)]), (None, "none", None, None, None)],
        f"site string, status string, deadline boolean, careers_url string, rejected {funds.REJECTED}",
    )
    after = funds.resolved_sites(cache, results, now())
    got = {r.site: r for r in after.collect()}
    assert {s: (r.status, r.checked_at) for s, r in got.items()} == {"found": ("found", NOW - 28 * DAY), "cut": ("found", NOW - DAY), "untouched": ("none", NOW - 13 * DAY), "new": ("none", NOW)}
    assert [(r.careers_url, r.status, r.at) for r in got["new"].rejected] == [("https://a.example", "410", NOW - 2 * DAY), ("https://e.example", "404", NOW)]
    units = spark.createDataFrame([("fund:board:https://b.example/X", "failed", ["HTTP 404"]), ("fund:board:https://b.example/x", "failed", ["HTTP 500"]), ("other:https://b.example/x", "failed", ["HTTP 404"])], "key string, status string, errors array<string>")
    gone = {r.site: r for r in funds.retired(after, units, now()).collect()}
    assert gone["found"].status == "dead_link" and [x.status for x in gone["found"].rejected] == ["404"] and gone["cut"].status == "found" and len(gone) == 4
    assert {r.site for r in funds.due(funds.retired(after, units, now()), now()).collect()} == {"found"}
    assert {r.site for r in funds.due(after, F.lit(str(NOW + 2 * DAY)).cast("timestamp")).collect()} == {"untouched", "found"}


def test_gone_boards_are_forgotten_by_the_streams_clock(spark, tmp_path):
    t = lambda d, h=0: dt.datetime(2026, 1, 1, h) + d * DAY
    batches = [[("https://a.example/", "404", t(0)), ("https://b.example", "404", t(0)), ("https://c.example", "500", t(0)), (None, "404", t(0))], [("https://A.example", "410", t(5)), ("https://b.example", "ok", t(6))], [("https://z.example", "ok", t(12))], [("https://z.example", "ok", t(16))], [("https://z.example", "ok", t(17))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "url string, status string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        q = None
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            stream = spark.readStream.schema("url string, status string, at timestamp").parquet(f"file://{tmp_path}/in/*")
            write = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
            q = negative_cache.gone_boards(stream, days=10).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            q.awaitTermination()
        finally:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [(r.url, r.state, (dt.datetime.fromtimestamp(r.at / 1000, dt.timezone.utc).replace(tzinfo=None) - t(0)).days) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("batch", "url").collect()]
    assert got == [("https://a.example", "gone", 0), ("https://b.example", "gone", 0), ("https://b.example", "back", 0), ("https://a.example", "forgotten", 15)]


def test_retention(spark, tmp_path):
    spark.sql(f"CREATE DATABASE kept LOCATION 'file://{tmp_path}/kept'")
    retention.create(spark, "kept.t", "n LONG")
    rows = lambda *r: spark.createDataFrame(r, "run string, n long")
    retention.write(rows(("2026-01-01-a", 1), ("2026-01-02", 2), ("it's odd", 3), ("2026-01-03-c", 4)), "kept.t")
    retention.write(rows(("2026-01-02", 20), ("2026-01-02", 21)), "kept.t")
    retention.write(rows(("2026-01-02", 20), ("2026-01-02", 21)), "kept.t")
    assert sorted(r.n for r in spark.table("kept.t").collect()) == [1, 3, 4, 20, 21]
    assert retention.prune(spark, "kept.t") == [] and retention.prune(spark, "kept.t", "2026-01-02", ("2026-01-03-c", "never")) == ["2026-01-01-a", "2026-01-03-c"]
    assert retention.runs(spark, "kept.t") == ["2026-01-02", "it's odd"] and sorted(p.name for p in (tmp_path / "kept" / "t").iterdir() if p.is_dir()) == ["run=2026-01-02", "run=it%27s odd"]
    assert retention.prune(spark, "kept.t", committed=("it's odd",)) == ["it's odd"] and spark.table("kept.t").count() == 2
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_outbox(spark, tmp_path):
    carried = []
    write = outbox.outbox(f"file://{tmp_path}/sent", lambda df: carried.extend((r.run_id, r.message) for r in df.collect()))
    batch = lambda *r: spark.createDataFrame(r, "run_id string, position long, message string")
    one = batch(("b", 2, "B"), ("a", 1, "A"), ("a", 3, "late"), (None, 4, "x"), ("", 5, "x"))
    write(one, 0)
    write(one, 0)  # replayed
    write(batch(("a", 9, "again"), ("c", 8, "C")), 1)
    assert carried == [("a", "A"), ("b", "B"), ("c", "C")]
    failing = outbox.outbox(f"file://{tmp_path}/sent", lambda df: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        failing(batch(("d", 1, "D")), 2)
    write(batch(("d", 1, "D")), 2)  # lost, so it is sent
    assert carried[-1] == ("d", "D") and spark.read.parquet(f"file://{tmp_path}/sent").count() == 4


def test_versions(spark, tmp_path):
    def lines(name, *rows):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text("\n".join(map(json.dumps, rows)))
        return f"file://{tmp_path}/{name}"

    shown = lambda run, id_, **k: {"run": run, "id": id_, "title": "t", "url": "u", "rankStatus": "ruled", **k}
    v1 = lines("v1", {"id": "only", "date": "2026-01-01"}, {"id": "sent", "date": "2026-01-01"}, {"date": "x"})
    v2 = lines(
        "v2", shown("1", "sent", inEmail=True), shown("2", "sent", rankStatus="model", score=1), shown("1", "capped", reason="over max_rows"), shown("1", "low", rankStatus="model", score=2.9), shown("1", "other", score=1), shown("1", "good", score=3),
        shown("2", "low", rankStatus="heuristic"), shown("3", "low", rankStatus="model", score=1), shown("1", "bare", rankStatus="model", score=1), {"run": "2", "id": "bare", "score": 5}, shown("1", "role", inEmail=True), shown("1", "late", reason="capped"), shown("2", "late", inEmail=True), shown("1", "acted", score=9), shown("1", ""),
    )
    v3 = lines("v3", {"id": "role", "decision": "pending"}, {"id": "acted", "decision": "actioned", "extra": {"x": 1}}, {"id": "undecided"})
    records = migration.read(spark, v1, v2, v3)
    want = {"only": "suppressed", "sent": "published", "capped": "pending", "low": "below_threshold", "other": "legacy_processed", "good": "pending", "bare": "below_threshold", "role": "published", "late": "published", "acted": "actioned"}
    assert {r.id: r.decision for r in migration.decisions(records).collect()} == want
    assert {r.id: r.decision for r in migration.decisions(records.unionByName(records)).collect()} == want  # read again, nothing changes
    assert {r.id: r.version for r in migration.decisions(records).collect()}["sent"] == 2 and migration.read(spark, v1=v1).count() == 2
    with pytest.raises(ValueError):
        migration.read(spark)


def test_snapshots(spark, tmp_path):
    assert migration.replay(spark, f"file://{tmp_path}", "id long") is None
    for i, name in enumerate(("2026-02-09-raw.json", "2026-02-08.json", "2026-01-01-a/raw.json", "2026-01-02-b/raw.json", "2026-01-02-b/manifest.json", "2026-02-08/raw.json", "notes.json")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps({"id": i}))
    at = lambda run=None: [(r.id, r.run) for r in migration.replay(spark, f"file://{tmp_path}", "id long", run).collect()]
    assert at() == [(5, "2026-02-08")] and at("2026-02-09") == [(0, "2026-02-09")] and at("2026-01-01-a") == [(2, "2026-01-01-a")] and migration.replay(spark, f"file://{tmp_path}", "id long", "never") is None


def test_checks(spark):
    df = spark.range(100).withColumn("x", F.when(F.col("id") > 3, F.col("id")))
    seen = checks.Checked(df, [checks.Check("x", F.col("x") > 0, spare=0.05), checks.Check("strict", F.col("x") > 0), checks.Check("all", F.col("id") >= 0), checks.Check("many", F.col("id") >= 0, least=101)])
    assert seen.rows.count() == 100
    assert [tuple(r) for r in seen.report().collect()] == [("x", "warn", 4, 100), ("strict", "fail", 4, 100), ("all", "ok", 0, 100), ("many", "fail", 0, 100)]
    none = checks.Checked(df.limit(0), [checks.Check("x", F.col("x") > 0)])
    none.rows.write.format("noop").mode("overwrite").save()
    assert [tuple(r) for r in none.report().collect()] == [("x", "ok", 0, 0)]
