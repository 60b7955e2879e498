import gzip
import json

import pytest
from pyspark.sql import functions as F

from rookery.sources import dataset, scan
from rookery.streaming import sweep


class Strange(Exception):
    status = 418


def _strange(entry, body):
    if body == "part":
        return scan.Incomplete([{"title": "p", "url": "https://x.example/p", "unknown": 1}])
    if body == "wrong":
        return [1]
    raise Strange("teapot " * 100)


class OddBoards(scan.BoardFiles):
    providers = (*scan.PROVIDERS, scan.Provider("odd", _strange, scan.on_host("odd.example")))

    @classmethod
    def name(cls):
        return "odd_boards"


def test_a_board_that_fails_is_a_row_and_no_failed_job(spark, tmp_path):
    entries = [
        {"board": "good", "provider": "ashby", "status": 200, "body": json.dumps({"jobs": [{"title": "a", "jobUrl": "https://x.example/1"}, {"title": None}]})},
        {"board": "found", "url": "https://jobs.lever.co/x", "body": json.dumps([{"text": "b", "createdAt": 1770076800000}])},
        {"board": "none", "url": "https://nobody.example/x", "body": "[]"}, {"board": "named", "provider": "nosuch", "body": "[]"},
        {"board": "shape", "provider": "greenhouse", "body": "[]"}, {"board": "gone", "provider": "lever", "status": 404}, {"board": "teapot", "provider": "odd", "body": "x"},
        {"board": "part", "url": "https://odd.example/", "body": "part"}, {"board": "wrong", "provider": "odd", "body": "wrong"}, {"board": "late", "provider": "lever", "message": "deadline"},
        {"board": "twice", "provider": "lever", "body": "[]"}, {"board": "twice", "provider": "lever", "status": 500, "message": "m"},
    ]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, entries[:6])) + "\n\n")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.json").write_text("\n".join(map(json.dumps, entries[6:])) + "\nnot json\n[1]")
    (tmp_path / "_skipped").write_text("junk")
    (tmp_path / "empty.json").write_text("")
    rows = scan.scan(spark, f"file://{tmp_path}", OddBoards)
    assert rows.rdd.getNumPartitions() == 2
    found = {r.board: r for r in scan.units(rows, F.lit("2026-02-04").cast("date")).collect()}
    assert {b: (r.status, r.error, r.records) for b, r in found.items()} == {
        "good": ("complete", None, 2), "found": ("complete", None, 1), "none": ("unsupported", "unsupported", 0), "named": ("unsupported", "unsupported", 0), "shape": ("failed", "fetch_error", 0), "gone": ("failed", "not_found", 0),
        "teapot": ("failed", "http_418", 0), "part": ("partial", None, 1), "wrong": ("failed", "fetch_error", 0), "late": ("failed", "timeout", 0), "twice": ("failed", "http_5xx", 0), None: ("failed", "fetch_error", 0),
    }
    assert len(found["teapot"].message) == 300 and found["good"].covered_through is not None and found["part"].covered_through is None
    kept = scan.judged(rows, ["a", "p", "b"], F.lit("2026-01-01").cast("date"), F.lit("2026-02-01").cast("date")).collect()
    assert {(r.board, r.place, r.reason) for r in kept} == {("good", 0, None), ("good", 1, "title"), ("found", 0, "window"), ("part", 0, None)}
    only = rows.filter("provider = 'odd' AND place IS NULL")
    assert {r.board for r in only.collect()} == {"teapot", "part", "wrong"}
    assert rows.filter(F.col("provider").isin("odd", "nosuch") & F.col("place").isNull()).count() == 4 and rows.filter("provider IS NULL").count() == 3


def test_error_classes_in_order(spark):
    cases = [((404, "timeout"), "not_found"), ((429, ""), "rate_limit"), ((500, "Timeout"), "timeout"), ((None, "unsupported"), "unsupported"), ((599, "x"), "http_5xx"), ((302, None), "http_302"), ((None, None), "fetch_error")]
    got = spark.createDataFrame([c[0] for c in cases], "s int, m string").select(scan.error_class(F.col("s"), F.col("m"))).collect()
    assert [r[0] for r in got] == [c[1] for c in cases]


def test_lines_of_directories(spark):
    cases = {
        ("lever", "a.b-c_d"): "https://jobs.lever.co/a.b-c_d", ("ashby", "a b"): None, ("ashby", ""): None, ("ashby", None): None, ("workday", "t|wd1|S"): "https://t.wd1.myworkdayjobs.com/S", ("workday", "t|wd1|S|more"): "https://t.wd1.myworkdayjobs.com/S",
        ("workday", "t|wd1"): None, ("workday", "t||S"): None, ("workday", "t.evil.example/|wd1|S"): None, ("icims", "acme"): "https://careers-acme.icims.com/jobs/search?ss=1&in_iframe=1", ("icims", "a.b"): None, ("nosuch", "a"): None,
    }
    got = spark.createDataFrame(list(cases), "v string, l string").select("v", "l", sweep.board_of(F.col("v"), F.col("l"))["careers_url"].alias("u")).collect()
    assert {(r.v, r.l): r.u for r in got} == cases


@pytest.mark.parametrize("stops", [(), (1,), (0, 2), (1, 1, 1)])
def test_a_sweep_goes_on_where_it_stopped(spark, tmp_path, stops):
    root = f"file://{tmp_path}"
    lines = spark.range(60).selectExpr("id AS position", "CASE WHEN id % 2 = 0 THEN 'lever' ELSE 'ashby' END AS vendor", "CASE WHEN id % 5 = 0 THEN 'no slug' ELSE concat('s', id) END AS line")
    dead = spark.createDataFrame([("lever", "https://jobs.lever.co/S2", 3), ("lever", "https://jobs.lever.co/s4", 2), ("lever", "https://jobs.ashbyhq.com/s1", 3)], "vendor string, board string, misses int")
    sweep.stored_directory(lines, f"{root}/directory", 10)
    go = lambda n=None: sweep.sweep(spark, f"{root}/directory", dead, f"{root}/out", f"{root}/checkpoint", most_batches=n)
    for n in stops:
        before = sweep.swept(spark, f"{root}/out").count() if n == 0 and (tmp_path / "out").exists() else None
        go(n)
        if before is not None:
            assert sweep.swept(spark, f"{root}/out").count() == before
    go()
    got = sweep.swept(spark, f"{root}/out").collect()
    assert sorted(r.position for r in got) == [i for i in range(60) if i % 5 and i != 2] and len({r.batch for r in got}) == 6
    go()  # nothing is left
    assert sweep.swept(spark, f"{root}/out").count() == len(got)


def test_a_whole_sweep_has_few_batches_however_long_the_directory(spark):
    lines = spark.range(2_000).selectExpr("id AS position", "'lever' AS vendor", "concat('s', id) AS line")
    dead = spark.createDataFrame([("lever", "https://jobs.lever.co/S2", 3)], "vendor string, board string, misses int")
    got = sweep.whole_sweep(spark, lines, dead, 20).collect()
    assert sorted(r.position for r in got) == [i for i in range(2_000) if i != 2] and len({r.batch for r in got}) <= sweep.MOST_BATCHES


def chunk(path, *lines):
    with gzip.open(path, "wt") as f:
        f.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def test_dataset(spark, tmp_path):
    row = lambda u, **k: {"url": u, "title": "t", "company": "acme", "ats": "Lever", "first_seen": "2026-02-03T00:00:00Z", **k}
    chunk(tmp_path / "a-1.json.gz", row("https://x.example/1"), row("https://x.example/2", ats="greenhouse", company="bad slug!"), "{broken", row("https://x.example/3", title=None), "", row("https://x.example/4", first_seen="soon"))
    chunk(tmp_path / "b.json.gz", row("https://x.example/5", ats="workday"), row("https://t.wd1.myworkdayjobs.com/S/job/1", ats="workday"), row("https://x.example/6", first_seen="2026-01-01T00:00:00Z"), row("https://x.example/7", ats="other"))
    chunk(tmp_path / "unlisted.json.gz", row("https://x.example/8"))
    (tmp_path / "manifest.json").write_text(json.dumps({"last_updated": "2026-02-03T00:00:00Z", "chunks": ["a-1.json.gz", "b.json.gz"], "more": 1}))
    folder = f"file://{tmp_path}"
    found = dataset.manifest(spark, folder, "2026-02-04T12:00:00Z")
    assert found.age_hours == 36 and not found.stale(48) and found.stale(35)
    good, corrupt = dataset.records(spark, folder, found.chunks)
    assert {(r.file, r.record[:7]) for r in corrupt.collect()} == {("a-1.json.gz", "{broken"), ("a-1.json.gz", '{"url":')} and good.count() == 7
    inside = dataset.in_window(good, ["lever", "greenhouse", "workday"], F.lit("2026-02-01").cast("timestamp"), F.lit("2026-02-04").cast("timestamp"))
    got = {r.url[-1]: r for r in dataset.with_boards(inside).collect()}
    assert {u: (r.uncertain, r.board.careers_url if r.board else None) for u, r in got.items() if u != "1"} == {"2": (False, None), "4": (True, "https://jobs.lever.co/acme"), "5": (False, None)}
    assert {r.board.careers_url for r in dataset.with_boards(inside).collect() if r.url.endswith("1")} == {"https://jobs.lever.co/acme", "https://t.wd1.myworkdayjobs.com/S"}


def test_only_what_is_asked_for_is_read(spark, tmp_path):
    chunk(tmp_path / "a.json.gz", {"url": "u", "title": "t", "ats": "lever", "first_seen": "2026-02-03"})
    good, _ = dataset.records(spark, f"file://{tmp_path}", ["a.json.gz"])
    plan = dataset.in_window(good, ["lever"], F.lit("2026-01-01").cast("timestamp"), F.lit("2027-01-01").cast("timestamp")).select("url")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<url:string,title:string,ats:string,first_seen:string>" in plan and "IsNotNull(url)" in plan and "Exchange" not in plan


@pytest.mark.parametrize("text,error,age", [
    (None, "manifest: ", float("inf")), ("not json", "lists no chunks", float("inf")), ('{"chunks": []}', "lists no chunks", float("inf")),
    ('{"last_updated": "2026-02-03T00:00:00Z", "chunks": ["../x.json.gz"]}', "unexpected chunk name", float("inf")), ('{"last_updated": "lately", "chunks": ["a.json.gz"]}', None, float("inf")),
])
def test_manifests_that_cannot_be_used(spark, tmp_path, text, error, age):
    if text is not None:
        (tmp_path / "manifest.json").write_text(text)
    found = dataset.manifest(spark, f"file://{tmp_path}", "2026-02-04T00:00:00Z")
    assert (found.error is None) == (error is None) and (error or "") in (found.error or "") and found.age_hours == age and found.stale(48)
    rows = {r.key: r.status for r in dataset.fallback_units(spark, found, 48, ["Lever", "workday"], ["lever"], "2026-02-04").collect()}
    assert rows == {"ats_dataset:manifest": "failed" if error else "partial", "ats_dataset:workday": "failed"}


def test_lane_filters_before_and_after_names(spark):
    rows = spark.createDataFrame([("1", "t", "acme", "lever"), ("2", "t", "ACME", "lever"), ("3", "t", "blocked", "lever"), ("4", "t", "plain", "paylocity"), ("5", "t", None, "lever")], "url string, title string, company string, ats string")
    names = spark.createDataFrame([("acme", "Acme Inc"), ("Acme", "Acme Inc"), ("blocked", "Spam Co")], "slug string, name string")
    swept = spark.createDataFrame([("9", "t")], "url string, title string")
    seen = []

    def keep(df):
        seen.append(df.columns)
        return df.filter(F.coalesce("company", F.lit("")) != "Spam Co")

    got = dataset.lane(rows, names, keep, swept).collect()
    assert {(r.url, r.company, r.company_is_slug) for r in got} == {("1", "Acme Inc", False), ("2", "Acme Inc", False), ("4", "plain", False), ("5", None, True), ("9", None, None)} and len(seen) == 2
