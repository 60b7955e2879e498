import pytest
from pyspark.sql import functions as F

from rookery.operators import coverage, graphs, identity, ledger, linkage, places, prefilter, ranking, titles
from rookery.sources import packing


def test_places(spark):
    cases = {
        "Austin, TX": "office", "NYC": "office", "Brooklyn, NY": "office", "Remote - US": "remote", "Remote": "remote", "United States": "remote", "Toronto, Canada": "other", "Remote, UK": "other", "London": "other",
        "Denver, CO": "other", "Berlin; Austin, TX": "office", "": "unknown", "Somewhere": "other", "Seattle, WA or Remote": "remote",
    }
    df = spark.createDataFrame([(k,) for k in cases], "l string").select("l", places.workplace(F.col("l"), ["tx", "New York, NY"]).alias("w"))
    assert {r.l: r.w for r in df.collect()} == cases


def test_titles(spark):
    t = lambda s, *a, **k: spark.createDataFrame([(s,)], "t string").select(titles.match_title(F.col("t"), *a, **k).alias("m")).first().m
    m = t("Senior Machine-Learning Engineer, ML platform", ["engineer"], ["machine learning", "learning", "ml", "plat*"], ["manager"])
    assert m.roles == ["engineer"] and m.keywords == ["machine learning", "ml", "plat*"] and m.excluded == [] and m.score == 3
    assert t("Éngineering", ["gineering"], [], []).roles == []
    assert t("Sales Engineer", [], [], ["sales"], exceptions={"sales": ["sales engineer"]}).excluded == []
    assert t("Sales Lead", [], [], ["sales"], exceptions={"sales": ["sales engineer"]}).excluded == ["sales"]


def test_rules_in_order(spark):
    p = prefilter.Preferences(roles=["engineer"], exclude=["sales"], allow=["tx"], block_companies=["evil corp"], seniority=["intern"], block_content=["clearance"], remote="exclude")
    rows = [("Sales Engineer", "Evil", "Austin, TX", ""), ("Engineer", "The Evil Corp Group", "Austin, TX", ""), ("Sales Engineer", "A", "London", ""), ("Engineer", "A", "London", ""), ("Engineer", "A", "Remote", ""), ("Chef", "A", "Austin, TX", ""), ("Engineer intern", "A", "Austin, TX", ""), ("Engineer", "A", "Austin, TX", "needs clearance"), ("Engineer", "A", "Austin, TX", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, company string, location string, description string")
    got = {r.i: r.reason for r in prefilter.classify(df, p).collect()}
    assert [got[i] for i in range(len(rows))] == ["company", "company", "title excluded", "location", "remote", "no role", "seniority", "content", None]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in graphs.components(edges, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(101)) and got[501] == 500 and len(got) == 103


def test_identity(spark):
    rows = [("acme", "b1", False), ("acme inc", "b1", True), ("other", "b2", False), *((f"n{i}", "agg", False) for i in range(9)), ("acme", "agg", False)]
    got = {r.company_key: r.canonical_key for r in identity.company_identity(spark.createDataFrame(rows, "company_key string, board string, watched boolean")).collect()}
    assert got["acme"] == got["acme inc"] == "acme inc" and got["other"] == "other" and got["n1"] == "n1"


POSTING = "ordinal string, url string, title string, company string, location string, source string, posted_at date, watchlist boolean, description string, fingerprint string"


def test_link_and_merge(spark):
    rows = [
        ("1", "https://www.linkedin.com/x", "E", "A", "", "linkedin", None, False, "long", "f1"), ("2", "https://boards.greenhouse.io/a/jobs/1?utm_source=q", "E", "A", "Austin", "watchlist", None, True, None, "f1"),
        ("3", "https://boards.greenhouse.io/a/jobs/1", "E", "A", None, "unknown", None, False, None, None), ("4", "https://b.com/1", "E", "B", "X", "unknown", None, False, None, None),
    ]
    merged = {r.ordinal: r for r in linkage.merge(linkage.link(spark.createDataFrame(rows, POSTING))).collect()}
    assert set(merged) == {"1", "4"}
    m = merged["1"]
    assert m.copies == 3 and m.source == "watchlist" and m.description == "long" and m.location == "Austin" and m.watchlist and m.merged_from == ["linkedin", "unknown", "watchlist"]


def test_soft_link_is_first_match(spark):
    rows = [(str(i), f"https://x.com/{i}", "Engineer", "Acme", place, "unknown", None, False, None, None) for i, place in enumerate(["Austin", "Boston", "", "Boston, MA"])]
    got = {r.ordinal: r.soft_record for r in linkage.soft_link(spark.createDataFrame(rows, POSTING)).collect()}
    assert got == {"0": "0", "1": "1", "2": "0", "3": "1"}


def test_dead_boards_fold(spark):
    def fold(kinds):
        n = 0
        for k in kinds:
            n = min(3, n + 1) if k == "miss" else 0 if k == "ok" else n if n >= 3 else 0
        return n

    import itertools

    cases = list(itertools.product(["miss", "ok", "other"], repeat=5))
    df = spark.createDataFrame([(i, j, k) for i, c in enumerate(cases) for j, k in enumerate(c)], "key int, at int, gone string")
    got = {r.key: r.misses for r in coverage.dead_boards(df, "key", "at", "gone").collect()}
    assert got == {i: fold(c) for i, c in enumerate(cases) if fold(c)}


def test_ledger_is_idempotent(spark):
    old = spark.createDataFrame([("a", "t0", None, 1, 2), ("b", "t1", 5, 1, 2)], "key string, title string, posted_at int, first_seen int, last_seen int")
    new = spark.createDataFrame([("a", "t2", 7, 4, 1), ("a", "t3", 8, 5, 2), ("c", "t4", 9, 6, 3)], "key string, title string, posted_at int, seen_at int, n int")
    once = ledger.upsert(old, new, "key", "n")
    assert {r.key: (r.title, r.posted_at, r.first_seen, r.last_seen, r.state) for r in once.collect()} == {"a": ("t3", 8, 1, 5, "updated"), "b": ("t1", 5, 1, 2, "kept"), "c": ("t4", 9, 6, 6, "new")}
    assert ledger.upsert(once.drop("state"), new, "key", "n").drop("state").exceptAll(once.drop("state")).isEmpty()


@pytest.mark.parametrize("score,watch,only,want", [(4.8, True, False, 5.0), (3.0, True, False, 3.5), (3.0, False, False, 3.0), (3.0, True, True, 3.0), (None, True, False, None)])
def test_bonus(spark, score, watch, only, want):
    df = spark.createDataFrame([(score, watch, only)], "s double, w boolean, o boolean")
    assert df.select(ranking.with_bonus(F.col("s"), F.col("w"), 0.5, F.col("o"))).first()[0] == want


def test_pack_sources(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 20), ("e", 1)], "name string, n long")
    got = {r.name: r.group for r in packing.pack_sources(counts, "name", "n", 10).collect()}
    assert got == {"d": 0, "a": 1, "b": 1, "c": 2, "e": 2}


@pytest.mark.parametrize("most", [0, 100_000])
def test_postings_do_not_move_to_be_judged(spark, monkeypatch, most):
    monkeypatch.setattr(prefilter, "BROADCAST_ROWS", most, raising=False)
    rows = [("Gear fitter", "Austin, TX", "Acme Inc."), (None, "Remote", None), ("old rod", "", "Bad Co")]
    df = spark.createDataFrame([(*r, None) for r in rows], "title string, location string, company string, description string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = prefilter.classify(df, prefilter.Preferences(roles=["gear"], exclude=["old"], allow=["tx"], block_companies=["bad co"]))
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(r.title, r.company_key): r.reason for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == {("Gear fitter", "acme"): None, (None, ""): "no role", ("old rod", "bad"): got["old rod", "bad"]} and "SortMergeJoin" not in plan
