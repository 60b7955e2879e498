import json
import random
import re
import unicodedata

from pyspark.sql import functions as F

from rookery.operators import enrichment, keywords, references


def plain_match(keyword, text, groups=True, short=True):
    """One keyword against one text, place by place."""
    inside = lambda c: c == "_" or unicodedata.category(c)[0] in "LMN"
    lower = text.lower()

    def one(term):
        kind, rest = "part", term
        for p in ("word", "stem"):
            if term.startswith(p + ":"):
                kind, rest = p, term[len(p) + 1 :].strip()
                if not rest:
                    return False
        if kind == "part" and short and re.fullmatch("[a-z]{2,3}", term):
            kind = "word"
        for i in range(len(lower) - len(rest) + 1):
            if lower[i : i + len(rest)] == rest:
                before, after = lower[i - 1 : i], lower[i + len(rest) : i + len(rest) + 1]
                if kind == "part" or (not (before and inside(before)) and (kind == "stem" or not (after and inside(after)))):
                    return True
        return False

    keyword = keyword.strip().lower()
    terms = [t.strip() for t in re.split(r"\s+\+\s+", keyword) if t.strip()] if groups else [keyword]
    return all(one(t) for t in terms or [keyword])


def test_keywords_against_a_plain_matcher(spark):
    rng = random.Random(4)
    letters = ["a", "b", "é", "e\u0301", "_", " ", "-", "+", ".", "(", "A", "|", "\\", "1"]
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    listed = [rng.choice(["", "word:", "stem:"]) + word(4) for _ in range(250)] + [f"{word(2)} + {rng.choice(['', 'word:'])}{word(2)}" for _ in range(60)] + ["word:", "stem: ", " ", "", "C++", "ab", "aab", "a + word:", "vp", "vp a", "word:vp b", "word:vp"]
    listed += [None, 3]
    texts = [word(12) for _ in range(150)] + ["", "vp b", "vp", "xvp", "vpé", "c++ a"]
    strings = [k for k in listed if isinstance(k, str) and k.strip()]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "title string")
    got = {r.text: r.keywords for r in keywords.matches(df, "title", keywords.Keywords(listed)).collect()}
    for t in set(texts):
        assert got.get(t, []) == sorted({k.strip().lower() for k in strings if plain_match(k, t)}), t
    bare = {r.text: r.keywords for r in keywords.matches(df, "title", keywords.Keywords(listed, groups=False, short_words=False)).collect()}
    for t in set(texts):
        assert bare.get(t, []) == sorted({k.strip().lower() for k in strings if plain_match(k, t, False, False)}), t


def test_title_filter(spark):
    df = spark.createDataFrame([(1, "Baker of bread", "w"), (1, "Baker of bread", "w"), (2, "Baker intern", "x"), (3, None, None), (4, "", ""), (5, "Internal baker", "y")], "id long, title string, wanted_by string")
    kept = lambda p, n: sorted(r.id for r in keywords.title_filter(df, "title", p, n).filter("kept").collect())
    assert kept(["baker"], ["word:intern"]) == [1, 1, 5] and kept([], ["intern"]) == [1, 1, 3, 4] and kept([" ", None], []) == [1, 1, 2, 3, 4, 5] and kept(["word:"], []) == [] and kept(["bread + baker"], ["a + b"]) == [1, 1]
    assert keywords.title_filter(df.limit(0), "title", ["a"], []).count() == 0


def test_patterns_share_beginnings():
    terms = [f"filler term {i}" for i in range(500)]
    pattern = keywords.tree_pattern(terms)
    assert pattern.count("filler") == 1 and len(pattern) < 2_500 and all(re.fullmatch(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern), t) for t in terms)


def test_positions_have_no_gaps_however_rows_are_dealt(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.random() < 0.4 if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k int, flag boolean")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = enrichment.numbered(df, [F.desc("k"), F.asc("id")], {"before": F.col("flag")}).collect()
        want = sorted(rows, key=lambda r: (-(r[1] or 0), r[0]))
        assert [r.id for r in sorted(got, key=lambda r: r.position)] == [r[0] for r in want] and sorted(r.position for r in got) == list(range(500))
        assert {r.id: r.before for r in got} == {r[0]: sum(bool(x[2]) for x in want[:i]) for i, r in enumerate(want)}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert enrichment.numbered(df.limit(0), [F.asc("id")]).count() == 0
    plan = enrichment.numbered(df, [F.asc("id")])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_enrichment_outcomes(spark):
    jobs = spark.createDataFrame([(1, "a", None, True), (2, "a", " ", True), (3, "b", "own", True), (4, "c", None, None), (5, None, None, True), (6, "d", "", True), (7, "e", None, True)], "id long, key string, description string, supported boolean")
    at = lambda h: f"2024-01-0{2 if h < 24 else 1} {(24 - h) % 24:02d}:00:00"
    cache = spark.createDataFrame([("a", True, "", "o", None, at(1)), ("d", True, "text", "o", None, at(3)), ("d", False, None, "o", "gone", at(5)), ("far", True, "x", "o", None, at(1))], "key string, ok boolean, description string, origin string, error string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    answers = spark.createDataFrame([("a", True, "new", "n", None), ("b", True, "never", "n", None)], "key string, ok boolean, description string, origin string, error string")
    run = lambda **k: {r.id: (r.outcome, r.description) for r in enrichment.enriched(jobs, cache, answers, [F.asc("id")], F.lit("2024-01-03").cast("timestamp"), **k).collect()}
    assert run() == {1: ("fetched", "new"), 2: ("fetched", "new"), 3: ("already_present", "own"), 4: ("unsupported_host", None), 5: ("past_deadline", None), 6: ("cache_hit", "text"), 7: ("past_deadline", None)}
    assert {i: o for i, (o, _) in run(scope=6, most=2).items()} == {1: "fetched", 2: "fetched", 3: "already_present", 4: "unsupported_host", 5: "over_max_jobs", 6: "over_max_jobs", 7: "over_enrichment_budget_scope"}
    assert set(run(scope=0).values()) == {("over_enrichment_budget_scope", d) for d in (None, " ", "own", "")} and {o for o, _ in run(enabled=False).values()} == {"disabled"}
    assert enrichment.telemetry(enrichment.enriched(jobs, cache, answers, [F.asc("id")], F.lit("2024-01-03").cast("timestamp"))).first().asDict() == {"attempted": 2, "succeeded": 3, "failed": 0, "cache_hits": 1, "skipped_existing": 1, "skipped_unsupported": 1, "skipped_budget": 0, "past_deadline": 2}


def graph(state):
    return '<script id="__NEXT_DATA__">' + json.dumps({"props": {"pageProps": {"apolloState": {"data": state}}}}) + "</script>"


def test_references(spark):
    ref = lambda k: {"__ref": k}
    circle = {"a": {"x": ref("b"), "text": 'says "__ref":"d"'}, "b": {"x": [ref("c"), ref("gone"), ref('q"\u00e9')]}, "c": {"x": ref("a")}, 'q"\u00e9': {"x": 1}, "d": {"x": ref("a")}}
    pages = spark.createDataFrame([(1, graph(circle)), (2, graph({"a": {"x": ref("a")}})), (3, None), (4, "<script>no</script>"), (5, '<script id="__NEXT_DATA__">{broken</script>')], "page long, html string")
    own = references.nodes(pages, "page", "html")
    assert own.count() == 6
    got = references.reached(own, own.filter("key = 'a'").select("page", "key")).collect()
    assert {(r.page, r.key, r.depth) for r in got} == {(1, "a", 0), (1, "b", 1), (1, "c", 2), (1, 'q"\u00e9', 2), (2, "a", 0)}


def test_rounds_do_not_read_pages_again(spark, monkeypatch):
    cut, plans = references.cut, []
    monkeypatch.setattr(references, "cut", lambda df, name: (plans.append(df._jdf.queryExecution().analyzed().toString()), cut(df, name))[1])
    state = {str(i): {"x": {"__ref": str(i + 1)}} for i in range(6)}
    own = references.nodes(spark.createDataFrame([(1, graph(state))], "page long, html string"), "page", "html")
    got = references.reached(own, spark.createDataFrame([(1, "0")], "page long, key string")).collect()
    assert {(r.key, r.depth) for r in got} == {(str(i), i) for i in range(6)}
    assert sum("__NEXT_DATA__" in p for p in plans) == 1


def test_role_pages(spark):
    ref = lambda k: {"__ref": k}
    found = {"seoLandingPageJobSearchResults:{1}": {"totalJobCount": 40, "startups": [ref("s1"), ref("s2"), ref("none"), ref("s1")]}, "seoLandingPageRoleAndLocation:{2}": {}}
    state = {"ROOT_QUERY": {"talent": found}, "s1": {"name": "One", "highlightedJobListings": [ref("j1"), ref("j2"), ref("none")]}, "s2": {"name": "", "highlightedJobListings": [ref("j1")]}, "j1": {"id": 7, "title": "T", "slug": "t-1", "locationNames": ["A", None, "B"], "remote": True, "liveStartAt": 1770076800}, "j2": {"id": 8}}
    pages = spark.createDataFrame([(1, graph(state)), (2, graph({"ROOT_QUERY": {"talent": {"seoLandingPageLocation": {}}}})), (3, graph({"ROOT_QUERY": {}})), (4, graph({"ROOT_QUERY": {"talent": {"seoLandingPageJobSearchResults": {}}}}))], "page long, html string")
    seen, jobs = references.role_pages(pages, "page", "html")
    assert {tuple(r) for r in seen.collect()} == {(1, True, 40, 1), (4, False, 0, 1)}
    assert [(r.page, r.url, r.company, r.location, str(r.posted_at)[:10]) for r in jobs.collect()] == [(1, "https://wellfound.com/jobs/7-t-1", "One", "A / B / Remote", "2026-02-03")] * 2


def test_json_of_a_page_is_read_once(spark):
    """Neither filters below generators nor columns of a reading compute it again."""
    ref = lambda k: {"__ref": k}
    state = {"ROOT_QUERY": {"talent": {"seoLandingPageJobSearchResults": {"startups": [ref("s")]}}}, "s": {"name": "S", "highlightedJobListings": [ref("j")]}, "j": {"id": 1, "title": "T"}}
    pages = spark.createDataFrame([(1, graph(state))], "page long, html string")
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("from_json(")
    assert count(references.nodes(pages, "page", "html")) == 1
    _, jobs = references.role_pages(pages, "page", "html")
    assert count(jobs) == 4  # the role's talent, its results, a company, a posting
    assert [(r.url, r.company) for r in jobs.collect()] == [("https://wellfound.com/jobs/1", "S")]
