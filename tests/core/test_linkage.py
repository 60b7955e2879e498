import random
import time

import pytest

from rookery.operators import linkage
from rookery.plans import all_queries

FIELDS = "ordinal string, company string, title string, url string, location string"


def sequential(rows):
    """The rule one record after the other: {ordinal: the ordinal that it joined, or its own}."""
    stored, out = {}, {}
    for ordinal, company, title, req, place in sorted(rows):
        if company == "":
            out[ordinal] = ordinal
            continue
        group = stored.setdefault((company, title), [])
        place = (place or "").strip().lower()
        for other, other_req, other_place in group:
            if (not req or not other_req or req == other_req) and (not place or not other_place or place in other_place or other_place in place):
                out[ordinal] = other
                break
        else:
            group.append((ordinal, req, place))
            out[ordinal] = ordinal
    return out


@pytest.mark.parametrize("batch", [1, 2, 64])
def test_soft_links_are_those_of_a_sequential_fold(spark, batch):
    rng = random.Random(batch)
    rows = []
    for i in range(600):
        req = rng.choice(["", "", "11111", "22222", "33333"])
        place = rng.choice([None, "", "Gent", "Gent, Belgium", "Brugge", "brugge ", "Brugge, Belgium", "Belgium", "Oslo", "Riga", "Bern"]) if i % 3 else f"Town {rng.randint(0, 80)}"
        rows.append((f"{i:05d}", rng.choice(["mill", "bakery", ""]), rng.choice(["cook", "cook", "baker"]), req, place))
    made = [(o, c, t, f"https://boards.greenhouse.io/{c or 'x'}/jobs/{r}" if r else f"https://x.example/{o}", p) for o, c, t, r, p in rows]
    rng.shuffle(made)
    got = {r.ordinal: r.soft_record for r in linkage.soft_link(spark.createDataFrame(made, FIELDS), batch).collect()}
    assert got == sequential(rows)
    assert linkage.soft_link(spark.createDataFrame([], FIELDS), batch).count() == 0


def test_a_large_group_of_places_that_disagree(spark):
    rows = [(f"{i:05d}", "Mill", "Cook", f"https://x.example/{i}", f"Town {i % 700:03d}") for i in range(2_000)]
    got = {r.ordinal: r.soft_record for r in linkage.soft_link(spark.createDataFrame(rows, FIELDS), 256).collect()}
    assert got == {r[0]: f"{int(r[0]) % 700:05d}" for r in rows}


def test_soft_dedupe_against_a_sequential_fold(spark):
    """The query itself, over the smallest tables."""
    from rookery.functions.text import company_key, title_key
    from rookery.plans.postings import postings

    folder = "/root/testdata/sf0.001"
    merged = linkage.merge(linkage.link(postings(spark, folder))).withColumn("c", company_key(linkage.F.col("company"))).withColumn("t", title_key(linkage.F.col("title"))).collect()
    got = {r.ordinal: r.soft_record for r in all_queries()["soft_dedupe"](spark, folder).collect()}
    assert len(got) == len(merged) and got == sequential([(r.ordinal, r.c, r.t, "", r.location) for r in merged])


def test_groups_of_several_kinds_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BROADCAST_ROWS", 0)
    test_soft_links_are_those_of_a_sequential_fold(spark, 2)


def test_what_a_cut_shuffled_is_freed(spark):
    from rookery.operators.graphs import FREED, cut

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before = shuffled()
    assert cut(spark.range(1_000).repartition(3, "id").groupBy((linkage.F.col("id") % 7).alias("k")).count(), "freed").count() == 7
    for _ in range(100):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    # the last count shuffles one row of its own
    assert len({n.split("_")[1] for n in left}) <= 1
    assert spark.conf.get(FREED) == "false"


def test_soft_dedupe_moves_no_urls_titles_and_descriptions(spark, monkeypatch):
    written, cut = {}, linkage.cut
    monkeypatch.setattr(linkage, "cut", lambda df, name: written.setdefault(name, cut(df, name)))
    all_queries()["soft_dedupe"](spark, "/root/testdata/sf0.001")
    assert set(written["keyed"].columns) == {"record", "ordinal", "location", "company_key", "title_key", "requisition"}


def test_names_in_urls(spark):
    from rookery.functions.urls import AGGREGATOR_NAMES, VENDOR_URLS, _names

    names = [*AGGREGATOR_NAMES, *(domain.rstrip("$").replace("\\", "") for domain, _, _ in VENDOR_URLS.values())]
    urls = [None, "", ".", "https://x.example.com/a"] + [text for n in names for text in (n, f"https://a.{n.upper()}:80/b", f"https://x.example/?u={n}", n.replace(".", "-"), n[1:], f"{n[:-1]}", n.replace(".", "..", 1), f"\n{n}\n{n}")]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select("url", _names(linkage.F.col("url"), names).alias("said")).collect()
    assert all(r.said == (None if r.url is None else any(n in r.url.lower() for n in names)) for r in got)
