import json

import pytest
from pyspark.sql import functions as F

from rookery.sources import vendors

#: For each vendor a payload with a whole row, one with parts missing and rows that are no postings; and what comes of it: (title, url, location, day).
CASES = {
    "bamboohr": (
        {"result": [{"id": 7, "jobOpeningName": " Night  baker ", "location": {"city": "Gent", "state": None}, "isRemote": True}, {"id": "8 b", "jobOpeningName": "Miller"}, {"id": "", "jobOpeningName": "x"}, {"jobOpeningName": "x"}, {"id": 9}, None]},
        [("Night baker", "https://o.example/careers/7", "Gent, Remote", None), ("Miller", "https://o.example/careers/8%20b", "", None)],
    ),
    "breezy": (
        [{"name": "Baker", "url": "https://b.example/1", "location": {"city": "Gent", "country": {"name": "Belgium"}, "is_remote": True}, "published_date": "2026-02-03T10:00:00.000Z"}, {"name": "Miller", "url": "https://b.example/2", "location": {"name": "Remote, EU", "is_remote": True}}, {"name": "x", "url": "http://b.example/3"}, {"name": "x"}, {"url": "https://b.example/4"}],
        [("Baker", "https://b.example/1", "Gent, Belgium, Remote", "2026-02-03"), ("Miller", "https://b.example/2", "Remote, EU", None)],
    ),
    "consider": (
        {"jobs": [{"title": "Baker", "applyUrl": "j/1", "locations": [" Gent ", "", "Brugge"], "remote": True, "timeStamp": 1770076800000}, {"title": "Miller", "url": "https://x.example/2", "locations": ["Remote"], "remote": True}, {"title": "x"}]},
        [("Baker", "https://o.example/j/1", "Gent, Brugge, Remote", "2026-02-03"), ("Miller", "https://x.example/2", "Remote", None)],
    ),
    "getro": (
        {"results": {"count": 2, "jobs": [{"title": "Baker", "url": "https://x.example/1", "locations": [], "searchable_locations": ["Gent", "Belgium"], "work_mode": "remote", "created_at": 1770076800}, {"title": "Miller", "url": "https://x.example/2", "organization": {"name": "Mill"}}, {"title": "x", "url": ""}]}},
        [("Baker", "https://x.example/1", "Gent, Belgium, Remote", "2026-02-03"), ("Miller", "https://x.example/2", "", None)],
    ),
    "oraclecloud": (
        {"items": [{"TotalJobsCount": 9, "requisitionList": [{"Id": "300", "Title": "Baker", "workLocation": [{"TownOrCity": "Gent", "Country": "BE"}], "WorkplaceTypeCode": "ORA_HYBRID", "PostedDate": "2026-02-03"}, {"RequisitionNumber": 5, "Title": "Miller", "PrimaryLocation": "Brugge"}, {"Title": "x"}]}, {"requisitionList": [{"Id": "1", "Title": "second item"}]}]},
        [("Baker", "https://o.example/job/300", "Gent, BE · Hybrid", "2026-02-03"), ("Miller", "https://o.example/job/5", "Brugge", None)],
    ),
    "phenom": (
        {"refineSearch": {"totalHits": 2, "data": {"jobs": [{"jobId": "R 1", "title": "<b>Bäcker &amp; Cafés</b>", "city": "Gent", "state": "Gent", "country": "Belgium", "postedDate": "2026-02-03T18:25:30.000+0000"}, {"jobId": 2, "title": "!!", "cityState": "Brugge", "dateCreated": "2026-02-04T00:00:00.000+0000"}, {"title": "x"}, {"jobId": 3}]}}},
        [("Bäcker & Cafés", "https://o.example/job/R%201/Backer-Cafes", "Gent, Belgium", "2026-02-03"), ("!!", "https://o.example/job/2/job", "Brugge", "2026-02-04")],
    ),
    "pinpoint": (
        {"data": [{"title": "Baker", "url": "https://x.example/1", "location": {"city": "Gent", "province": " "}}, {"title": "Miller", "url": " https://x.example/2 ", "location": {"name": "HQ", "city": "Gent"}}, {"title": "x", "url": "ftp://x"}]},
        [("Baker", "https://x.example/1", "Gent", None), ("Miller", "https://x.example/2", "HQ", None)],
    ),
    "recruitee": (
        {"offers": [{"title": "Baker", "careers_url": "https://x.example/o/1", "city": "Gent", "country": "Belgium", "remote": True, "published_at": "2026-02-03 10:00:00 UTC"}, {"title": "Miller", "url": "https://x.example/o/2", "location": "Brugge", "remote": True}]},
        [("Baker", "https://x.example/o/1", "Gent, Belgium, Remote", "2026-02-03"), ("Miller", "https://x.example/o/2", "Brugge", None)],
    ),
    "rippling": (
        [{"name": "Baker", "url": "https://ats.rippling.com/b/1", "workLocation": {"label": " Gent ", "id": 3}}, {"name": "Miller", "url": "https://ats.rippling.com/b/2", "workLocation": "Brugge"}, {"name": "x", "url": "https://ats.rippling.com.evil.example/3"}, {"name": "Cook", "url": "https://ats.rippling.com/b/4"}],
        [("Baker", "https://ats.rippling.com/b/1", "Gent", None), ("Miller", "https://ats.rippling.com/b/2", "Brugge", None), ("Cook", "https://ats.rippling.com/b/4", "", None)],
    ),
    "smartrecruiters": (
        {"content": [{"id": "1", "name": "Baker, nights", "ref": "https://api.smartrecruiters.com/v1/companies/Mill/postings/77", "location": {"city": "Gent", "country": "be", "remote": True}, "releasedDate": "2026-02-03T00:00:00.000Z"}, {"id": "2", "name": "Miller", "ref": "https://evil.example/v1/companies/M/postings/9", "location": {"fullLocation": "Brugge, BE"}}, {"name": "x"}]},
        [("Baker, nights", "https://jobs.smartrecruiters.com/Mill/77-baker-nights", "Gent, be, Remote", "2026-02-03"), ("Miller", "https://jobs.smartrecruiters.com/own/2-miller", "Brugge, BE", None)],
    ),
    "workable": (
        {"jobs": [{"title": "Baker", "shortlink": "https://apply.workable.com/j/A1", "url": "https://x.example", "city": "Gent", "country": "Belgium", "published_on": "2026-02-03"}, {"title": "Miller", "shortlink": "https://evil.example", "url": "https://jobs.workable.com/view/2", "telecommuting": True, "created_at": "2026-02-04"}, {"title": "x", "url": "https://evil.example"}]},
        [("Baker", "https://apply.workable.com/j/A1", "Gent, Belgium", "2026-02-03"), ("Miller", "https://jobs.workable.com/view/2", "Remote", "2026-02-04")],
    ),
}


def payloads(spark, *texts, origin="https://o.example"):
    return spark.createDataFrame([(f"b{i}", origin, t, "x", "y") for i, t in enumerate(texts)], "board string, origin string, payload string, j string, _at string")


@pytest.mark.parametrize("vendor", sorted(vendors.VENDORS))
def test_vendor(spark, vendor):
    payload, want = CASES[vendor]
    odd = ["", None, "[1", "{}", "[]", '{"jobs": 3, "result": "x", "data": [], "items": {}}', "null"]
    origin = "https://jobs.smartrecruiters.com/own" if vendor == "smartrecruiters" else "https://o.example"
    got = vendors.postings(payloads(spark, json.dumps(payload), *odd, origin=origin), vendor).collect()
    assert [(r.title, r.url, r.location, str(r.posted_at) if r.posted_at else None) for r in got] == want and {r.board for r in got} == {"b0"}


def test_getro_pay(spark):
    row = {"title": "t", "url": "https://x.example/1"}
    jobs = [row | {"compensation_period": p, "compensation_amount_min_cents": a, "compensation_amount_max_cents": b, "compensation_currency": "EUR"} for p, a, b in (("year", 100_000, 250_000), ("hour", 5_000, 6_000), (None, 0, 90_000), ("YEAR", None, None))]
    got = vendors.postings(payloads(spark, json.dumps({"results": {"jobs": jobs}})), "getro").collect()
    assert [(r.pay_low, r.pay_high, r.currency) for r in got] == [(1_000.0, 2_500.0, "EUR"), (None, None, None), (900.0, 900.0, "EUR"), (None, None, None)]


def test_gem_keeps_rows_without_details_and_the_last_of_several(spark):
    post = lambda i, **k: {"extId": i, "title": f"t{i}", "locations": [{"name": "Gent", "isRemote": True}, {"name": "Gent", "isRemote": True}, {}], **k}
    lists = [{"data": {"oatsExternalJobPostings": {"jobPostings": [post("a"), post("a"), post("b"), post(None), post("c", title=None)]}}}]
    detail = lambda i, s, **k: {"data": {"oatsExternalJobPosting": {"extId": i, "firstPublishedTsSec": s, **k}}}
    details = [detail("a", 1, descriptionHtml="old"), detail("a", 1770076800, descriptionHtml="<p>new</p>", jobPostSectionHtml={"introHtml": "hi", "outroHtml": None}, compensationHtml="5 &amp; 6"), detail("z", 5), {"errors": []}]
    got = vendors.gem(payloads(spark, json.dumps(lists), None), payloads(spark, json.dumps(details), "[")).collect()
    assert sorted((r.title, r.url, r.location, r.description, str(r.posted_at)) for r in got) == [
        ("ta", "https://o.example/a", "Gent · Remote", "hi\n\nnew\n\nCompensation: 5 & 6", "2026-02-03"), ("ta", "https://o.example/a", "Gent · Remote", "hi\n\nnew\n\nCompensation: 5 & 6", "2026-02-03"), ("tb", "https://o.example/b", "Gent · Remote", "", "None"),
    ]


def test_builtin_and_its_drift(spark):
    item = lambda i, name: json.dumps({"@type": "ListItem", "position": 1, "name": name, "url": f"https://x.example/job/a/{i}", "description": "d {x}"}, separators=(",", ":"))
    card = lambda i, mode, where, pay, age: f'<a href="/company/m"> <b>Mill</b></a><a data-id="job-card-title" data-builtin-track-job-id="{i}">t</a><i class="fa-house-building"></i><div>\n <b>{mode}</b></div>{where}<i class="fa-sack-dollar"></i><p>{pay}</p><i class="fa-clock"></i><p>{age}</p>'
    one = '<i class="fa-location-dot"></i><p>Gent, BE</p>'
    two = '<i class="fa-location-dot"></i><p aria-label="Job locations" class="k" data-bs-title="&lt;div&gt;Gent&lt;/div&gt;&lt;div&gt;Brugge&lt;/div&gt;">2 Locations</p>'
    none = '<i class="fa-location-dot"></i><p>3 Locations</p>'
    page = "[" + ",".join([item(1, 'Baker "A" }'), item(2, "Miller"), item(3, "Cook"), item(4, "Alone"), item(1, 'Baker "A" }'), item(5, "Far")]) + "]"
    page += card(1, "Hybrid", one, "80K-120.5K Annually", "Reposted 2 Days Ago") + card(2, "remote", two, "115K-130K Hourly", "30+ Days Ago") + card(3, "In-Office", none, "90K Annually", "An Hour Ago") + card(5, "Remote", none, "", "5 Minutes Ago").replace("/company/", "/other/")+ card(6, "Elsewhere", none, "", "")
    rows = vendors.builtin(payloads(spark, page, None, "no items"), F.lit("2026-02-03").cast("date"))
    assert sorted((r.title, r.company, r.location, r.pay_low, r.pay_high, str(r.posted_at)) for r in rows.collect()) == [
        ("Alone", None, "", None, None, "None"), ('Baker "A" }', "Mill", "Hybrid · Gent, BE", 80_000.0, 120_500.0, "2026-02-01"), ("Cook", "Mill", "", 90_000.0, 90_000.0, "2026-02-03"),
        ("Far", "", "Remote", None, None, "2026-02-03"), ("Miller", "Mill", "Remote · Gent · Brugge", None, None, "2026-01-04"),
    ]
    made = lambda b, n, company, place: [(b, company, place)] * n
    told = spark.createDataFrame(made("few", 4, "", "") + made("none", 5, "", "") + made("bare", 6, "c", "") + made("well", 5, "c", "p"), "board string, company string, location string")
    assert {r.board: r.warning for r in vendors.drift(told).collect()} == {"few": None, "none": "cards", "bare": "places", "well": None}
