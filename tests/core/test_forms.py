"""Forms of urls, names, entities, days and places that the driver's tables do not hold."""

from pyspark.sql import functions as F

from rookery.functions import text, urls
from rookery.operators import linkage, places
from rookery.sources import boards


def told(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_query_values_are_encoded_anew(spark):
    given = ["https://x.example/?q=a b", "https://x.example/?q=a%20b", "https://x.example?q=a+b", "https://x.example/?b=%zz&a", "https://x.example/?%71=a%2Bb~*", "https://x.example/?utm%5Fsource=x&q=1", "https://x.example/?q=%C3%A9&a=1=2"]
    want = ["https://x.example/?q=a+b"] * 3 + ["https://x.example/?a=&b=%25zz", "https://x.example/?q=a%2Bb%7E*", "https://x.example/?q=1", "https://x.example/?a=1%3D2&q=%C3%A9"]
    assert told(spark, urls.canonical_url, given) == want


def test_canonical_urls(spark):
    given = ["https://h.com:8443/x/", "http://www.H.com:80/x", "https://h.com:443", "https://me:pw@h.com/a?b=2&a=1&utm_source=x#f", "http://h.com/?b&a", "not a url ", "", None]
    want = ["https://h.com:8443/x", "https://h.com/x", "https://h.com/", "https://me:pw@h.com/a?a=1&b=2", "https://h.com/?a=&b=", "not a url", "", None]
    assert told(spark, urls.canonical_url, given) == want


def test_requisitions(spark):
    given = ["https://boards.greenhouse.io/Acme/jobs/12", "https://careers.greenhouse.io/x?gh_jid=77", "https://jobs.lever.co/acme/0123abcd-ef", "https://acme.wd5.myworkdayjobs.com/s/job/x/T_R-99?a=b", "https://acme.recruitee.com/o/role-1", "https://acme.recruitee.com/o/", "https://x.com/jobs/1", None]
    want = ["greenhouse:acme:12", "greenhouse:careers.greenhouse.io:77", "lever:acme:0123abcd-ef", "workday:acme:r-99", "recruitee:acme:role-1", None, None, None]
    assert told(spark, urls.requisition, given) == want


def test_names_fold_marks_of_any_latin_letter(spark):
    assert told(spark, text.company_key, ["Škoda Auto a.s.", "Crédit & Co", "Citroën", "Nguyễn Labs", None]) == ["skoda auto a s", "credit and", "citroen", "nguyen", ""]


def test_entities(spark):
    given = ["caf&eacute; &#169; &#x41;&#x1F600; &amp;lt; &nbsp;&#160;.", "a & b &unknown; &#0; &#xD800; &&amp;&", "plain", ""]
    want = ["café © A😀 &lt;   .", "a & b &unknown; &#0; &#xD800; &&&", "plain", ""]
    assert told(spark, text.decode_entities, given) == want


def test_days(spark):
    given = ["1714521600", "1714521600000", "2024-05-01T10:00:00Z", "Wed, 01 May 2024 09:00:00 +0000", "1 May 2024", "May 1, 2024", "soon", "", None, "2024-99-99"]
    assert [str(d) if d else None for d in told(spark, boards.day, given)] == ["2024-05-01"] * 6 + [None] * 4


def test_fingerprints_count_within_a_company(spark):
    keys = spark.createDataFrame([("https://x.com/1", "f", "Acme Inc"), ("https://x.com/2", "f", "ACME"), ("https://x.com/3", "f", "Other"), ("https://x.com/4", "", "Acme")], "url string, fingerprint string, company string")
    found = [r.k[-1] for r in keys.select("url", linkage.hard_keys(F.col("url"), F.col("fingerprint"), F.col("company")).alias("k")).orderBy("url").collect()]
    assert found[0] == found[1] == "f:acme|f" and found[2] == "f:other|f" and found[3].startswith("u:")


def test_places(spark):
    given = ["Vienna, Austria", "Lagos", "Ottawa, Ontario", "Atlanta, Georgia", "Austin, TX", "Remote - US", "Nowhere at all", None]
    assert told(spark, lambda c: places.workplace(c, ["tx"]), given) == ["other", "other", "other", "other", "office", "remote", "other", "unknown"]
    assert told(spark, lambda c: places.workplace(c, ["ga"]), ["Atlanta, Georgia", "Tbilisi, Georgia"])[0] == "office"


def test_places_of_a_location(spark):
    """Own strings for each rule of reading: accepted are California, New York City, Austin and Portland, Oregon."""
    allow = ["California", "New York, NY", "NYC", "Austin, TX", "Portland, OR"]
    cases = {
        "office": ["Fresno, CA", "Oakland", "Menlo Park", "Greater Los Angeles Area", "San Diego, California, USA", "Queens, New York", "Berlin; Austin, TX", "Oslo & San Jose", "Denver (hybrid), Pasadena", "Seattle, WA, USA, Portland, OR, USA", "100 Main St, Irvine, CA 92612", "US-CA-San Francisco", "Roving California"],
        "remote": ["Remote", "Anywhere", "Remote - United States", "USA (Remote)", "United States", "Denver, CO or Remote", "America · Mexico", "Remote, New Mexico"],
        "other": ["Buffalo, New York, United States", "West New York, NJ", "Portland, ME", "Dublin, OH", "Vancouver, WA", "Edmonton, AB, CA", "Montreal, CA", "Halifax, NS", "Paris", "Paris, TX", "Lisbon, Portugal", "New Mexico", "Remote, Ireland", "France · Europe · Remote", "Remote (APAC)", "Remote - Canada", "United States, Utah, USA", "Atlantis", "Denver, CO, USA, Boston, MA, USA"],
        "unknown": ["", " ", "N/A", "tbd", "--", None],
    }
    for want, given in cases.items():
        got = told(spark, lambda c: places.workplace(c, allow), given)
        assert dict(zip(given, got)) == dict.fromkeys(given, want)
    assert told(spark, lambda c: places.workplace(c, ["ca"]), ["Dublin, CA", "Vancouver, CA", "Ontario, CA"]) == ["office", "other", "other"]
    assert told(spark, lambda c: places.workplace(c, []), ["Dublin, OH", "Dublin", "Ohio", "Remote"]) == ["office", "other", "office", "remote"]
    two = spark.createDataFrame([("san francisco, ca, usa, new york, ny",)], "l string").select(places.read_segment(F.col("l"))["places"].alias("p")).first().p
    assert [(x.city, x.state) for x in two] == [("san francisco", "ca"), ("new york", "ny")]
    assert [places.allowed(e) for e in ("California", "ca", "NYC", "Seattle, Washington", "Lisbon, Portugal", " ", "New York")] == [(None, "ca"), (None, "ca"), ("nyc", "ny"), ("seattle", "wa"), ("lisbon", None), (None, None), ("new york", "ny")]
