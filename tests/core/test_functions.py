from pyspark.sql import functions as F

from rookery.functions import dates, jsons, text, urls
from rookery.sources import boards, files


def one(spark, *cols, **values):
    """The values of expressions over one row of named strings."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    got = row.select(*cols).first()
    return got[0] if len(cols) == 1 else tuple(got)


def test_canonical_url(spark):
    cases = {
        "http://www.Example.com/a/b/?utm_source=x&b=2&a=1#frag": "https://example.com/a/b?a=1&b=2",
        "https://x.com": "https://x.com/", "https://x.com/?ref=1": "https://x.com/", "https://x.com/a?b": "https://x.com/a?b=",
        " not a url ": "not a url", "https://x.com/p?z=1&a=2&a=1": "https://x.com/p?a=2&a=1&z=1", "https://x.com/?gh_jid=5&gh_src=q": "https://x.com/?gh_jid=5",
    }
    for raw, want in cases.items():
        assert one(spark, urls.canonical_url(F.col("u")), u=raw) == want, raw


def test_plain_urls_come_out_as_parameter_by_parameter(spark):
    cases = ["http://www.x.com/a/b/?utm_source=f&b=2&a=1#top", "https://x.com/p?z=1&a=2&a=1", "https://x.com/p?a-b=1&a=2&a0=3&A=4", "https://x.com/p?ref=1", "https://x.com/p?refs=1&src=", "https://x.com//a//", "https://www./a", "http://X.com/a?b=1", "https://x.com/a?b=1&&c=2", "https://x.com/a?b=%20", "https://x.com/a\x1fb", None]
    df = spark.createDataFrame([(c,) for c in cases], "u string")
    rows = df.select("u", urls.canonical_url(F.col("u")).alias("a"), urls._canonical_any(F.col("u")).alias("b"), F.trim("u").rlike(urls._PLAIN).alias("plain")).collect()
    assert all(r.a == r.b for r in rows) and [r.u for r in rows if r.plain] == cases[:6]


def test_requisitions(spark):
    cases = {
        "https://boards.greenhouse.io/Acme/jobs/123?x=1": "greenhouse:acme:123", "https://jobs.lever.co/acme/0a1b2c3d-4e5f": "lever:acme:0a1b2c3d-4e5f", "https://acme.wd5.myworkdayjobs.com/s/job/x/Title_R-123": "workday:acme:r-123",
        "https://acme.recruitee.com/o/abc": None, "https://acme.recruitee.com/o/abcd/": "recruitee:acme:abcd", "https://example.com/jobs/1": None, "": None,
    }
    for raw, want in cases.items():
        assert one(spark, urls.requisition(F.col("u")), u=raw) == want, raw
    assert one(spark, urls.is_aggregator(F.col("u")), u="https://uk.linkedin.com/jobs/1") and not one(spark, urls.is_aggregator(F.col("u")), u="https://notlinkedin.com/")


def test_names_and_titles(spark):
    assert one(spark, text.company_key(F.col("a")), text.company_key(F.col("b")), a="Acmé, Inc.", b="ACME  Holdings & Co") == ("acme", "acme and")
    assert one(spark, text.title_key(F.col("a")), a="Senior C++ Engineer (Remote), .NET") == "senior c++ engineer .net"
    assert one(spark, text.display_name(F.col("a")), a="open-AI_labs") == "Open AI Labs"
    assert one(spark, text.clean(F.col("a")), a="  a \n b ") == "a b"
    assert one(spark, text.bounded_distance(F.col("a"), F.col("b")), a="kitten", b="sitting") == 3


def test_html(spark):
    html = "<style>p{}</style><p>One &amp; two</p><ul><li>three&nbsp;x</li></ul><script>bad()</script>&lt;b&gt;"
    assert one(spark, text.html_to_text(F.col("h")), h=html) == "One & two\n\nthree x\n\n<b>"
    assert one(spark, urls.careers_links(F.col("h")), h="<a href='/careers'>x</a><a class=q href=\"/about\">y</a><a href='/careers'>z</a>") == ["/careers"]


def test_dates(spark):
    today = F.lit("2026-05-10").cast("date")
    said = {"Posted 3 Days Ago": "2026-05-07", "Posted 30+ Days Ago": None, "Yesterday": "2026-05-09", "about 1 month ago": "2026-04-10", "an hour ago": "2026-05-10", "never": None}
    for raw, want in said.items():
        assert one(spark, dates.relative_day(F.col("s"), today).cast("string"), s=raw) == want, raw
    sheet = {"2026-03-04": "2026-03-04", "3/4/2026": "2026-03-04", "14/3/2026": "2026-03-14", "2026/3/4": "2026-03-04", "13/13/2026": None, "x": None}
    for raw, want in sheet.items():
        assert one(spark, dates.sheet_date(F.col("s")).cast("string"), s=raw) == want, raw
    pay = {"$120K - $150k": (120_000, 150_000), "120,000 to 150,000": (120_000, 150_000), "$50/hr": (104_000, 104_000)}
    for raw, (low, high) in pay.items():
        got = one(spark, dates.annual_pay(F.col("s")), s=raw)
        assert (got.low, got.high) == (low, high), raw


def test_json_and_cells(spark):
    assert one(spark, jsons.extract_json(F.col("s")), s='so ```json\n[{"a": 1}]\n``` ok') == '[{"a": 1}]'
    assert one(spark, jsons.extract_json(F.col("s")), s="so [1, 2") is None
    assert one(spark, files.csv_cell(F.col("s")), s='a "b", c') == '"a ""b"", c"' and one(spark, files.safe_cell(F.col("s")), s="=1+1") == "'=1+1"
    h = one(spark, boards.comment_header(F.col("s")), s="Acme | Engineer | Remote | https://a.io/x\nmore")
    assert (h.company, h.role, h.location, h.url) == ("Acme", "Engineer", "Remote", "https://a.io/x")


def test_sheet_round_trip(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Job Title,Notes\n"a ""q""","line\nbreak"\n ,\n x ,y\n')
    got = files.read_sheet(spark, f"file://{tmp_path}/s.csv").collect()
    assert [tuple(r) for r in got] == [('a "q"', "line\nbreak"), ("x", "y")] and got[0].__fields__ == ["job_title", "notes"]


def test_signed_links(spark):
    import base64
    import hashlib
    import hmac

    from rookery.functions import signing

    for secret in (b"k", b"long" * 40):
        assert one(spark, signing.hmac_sha256(F.col("s"), secret), s="é message") == hmac.new(secret, "é message".encode(), hashlib.sha256).hexdigest()
    link = one(spark, signing.signed_link(F.lit("u"), F.lit("add"), F.col("s"), F.lit(9), b"k"), s="7")
    assert link == "u?action=add&id=7&exp=9&sig=" + base64.urlsafe_b64encode(hmac.new(b"k", b"add.7.9", hashlib.sha256).digest()).decode().rstrip("=")
