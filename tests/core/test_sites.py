from pyspark.sql import functions as F

from rookery.functions import jsons
from rookery.operators import sites

ORCHARD = r"""<p>We hire: <a href="https://jobs.lever.co/orchard-co?lever-via=x">board</a>, <script>cfg = {"a":"https:\/\/jobs.lever.co\/orchard-co\/9f","b":"https://boards.eu.greenhouse.io/orchardeu"}</script>
<iframe data-src='//boards.greenhouse.io/embed/job_board/js?for=orchardus&amp;b=2'></iframe> <a href="https://Mill-House.recruitee.com/o/baker">bread</a> <a href="https://apply.workable.com/Two%20Rivers./j/1">rivers</a>
<a href="https://pear.wd3.myworkdayjobs.com/de-DE/Pear_Careers/job/7?x=1">pear</a> https://tree.jobs.personio.de/job/5"""
NONE = r"""<a href="https://jobs.lever.co/login">in</a> <a href="https://eu.teamtailor.com/x">t</a> <a href="https://jobs.lever.co.evil.example/y">e</a> <a href="https://www.bamboohr.com">b</a> <a href="https://apply.workable.com/">w</a>
<a href="https://pear.wd3.myworkdayjobs.com/fr/">only a locale</a> <a href="https://myjobs.lever.co/z">other host</a>"""


def test_boards(spark):
    rows = [(1, ORCHARD), (2, NONE), (3, None), (4, ""), (5, "https://jobs.ashbyhq.com/fig " * 2_000)]
    got = sites.boards_in_pages(spark.createDataFrame(rows, "page long, html string"), "page", "html").collect()
    assert {(r.page, r.vendor, r.slug, r.careers_url, r["count"]) for r in got} == {
        (1, "lever", "orchard-co", "https://jobs.lever.co/orchard-co", 2),
        (1, "greenhouse", "orchardeu", "https://job-boards.greenhouse.io/orchardeu", 1),
        (1, "greenhouse", "orchardus", "https://job-boards.greenhouse.io/orchardus", 1),
        (1, "recruitee", "mill-house", "https://mill-house.recruitee.com", 1),
        (1, "workable", "Two Rivers", "https://apply.workable.com/Two%20Rivers", 1),
        (1, "workday", "pear|wd3|Pear_Careers", "https://pear.wd3.myworkdayjobs.com/Pear_Careers", 1),
        (1, "personio", "tree", "https://tree.jobs.personio.com", 1),
        (5, "ashby", "fig", "https://jobs.ashbyhq.com/fig", 2_000),
    }


def test_links_are_resolved(spark):
    page = "http://u@Orchard.example:81/a/b.html?q=1"
    cases = {
        "c": "http://u@orchard.example:81/a/c", "../c/./d?x=1": "http://u@orchard.example:81/c/d?x=1", "/../../e": "http://u@orchard.example:81/e", "?p=2": "http://u@orchard.example:81/a/b.html?p=2",
        "//other.example/f": "http://other.example/f", "HTTPS://x.example": "HTTPS://x.example", "mailto:a@b.example": None, "javascript:void(0)": None, "": None,
    }
    got = spark.createDataFrame([(k, page) for k in cases], "l string, p string").select("l", sites.resolved(F.col("l"), F.col("p")).alias("u")).collect()
    assert {r.l: r.u for r in got} == cases
    assert spark.createDataFrame([("c", "no url"), ("https://x.example/", None)], "l string, p string").select(sites.resolved(F.col("l"), F.col("p"))).collect()[0][0] is None


def test_careers(spark):
    far = "<a href='/who'>" + "<span>x</span>" * 100 + "open positions</a>"
    html = f"<a class=k href='/team'>Come and <i>join us</i></a>{far}<a href='work_with_us'>here</a><a href='https://jobs.orchard.example/'>all</a><a href='/team/'>Careers again</a><a href='https://lever.example/jobs'>not ours</a><a href='/#jobs'>jobs</a><a href='/'>jobs</a><a href='/blog'>news</a><a>jobs</a><a href='/open-roles'>no end"
    rows = [(1, html, "https://www.orchard.example/x/"), (2, html, "ftp://orchard.example/"), (3, None, "https://a.example"), (4, html, None), (5, "<a href='/jobs'>j</a>", "pear.example/y")]
    got = sites.careers_in_pages(spark.createDataFrame(rows, "page long, html string, url string"), "page", "html", "url").orderBy("page", "place").collect()
    own = "https://www.orchard.example"
    assert [(r.page, r.url) for r in got] == [(1, f"{own}/team"), (1, f"{own}/who"), (1, f"{own}/x/work_with_us"), (1, "https://jobs.orchard.example/"), (1, f"{own}/open-roles"), (5, "https://pear.example/jobs")]


def test_first_balanced_array(spark):
    cases = {
        "I'd say [3, 4] or [5]": "[3, 4]", r'a ["]", "\"]", "\\"] b]': r'["]", "\"]", "\\"]', "x ```json\nnone\n``` [6, [7, []]] ]": "[6, [7, []]]", "```\n[8]\n``` [9]": "[8]", "so [1, 2": None, '["open]': None,
        "[NaN]": None, "[1,]": None, "": None, "none": None, "]] [0]": "[0]", "[" * 50 + "]" * 50: "[" * 50 + "]" * 50,
    }
    got = spark.createDataFrame([(k,) for k in cases] + [(None,)], "s string").select("s", jsons.extract_json(F.col("s")).alias("j")).collect()
    assert {r.s: r.j for r in got} == {**cases, None: None}
