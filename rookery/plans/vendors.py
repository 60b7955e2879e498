"""Queries of boards in the shapes of their vendors: parts become payloads with nested, dated and missing fields, and are parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.plans.registry import query, table
from rookery.sources import boards, vendors

# a board holds 50 parts, so the number of payloads grows with the table and none grows beyond that
_BASE = """WITH p AS (SELECT 'b' || (p_partkey // 50) AS board, p_partkey AS k, CASE WHEN p_partkey % 13 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS city, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS region,
  p_partkey % 4 = 0 AS remote, CASE WHEN p_partkey % 3 <> 0 THEN DATE '2024-01-01' + p_size::INT END AS day FROM part) """
_SLUG = "trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-')"
_REMOTE = "CASE WHEN remote THEN 'Remote' END"


def _parts(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("b"), F.floor(k / 50).cast("string")).alias("board"), F.concat(F.lit("https://b"), F.floor(k / 50).cast("string"), F.lit(".example.com")).alias("origin"), k.alias("k"),
        F.when(k % 13 != 0, F.col("p_name")).alias("title"), F.when(k % 5 != 0, F.col("p_brand")).alias("city"), F.when(k % 7 != 0, F.col("p_type")).alias("region"), (k % 4 == 0).alias("remote"),
        F.when(k % 3 != 0, F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int"))).alias("day"), k.cast("string").alias("id"),
    )


def _named(**fields):
    return F.struct(*(v.alias(n) for n, v in fields.items()))


def _payloads(parts, row, wrap=lambda rows: rows):
    return parts.groupBy("board", "origin").agg(F.to_json(wrap(F.collect_list(row))).alias("payload"))


def _shown(df):
    return df.select("board", "title", "url", "location", "posted_at")


def _url(at):
    return F.concat(F.lit(at), F.col("id"))


_C, _T = F.col, lambda x: F.date_format("day", x)


@query("vendor_bamboohr", _BASE + f"SELECT board, title, 'https://' || board || '.example.com/careers/' || k AS url, concat_ws(', ', city, region, {_REMOTE}) AS location, NULL::DATE AS posted_at FROM p WHERE title IS NOT NULL")
def bamboohr(spark, sf_dir):
    row = _named(id=_C("k"), jobOpeningName=_C("title"), isRemote=_C("remote"), location=_named(city=_C("city"), state=_C("region")))
    return _shown(vendors.postings(_payloads(_parts(spark, sf_dir), row, lambda r: _named(meta=F.lit(1), result=r)), "bamboohr"))


@query("vendor_breezy", _BASE + f"SELECT board, title, 'https://b.breezy.hr/p/' || k AS url, concat_ws(', ', CASE WHEN k % 2 = 0 THEN region END, CASE WHEN k % 2 = 1 OR region IS NULL THEN concat_ws(', ', city, 'Utopia') END, {_REMOTE}) AS location, day AS posted_at FROM p WHERE title IS NOT NULL AND k % 11 <> 0")
def breezy(spark, sf_dir):
    """The place's own name, else its parts; every eleventh url is not https."""
    at = _named(name=F.when(_C("k") % 2 == 0, _C("region")), city=_C("city"), country=_named(name=F.lit("Utopia")), is_remote=_C("remote"))
    row = _named(name=_C("title"), url=F.when(_C("k") % 11 == 0, _url("http://b.breezy.hr/p/")).otherwise(_url("https://b.breezy.hr/p/")), location=at, published_date=_T("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return _shown(vendors.postings(_payloads(_parts(spark, sf_dir), row), "breezy"))


@query("vendor_consider", _BASE + f"SELECT board, title, CASE WHEN k % 2 = 0 THEN 'https://' || board || '.example.com' ELSE 'https://x.example.com' END || '/jobs/' || k AS url, concat_ws(', ', city, region, {_REMOTE}) AS location, day AS posted_at FROM p WHERE title IS NOT NULL")
def consider(spark, sf_dir):
    """Several places and a remote flag; urls relative to the board's site half of the time; milliseconds."""
    row = _named(title=_C("title"), applyUrl=F.when(_C("k") % 2 == 0, _url("/jobs/")), url=F.when(_C("k") % 2 == 1, _url("https://x.example.com/jobs/")), companyName=F.lit("C"), locations=F.array("city", "region"), remote=_C("remote"), timeStamp=F.unix_timestamp(_C("day").cast("timestamp")) * 1000)
    return _shown(vendors.postings(_payloads(_parts(spark, sf_dir), row, lambda r: _named(jobs=r)), "consider"))


@query("vendor_getro", _BASE + f"SELECT board, 'Company ' || board AS company, title, 'https://x.example.com/' || k AS url, concat_ws(', ', city, region, {_REMOTE}) AS location, day AS posted_at, CASE WHEN k % 2 = 0 THEN 1000.0 * k END::DOUBLE AS pay_low, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 6 = 0 THEN 2000.0 ELSE 1000.0 END * k END::DOUBLE AS pay_high FROM p WHERE title IS NOT NULL")
def getro(spark, sf_dir):
    """The posting company's own name, places or else searchable ones, pay in cents, by the year only; seconds."""
    some = (_C("city").isNotNull() | _C("region").isNotNull()) & (_C("k") % 2 == 0)
    row = _named(title=_C("title"), url=_url("https://x.example.com/"), organization=_named(name=F.concat(F.lit("Company "), "board")), locations=F.when(some, F.array("city", "region")).otherwise(F.array().cast("array<string>")), searchable_locations=F.array("city", "region"), work_mode=F.when(_C("remote"), "remote").otherwise("on_site"), created_at=F.unix_timestamp(_C("day").cast("timestamp")),
                 compensation_period=F.when(_C("k") % 2 == 0, "year").otherwise("hour"), compensation_amount_min_cents=_C("k") * 100_000, compensation_amount_max_cents=F.when(_C("k") % 6 == 0, _C("k") * 200_000), compensation_currency=F.lit("EUR"))
    found = vendors.postings(_payloads(_parts(spark, sf_dir), row, lambda r: _named(results=_named(jobs=r))), "getro")
    return found.select("board", "company", "title", "url", "location", "posted_at", "pay_low", "pay_high")


@query("vendor_oraclecloud", _BASE + "SELECT board, title, CASE WHEN k % 6 = 0 THEN 'https://x.example.com/' ELSE 'https://' || board || '.example.com/job/' END || k AS url, concat_ws(' · ', CASE WHEN city IS NOT NULL THEN city WHEN region IS NOT NULL THEN region || ', UT' ELSE 'UT' END, CASE WHEN remote THEN 'Remote' END) AS location, day AS posted_at FROM p WHERE title IS NOT NULL")
def oraclecloud(spark, sf_dir):
    """Rows two levels down; the url made from the number where no other is given; the primary place or the first one's parts."""
    row = _named(Id=F.when(_C("k") % 2 == 0, _C("k")), RequisitionNumber=_C("id"), Title=_C("title"), ExternalURL=F.when(_C("k") % 6 == 0, _url("https://x.example.com/")), PrimaryLocation=_C("city"), workLocation=F.array(_named(Region=_C("region"), Country=F.lit("UT"))), WorkplaceTypeCode=F.when(_C("remote"), "ORA_REMOTE"), PostedDate=_T("yyyy-MM-dd"))
    return _shown(vendors.postings(_payloads(_parts(spark, sf_dir), row, lambda r: _named(items=F.array(_named(TotalJobsCount=F.size(r), requisitionList=r)))), "oraclecloud"))


@query("vendor_phenom", _BASE + "SELECT board, title, 'https://' || board || '.example.com/job/' || k || '/' || regexp_replace(trim(regexp_replace(title, '[^A-Za-z0-9]+', '-', 'g'), '-'), '^$', 'job') AS url, CASE WHEN k % 2 = 0 AND city IS NOT NULL THEN city ELSE concat_ws(', ', region, 'Utopia') END AS location, day AS posted_at FROM p WHERE title IS NOT NULL")
def phenom(spark, sf_dir):
    """Rows three levels down; the url made of number and title."""
    row = _named(jobId=_C("k"), title=F.concat(F.lit("<b>"), "title", F.lit("</b>")), cityStateCountry=F.when(_C("k") % 2 == 0, _C("city")), city=_C("region"), state=_C("region"), country=F.lit("Utopia"), postedDate=_T("yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'"))
    return _shown(vendors.postings(_payloads(_parts(spark, sf_dir), row, lambda r: _named(refineSearch=_named(totalHits=F.size(r), data=_named(jobs=r)))), "phenom"))


@query("vendor_pinpoint", _BASE + "SELECT board, title, 'https://b.pinpointhq.com/' || k AS url, coalesce(CASE WHEN k % 2 = 0 THEN region END, concat_ws(', ', city, 'UT')) AS location, NULL::DATE AS posted_at FROM p WHERE title IS NOT NULL")
def pinpoint(spark, sf_dir):
    row = _named(title=_C("title"), url=_url("https://b.pinpointhq.com/"), location=_named(name=F.when(_C("k") % 2 == 0, _C("region")), city=_C("city"), province=F.lit("UT")))
    return _shown(vendors.postings(_payloads(_parts(spark, sf_dir), row, lambda r: _named(data=r)), "pinpoint"))


@query("vendor_recruitee", _BASE + f"SELECT board, title, 'https://x.example.com/o/' || k AS url, CASE WHEN k % 2 = 0 AND region IS NOT NULL THEN region ELSE concat_ws(', ', city, 'Utopia', {_REMOTE}) END AS location, day AS posted_at FROM p WHERE title IS NOT NULL")
def recruitee(spark, sf_dir):
    row = _named(title=_C("title"), careers_url=F.when(_C("k") % 3 == 0, _url("https://x.example.com/o/")), url=_url("https://x.example.com/o/"), location=F.when(_C("k") % 2 == 0, _C("region")), city=_C("city"), country=F.lit("Utopia"), remote=_C("remote"), published_at=_T("yyyy-MM-dd HH:mm:ss"))
    return _shown(vendors.postings(_payloads(_parts(spark, sf_dir), row, lambda r: _named(offers=r)), "recruitee"))


@query("vendor_rippling", _BASE + "SELECT board, title, 'https://ats.rippling.com/b/jobs/' || k AS url, coalesce(CASE WHEN k % 2 = 0 THEN region ELSE city END, '') AS location, NULL::DATE AS posted_at FROM p WHERE title IS NOT NULL AND k % 11 <> 0")
def rippling(spark, sf_dir):
    """The place is an object with a label or a text, in payloads of their own; every eleventh url is on another host."""
    parts = _parts(spark, sf_dir).withColumn("board", F.concat("board", F.when(_C("k") % 2 == 0, "").otherwise("")))
    url = F.when(_C("k") % 11 == 0, _url("https://evil.example.com/")).otherwise(_url("https://ats.rippling.com/b/jobs/"))
    objects = _payloads(parts.filter("k % 2 = 0"), _named(name=_C("title"), url=url, workLocation=_named(label=_C("region"), id=_C("id"))))
    texts = _payloads(parts.filter("k % 2 = 1"), _named(name=_C("title"), url=url, workLocation=_C("city")))
    return _shown(vendors.postings(objects.unionByName(texts), "rippling"))


@query("vendor_smartrecruiters", _BASE + f"SELECT board, title, 'https://jobs.smartrecruiters.com/' || CASE WHEN k % 2 = 0 THEN 'Acme' ELSE 'Own' END || '/' || k || '-' || {_SLUG} AS url, concat_ws(', ', CASE WHEN k % 2 = 0 THEN region END, CASE WHEN k % 2 = 1 OR region IS NULL THEN concat_ws(', ', city, 'ut') END, {_REMOTE}) AS location, day AS posted_at FROM p WHERE title IS NOT NULL")
def smartrecruiters(spark, sf_dir):
    """The posting's own page from the link to the interface, or from board and number."""
    at = _named(fullLocation=F.when(_C("k") % 2 == 0, _C("region")), city=_C("city"), country=F.lit("ut"), remote=_C("remote"))
    row = _named(id=_C("id"), name=_C("title"), ref=F.when(_C("k") % 2 == 0, _url("https://api.smartrecruiters.com/v1/companies/Acme/postings/")), location=at, releasedDate=_T("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return _shown(vendors.postings(_payloads(_parts(spark, sf_dir).withColumn("origin", F.lit("https://jobs.smartrecruiters.com/Own")), row, lambda r: _named(content=r)), "smartrecruiters"))


@query("vendor_workable", _BASE + "SELECT board, title, 'https://apply.workable.com/' || CASE WHEN k % 2 = 0 THEN 'j/' ELSE 'long/' END || k AS url, CASE WHEN city IS NULL AND region IS NULL THEN CASE WHEN remote THEN 'Remote' ELSE '' END ELSE concat_ws(', ', city, region) END AS location, day AS posted_at FROM p WHERE title IS NOT NULL")
def workable(spark, sf_dir):
    row = _named(title=_C("title"), shortlink=F.when(_C("k") % 2 == 0, _url("https://apply.workable.com/j/")).otherwise(_url("https://elsewhere.example.com/")), url=_url("https://apply.workable.com/long/"), city=_C("city"), country=_C("region"), telecommuting=_C("remote"), published_on=F.when(_C("k") % 2 == 0, _T("yyyy-MM-dd")), created_at=_T("yyyy-MM-dd"))
    return _shown(vendors.postings(_payloads(_parts(spark, sf_dir), row, lambda r: _named(jobs=r)), "workable"))


@query("flat_boards", _BASE + "SELECT board, vendor, title, url, location FROM (SELECT 'pinpoint' AS vendor, board, title, 'https://x.example.com/' || k AS url, coalesce(city, '') AS location, k FROM p WHERE k % 2 = 0 UNION ALL SELECT 'rippling', board, title, 'https://ats.rippling.com/' || k, coalesce(city, ''), k FROM p WHERE k % 2 = 1) WHERE title IS NOT NULL")
def flat_boards(spark, sf_dir):
    """Boards of several vendors as one table of postings."""
    parts = _parts(spark, sf_dir)
    one = _payloads(parts.filter("k % 2 = 0"), _named(title=_C("title"), url=_url("https://x.example.com/"), location=_named(city=_C("city"))), lambda r: _named(data=r))
    two = _payloads(parts.filter("k % 2 = 1"), _named(name=_C("title"), url=_url("https://ats.rippling.com/"), workLocation=_C("city")))
    each = [vendors.postings(p, v).withColumn("vendor", F.lit(v)) for p, v in ((one, "pinpoint"), (two, "rippling"))]
    return each[0].unionByName(each[1]).select("board", "vendor", "title", "url", "location")


@query("vendor_gem", _BASE + "SELECT board, title, 'https://' || board || '.example.com/' || k AS url, concat_ws(' · ', city, CASE WHEN remote THEN 'Remote' END, CASE WHEN region <> city OR city IS NULL THEN region END) AS location, CASE WHEN k % 4 <> 1 THEN CASE WHEN k % 8 = 0 THEN 'second' ELSE 'first' END ELSE '' END AS description, CASE WHEN k % 4 <> 1 THEN day END AS posted_at FROM p WHERE title IS NOT NULL AND k % 10 <> 9")
def gem(spark, sf_dir):
    """A list joined to its details by key: details missing, repeated (the last counts), without a list's row, and rows without a key."""
    parts = _parts(spark, sf_dir)
    row = _named(extId=F.when(_C("k") % 10 != 9, _C("id")), title=_C("title"), locations=F.array(_named(name=_C("city"), isRemote=_C("remote")), _named(name=_C("region"), isRemote=F.lit(False))))
    lists = _payloads(parts, row, lambda r: F.array(_named(data=_named(oatsExternalJobPostings=_named(jobPostings=r)))))
    detail = lambda text: _named(data=_named(oatsExternalJobPosting=_named(extId=_C("id"), firstPublishedTsSec=F.unix_timestamp(_C("day").cast("timestamp")), descriptionHtml=F.concat(F.lit("<p>"), F.lit(text), F.lit("</p>")))))
    known = parts.filter("k % 4 <> 1")
    ordered = known.groupBy("board", "origin").agg(F.to_json(F.concat(F.collect_list(detail("first")), F.array(_named(data=_named(oatsExternalJobPosting=_named(extId=F.lit("none"), firstPublishedTsSec=F.lit(1).cast("bigint"), descriptionHtml=F.lit("x"))))), F.collect_list(F.when(_C("k") % 8 == 0, detail("second"))))).alias("payload"))
    return vendors.gem(lists, ordered).select("board", "title", "url", "location", F.coalesce("description", F.lit("")).alias("description"), "posted_at")


_CARD = "CASE WHEN k % 9 <> 0 THEN"


@query("vendor_builtin", _BASE + f"""SELECT board, coalesce({_CARD} 'Company ' || k END, '') AS company, title, 'https://builtin.example.com/job/x/' || k AS url,
  coalesce({_CARD} CASE WHEN k % 2 = 0 THEN concat_ws(' · ', CASE WHEN remote THEN 'Remote' ELSE 'Hybrid' END, CASE WHEN city IS NULL AND region IS NULL THEN NULL ELSE concat_ws(' · ', city, region) END) ELSE coalesce('Hybrid · ' || city, '') END END, '') AS location,
  {_CARD} DATE '2024-06-01' - (k % 20 + 1)::INT END AS posted_at, {_CARD} CASE WHEN k % 3 = 0 THEN 1000.0 * (k % 100 + 1) END END::DOUBLE AS pay_low, {_CARD} CASE WHEN k % 3 = 0 THEN 1000.0 * (k % 100 + 21) END END::DOUBLE AS pay_high
  FROM p WHERE title IS NOT NULL AND NOT (k % 2 = 0 AND city IS NULL AND region IS NULL)""")
def builtin(spark, sf_dir):
    """List items joined to the page's cards by number; every ninth has no card; one place as text, several in a tooltip."""
    parts = _parts(spark, sf_dir).filter(~((_C("k") % 2 == 0) & _C("city").isNull() & _C("region").isNull()))
    item = F.concat(F.lit('{"@type":"ListItem","position":1,"name":'), F.to_json(F.array(F.coalesce("title", F.lit("")))).substr(F.lit(2), F.length(F.to_json(F.array(F.coalesce("title", F.lit(""))))) - 2), F.lit(',"url":"https://builtin.example.com/job/x/'), "id", F.lit('","description":"d"}'))
    field = lambda icon, value: F.concat(F.lit(f'<i class="fa {icon}"></i><div> <span>'), value, F.lit("</span></div>"))
    several = F.concat(F.lit('<i class="fa fa-location-dot"></i><span aria-label="Job locations" data-bs-title="'), F.concat_ws("", *(F.concat(F.lit("&lt;div&gt;"), c, F.lit("&lt;/div&gt;")) for c in ("city", "region"))), F.lit('">2 Locations</span>'))
    where = F.when(_C("k") % 2 == 0, several).otherwise(F.coalesce(field("fa-location-dot", _C("city")), F.lit("")))
    pay = F.when(_C("k") % 3 == 0, field("fa-sack-dollar", F.concat((_C("k") % 100 + 1).cast("string"), F.lit("K-"), (_C("k") % 100 + 21).cast("string"), F.lit("K Annually")))).otherwise(field("fa-sack-dollar", F.lit("115K-130K Hourly")))
    card = F.concat(F.lit('<a class="c" href="/company/x"><span>Company '), "id", F.lit('</span></a><a data-id="job-card-title" data-builtin-track-job-id="'), "id", F.lit('">t</a>'), field("fa-clock", F.concat(F.lit("Reposted "), (_C("k") % 20 + 1).cast("string"), F.lit(" Days Ago"))), field("fa-house-building", F.when(_C("remote"), "Remote").otherwise("Hybrid")), where, pay)
    pages = parts.groupBy("board").agg(F.concat(F.lit('<script>{"itemListElement":['), F.concat_ws(",", F.collect_list(item)), F.lit("]}</script>"), F.concat_ws("", F.collect_list(F.when(_C("k") % 9 != 0, card)))).alias("payload"))
    found = vendors.builtin(pages, F.lit("2024-06-01").cast("date"))
    return found.select("board", F.coalesce("company", F.lit("")).alias("company"), "title", "url", "location", "posted_at", "pay_low", "pay_high")


@query("board_days", _BASE + "SELECT board, count(day) AS dated, min(day) AS first_day, max(day) AS last_day FROM p GROUP BY 1")
def board_days(spark, sf_dir):
    """Days of boards in seconds, milliseconds, time stamps and mail dates alike."""
    s = F.unix_timestamp(_C("day").cast("timestamp"))
    form = F.get(F.array(s.cast("string"), (s * 1000).cast("string"), _T("yyyy-MM-dd'T'HH:mm:ssXXX"), _T("EEE, dd MMM yyyy HH:mm:ss Z")), (_C("k") % 4).cast("int"))
    days = _parts(spark, sf_dir).select("board", boards.day(form).alias("day"))
    return days.groupBy("board").agg(F.count("day").alias("dated"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
