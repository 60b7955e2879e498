"""Boards of vendors in the shapes that they serve: for each a schema of its payload, where its rows are, and what a posting's columns are made of.

Payloads are rows of (board, origin, payload), `origin` being the address under which the board's own pages live. A payload that isn't JSON, or has other fields,
gives no postings; a missing, null or differently typed field is a missing one. Nothing is joined and nothing shuffled: a payload becomes rows by one
from_json and one explode.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.dates import epoch, relative_day
from rookery.functions.text import LONE_MARKS, MARKED, PLAIN, clean, html_to_text
from rookery.functions.urls import host, path
from rookery.operators.sites import resolved
from rookery.sources.boards import day

#: The columns of every parsed vendor.
POSTING = ("board", "company", "title", "url", "location", "description", "posted_at", "pay_low", "pay_high", "currency")
_TYPES = {"posted_at": "date", "pay_low": "double", "pay_high": "double"}


def said(x: Column) -> Column:
    """The text without space around it; null if nothing is left."""
    return F.nullif(F.trim(x), F.lit(""))


def listed(*xs: Column, by: str = ", ") -> Column:
    return F.concat_ws(by, *map(said, xs))


def or_remote(place: Column, remote: Column) -> Column:
    """The place, and that it is remote where nothing in it says so."""
    return F.when(F.coalesce(remote, F.lit(False)) & ~F.coalesce(place, F.lit("")).rlike("(?i)remote"), listed(place, F.lit("Remote"))).otherwise(place)


def places(names: Column) -> Column:
    return F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")


def hyphened(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "(?i)[^a-z0-9]+", "-"), "^-+|-+$", "")


def in_path(text: Column) -> Column:
    """The text as one segment of a url."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


@dataclass(frozen=True)
class Vendor:
    schema: str
    rows: Callable[[Column], Column]
    fields: Callable[[Column, Column], dict[str, Column]]
    #: Hosts that postings' urls must have; any if empty.
    hosts: tuple[str, ...] = ()


def _bamboohr(j, origin):
    id_ = said(j["id"])
    return {"title": j["jobOpeningName"], "url": F.concat(origin, F.lit("/careers/"), in_path(id_)), "location": listed(j["location"]["city"], j["location"]["state"], F.when(j["isRemote"], "Remote"))}


def _recruitee(j, origin):
    place = F.coalesce(said(j["location"]), listed(j["city"], j["country"], F.when(j["remote"], "Remote")))
    return {"title": j["title"], "url": F.coalesce(said(j["careers_url"]), j["url"]), "location": place, "description": html_to_text(j["description"]), "posted_at": j["published_at"]}


def _pinpoint(j, origin):
    return {"title": j["title"], "url": j["url"], "location": F.coalesce(said(j["location"]["name"]), listed(j["location"]["city"], j["location"]["province"]))}


def _breezy(j, origin):
    at = j["location"]
    place = F.coalesce(said(at["name"]), listed(at["city"], at["state"], at["country"]["name"]))
    return {"title": j["name"], "url": j["url"], "location": or_remote(place, at["is_remote"]), "posted_at": j["published_date"]}


def _rippling(j, origin):
    at = j["workLocation"]  # an object with a label, or a text
    return {"title": j["name"], "url": j["url"], "location": F.when(F.trim(at).startswith("{"), F.get_json_object(at, "$.label")).otherwise(at)}


def _workable(j, origin):
    own = lambda u: F.when(host(u).isin("apply.workable.com", "jobs.workable.com"), u)
    place = F.coalesce(F.nullif(listed(j["city"], j["country"]), F.lit("")), F.when(j["telecommuting"], "Remote"))
    return {"title": j["title"], "url": F.coalesce(own(j["shortlink"]), own(j["url"])), "location": place, "description": html_to_text(j["description"]), "posted_at": F.coalesce(said(j["published_on"]), j["created_at"])}


def _smartrecruiters(j, origin):
    at, name = j["location"], hyphened(F.lower(j["name"]))
    full = F.coalesce(said(at["fullLocation"]), listed(at["city"], at["region"], at["country"]))
    ref = r"^/v1/companies/([^/]+)/postings/([^/]+)/*$"
    api = (host(j["ref"]) == "api.smartrecruiters.com") & path(j["ref"]).rlike(ref)
    company = F.when(api, F.regexp_extract(path(j["ref"]), ref, 1)).otherwise(said(F.regexp_extract(path(origin), "^/([^/]+)", 1)))
    id_ = F.when(api, F.regexp_extract(path(j["ref"]), ref, 2)).otherwise(said(j["id"]))
    url = F.concat(F.lit("https://jobs.smartrecruiters.com/"), company, F.lit("/"), id_, F.when(name != "", F.concat(F.lit("-"), name)).otherwise(""))
    return {"title": j["name"], "url": url, "location": listed(full, F.when(at["remote"], "Remote")), "posted_at": j["releasedDate"]}


def _oraclecloud(j, origin):
    at, kind = F.get(j["workLocation"], 0), j["WorkplaceTypeCode"]
    place = F.coalesce(said(j["PrimaryLocation"]), listed(at["TownOrCity"], at["Region"], at["Country"]))
    mode = F.when(kind == "ORA_REMOTE", "Remote").when(kind == "ORA_HYBRID", "Hybrid")
    url = F.coalesce(said(j["ExternalURL"]), F.concat(origin, F.lit("/job/"), F.coalesce(said(j["Id"]), said(j["RequisitionNumber"]))))
    return {"title": j["Title"], "url": url, "location": listed(place, mode, by=" · "), "description": html_to_text(j["ShortDescriptionStr"]), "posted_at": j["PostedDate"]}


def _phenom(j, origin):
    direct = F.coalesce(*(F.nullif(clean(html_to_text(j[k])), F.lit("")) for k in ("location", "cityStateCountry", "cityState")))
    parts = F.array_distinct(F.filter(F.array(*(said(j[k]) for k in ("city", "state", "country"))), lambda x: x.isNotNull()))
    title = clean(html_to_text(j["title"]))
    # letters fold to their plain ones, in either case
    plain = F.translate(F.translate(F.regexp_replace(title, LONE_MARKS, ""), MARKED, PLAIN), *_UPPER)
    name = F.coalesce(F.nullif(hyphened(plain), F.lit("")), F.lit("job"))
    url = F.concat(origin, F.lit("/job/"), in_path(said(j["jobId"])), F.lit("/"), name)
    return {"title": title, "url": url, "location": F.coalesce(direct, F.array_join(parts, ", ")), "posted_at": F.coalesce(said(j["postedDate"]), j["dateCreated"])}


_UPPER = tuple("".join(x) for x in zip(*((c.upper(), p.upper()) for c, p in zip(MARKED, PLAIN) if len(c.upper()) == 1 and c.upper() != c)))


def _getro(j, origin):
    first = lambda a: F.when(F.size(places(a)) > 0, F.array_join(places(a), ", "))
    yearly = F.lower(F.trim(F.coalesce(j["compensation_period"], F.lit("")))).isin("", "year")
    cents = lambda k: F.when(yearly & (j[k] > 0), j[k] / 100)
    low, high = cents("compensation_amount_min_cents"), cents("compensation_amount_max_cents")
    return {
        "company": F.coalesce(said(j["organization"]["name"]), j["organization_name"]), "title": j["title"], "url": j["url"], "posted_at": j["created_at"],
        "location": or_remote(F.coalesce(first(j["locations"]), first(j["searchable_locations"])), j["work_mode"] == "remote"),
        "pay_low": F.coalesce(low, high), "pay_high": F.coalesce(high, low), "currency": F.when(F.coalesce(low, high).isNotNull(), said(j["compensation_currency"])),
    }


def _consider(j, origin):
    url = resolved(F.coalesce(said(j["url"]), said(j["applyUrl"])), F.concat(origin, F.lit("/")))
    return {"company": j["companyName"], "title": j["title"], "url": url, "location": or_remote(F.array_join(places(j["locations"]), ", "), j["remote"]), "posted_at": j["timeStamp"]}


# The names of the vendors' fields.
VENDORS = {
    "bamboohr": Vendor("struct<result:array<struct<id:string,jobOpeningName:string,isRemote:boolean,location:struct<city:string,state:string>>>>", lambda p: p["result"], _bamboohr),
    "breezy": Vendor("array<struct<name:string,url:string,published_date:string,location:struct<name:string,city:string,state:string,country:struct<name:string>,is_remote:boolean>>>", lambda p: p, _breezy),
    "consider": Vendor("struct<jobs:array<struct<title:string,url:string,applyUrl:string,companyName:string,locations:array<string>,remote:boolean,timeStamp:string>>>", lambda p: p["jobs"], _consider),
    "getro": Vendor(
        "struct<results:struct<jobs:array<struct<title:string,url:string,organization:struct<name:string>,organization_name:string,locations:array<string>,searchable_locations:array<string>,work_mode:string,created_at:string,"
        "compensation_period:string,compensation_amount_min_cents:double,compensation_amount_max_cents:double,compensation_currency:string>>>>", lambda p: p["results"]["jobs"], _getro,
    ),
    "oraclecloud": Vendor(
        "struct<items:array<struct<requisitionList:array<struct<Id:string,RequisitionNumber:string,Title:string,ExternalURL:string,PrimaryLocation:string,workLocation:array<struct<TownOrCity:string,Region:string,Country:string>>,"
        "WorkplaceTypeCode:string,ShortDescriptionStr:string,PostedDate:string>>>>>", lambda p: F.get(p["items"], 0)["requisitionList"], _oraclecloud,
    ),
    "phenom": Vendor(
        "struct<refineSearch:struct<data:struct<jobs:array<struct<jobId:string,title:string,location:string,cityStateCountry:string,cityState:string,city:string,state:string,country:string,postedDate:string,dateCreated:string>>>>>",
        lambda p: p["refineSearch"]["data"]["jobs"], _phenom,
    ),
    "pinpoint": Vendor("struct<data:array<struct<title:string,url:string,location:struct<name:string,city:string,province:string>>>>", lambda p: p["data"], _pinpoint),
    "recruitee": Vendor("struct<offers:array<struct<title:string,careers_url:string,url:string,location:string,city:string,country:string,remote:boolean,description:string,published_at:string>>>", lambda p: p["offers"], _recruitee),
    "rippling": Vendor("array<struct<name:string,url:string,workLocation:string>>", lambda p: p, _rippling, ("ats.rippling.com",)),
    "smartrecruiters": Vendor("struct<content:array<struct<id:string,name:string,ref:string,releasedDate:string,location:struct<fullLocation:string,city:string,region:string,country:string,remote:boolean>>>>", lambda p: p["content"], _smartrecruiters),
    "workable": Vendor("struct<jobs:array<struct<title:string,shortlink:string,url:string,city:string,country:string,telecommuting:boolean,description:string,published_on:string,created_at:string>>>", lambda p: p["jobs"], _workable),
}


def _finished(rows: DataFrame, fields: dict[str, Column], hosts: tuple[str, ...] = ()) -> DataFrame:
    """Postings from a row each: those with a title and an https url."""
    made = fields | {"board": F.col("board"), "title": clean(fields["title"]), "url": F.trim(fields["url"]), "location": clean(fields.get("location", F.lit(""))), "posted_at": day(fields.get("posted_at", F.lit(None).cast("string")))}
    out = rows.select(*(made.get(c, F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in POSTING))
    kept = out.filter((F.col("title") != "") & F.col("url").rlike(r"^https://[^/?#\s]"))
    return kept.filter(host(F.col("url")).isin(*hosts)) if hosts else kept


def postings(payloads: DataFrame, vendor: str) -> DataFrame:
    """The postings of one vendor's payloads."""
    v = VENDORS[vendor]
    rows = payloads.select("board", "origin", F.explode(v.rows(F.from_json("payload", v.schema))).alias("j"))
    return _finished(rows, v.fields(F.col("j"), F.col("origin")), v.hosts)


# boards whose postings stand in two places


def gem(lists: DataFrame, details: DataFrame) -> DataFrame:
    """Postings of a board's list, each with what its detail adds; a posting without a detail stays, of details that repeat the last counts.

    Both are payloads of batched answers: lists [{data: {oatsExternalJobPostings: {jobPostings}}}], details [{data: {oatsExternalJobPosting}}, ...].
    """
    listed_kind = "array<struct<data:struct<oatsExternalJobPostings:struct<jobPostings:array<struct<extId:string,title:string,locations:array<struct<name:string,isRemote:boolean>>>>>>>>"
    detail_kind = "array<struct<data:struct<oatsExternalJobPosting:struct<extId:string,firstPublishedTsSec:double,descriptionHtml:string,compensationHtml:string,jobPostSectionHtml:struct<introHtml:string,outroHtml:string>>>>>"
    rows = lists.select("board", "origin", F.explode(F.get(F.from_json("payload", listed_kind), 0)["data"]["oatsExternalJobPostings"]["jobPostings"]).alias("j"))
    said_more = details.select("board", F.posexplode(F.from_json("payload", detail_kind)["data"]["oatsExternalJobPosting"]).alias("_at", "d")).filter("d.extId IS NOT NULL")
    last = said_more.groupBy(F.col("board").alias("_board"), F.col("d.extId").alias("_id")).agg(F.max_by("d", "_at").alias("d"))
    both = rows.join(last, (F.col("board") == F.col("_board")) & (F.col("j.extId") == F.col("_id")), "left")
    where = F.transform("j.locations", lambda x: listed(x["name"], F.when(x["isRemote"], "Remote"), by=" · "))
    text = F.concat_ws("\n\n", *(F.nullif(html_to_text(F.col(f"d.{k}")), F.lit("")) for k in ("jobPostSectionHtml.introHtml", "descriptionHtml", "jobPostSectionHtml.outroHtml")))
    pay = F.nullif(html_to_text(F.col("d.compensationHtml")), F.lit(""))
    whole = F.concat_ws("\n\n", F.nullif(text, F.lit("")), F.concat(F.lit("Compensation: "), pay))
    fields = {
        "title": F.col("j.title"), "url": F.concat("origin", F.lit("/"), said(F.col("j.extId"))), "location": F.array_join(F.array_distinct(F.filter(where, lambda x: x != "")), " · "),
        "description": whole, "posted_at": epoch(F.when(F.col("d.firstPublishedTsSec") > 0, F.col("d.firstPublishedTsSec"))).cast("date").cast("string"),
    }
    return _finished(both, fields)


_ITEM = r'(?s)\{"@type"\s*:\s*"ListItem"(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}'
MODES = ("Remote or Hybrid", "Remote", "Hybrid", "In-Office")


def builtin(pages: DataFrame, today: Column) -> DataFrame:
    """Postings of a list page's JSON-LD items, each with what the card of the same number says of company, place, pay and age; an item without a card stays.

    Pages are rows of (board, payload). A card begins at its title anchor; its company is the last company link before that. Several places stand in a tooltip.
    Only bands a year are pay; a mode without a place counts only where it says remote.
    """
    items = pages.select("board", F.explode(F.transform(F.regexp_extract_all("payload", F.lit(_ITEM), F.lit(0)), lambda x: F.from_json(x, "name string, url string, description string"))).alias("j"))
    pieces = F.split("payload", 'data-id="job-card-title"')
    cut = pages.select("board", F.posexplode(F.transform(pieces, lambda p, i: F.struct(F.when(i > 0, F.get(pieces, i - 1)).alias("before"), p.alias("card")))).alias("_at", "p")).filter("_at > 0")
    after = lambda icon: clean(html_to_text(F.regexp_extract("p.card", rf"(?s){icon}.{{0,600}}?>(\s*[^<>\s][^<>]*)<", 1)))
    companies = F.regexp_extract_all("p.before", F.lit(r'(?s)<a[^>]+href="/company/[^"]*"[^>]*>(.*?)</a>'), F.lit(1))
    mode, where, pay = after("fa-house-building"), after("fa-location-dot"), after("fa-sack-dollar")
    band = r"(?i)^([0-9]+(?:\.[0-9]+)?)K(?:-([0-9]+(?:\.[0-9]+)?)K)?\s+Annually$"
    tooltip = F.regexp_replace(F.regexp_extract("p.card", r'aria-label="Job locations"[^>]*data-bs-title="([^"]*)"', 1), "&lt;", "<")
    several = F.filter(F.transform(F.split(F.replace(tooltip, F.lit("&gt;"), F.lit(">")), r"(?i)</div>|<br\s*/?>"), lambda x: clean(html_to_text(x))), lambda x: x != "")
    known = F.get(F.filter(F.array(*map(F.lit, MODES)), lambda m: F.lower(m) == F.lower(mode)), 0)
    spots = F.when((where != "") & ~where.rlike(r"(?i)^[0-9]+\s+locations?$"), F.array(where)).otherwise(several)
    location = F.when(F.size(spots) > 0, F.concat_ws(" · ", known, F.array_join(spots, " · "))).otherwise(F.when(known.rlike("(?i)remote"), known))
    k = lambda i: F.regexp_extract(pay, band, i).try_cast("double") * 1000
    cards = cut.select(
        F.col("board").alias("_board"), "_at", F.regexp_extract("p.card", r'data-builtin-track-job-id="([0-9]+)"', 1).alias("_id"),
        F.struct(clean(html_to_text(F.try_element_at(companies, F.lit(-1)))).alias("company"), location.alias("location"), k(1).alias("low"), F.coalesce(k(2), k(1)).alias("high"), relative_day(F.regexp_replace(F.regexp_replace(after("fa-clock"), r"(?i)^reposted |\+", ""), "(?i)minute", "hour"), today).alias("day")).alias("c"),
    ).filter("_id <> ''").groupBy("_board", "_id").agg(F.max_by("c", "_at").alias("c"))
    number = F.regexp_extract("j.url", r"/([0-9]+)(?:[/?#]|$)", 1)
    both = items.withColumn("_number", number).join(cards, (F.col("board") == F.col("_board")) & (F.col("_number") == F.col("_id")), "left")
    fields = {"company": F.col("c.company"), "title": F.col("j.name"), "url": F.col("j.url"), "location": F.col("c.location"), "description": F.col("j.description"), "posted_at": F.col("c.day").cast("string"), "pay_low": F.col("c.low"), "pay_high": F.col("c.high")}
    # a posting shows up in several lists of a board: one row each
    return _finished(both, fields).dropDuplicates(["board", "url"])


def drift(rows: DataFrame, least_rows: int = 5, least_located: float = 0.5) -> DataFrame:
    """(board, rows, cards, located, warning): boards whose cards no longer parse ('cards'), or seldom give a place ('places'); null where all is well or rows are few."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    counted = rows.groupBy("board").agg(F.count(F.lit(1)).alias("rows"), F.count_if(has("company") | has("location")).alias("cards"), F.count_if(has("location")).alias("located"))
    few = (F.col("cards") >= least_rows) & (F.col("located") < least_located * F.col("cards"))
    return counted.withColumn("warning", F.when(F.col("rows") >= least_rows, F.when(F.col("cards") == 0, "cards").when(few, "places")))
