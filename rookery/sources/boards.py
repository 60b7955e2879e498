"""Board payloads as postings: one projection for each shape of payload, over a table of (board, payload) rows that Spark has read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.dates import epoch, iso_date
from rookery.functions.text import clean, html_to_text

#: The columns of every parsed board.
POSTING = ("board", "title", "url", "location", "description", "posted_at")


def day(text: Column) -> Column:
    """The day of an epoch in seconds or milliseconds, a date or time stamp, or an RFC 822 date; null for anything else."""
    number = F.when(text.rlike(r"^\s*[0-9]{9,13}(\.[0-9]+)?\s*$"), epoch(text.try_cast("double")))
    mail = F.regexp_extract(text, r"^\s*(?:[A-Za-z]{3},\s*)?([0-9]{1,2} [A-Za-z]{3} [0-9]{4})\b", 1)
    start = F.regexp_extract(text, r"^\s*([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return F.coalesce(number.cast("date"), F.try_to_date(start, "yyyy-MM-dd"), F.try_to_date(mail, "d MMM yyyy"), F.try_to_date(iso_date(text), "yyyy-MM-dd"))


def _postings(df: DataFrame, title: Column, url: Column, location: Column, description: Column, posted_at: Column) -> DataFrame:
    """Rows without a title or an http url are no postings."""
    out = df.select("board", clean(title).alias("title"), F.trim(url).alias("url"), F.coalesce(clean(location), F.lit("")).alias("location"), description.alias("description"), day(posted_at).alias("posted_at"))
    return out.filter((F.col("title") != "") & F.col("url").rlike("(?i)^https?://"))


def greenhouse(payloads: DataFrame) -> DataFrame:
    """{jobs: [{title, absolute_url, location: {name}, content (HTML, escaped twice), first_published}]}"""
    kind = "struct<jobs:array<struct<title:string,absolute_url:string,location:struct<name:string>,content:string,first_published:string>>>"
    j = payloads.select("board", F.explode(F.from_json("payload", kind)["jobs"]).alias("j"))
    return _postings(j, F.col("j.title"), F.col("j.absolute_url"), F.col("j.location.name"), html_to_text(html_to_text(F.col("j.content"))), F.col("j.first_published"))


def lever(payloads: DataFrame) -> DataFrame:
    """[{text, hostedUrl, categories: {location, allLocations}, descriptionPlain, createdAt (ms)}]"""
    kind = "array<struct<text:string,hostedUrl:string,categories:struct<location:string,allLocations:array<string>>,descriptionPlain:string,createdAt:bigint>>"
    j = payloads.select("board", F.explode(F.from_json("payload", kind)).alias("j"))
    places = F.coalesce(F.nullif(F.array_join("j.categories.allLocations", "; "), F.lit("")), F.col("j.categories.location"))
    return _postings(j, F.col("j.text"), F.col("j.hostedUrl"), places, F.col("j.descriptionPlain"), F.col("j.createdAt").cast("string"))


def ashby(payloads: DataFrame) -> DataFrame:
    """{jobs: [{title, jobUrl, location, isRemote, secondaryLocations: [{location}], descriptionPlain, publishedAt}]}"""
    kind = "struct<jobs:array<struct<title:string,jobUrl:string,location:string,isRemote:boolean,secondaryLocations:array<struct<location:string>>,descriptionPlain:string,publishedAt:string>>>"
    j = payloads.select("board", F.explode(F.from_json("payload", kind)["jobs"]).alias("j"))
    more = F.coalesce(F.col("j.secondaryLocations.location"), F.array().cast("array<string>"))
    places = F.array_distinct(F.concat(F.array("j.location"), more, F.when(F.col("j.isRemote"), F.array(F.lit("Remote"))).otherwise(F.array().cast("array<string>"))))
    return _postings(j, F.col("j.title"), F.col("j.jobUrl"), F.array_join(places, " · "), F.col("j.descriptionPlain"), F.col("j.publishedAt"))


def xml_items(payloads: DataFrame, item: str, fields: dict[str, str]) -> DataFrame:
    """Feeds of XML items (RSS, positions): one element a posting, its fields as simple child elements, CDATA or text."""
    cut = payloads.select("board", F.explode(F.regexp_extract_all("payload", F.lit(rf"(?s)<{item}(?:\s[^>]*)?>(.*?)</{item}>"), F.lit(1))).alias("x"))
    field = lambda n: F.regexp_replace(F.regexp_extract("x", rf"(?s)<{n}(?:\s[^>]*)?>\s*(.*?)\s*</{n}>", 1), r"(?s)^<!\[CDATA\[|\]\]>$", "")
    return _postings(cut, *(field(fields[x]) for x in ("title", "url", "location")), html_to_text(field(fields["description"])), field(fields["posted_at"]))


XML_BOARDS = {
    "personio": ("position", {"title": "name", "url": "url", "location": "office", "description": "jobDescriptions", "posted_at": "createdAt"}),
    "jobvite": ("job", {"title": "title", "url": "detail-url", "location": "location", "description": "description", "posted_at": "date"}),
    "teamtailor": ("item", {"title": "title", "url": "link", "location": "location", "description": "description", "posted_at": "pubDate"}),
}


def comment_header(text: Column) -> Column:
    """(company, role, location, url) of a comment whose first line is "Company | Role | Location | ..."; null without two parts."""
    parts = F.transform(F.split(F.split(text, r"\n|<p>", 2)[0], r"\s*\|\s*"), lambda p: F.trim(p))
    url = F.nullif(F.regexp_extract(text, r"https?://[^\s\"'<>|]+", 0), F.lit(""))
    return F.when(F.size(parts) >= 2, F.struct(parts[0].alias("company"), parts[1].alias("role"), F.get(parts, 2).alias("location"), url.alias("url")))


def html_cards(payloads: DataFrame, block: str, title: str, url: str, location: str) -> DataFrame:
    """Boards of HTML cards: `block` captures a card, the others their part of it."""
    cut = payloads.select("board", F.explode(F.regexp_extract_all("payload", F.lit(block), F.lit(1))).alias("x"))
    part = lambda p: html_to_text(F.regexp_extract("x", p, 1))
    return _postings(cut, part(title), F.regexp_extract("x", url, 1), part(location), F.lit(None).cast("string"), F.lit(None).cast("string"))
