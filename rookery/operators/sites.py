"""What pages link to: the boards that they name anywhere, and the careers pages of their own site.

Both explode a page into its mentions or anchors, judge each row by column expressions and group them by page, so a page with very many links is rows and not one value.
Null pages have none. Columns are named by the caller; others are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.text import html_to_text
from rookery.functions.urls import bound, parts

# Domains of vendors, where their boards' names stand, and names that are parts of the vendors' own sites.
#: vendor: (pattern of the host, pattern of what stands before the name in the path; None where the name is the host's label, the board's url)
PLACES = {
    "ashby": (r"jobs\.ashbyhq\.com", "/", "https://jobs.ashbyhq.com/{}"),
    "bamboohr": (r"[a-z0-9-]+\.bamboohr\.com", None, "https://{}.bamboohr.com/careers"),
    "breezy": (r"[a-z0-9-]+\.breezy\.hr", None, "https://{}.breezy.hr"),
    "gem": (r"jobs\.gem\.com", "/", "https://jobs.gem.com/{}"),
    "greenhouse": (r"(?:boards-api|(?:job-boards|boards)(?:\.eu)?)\.greenhouse\.io", r"/(?:v1/boards/|embed/job_board(?:/js)?\?for=)?", "https://job-boards.greenhouse.io/{}"),
    "jazzhr": (r"[a-z0-9-]+\.applytojob\.com", None, "https://{}.applytojob.com/apply"),
    "jobvite": (r"jobs\.jobvite\.com", "/", "https://jobs.jobvite.com/{}"),
    "lever": (r"jobs\.lever\.co", "/", "https://jobs.lever.co/{}"),
    "personio": (r"[a-z0-9-]+\.jobs\.personio\.(?:com|de)", None, "https://{}.jobs.personio.com"),
    "pinpoint": (r"[a-z0-9-]+\.pinpointhq\.com", None, "https://{}.pinpointhq.com"),
    "recruitee": (r"[a-z0-9-]+\.recruitee\.com", None, "https://{}.recruitee.com"),
    "rippling": (r"ats\.rippling\.com", r"/(?:[a-z]{2}-[a-z]{2}/)?", "https://ats.rippling.com/{}/jobs"),
    "smartrecruiters": (r"(?:jobs|careers)\.smartrecruiters\.com", "/", "https://jobs.smartrecruiters.com/{}"),
    "teamtailor": (r"[a-z0-9-]+\.teamtailor\.com", None, "https://{}.teamtailor.com/jobs"),
    "workable": (r"apply\.workable\.com", "/", "https://apply.workable.com/{}"),
    "workday": (r"[a-z0-9-]+\.wd[0-9]{1,2}\.myworkdayjobs\.com", r"/(?:[a-z]{2}(?:-[a-z]{2})?/)?", "https://{}/{}"),
}
#: Names that no board has, in the order of the alphabet.
RESERVED = (
    "about", "api", "app", "apply", "assets", "blog", "career", "careers", "cdn", "docs", "embed", "en", "go", "help", "images", "img", "integrations", "j", "job", "jobs", "login", "marketplace",
    "my", "partners", "posting-api", "privacy", "search", "secure", "signup", "static", "status", "support", "terms", "v0", "v1", "widget", "www",
)
RESERVED_OF = {"teamtailor": ("eu", "na")}

_MENTION = "(?i)((?:" + "|".join(f"(?<![a-z0-9.-]){host}" for host, _, _ in PLACES.values()) + r")(?![a-z0-9-]|\.[a-z0-9])(?:[/?][^\s\"'<>\\]*)?)"
_SLUG = r"([a-z0-9](?:[a-z0-9._-]|%[0-9a-f]{2}){0,80})"


def plain_slashes(html: Column) -> Column:
    """The text with slashes and ampersands that scripts and attributes escape written out."""
    return F.regexp_replace(F.regexp_replace(html, r"(?i)\\u002f|\\/|&#x2f;|&#47;|%2f", "/"), "(?i)&amp;", "&")


def _board(mention: Column) -> Column:
    """(vendor, slug, careers_url) of a host and path; null where it names no board."""

    def said(m: Column) -> Column:
        host, path = m["host"], m["path"]
        found = F.lit(None)
        for vendor, (pattern, before, url) in PLACES.items():
            taken = (*RESERVED, *RESERVED_OF.get(vendor, ()))
            if vendor == "workday":
                site = F.regexp_extract(path, rf"(?i)^{before}(?![a-z]{{2}}(?:-[a-z]{{2}})?(?:[/?#]|$))([a-z0-9_-]{{1,80}})(?=[/?#]|$)", 1)
                slug = F.concat_ws("|", F.split(host, r"\.")[0], F.get(F.split(host, r"\."), 1), site)
                board, full = F.when(site != "", slug), F.format_string(url.replace("{}", "%s"), host, site)
            else:
                named = F.try_element_at(F.split(host, r"\."), F.lit(-3 if vendor != "personio" else -4)) if before is None else F.try_url_decode(F.regexp_extract(path, rf"(?i)^{before}{_SLUG}", 1))
                slug = F.regexp_replace(F.regexp_replace(named, "(?s)[?#&=].*$", ""), "[._-]+$", "")
                board = F.when(slug != "", slug)
                full = F.format_string(url.replace("{}", "%s"), slug if before is None else F.replace(F.url_encode(slug), F.lit("+"), F.lit("%20")))
            one = F.struct(F.lit(vendor).alias("vendor"), board.alias("slug"), full.alias("careers_url"))
            found = F.when(host.rlike(f"^{pattern}$"), F.when(~F.lower(board).isin(*taken), one)).otherwise(found)
        return found

    cut = F.struct(F.lower(F.regexp_extract(mention, "^[^/?]+", 0)).alias("host"), F.regexp_extract(mention, r"^[^/?]+(.*)$", 1).alias("path"))
    return bound(cut, said)


def boards_in_pages(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, vendor, slug, careers_url, count): each board that a page names, in links, scripts or escaped texts, and how often; the spelling of the first mention stays."""
    mentions = pages.select(F.col(id_col), F.posexplode(F.regexp_extract_all(plain_slashes(F.col(html_col)), F.lit(_MENTION), F.lit(1))).alias("_at", "_mention"))
    named = mentions.select(id_col, "_at", _board(F.col("_mention")).alias("_b")).filter(F.col("_b").isNotNull())
    one = named.groupBy(id_col, F.lower("_b.careers_url").alias("_key")).agg(F.min(F.struct("_at", "_b"))["_b"].alias("_b"), F.count(F.lit(1)).alias("count"))
    return one.select(id_col, "_b.vendor", "_b.slug", "_b.careers_url", "count")


def anchors(html: Column) -> Column:
    """[(href, text)] of a page's anchors, in page order: what stands in the tag's href, and what stands between it and its end tag."""
    # a page is cut where anchors begin, so an anchor without an end tag costs no second look at the page
    pieces = F.filter(F.split(html, r"(?i)<a(?=[\s>])"), lambda p, i: i > 0)
    href = lambda p: F.replace(F.regexp_extract(p, r"(?i)^[^>]*?\shref\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("&amp;"), F.lit("&"))
    return F.transform(pieces, lambda p: F.struct(F.trim(href(p)).alias("href"), F.regexp_extract(p, r"(?is)^[^>]*>(.*?)(?:</a|\z)", 1).alias("text")))


def resolved(link: Column, page: Column) -> Column:
    """A link of a page as an absolute http url; null for links of other kinds and for links of pages that have no http url."""
    scheme = F.lower(F.regexp_extract(page, "^(?i)(https?)://", 1))
    # a segment "." goes, and ".." takes the one before it along
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s)))
    tidy = lambda path: F.concat(F.lit("/"), F.array_join(F.aggregate(F.filter(F.split(path, "/"), lambda s, i: i > 0), F.array().cast("array<string>"), step), "/"))

    def said(p: Column) -> Column:
        site = F.concat(scheme, F.lit("://"), p["user"], p["host"], p["port"])
        folder = F.regexp_replace(F.coalesce(F.nullif(p["path"], F.lit("")), F.lit("/")), "[^/]*$", "")
        path, rest = F.regexp_extract(link, r"^[^?#]*", 0), F.regexp_extract(link, r"[?#].*$", 0)
        own = F.when(link == "", None).when(link.startswith("?"), F.concat(site, p["path"], link)).when(link.startswith("/"), F.concat(site, tidy(path), rest))
        return (
            F.when(link.rlike("(?i)^https?://"), link).when(link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None)
            .when(p["host"] != "", F.when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).otherwise(F.coalesce(own, F.when(link != "", F.concat(site, tidy(F.concat(folder, path)), rest)))))
        )

    return bound(parts(page), said)


CAREERS = r"(?i)\b(careers?|jobs?|join(?:[\s-]+(?:us|the[\s-]+team))?|hiring|work[\s-]+(?:with|at)[\s-]+us|open[\s-]+(?:roles|positions))\b"


def careers_in_pages(pages: DataFrame, id_col: str, html_col: str, url_col: str) -> DataFrame:
    """(id, place, url): links of a page to its own site (or below it) whose path, first host label or text speaks of careers; each target once, as its first link writes it.

    `place` numbers a page's anchors; links with a fragment, and to the site's front page, are no careers pages. A page url without a scheme is an https one.
    """
    page = F.when(F.trim(url_col).rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.trim(url_col)).otherwise(F.concat(F.lit("https://"), F.trim(url_col)))
    linked = pages.select(F.col(id_col), page.alias("_page"), F.posexplode(anchors(F.col(html_col))).alias("place", "_a")).filter(~F.contains("_a.href", F.lit("#")))
    full = linked.select(id_col, "place", "_page", F.col("_a.text").alias("_text"), resolved(F.col("_a.href"), F.col("_page")).alias("url")).filter("url IS NOT NULL")
    to = full.select("*", parts(F.col("url")).alias("_to"), F.regexp_replace(parts(F.col("_page"))["host"], r"^www\.", "").alias("_site"))
    bare = F.regexp_replace("_to.host", r"^www\.", "")
    own = (F.col("_site") != "") & ((bare == F.col("_site")) | F.endswith(bare, F.concat(F.lit("."), "_site")))
    speaks = F.concat_ws(" \n ", F.regexp_replace("_to.path", "[/_]", " "), F.split("_to.host", r"\.")[0], html_to_text(F.col("_text"))).rlike(CAREERS)
    target = F.lower(F.regexp_replace(F.concat("_to.host", "_to.path"), "/+$", ""))
    kept = to.filter(own & speaks).select(id_col, "place", "url", target.alias("_target"), "_site").filter(F.regexp_replace("_target", r"^www\.", "") != F.col("_site"))
    first = kept.groupBy(id_col, "_target").agg(F.min(F.struct("place", "url")).alias("_first"))
    return first.select(id_col, "_first.place", "_first.url")
