"""URLs: canonical form, site keys, requisition identities, board links. Null or blank urls give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track, hosts that copy postings, vendors of boards.
TRACKING = r"(?i)^(utm_|ref$|source$|src$|gh_src$|lever-|trackingid$|refid$|trk$|trkinfo$|position$|pagenum$|originalsubdomain$|eblid$)"
AGGREGATORS = r"(?i)(^|\.)(linkedin\.com|indeed\.com|glassdoor\.com|wellfound\.com|angel\.co|ziprecruiter\.com|simplyhired\.com|jobs\.google\.com|freehire\.me)$"
AGGREGATOR_NAMES = ["linkedin.com", "indeed.com", "glassdoor.com", "wellfound.com", "angel.co", "ziprecruiter.com", "simplyhired.com", "jobs.google.com", "freehire.me"]
LAST_SEGMENT_VENDORS = {"smartrecruiters": r"smartrecruiters\.com$", "workable": r"workable\.com$", "recruitee": r"recruitee\.com$", "breezy": r"breezy\.hr$", "jobvite": r"jobvite\.com$", "bamboohr": r"bamboohr\.com$"}

_URL = r"^(?i:(https?)://)([^/?#@]*@)?([^/?#:]+)(:[0-9]+)?([^?#]*)(\?[^#]*)?(#.*)?$"


def bound(value: Column, f) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), _URL, group)


def parts(url: Column) -> Column:
    """(user, host, port, path, query) of an http url by one match; all '' for other texts, null for null. Ports that the scheme implies are ''."""
    cut = F.split(F.regexp_replace(F.trim(url), _URL, "$1\x1f$2\x1f$3\x1f$4\x1f$5\x1f$6"), "\x1f")
    some = lambda c, i: F.coalesce(F.when(F.size(c) == 6, F.get(c, i)), F.lit(""))
    implied = lambda c: F.concat(F.lower(some(c, 0)), some(c, 3)).isin("https:443", "http:80")
    return bound(cut, lambda c: F.when(c.isNotNull(), F.struct(some(c, 1).alias("user"), F.lower(some(c, 2)).alias("host"), F.when(implied(c), "").otherwise(some(c, 3)).alias("port"), some(c, 4).alias("path"), some(c, 5).alias("query"))))


def host(url: Column) -> Column:
    """The lower-case host, '' where the text is no http url."""
    return F.lower(_part(url, 3))


def path(url: Column) -> Column:
    return _part(url, 5)


def _params(query: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: p != "")


def params(url: Column) -> Column:
    """The query's key=value texts, without empty ones."""
    return _params(_part(url, 6))


#: A url that decoding and encoding leave as it is: a lower-case host without user or port, a path of printable characters, every parameter a plain key and a plain value.
_PLAIN = r"^(?i:https?)://(?:www\.)?+([a-z0-9.-]++)((?:/++[\x21\x22\x24-\x2E\x30-\x3E\x40-\x7E]++)++)/*+(?:\?((?:[A-Za-z0-9._*-]++=[A-Za-z0-9._*-]*+&?+)++(?<!&)))?+(?:#[!-~]*+)?\z"
_TRACKED = r"(?i)^(utm_|lever-|(ref|source|src|gh_src|trackingid|refid|trk|trkinfo|position|pagenum|originalsubdomain|eblid)\x01)"


def canonical_url(url: Column) -> Column:
    """https, lower host without www., user and port as they are, no fragment, no tracking parameters, the rest decoded, sorted by key (stable) and encoded anew, no slash at the end; other texts trimmed.

    Most urls are plain: one match takes them apart, and their parameters are sorted as they stand. Plain ones that repeat a key go the long way too, as their values' order has to stay.
    """
    text = F.trim(url)
    # \x01 for = sorts below all that a key may hold, so that the order of parameters is that of their keys
    params_ = lambda c: F.array_join(F.sort_array(F.filter(F.split(F.replace(F.get(c, 1), F.lit("="), F.lit("\x01")), "&"), lambda p: ~p.rlike(_TRACKED))), "&")
    again = lambda q: F.contains(q, F.lit("&")) & q.rlike("(?:^|&)([^\x01&]++)\x01[^&]*+&\\1\x01")
    asked = lambda c: bound(params_(c), lambda q: F.when(q == "", F.get(c, 0)).when(~again(q), F.concat(F.get(c, 0), F.lit("?"), F.replace(q, F.lit("\x01"), F.lit("=")))))
    short = lambda c: F.when(F.size(c) == 2, F.when(F.get(c, 1) == "", F.get(c, 0)).otherwise(asked(c)))
    cut = F.when(~F.contains(text, F.lit("\x1f")), F.split(F.regexp_replace(text, _PLAIN, "https://$1$2\x1f$3"), "\x1f"))
    return bound(bound(cut, short), lambda x: F.coalesce(x, _canonical_any(url)))


def _canonical_any(url: Column) -> Column:
    """The canonical form of any url, parameter by parameter."""
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    key = lambda p: plain(F.split(p, "=", 2)[0])
    pair = lambda p: F.concat(F.url_encode(key(p)), F.lit("="), F.url_encode(plain(F.coalesce(F.get(F.split(p, "=", 2), 1), F.lit("")))))
    # the place breaks ties, so that the order of equal keys stays
    keyed = lambda q: F.transform(F.filter(_params(q), lambda p: ~key(p).rlike(TRACKING)), lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), pair(p).alias("p")))
    query = lambda q: F.array_join(F.transform(F.array_sort(keyed(q)), lambda s: s["p"]), "&")
    asked = lambda q: F.when(q == "", "").otherwise(bound(query(q), lambda x: F.when(x != "", F.concat(F.lit("?"), x)).otherwise("")))
    whole = lambda u: F.concat(F.lit("https://"), u["user"], F.regexp_replace(u["host"], r"^www\.", ""), u["port"], F.coalesce(F.nullif(F.regexp_replace(u["path"], "/+$", ""), F.lit("")), F.lit("/")), asked(u["query"]))
    return bound(parts(url), lambda u: F.when(u["host"] == "", F.trim(url)).otherwise(whole(u)))


def site_key(url: Column) -> Column:
    """The host without www., null for anything but http urls."""
    return F.nullif(F.regexp_replace(host(url), r"^www\.", ""), F.lit(""))


def same_site(a: Column, b: Column) -> Column:
    """Whether one's site is the other's or below it."""
    x, y = site_key(a), site_key(b)
    return F.coalesce((x == y) | F.endswith(x, F.concat(F.lit("."), y)) | F.endswith(y, F.concat(F.lit("."), x)), F.lit(False))


def _names(url: Column, names: list[str]) -> Column:
    """Whether any of the names stands anywhere in the url: a cheap test before patterns."""

    # looks for the last full stop of each name first, as texts have few of them
    ends = ((head.replace(".", r"\."), tail) for head, tail in (name.rsplit(".", 1) for name in names))
    return F.lower(url).rlike(r"\.(?:" + "|".join(rf"{tail}(?<={head}\.{tail})" for head, tail in ends) + ")")


def is_aggregator(url: Column) -> Column:
    return F.coalesce(_names(url, AGGREGATOR_NAMES) & host(url).rlike(AGGREGATORS), F.lit(False))


_LABEL, _FIRST = "label", "first"
#: vendor: (host, whose name the organisation is: the host's first label or the path's first segment, pattern of the path whose last group is the requisition)
VENDOR_URLS = {
    "greenhouse": (r"greenhouse\.io$", _FIRST, r"^/(?:embed/job_app/?)?([^/]+)/jobs/([0-9]+)"),
    "lever": (r"lever\.co$", _FIRST, r"(?i)^/([^/]+)/([0-9a-f-]{8,})"),
    "ashby": (r"ashbyhq\.com$", _FIRST, r"(?i)^/([^/]+)/([0-9a-f-]{8,})"),
    "workday": (r"myworkdayjobs\.com$", _LABEL, r"(?i)()_(R-?[0-9]+|JR-?[0-9]+)\b"),
    **{vendor: (domain, _LABEL, r"()([^/]{4,})/*$") for vendor, domain in LAST_SEGMENT_VENDORS.items()},
}


def requisition(url: Column) -> Column:
    """vendor:organisation:requisition where the url is a known vendor's, else null."""

    def said(u: Column) -> Column:
        found = F.lit(None).cast("string")
        for vendor, (domain, whose, pattern) in reversed(VENDOR_URLS.items()):
            organisation = F.split(u["host"], r"\.")[0] if whose == _LABEL else F.regexp_extract(u["path"], pattern, 1)
            one = lambda o, r, v=vendor: F.when((o != "") & (r != ""), F.concat(F.lit(f"{v}:"), F.lower(o), F.lit(":"), F.lower(r)))
            own = one(organisation, F.regexp_extract(u["path"], pattern, 2))
            if vendor == "greenhouse":  # a company's own page may carry the board's number as a parameter
                own = F.coalesce(own, one(u["host"], F.regexp_extract(u["query"], r"[?&]gh_jid=([^&]*)", 1)))
            found = F.when(u["host"].rlike(domain), own).otherwise(found)
        return found

    names = [domain.rstrip("$").replace("\\", "") for domain, _, _ in VENDOR_URLS.values()]
    return F.when(_names(url, names), bound(parts(url), said))


def posting_id(url: Column) -> Column:
    """16 hex digits that stay the same for every copy of a posting."""
    return F.substring(F.sha2(F.coalesce(requisition(url), F.concat(F.lit("url:"), canonical_url(url))), 256), 1, 16)


def unit_key(kind: Column, id_: Column) -> Column:
    """kind:id, the id in lower case without slashes at its end, 'unknown' if there is none."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(id_.cast("string"), F.lit("")))), "/+$", "")
    return F.concat(kind, F.lit(":"), F.coalesce(F.nullif(plain, F.lit("")), F.lit("unknown")))


def links(html: Column) -> Column:
    """The href targets of a page's anchors, in page order, with entities of ampersands decoded."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href=[\"']([^\"'>]+)[\"']"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


CAREERS = r"(?i)(^|[^a-z])(careers?|jobs?|join-us|work-with-us|openings?|vacancies|positions|hiring)([^a-z]|$)"


def careers_links(html: Column) -> Column:
    """Distinct links whose target speaks of careers, in page order."""
    return F.array_distinct(F.filter(links(html), lambda x: x.rlike(CAREERS)))


def board_slug(url: Column) -> Column:
    """The first segment of the path, decoded and cut at what can't be part of it; null if there is none."""
    return F.nullif(F.regexp_replace(F.try_url_decode(F.regexp_extract(path(url), r"^/+([^/?#&=]+)", 1)), r"[?#&=].*$", ""), F.lit(""))


def record_key(url: Column, board: Column, name: Column) -> Column:
    """What tells companies of lists apart: their site, else their board, else their name."""
    return F.coalesce(F.concat(F.lit("site:"), site_key(url)), F.concat(F.lit("board:"), F.lower(F.nullif(board, F.lit("")))), F.concat(F.lit("name:"), F.lower(F.nullif(name, F.lit("")))))


def fingerprint(*parts: Column, length: int = 16) -> Column:
    """A short hash of values, the same for the same values in the same order."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, length)
