"""What is known of funds' companies from run to run: lists that are fetched anew once they are old, resolved sites with ages by outcome, boards that turned out to be gone.

All are merges of yesterday's table with today's results by key. "Now" is a parameter. A result that only time cut short is none; trouble that may pass never drops a board that was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How long each kind of knowledge holds.
LIST_HOURS = 20
KEEP_DAYS = 60
REJECTED_DAYS = 90
STATUS_DAYS = {"found": 30, "none": 14, "dead_link": 14, "error": 2}
GONE = ("404", "410", "empty")

REJECTED = "array<struct<careers_url:string,status:string,at:timestamp>>"


def _ago(now: Column, days: float) -> Column:
    return F.timestamp_seconds(now.cast("double") - days * 86_400)


def url_key(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(F.trim(url), "/+$", "")), F.lit(""))


def merged_lists(cached: DataFrame, listed: DataFrame, now: Column) -> DataFrame:
    """(fund, key, <fields>, last_seen, fetched_at): each fund's companies.

    A list younger than LIST_HOURS stays. An older one takes what was listed now, field by field where the new row has one, keeps the others for KEEP_DAYS after they were last seen, and is as old as now. A fund that listed
    nothing keeps what it had. `listed` has no last_seen and no fetched_at; rows without a key are no companies; of rows that repeat a key the greatest counts.
    """
    fields = [c for c in listed.columns if c not in ("fund", "key")]
    new = listed.filter("fund IS NOT NULL AND key IS NOT NULL").groupBy("fund", "key").agg(F.max(F.struct(*fields)).alias("_new")) if fields else listed.select("fund", "key").distinct().withColumn("_new", F.struct(F.lit(1)))
    age = cached.groupBy("fund").agg((F.max("fetched_at") > _ago(now, LIST_HOURS / 24)).alias("_fresh"))
    asked = listed.filter("fund IS NOT NULL").select("fund").distinct().withColumn("_listed", F.lit(True))
    flags = age.join(asked, "fund", "full_outer").select("fund", F.coalesce("_fresh", F.lit(False)).alias("_fresh"), F.coalesce("_listed", F.lit(False)).alias("_listed"))
    both = cached.withColumn("_old", F.lit(True)).join(new, ["fund", "key"], "full_outer").join(flags, "fund")
    renew = F.col("_listed") & ~F.col("_fresh")
    seen_now = renew & F.col("_new").isNotNull()
    stays = F.col("_old") & (~renew | F.coalesce(F.col("last_seen") > _ago(now, KEEP_DAYS), F.lit(False)))
    return both.filter(seen_now | F.coalesce(stays, F.lit(False))).select(
        "fund", "key", *(F.when(seen_now, F.coalesce(F.col(f"_new.{c}"), F.col(c))).otherwise(F.col(c)).alias(c) for c in fields),
        F.when(seen_now, now).otherwise(F.col("last_seen")).alias("last_seen"), F.when(renew, now).otherwise(F.col("fetched_at")).alias("fetched_at"),
    )


def compacted(rejected: Column, now: Column) -> Column:
    """Rejected addresses that are known to be gone, the latest of each, none older than REJECTED_DAYS; null if none is left."""
    dated = F.transform(F.coalesce(rejected, F.array().cast(REJECTED)), lambda r: F.struct(url_key(r["careers_url"]).alias("k"), F.coalesce(r["at"], now).alias("at"), r["careers_url"].alias("careers_url"), r["status"].alias("status")))
    gone = F.array_sort(F.filter(dated, lambda r: r["status"].isin(*GONE) & r["k"].isNotNull() & (r["at"] >= _ago(now, REJECTED_DAYS))))
    # sorted by address, then age: the last of each address is the one before another
    last = F.filter(gone, lambda r, i: F.coalesce(F.get(gone, i + 1)["k"] != r["k"], F.lit(True)))
    plain = F.transform(last, lambda r: F.struct(r["careers_url"].alias("careers_url"), r["status"].alias("status"), r["at"].alias("at")))
    return F.when(F.size(plain) > 0, plain)


def resolved_sites(cache: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """(site, status, checked_at, careers_url, rejected) after today's results (site, status, deadline, careers_url, rejected), one a site."""
    r = results.filter("site IS NOT NULL").select("site", F.struct("status", "deadline", "careers_url", "rejected").alias("_r"))
    p = cache.select("site", F.struct("status", "checked_at", "careers_url", "rejected").alias("_p"))
    both = p.join(r, "site", "full_outer")
    stays = F.col("_r").isNull() | F.coalesce(F.col("_r.deadline"), F.lit(False))
    spared = (F.col("_r.status") == "error") & F.coalesce(F.col("_p.status") == "found", F.lit(False))
    again = _ago(now, STATUS_DAYS["found"] - STATUS_DAYS["error"])
    old = lambda at: F.struct(F.col("_p.status").alias("status"), at.alias("checked_at"), F.col("_p.careers_url").alias("careers_url"), F.col("_p.rejected").alias("rejected"))
    new = F.struct(F.col("_r.status").alias("status"), now.alias("checked_at"), F.col("_r.careers_url").alias("careers_url"), compacted(F.col("_r.rejected"), now).alias("rejected"))
    after = F.when(stays, F.when(F.col("_p").isNotNull(), old(F.col("_p.checked_at")))).when(spared, old(again)).otherwise(new)
    return both.select("site", after.alias("s")).filter("s IS NOT NULL").select("site", "s.*")


def retired(cache: DataFrame, units: DataFrame, now: Column) -> DataFrame:
    """The cache, where boards whose unit fund:board:<address> failed with HTTP 404 are dead links, due at once. `units` has key, status, errors."""
    prefix = "fund:board:"
    lost = units.filter(F.col("key").startswith(prefix) & (F.col("status") == "failed") & F.exists("errors", lambda e: e.rlike(r"\bHTTP 404\b"))).select(url_key(F.col("key").substr(F.lit(len(prefix) + 1), F.length("key"))).alias("_url")).distinct()
    met = cache.join(lost, url_key(F.col("careers_url")) == F.col("_url"), "left")
    dead = F.col("_url").isNotNull()
    more = F.concat(F.coalesce("rejected", F.array().cast(REJECTED)), F.array(F.struct(F.col("careers_url"), F.lit("404").alias("status"), now.alias("at"))))
    return met.select("site", F.when(dead, "dead_link").otherwise(F.col("status")).alias("status"), F.when(dead, _ago(now, STATUS_DAYS["dead_link"])).otherwise(F.col("checked_at")).alias("checked_at"), "careers_url", F.when(dead, compacted(more, now)).otherwise(F.col("rejected")).alias("rejected"))


def due(cache: DataFrame, now: Column) -> DataFrame:
    """Sites whose knowledge is too old; a status that isn't known is due."""
    days = F.create_map(*(F.lit(x) for kv in STATUS_DAYS.items() for x in kv))
    return cache.filter(F.coalesce(F.col("checked_at").cast("double") <= now.cast("double") - F.try_element_at(days, "status") * 86_400, F.lit(True)))
