"""Record linkage: postings that share a hard key are one record, whose columns come from the preferred copy or the earliest known value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.text import company_key, title_key
from rookery.functions.urls import canonical_url, is_aggregator, requisition
from rookery.operators.graphs import components, cut

# How good a source is as the place to apply; others rank last.
SOURCE_RANK = {"watchlist": 0, "portfolio": 1, "ats_sweep": 1, "freehire": 2, "freehire_feed": 2, "linkedin": 3, "wellfound": 3, "unknown": 9}


#: A table of up to this many rows may be broadcast.
BROADCAST_ROWS = 100_000


def _keys(url: Column, fingerprint: Column, company: Column) -> list[Column]:
    return [F.concat(F.lit("u:"), canonical_url(url)), F.concat(F.lit("a:"), requisition(url)), F.when(fingerprint != "", F.concat(F.lit("f:"), company_key(company), F.lit("|"), fingerprint))]


def hard_keys(url: Column, fingerprint: Column, company: Column) -> Column:
    """The keys of which a shared one makes two postings the same: canonical url, requisition, and the fingerprint within a company."""
    return F.filter(F.array(*_keys(url, fingerprint, company)), lambda k: k.isNotNull())


def preference() -> list[Column]:
    """The order of copies: no aggregator, better source, more known, earlier."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SOURCE_RANK.items() for x in kv)), F.col("source")), F.lit(9))
    known = F.when(F.coalesce("description", F.lit("")) != "", 2).otherwise(0) + F.when(F.col("posted_at").isNotNull(), 1).otherwise(0)
    return [is_aggregator(F.col("url")).asc(), rank.asc(), known.desc(), F.col("ordinal").asc()]


def link(postings: DataFrame) -> DataFrame:
    """Adds record: the smallest key among all that a posting's hard keys reach."""
    of = F.col("url"), F.col("fingerprint"), F.col("company")
    keyed = postings.withColumn("_first", F.least(*_keys(*of)))
    # two keys take a requisition or a fingerprint; other postings' urls are not read for bridges
    several = F.coalesce(F.col("fingerprint") != "", F.lit(False)) | requisition(F.col("url")).isNotNull()
    # asked in the keys and not before them: Spark derives filters from what follows and may ask those first
    bridges = postings.select(F.when(several, hard_keys(*of)).alias("_keys")).select(F.array_min("_keys").alias("a"), F.explode("_keys").alias("b")).filter("a <> b").distinct()
    found = components(bridges, "a", "b")
    # only records that a bridge reaches are looked up; where they are few, no posting moves for it
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return keyed.join(found, F.col("_first") == F.col("node"), "left").withColumn("record", F.coalesce("component", "_first")).drop("_first", "node", "component")


def merge(linked: DataFrame, best: tuple[str, ...] = ("url", "title", "company", "source")) -> DataFrame:
    """One row a record: the preferred copy's url, title and company (or what else `best` names), the first known description and location in that order, the earliest days, and all sources and urls.

    Copies are aggregated as structs led by their preference, so a record of any number of copies is merged with partial sums and no sort.
    """
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SOURCE_RANK.items() for x in kv)), F.col("source")), F.lit(9))
    told = F.when(F.coalesce("description", F.lit("")) != "", 2).otherwise(0) + F.when(F.col("posted_at").isNotNull(), 1).otherwise(0)
    # one number in the order of preference(): aggregator or not, a rank of one digit, how much is known
    sign, led = F.when(is_aggregator(F.col("url")), 100).otherwise(0) + 10 * rank - told, ["_sign", "ordinal"]
    known = lambda c: F.min(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(*led, c)))[c].alias(c)
    merged = linked.withColumn("_sign", sign).groupBy("record").agg(
        F.min(F.struct(*led, *best)).alias("_best"), known("description"), known("location"),
        F.min("posted_at").alias("posted_at"), F.max("watchlist").alias("watchlist"), F.array_sort(F.collect_set("source")).alias("merged_from"), F.count(F.lit(1)).alias("copies"), F.min("ordinal").alias("ordinal"),
    )
    return merged.select("record", *(f"_best.{c}" for c in best), "description", "location", "posted_at", "watchlist", "merged_from", "copies", "ordinal")


def compatible_locations(a: Column, b: Column) -> Column:
    x, y = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (a, b))
    return (x == "") | (y == "") | F.contains(x, y) | F.contains(y, x)


#: Records of a group that are folded in one row at a time.
BATCH = 64


def with_soft_keys(postings: DataFrame) -> DataFrame:
    """Adds company_key, title_key and requisition, as soft_link reads them."""
    return postings.withColumns({"company_key": company_key(F.col("company")), "title_key": title_key(F.col("title")), "requisition": requisition(F.col("url"))})


def soft_link(records: DataFrame, batch: int = BATCH) -> DataFrame:
    """Adds soft_record: within equal company and title keys, in the order of their ordinals, each record joins the first stored one that is compatible, else is stored. Keys that the records have are not made again.

    Records of the same company, title, place and requisition are of one kind, fare alike and count once; the first record of a group of one kind is what all of the group join. The rule isn't transitive, so in other groups order decides.
    It is kept in rounds: the first `batch` open records of every group are folded in order, and whoever of the group is compatible with one that was stored joins the first such. All others are later than that batch and met none of its
    stored records, so they are the group's open ones of the next round. A row holds `batch` records at most; a group of any size is rows.
    """
    group, kind = ["company_key", "title_key"], ["company_key", "title_key", "_place", "_req"]
    # place and requisition are made on reading, as each is written once already
    keyed = cut(records if {*group, "requisition"} <= {*records.columns} else with_soft_keys(records), "keyed").withColumns({"_place": F.lower(F.trim(F.coalesce("location", F.lit("")))), "_req": F.coalesce("requisition", F.lit(""))})
    named, earliest = keyed.filter("company_key <> ''"), F.min("ordinal").cast("string").alias("ordinal")
    groups = cut(named.groupBy(*group).agg(earliest, F.min(F.struct("_place", "_req")).alias("_low"), F.max(F.struct("_place", "_req")).alias("_high")), "groups")
    settled = groups.filter("_low = _high").select(*group, "_low._place", "_low._req", F.col("ordinal").alias("_target"))
    mixed = groups.filter("_low <> _high").select(*group)
    alike = lambda s, r: ((s["place"] == "") | (r["place"] == "") | F.contains(s["place"], r["place"]) | F.contains(r["place"], s["place"])) & ((s["req"] == "") | (r["req"] == "") | (s["req"] == r["req"]))
    row = F.struct("ordinal", F.col("_place").alias("place"), F.col("_req").alias("req"))
    start = F.array().cast("array<struct<ordinal:string,place:string,req:string>>")
    step = lambda stored, r: F.when(F.exists(stored, lambda s: alike(s, r)), stored).otherwise(F.concat(stored, F.array(r)))
    open_, n = None, mixed.count()
    if 0 < n <= BROADCAST_ROWS:
        open_ = cut(named.join(F.broadcast(mixed), group, "left_semi").groupBy(*kind).agg(earliest), "open")
    elif n:  # kinds are put together before they move to their groups
        open_ = cut(named.groupBy(*kind).agg(earliest), "kinds").join(mixed, group, "left_semi")
    while open_ is not None:
        first = open_.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy("ordinal"))).filter(F.col("_n") <= batch)
        stored = first.groupBy(*group).agg(F.aggregate(F.array_sort(F.collect_list(row)), start, step).alias("_stored"))
        told = cut(open_.join(stored, group).withColumn("_target", F.get(F.filter("_stored", lambda s: alike(s, F.struct(F.col("_place").alias("place"), F.col("_req").alias("req")))), 0)["ordinal"]).drop("_stored"), "told")
        settled = settled.unionByName(told.filter("_target IS NOT NULL").select(*kind, "_target"))
        open_ = told.filter("_target IS NULL").drop("_target")
        if open_.isEmpty():
            break
    return keyed.join(settled, kind, "left").withColumn("soft_record", F.coalesce("_target", "ordinal")).drop("_target", "_place", "_req")


def newest_per(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key: the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
