"""Company identity: names and boards as nodes, evidence as edges, components as companies. Names alone never merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.functions.text import company_key
from rookery.operators.graphs import components, cut

#: A board with more distinct names than this is an aggregator, and none of its edges count.
MOST_NAMES = 8


def company_identity(evidence: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """(company_key, canonical_key, names) from (company_key, board, watched) evidence.

    The canonical key of a component is its smallest watched key, else the key with most evidence, then the longest, then the first by letters.
    """
    rows = evidence.filter("company_key <> '' AND board IS NOT NULL").withColumn("board", F.regexp_replace(F.lower("board"), "/+$", ""))
    names = rows.groupBy("board").agg(F.count_distinct("company_key").alias("names")).filter(F.col("names") <= most_names).select("board")
    edges = rows.join(names, "board").select(F.concat(F.lit("name:"), "company_key").alias("a"), F.concat(F.lit("board:"), "board").alias("b")).distinct()
    found = components(edges, "a", "b").filter(F.col("node").startswith("name:")).select(F.substring("node", 6, 1 << 20).alias("company_key"), "component")
    weight = evidence.filter("company_key <> ''").groupBy("company_key").agg(F.count(F.lit(1)).alias("rows"), F.max("watched").alias("watched"))
    told = weight.join(found, "company_key", "left").withColumn("component", F.coalesce("component", F.concat(F.lit("name:"), "company_key")))
    led = F.struct((~F.col("watched")).alias("a"), F.when(F.col("watched"), 0).otherwise(-F.col("rows")).alias("b"), F.when(F.col("watched"), 0).otherwise(-F.length("company_key")).alias("c"), F.col("company_key").alias("d"))
    canonical = told.groupBy("component").agg(F.min(led)["d"].alias("canonical_key"), F.count(F.lit(1)).alias("names"))
    return told.join(canonical, "component").select("company_key", "canonical_key", "names")


def _board(url):
    return F.nullif(F.lower(F.regexp_replace(F.trim(url), "/+$", "")), F.lit(""))


def resolved_companies(jobs: DataFrame, watchlist: DataFrame, declared: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """The jobs (company, board, aliases and any other columns) with `company_key` and `company` as their employer is called.

    Names meet on boards: what lanes, the watchlist (name, careers_url) and the boards themselves (`declared`: careers_url, name, aliases; of boards that are seen only) call them. A name of the last two kinds, or the one that a board's slug
    spells, outranks counts. An alias counts only if it stands for one board and is nobody's own name. A board of more than `most_names` names bridges nothing. Of a company's names the canonical is the first watched one, else the first that a
    board vouches for, else the most frequent, longest, first by letters; its display is a watched spelling, else one of the canonical name, else an authored one, else the most frequent, shortest, first.
    A job goes by its board where that is known, else by its name; jobs without either stay as they are.
    """
    own = jobs.withColumn("_key", company_key(F.col("company"))).withColumn("_board", _board(F.col("board")))
    # postings of one company on one board are one row for all that is learnt of names
    raw = jobs.groupBy("company", "board").agg(F.count(F.lit(1)).alias("count"))
    named = cut(raw.select("company", "count", company_key(F.col("company")).alias("_key"), _board(F.col("board")).alias("_board")).filter("_key <> ''"), "named")
    watched = watchlist.select(company_key(F.col("name")).alias("key"), F.col("name").alias("display"), _board(F.col("careers_url")).alias("board")).filter("key <> ''")
    links = cut(named.select(F.col("_key").alias("key"), F.col("_board").alias("board")).unionByName(watched.select("key", "board")).filter("board IS NOT NULL").distinct(), "links")
    said = declared.select(_board(F.col("careers_url")).alias("board"), company_key(F.col("name")).alias("key"), "aliases").filter("key <> ''").join(links.select("board").distinct(), "board", "left_semi")
    primary = cut(links.unionByName(said.select("key", "board")).distinct(), "links")
    aliases = jobs.select("company", "board", F.explode("aliases").alias("a")).distinct().filter(company_key(F.col("company")) != "").select(_board(F.col("board")).alias("board"), "a")
    other = aliases.unionByName(said.select("board", F.explode("aliases").alias("a"))).select(company_key(F.col("a")).alias("key"), "board").filter("key <> '' AND board IS NOT NULL").distinct()
    single = other.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("board").alias("board")).filter("n = 1").join(primary.select("key").distinct(), "key", "left_anti")
    all_links = cut(primary.unionByName(single.select("key", "board")), "links")
    bridging = all_links.groupBy("board").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most_names).select("board")
    edges = all_links.join(bridging, "board").select(F.concat(F.lit("name:"), "key").alias("a"), F.concat(F.lit("board:"), "board").alias("b"))
    found = components(edges, "a", "b")
    member = found.filter(F.col("node").startswith("name:")).select(F.substring("node", 6, 1 << 20).alias("key"), "component")
    slug = company_key(F.coalesce(F.try_url_decode(F.regexp_extract("board", r"^https?://[^/]+/([^/?#]+)", 1)), F.lit("")))
    vouched = all_links.filter(F.col("key") == slug).select("key").unionByName(said.select("key")).distinct().withColumn("_vouched", F.lit(True))
    spelled = named.select(F.col("_key").alias("key"), F.col("company").alias("display"), "count").unionByName(watched.select("key", "display", F.lit(1).cast("long").alias("count"))).groupBy("key", "display").agg(F.sum("count").alias("count"))
    total = spelled.groupBy("key").agg(F.sum("count").alias("_rows"))
    told = member.join(watched.select("key").distinct().withColumn("_watched", F.lit(True)), "key", "left").join(vouched, "key", "left").join(total, "key", "left")
    told = cut(told.select("key", "component", F.coalesce("_watched", F.lit(False)).alias("watched"), F.coalesce("_vouched", F.lit(False)).alias("vouched"), F.coalesce("_rows", F.lit(0)).alias("rows")), "names")
    good = F.col("watched") | F.col("vouched")
    led = F.struct((~F.col("watched")).alias("a"), (~good).alias("b"), F.when(good, 0).otherwise(-F.col("rows")).alias("c"), F.when(good, 0).otherwise(-F.length("key")).alias("d"), F.col("key").alias("e"))
    canonical = told.groupBy("component").agg(F.min(led)["e"].alias("canonical"))
    authored = F.col("display").rlike(r"[A-Z]|[ .,&-]")
    shown = F.struct((~F.col("watched")).alias("a"), (F.col("key") != F.col("canonical")).alias("b"), (~authored).alias("c"), (-F.col("count")).alias("d"), F.length("display").alias("e"), F.col("display").alias("f"))
    best = told.join(canonical, "component").join(spelled, "key").groupBy("component").agg(F.min(shown)["f"].alias("_display"))
    called = cut(canonical.join(best, "component", "left").select("component", "canonical", F.coalesce("_display", "canonical").alias("display")), "called")
    by_name = member.join(called, "component").select(F.col("key").alias("_nkey"), F.struct(F.col("canonical").alias("key"), "display").alias("_by_name"))
    by_board = found.filter(F.col("node").startswith("board:")).select(F.substring("node", 7, 1 << 20).alias("_bboard"), "component").join(called, "component").select("_bboard", F.struct(F.col("canonical").alias("key"), "display").alias("_by_board"))
    # jobs without a board meet none, and are dealt evenly instead of all to one task
    dealt = own.withColumn("_at", F.coalesce("_board", F.concat(F.lit("\x1f"), (F.monotonically_increasing_id() % 4_096).cast("string"))))
    on_board = dealt.join(by_board, F.col("_at") == F.col("_bboard"), "left").withColumn("_by_board", F.when(F.col("_board").isNotNull(), F.col("_by_board"))).drop("_at")
    met = on_board.join(by_name, F.col("_key") == F.col("_nkey"), "left").withColumn("_is", F.coalesce("_by_board", "_by_name"))
    return met.withColumns({"company_key": F.coalesce("_is.key", "_key"), "company": F.coalesce("_is.display", "company")}).drop("_key", "_board", "_bboard", "_nkey", "_by_board", "_by_name", "_is")
