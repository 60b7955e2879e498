"""Queries of board slugs, record keys, list membership, proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.functions import urls
from rookery.operators import feedback
from rookery.plans.decisions import _SHOWN, _found
from rookery.plans.postings import postings
from rookery.plans.registry import query, table


@query("board_slugs", r"SELECT page_id, nullif(regexp_extract(url, '^https?://[^/?#]+/+([^/?#&=]+)', 1), '') AS slug FROM pages")
def board_slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.board_slug(F.col("url")).alias("slug"))


@query("record_keys", r"SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'site:' || regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\.', '') WHEN 1 THEN 'board:b' || page_id ELSE 'name:name ' || page_id END AS key, substr(sha256(page_id || chr(31) || url), 1, 16) AS mark FROM pages")
def record_keys(spark, sf_dir):
    i = F.col("page_id")
    url, board, name = F.when(i % 3 == 0, F.col("url")), F.when(i % 3 == 1, F.concat(F.lit("B"), i.cast("string"))), F.concat(F.lit("Name "), i.cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", urls.record_key(url, board, name).alias("key"), urls.fingerprint(i, F.col("url")).alias("mark"))


@query("funds_by_company", "SELECT l_suppkey, count(DISTINCT l_returnflag || l_linestatus) AS n, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), ',') AS funds FROM lineitem GROUP BY 1")
def funds_by_company(spark, sf_dir):
    """Which lists name a company: distinct sets with partial aggregation."""
    own = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("fund"))
    sets = own.groupBy("l_suppkey").agg(F.array_sort(F.collect_set("fund")).alias("f"))
    return sets.select("l_suppkey", F.size("f").cast("long").alias("n"), F.array_join("f", ",").alias("funds"))


@query("companies_per_fund", "SELECT l_returnflag || l_linestatus AS fund, count(DISTINCT l_suppkey) AS companies, count(*) AS n FROM lineitem GROUP BY 1")
def companies_per_fund(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("fund"), "l_suppkey")
    return own.groupBy("fund").agg(F.count_distinct("l_suppkey").alias("companies"), F.count(F.lit(1)).alias("n"))


@query("costly_exclusions", f"WITH {_SHOWN}, t AS (SELECT unnest(['bolt', 'red', 'small', 'zinc']) AS term) SELECT term, count(*) AS n_added FROM f, t WHERE added AND regexp_matches(title, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') GROUP BY 1 HAVING count(*) >= 2")
def costly_exclusions(spark, sf_dir):
    titled = _found(spark, sf_dir).join(postings(spark, sf_dir).select("ordinal", "title"), "ordinal")
    return feedback.costly_exclusions(titled, "title", ["bolt", "red", "small", "zinc"])


@query("proposal_problems", """SELECT event_id, array_to_string(list_filter([CASE WHEN event_type = 'error' THEN 'unknown operation' END, CASE WHEN user_id % 3 = 0 THEN 'path not allowed' END, CASE WHEN value < 50 THEN 'no value' END], lambda x: x IS NOT NULL), ', ') AS problems FROM events""")
def proposal_problems(spark, sf_dir):
    changes = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "drop_table").otherwise("add_to_list").alias("op"), F.when(F.col("user_id") % 3 == 0, "rank.min").otherwise("titles.exclude").alias("path"), F.when(F.col("value") < 50, " ").otherwise("x").alias("value"))
    return feedback.validate_changes(changes, ["titles.exclude"]).select("event_id", F.array_join("problems", ", ").alias("problems"))


@query("approvals_to_apply", "SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 20 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND event_id % 40 = 0)")
def approvals_to_apply(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return feedback.to_apply(e.filter("event_type = 'purchase' AND value > 20").select("user_id"), e.filter("event_type = 'signup' AND event_id % 40 = 0"), "user_id")
