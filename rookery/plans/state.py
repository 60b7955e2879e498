"""Queries of shown records, proposals, caches and replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.functions import signing
from rookery.operators import coverage, ledger, ranking
from rookery.plans.registry import query, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("recovered_observations", """WITH o AS (SELECT ts::DATE AS run, user_id AS url, event_id AS "at", event_type FROM events WHERE ts::DATE NOT IN (SELECT ts::DATE FROM events WHERE event_id % 997 = 0))
  SELECT url, max_by(run, ("at", run)) AS run, max("at") AS "at", max_by(event_type, ("at", run)) AS event_type FROM o GROUP BY 1""")
def recovered_observations(spark, sf_dir):
    e = _events(spark, sf_dir)
    o = e.select(F.to_date("ts").alias("run"), F.col("user_id").alias("url"), F.col("event_id").alias("at"), "event_type")
    done = e.filter("event_id % 997 = 0").select(F.to_date("ts").alias("run"))
    return ledger.recovered(o, done, "run", "url", "at")


@query("shown_merge", """WITH d AS (SELECT user_id AS id, event_id, floor(value) AS score, event_type = 'purchase' AS delivered, ts < TIMESTAMP '2024-01-15' AS early FROM events),
  b AS (SELECT id, max_by(score, event_id) AS score, max_by(delivered, event_id) AS delivered FROM d WHERE early GROUP BY 1), n AS (SELECT id, max_by(score, event_id) AS score, max_by(delivered, event_id) AS delivered FROM d WHERE NOT early GROUP BY 1)
  SELECT id, CASE WHEN coalesce(b.delivered, false) AND NOT coalesce(n.delivered, false) THEN b.score ELSE coalesce(n.score, b.score) END::BIGINT AS score, coalesce(b.delivered, false) OR coalesce(n.delivered, false) AS delivered FROM b FULL JOIN n USING (id)""")
def shown_merge(spark, sf_dir):
    """What all users were shown before and since a day."""
    d = _events(spark, sf_dir).select(F.col("user_id").alias("id"), "event_id", F.floor("value").alias("score"), (F.col("event_type") == "purchase").alias("delivered"), "ts")
    last = lambda x: x.groupBy("id").agg(F.max_by("score", "event_id").alias("score"), F.max_by("delivered", "event_id").alias("delivered"))
    return ledger.merge_shown(last(d.filter("ts < TIMESTAMP '2024-01-15'")), last(d.filter("ts >= TIMESTAMP '2024-01-15'")), "id")


@query("latest_commit", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 1")
def latest_commit(spark, sf_dir):
    return ledger.latest(_events(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", "user_id", "event_type"), "event_id")


@query("preference_changes", """WITH l AS (SELECT user_id AS id, coalesce(list_distinct(list(event_type) FILTER (ts < TIMESTAMP '2024-01-10')), []) AS v FROM events GROUP BY 1), a AS (SELECT user_id AS id, list_distinct(list(event_type)) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1),
  r AS (SELECT user_id AS id, list_distinct(list(event_type)) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1)
  SELECT l.id, array_to_string(list_sort(list_filter(list_distinct(list_concat(l.v, coalesce(a.v, []))), lambda x: NOT list_contains(coalesce(r.v, []), x))), ',') AS vals, array_to_string(list_sort(list_filter(coalesce(r.v, []), lambda x: NOT list_contains(l.v, x))), ',') AS missing
  FROM l LEFT JOIN a USING (id) LEFT JOIN r USING (id)""")
def preference_changes(spark, sf_dir):
    """Each user's list is what its events of the first days name; later days add, the last ones remove."""
    e = _events(spark, sf_dir).withColumnRenamed("user_id", "id")
    op = F.when(F.expr("ts < TIMESTAMP '2024-01-10'"), "list").when(F.expr("ts < TIMESTAMP '2024-01-20'"), "add").otherwise("remove")
    changes = e.select("id", op.alias("op"), F.col("event_type").alias("value"))
    lists = changes.groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("op") == "list", F.col("value")))).alias("values"))
    return ledger.changes_applied(lists, changes, "id").select("id", F.array_join("values", ",").alias("vals"), F.array_join("missing", ",").alias("missing"))


@query("run_windows", """SELECT event_type AS key, min(CASE WHEN value > 50 THEN ts END) AS since, count(*) AS units, min(CASE WHEN value > 50 THEN ts END) IS NULL AS unbounded FROM events GROUP BY 1""")
def run_windows(spark, sf_dir):
    u = _events(spark, sf_dir).select(F.col("event_type").alias("key"), F.when(F.col("value") > 50, F.col("ts")).alias("since"))
    return coverage.run_windows(u, "key", "since")


@query("clamped_windows", """SELECT event_id, greatest(ts::DATE, DATE '2024-01-10') AS since, greatest(0, DATE '2024-01-10' - ts::DATE)::INT AS gap_days, CASE WHEN event_type = 'view' THEN ts WHEN event_type = 'purchase' THEN TIMESTAMP '2024-02-01' END AS covered FROM events""")
def clamped_windows(spark, sf_dir):
    c = coverage.clamp(F.to_date("ts"), F.lit("2024-01-10").cast("date"))
    covered = coverage.unit(F.lit("2024-02-01").cast("timestamp_ntz"), F.when(F.col("event_type") == "view", F.col("ts").cast("timestamp_ntz")), F.when(F.col("event_type") == "purchase", "complete").otherwise("partial"))
    return _events(spark, sf_dir).select("event_id", c["since"].alias("since"), c["gap_days"].alias("gap_days"), covered.alias("covered"))


@query("rank_cache_keys", r"""SELECT p_partkey, sha256('v1' || chr(10) || 'model' || chr(10) || p_name || chr(10) || p_type) AS key, (ceil(ceil(p_size / 25.0) / 4.0) * 180000)::BIGINT AS deadline_ms FROM part""")
def rank_cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ranking.cache_key(F.lit("v1"), F.lit("model"), F.col("p_name"), F.col("p_type")).alias("key"), ranking.deadline_ms(F.col("p_size"), 25, 4, 180_000).alias("deadline_ms"))


@query("rate_limits", "SELECT user_id, count(*) >= 2 AND bool_and(event_type = 'error' AND value * 1000 < 15000) AS limited FROM events GROUP BY 1")
def rate_limits(spark, sf_dir):
    """Every event is a call."""
    calls = _events(spark, sf_dir).select("user_id", F.col("event_type").alias("status"), (F.col("value") * 1000).alias("ms"))
    return ranking.rate_limited(calls, "user_id")


@query("fresh_scores", "SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOURS) AS fresh FROM events GROUP BY 1")
def fresh_scores(spark, sf_dir):
    ok = ranking.fresh(F.col("ts").cast("timestamp_ntz"), F.lit("2024-01-31").cast("timestamp_ntz"), 168)
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count_if(ok).alias("fresh"))


@query("signed_links")
def signed_links(spark, sf_dir):
    """A signed link for every order; tested against the standard library, as DuckDB has no HMAC."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", signing.signed_link(F.lit("https://x.example.com/act"), F.lit("add"), F.col("o_orderkey").cast("string"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")), b"a key that tests use").alias("link"))
