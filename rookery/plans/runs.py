"""Queries of coverage, windows, checkpoints, states and the ledger, over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.operators import coverage, ledger
from rookery.plans.registry import query, table

_STATUS = "CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'view' THEN 'complete' WHEN 'click' THEN 'partial' WHEN 'error' THEN 'failed' ELSE 'odd' END"


def units(spark, sf_dir):
    """Events as units of retrieval: a user is a unit, a day a run, the type its outcome."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type").isin("purchase", "view"), "complete").when(F.col("event_type") == "click", "partial").when(F.col("event_type") == "error", "failed").otherwise("odd")
    return e.select(F.col("user_id").alias("key"), F.col("ts").alias("covered_through"), F.to_date("ts").alias("run"), status.alias("status"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("errors"), "event_type", "event_id", "value")


@query("coverage_tally", f"""WITH u AS (SELECT user_id AS key, {_STATUS} AS s FROM events) SELECT key, count(*) FILTER (s = 'complete') AS complete, count(*) FILTER (s = 'partial') AS partial, count(*) FILTER (s IN ('failed', 'odd')) AS failed, count(*) FILTER (s = 'skipped') AS skipped, bool_and(s = 'complete') AS retrieval_complete FROM u GROUP BY 1""")
def coverage_tally(spark, sf_dir):
    return coverage.tally(units(spark, sf_dir), ["key"])


@query("lane_health", """WITH l AS (SELECT ts::DATE AS lane, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'click') AS incomplete, count(*) FILTER (event_type = 'error') AS failed, bool_or(value > 499) AS aborted FROM events GROUP BY 1)
  SELECT lane, completed, incomplete, failed, aborted, CASE WHEN completed = 0 AND incomplete = 0 AND (failed > 0 OR aborted) THEN 'failed' WHEN incomplete > 0 OR failed > 0 OR aborted THEN 'partial' ELSE 'ok' END AS outcome FROM l""")
def lane_health(spark, sf_dir):
    """Every event counts."""
    e = table(spark, sf_dir, "events")
    one = lambda t: F.when(F.col("event_type") == t, 1).otherwise(0)
    lanes = e.select(F.to_date("ts").alias("lane"), one("purchase").alias("completed"), one("click").alias("incomplete"), one("error").alias("failed"), (F.col("value") > 499).alias("aborted"))
    return coverage.health(lanes)


@query("checkpoints", """WITH old AS (SELECT user_id AS key, max(ts) AS c FROM events WHERE ts < TIMESTAMP '2024-01-10' AND event_type = 'purchase' GROUP BY 1),
  new AS (SELECT user_id AS key, max(ts) AS c FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type IN ('purchase', 'view', 'click') GROUP BY 1)
  SELECT key, greatest(old.c, new.c) AS covered_through FROM old FULL JOIN new USING (key)""")
def checkpoints(spark, sf_dir):
    u = units(spark, sf_dir)
    old = u.filter("covered_through < TIMESTAMP '2024-01-10' AND event_type = 'purchase'").groupBy("key").agg(F.max("covered_through").alias("covered_through"))
    return coverage.advance(old, u.filter("covered_through >= TIMESTAMP '2024-01-10'"))


@query("window_plans", """WITH c AS (SELECT user_id AS key, max(CASE WHEN event_type = 'purchase' THEN ts END) AS covered, max(ts) AS seen FROM events GROUP BY 1)
  SELECT key, least(coalesce(covered, TIMESTAMP '2024-02-01' - INTERVAL 14 DAYS) - INTERVAL 48 HOURS, TIMESTAMP '2024-01-28') AS since FROM c""")
def window_plans(spark, sf_dir):
    u = units(spark, sf_dir).groupBy("key").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("covered_through"))).alias("covered"))
    start, horizon = F.lit("2024-02-01").cast("timestamp_ntz"), F.lit("2024-01-28").cast("timestamp_ntz")
    return u.select("key", coverage.plan_window(F.col("covered").cast("timestamp_ntz"), start, 14, 48, horizon).alias("since"))


@query("failed_in_last_runs", """WITH r AS (SELECT DISTINCT ts::DATE AS run FROM events ORDER BY 1 DESC LIMIT 3), f AS (SELECT user_id AS key, count(DISTINCT ts::DATE) AS failed_runs FROM events WHERE event_type = 'error' AND ts::DATE IN (SELECT run FROM r) GROUP BY 1) SELECT * FROM f WHERE failed_runs = 3""")
def failed_in_last_runs(spark, sf_dir):
    return coverage.failed_in_each(units(spark, sf_dir).withColumn("failed", F.col("event_type") == "error"), "key", "run")


@query("dead_boards", """WITH RECURSIVE c AS (SELECT user_id AS key, event_id, CASE event_type WHEN 'error' THEN 'miss' WHEN 'purchase' THEN 'ok' ELSE 'other' END AS gone, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
  f AS (SELECT key, i, event_id, CASE WHEN gone = 'miss' THEN 1 ELSE 0 END AS misses FROM c WHERE i = 1
    UNION ALL SELECT c.key, c.i, c.event_id, CASE c.gone WHEN 'miss' THEN least(3, f.misses + 1) WHEN 'ok' THEN 0 ELSE CASE WHEN f.misses >= 3 THEN f.misses ELSE 0 END END FROM f JOIN c ON c.key = f.key AND c.i = f.i + 1),
  l AS (SELECT key, max_by(misses, i) AS misses, max(event_id) AS last_checked FROM f GROUP BY 1) SELECT key, misses::INT AS misses, last_checked FROM l WHERE misses > 0""")
def dead_boards(spark, sf_dir):
    checks = units(spark, sf_dir).withColumn("gone", F.when(F.col("event_type") == "error", "miss").when(F.col("event_type") == "purchase", "ok").otherwise("other"))
    return coverage.dead_boards(checks, "key", "event_id", "gone")


@query("sweep_cursors", """WITH s AS (SELECT user_id AS grp, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, event_type <> 'error' AS done FROM events) SELECT grp, coalesce(min(CASE WHEN NOT done THEN i END), max(i) + 1) AS cursor FROM s GROUP BY 1""")
def sweep_cursors(spark, sf_dir):
    from pyspark.sql import Window

    steps = units(spark, sf_dir).select(F.col("key").alias("grp"), (F.row_number().over(Window.partitionBy("key").orderBy("event_id")) - 1).cast("long").alias("i"), (F.col("event_type") != "error").alias("done"))
    return coverage.completed_prefix(steps, "grp", "i", "done")


@query("ledger_upsert", """WITH a AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-10'), b AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10'),
  o AS (SELECT user_id AS key, max_by(event_type, event_id) AS title, min(ts) AS posted_at, min(ts) AS first_seen, max(ts) AS last_seen FROM a GROUP BY 1),
  n AS (SELECT user_id AS key, max_by(event_type, event_id) AS title, max_by(ts, event_id) AS posted_at, max_by(ts, event_id) AS seen_at, min(ts) AS first FROM b GROUP BY 1)
  SELECT key, coalesce(n.title, o.title) AS title, coalesce(o.posted_at, n.posted_at) AS posted_at, least(o.first_seen, n.first) AS first_seen, greatest(o.last_seen, n.seen_at) AS last_seen,
  CASE WHEN o.first_seen IS NULL THEN 'new' WHEN n.title IS NULL THEN 'kept' ELSE 'updated' END AS state FROM o FULL JOIN n USING (key)""")
def ledger_upsert(spark, sf_dir):
    """A ledger of the first days' roles takes in the later ones, of all users."""
    e = units(spark, sf_dir).withColumnRenamed("covered_through", "ts")
    old = e.filter("ts < TIMESTAMP '2024-01-10'").groupBy("key").agg(F.max_by("event_type", "event_id").alias("title"), F.min("ts").alias("posted_at"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    new = e.filter("ts >= TIMESTAMP '2024-01-10'").select("key", F.col("event_type").alias("title"), F.col("ts").alias("posted_at"), F.col("ts").alias("seen_at"), "event_id")
    return ledger.upsert(old, new, "key", "event_id")


@query("active_boards", "SELECT user_id AS key, count(DISTINCT ts::DATE) AS hit_days, max(ts::DATE) AS last_hit, DATE '2024-01-31' - max(ts::DATE) > 2 AS overdue FROM events WHERE event_type = 'purchase' GROUP BY 1")
def active_boards(spark, sf_dir):
    return ledger.active(units(spark, sf_dir).filter("event_type = 'purchase'"), "key", "run", "2024-01-31", 2)


@query("unseen_events", "SELECT event_id, user_id AS key FROM events WHERE ts >= TIMESTAMP '2024-01-25' AND user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-25' AND event_type = 'purchase' AND value > 400)")
def unseen_events(spark, sf_dir):
    u = units(spark, sf_dir)
    seen = u.filter("covered_through < TIMESTAMP '2024-01-25' AND event_type = 'purchase' AND value > 400")
    return ledger.unseen(u.filter("covered_through >= TIMESTAMP '2024-01-25'"), seen, "key").select("event_id", "key")


@query("oldest_fetched", "SELECT event_type, min(ts) AS oldest, max(ts) AS newest, count(*) AS n FROM events GROUP BY 1")
def oldest_fetched(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.count(F.lit(1)).alias("n"))


@query("covered_through_groups", """WITH g AS (SELECT user_id % 10 AS grp, max(CASE WHEN value < 490 THEN ts END) AS reached, count(*) > 5 AS capped FROM events GROUP BY 1) SELECT min(reached) AS covered_through, count(*) FILTER (capped) AS capped_groups FROM g WHERE capped""")
def covered_through_groups(spark, sf_dir):
    """The time up to which all capped groups have been read."""
    g = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("grp")).agg(F.max(F.when(F.col("value") < 490, F.col("ts"))).alias("reached"), (F.count(F.lit(1)) > 5).alias("capped"))
    return g.filter("capped").agg(F.min("reached").alias("covered_through"), F.count_if("capped").alias("capped_groups"))
