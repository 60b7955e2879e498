"""Queries of what is kept from run to run: funds' lists and sites, retention, records of older versions, snapshots, checks, the outbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.operators import checks, funds, migration, retention
from rookery.operators.graphs import fresh_folder
from rookery.plans.registry import query, table
from rookery.streaming import outbox

_NOW = "2024-03-01 00:00:00"


def _now():
    return F.lit(_NOW).cast("timestamp")



@query("fund_lists", f"""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, 'f' || s_nationkey AS fund, s_name FROM supplier), c AS (SELECT *, TIMESTAMP '{_NOW}' - CASE WHEN n % 3 = 0 THEN INTERVAL 19 HOUR ELSE INTERVAL 21 HOUR END AS fetched_at, CASE WHEN k % 5 <> 0 THEN TIMESTAMP '{_NOW}' - to_days(((k % 4) * 20 + 1)::INT) END AS last_seen, k % 7 <> 0 AS cached, n % 4 <> 3 AND k % 2 = 0 AS listed FROM s),
  f AS (SELECT fund, bool_or(cached) AS any_cached, bool_or(cached) AND bool_and(n % 3 = 0) AS fresh, bool_or(listed) AS any_listed FROM c GROUP BY 1), m AS (SELECT c.*, any_listed AND NOT fresh AS renew FROM c JOIN f USING (fund))
  SELECT fund, 'k' || k AS key, CASE WHEN renew AND listed AND (k % 4 = 0 OR NOT cached) THEN CASE WHEN k % 4 = 0 THEN 'new ' || s_name END ELSE s_name END AS name, CASE WHEN renew AND listed THEN TIMESTAMP '{_NOW}' ELSE last_seen END AS last_seen, CASE WHEN renew THEN TIMESTAMP '{_NOW}' ELSE fetched_at END AS fetched_at
  FROM m WHERE (renew AND listed) OR (cached AND (NOT renew OR last_seen > TIMESTAMP '{_NOW}' - INTERVAL 60 DAY))""")
def fund_lists(spark, sf_dir):
    """Lists of funds: fresh ones stay, old ones take what is listed now and keep what was seen within sixty days."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    fund, key = F.concat(F.lit("f"), F.col("s_nationkey").cast("string")).alias("fund"), F.concat(F.lit("k"), k.cast("string")).alias("key")
    ago = lambda hours: F.timestamp_seconds(_now().cast("double") - hours * 3_600)
    cached = s.filter("s_suppkey % 7 <> 0").select(fund, key, F.col("s_name").alias("name"), F.when(k % 5 != 0, ago(((k % 4) * 20 + 1) * 24)).alias("last_seen"), ago(F.when(F.col("s_nationkey") % 3 == 0, 19).otherwise(21)).alias("fetched_at"))
    listed = s.filter("s_nationkey % 4 <> 3 AND s_suppkey % 2 = 0").select(fund, key, F.when(k % 4 == 0, F.concat(F.lit("new "), "s_name")).alias("name"))
    found = funds.merged_lists(cached, listed, _now())
    return found.select("fund", "key", "name", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"))


def _cache(spark, sf_dir):
    k = F.col("c_custkey")
    ago = lambda days: F.timestamp_seconds(_now().cast("double") - days * 86_400)
    status = F.get(F.array(*map(F.lit, ("found", "none", "error", "dead_link"))), (k % 4).cast("int"))
    return table(spark, sf_dir, "customer").filter("c_custkey % 9 <> 0").select(
        F.concat(F.lit("s"), k.cast("string")).alias("site"), status.alias("status"), ago(k % 40).alias("checked_at"), F.when(k % 4 == 0, F.concat(F.lit("https://b.example/"), k.cast("string"), F.lit("/"))).alias("careers_url"),
        F.when(k % 4 == 3, F.array(F.struct(F.lit("https://old.example").alias("careers_url"), F.lit("404").alias("status"), ago(k % 100).alias("at")))).cast(funds.REJECTED).alias("rejected"),
    )


_SITES = f"""WITH c AS (SELECT c_custkey AS k, 's' || c_custkey AS site, ['found', 'none', 'error', 'dead_link'][c_custkey % 4 + 1] AS status, TIMESTAMP '{_NOW}' - to_days((c_custkey % 40)::INT) AS checked_at, c_custkey % 9 <> 0 AS cached, c_custkey % 2 = 0 AS asked, c_custkey % 14 = 0 AS deadline, CASE WHEN c_custkey % 3 = 0 THEN 'error' ELSE 'none' END AS said FROM customer) """


@query("resolved_sites", _SITES + f"""SELECT site, CASE WHEN NOT asked OR deadline OR (said = 'error' AND cached AND status = 'found') THEN status ELSE said END AS status, CASE WHEN NOT asked OR deadline THEN checked_at WHEN said = 'error' AND cached AND status = 'found' THEN TIMESTAMP '{_NOW}' - INTERVAL 28 DAY ELSE TIMESTAMP '{_NOW}' END AS checked_at,
  CASE WHEN NOT asked OR deadline THEN CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END WHEN said = 'error' AND cached AND status = 'found' THEN 0 ELSE CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END END AS rejected FROM c WHERE cached OR (asked AND NOT deadline)""")
def resolved_sites(spark, sf_dir):
    """Today's results over what was known: time cut short is no result, an error spares what was found, proofs that boards are gone are kept for ninety days."""
    k = F.col("c_custkey")
    ago = lambda days: F.timestamp_seconds(_now().cast("double") - days * 86_400)
    proof = lambda url, status, days: F.struct(F.lit(url).alias("careers_url"), F.lit(status).alias("status"), ago(F.lit(days)).alias("at"))
    rejected = F.when(k % 6 == 0, F.array(proof("https://x.example/", "404", 5), proof("https://X.example", "410", 4), proof("https://y.example", "503", 1), proof("https://z.example", "404", 91)))
    results = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("s"), k.cast("string")).alias("site"), F.when(k % 3 == 0, "error").otherwise("none").alias("status"), (k % 14 == 0).alias("deadline"), F.lit(None).cast("string").alias("careers_url"), rejected.cast(funds.REJECTED).alias("rejected"))
    found = funds.resolved_sites(_cache(spark, sf_dir), results, _now())
    return found.select("site", "status", F.col("checked_at").cast("timestamp_ntz").alias("checked_at"), F.coalesce(F.size("rejected"), F.lit(0)).alias("rejected")).withColumn("rejected", F.greatest("rejected", F.lit(0)))


@query("due_sites", _SITES + f"""SELECT site, CASE WHEN lost THEN 'dead_link' ELSE status END AS status FROM (SELECT *, k % 4 = 0 AND k % 5 = 0 AS lost FROM c WHERE cached)
  WHERE lost OR k % 40 >= CASE status WHEN 'found' THEN 30 WHEN 'error' THEN 2 ELSE 14 END""")
def due_sites(spark, sf_dir):
    """Sites to look at again: those whose time is over, and those whose board was gone when it was read."""
    k = F.col("c_custkey")
    units = table(spark, sf_dir, "customer").select(F.concat(F.lit("fund:board:https://B.example/"), k.cast("string")).alias("key"), F.when(k % 5 < 2, "failed").otherwise("complete").alias("status"), F.array(F.when(k % 5 == 0, "got HTTP 404 today").otherwise("HTTP 4040 timeout")).alias("errors"))
    return funds.due(funds.retired(_cache(spark, sf_dir), units, _now()), _now()).select("site", "status")


@query("pruned_observations", "SELECT strftime(ts, '%Y-%m-%d') || '-' || event_type AS run, count(*) AS rows FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND strftime(ts, '%Y-%m-%d') || '-' || event_type <> '2024-01-12-click' GROUP BY 1")
def pruned_observations(spark, sf_dir):
    """A table of runs, of which one is written again, the old ones go by name, and so does a committed one."""
    name = "kept_" + fresh_folder(spark, "runs").rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{fresh_folder(spark, 'runs')}'")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("-"), "event_type").alias("run"))
    retention.create(spark, f"{name}.observed", "event_id LONG")
    retention.write(rows, f"{name}.observed")
    retention.write(rows.filter("run LIKE '2024-01-1%'"), f"{name}.observed")
    retention.prune(spark, f"{name}.observed", "2024-01-10", ("2024-01-12-click",))
    return spark.table(f"{name}.observed").groupBy("run").agg(F.count(F.lit(1)).alias("rows"))


_MARKS = """WITH o AS (SELECT o_custkey AS id, strftime(o_orderdate, '%Y-%m-%d') || '-' || o_orderkey AS run, CASE WHEN o_orderkey % 6 = 0 THEN 'E' WHEN o_orderkey % 6 = 1 THEN 'R' WHEN o_orderkey % 6 = 2 THEN 'r' WHEN o_orderkey % 6 = 3 THEN 'L' ELSE 'O' END AS m FROM orders),
  m AS (SELECT id, array_agg(m ORDER BY run) AS ms, count(*) AS runs FROM o GROUP BY 1), p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 1 THEN 'published' WHEN c_custkey % 10 = 2 THEN 'pending' END AS role, ms, coalesce(runs, 0) AS runs FROM customer LEFT JOIN m ON id = c_custkey)"""


@query("legacy_decisions", _MARKS + """ SELECT 'c' || id AS id, coalesce(list_reduce(list_concat([coalesce(role, CASE ms[1] WHEN 'E' THEN 'published' WHEN 'R' THEN 'pending' WHEN 'r' THEN 'pending' WHEN 'L' THEN 'below_threshold' WHEN 'O' THEN 'legacy_processed' END)], CASE WHEN role IS NULL THEN ms[2:] ELSE coalesce(ms, []) END),
    lambda d, m: CASE WHEN m = 'E' AND d = 'pending' THEN 'published' WHEN m = 'R' AND d NOT IN ('published', 'actioned') THEN 'pending' WHEN m = 'L' AND d IN ('legacy_processed', 'pending') THEN 'below_threshold' ELSE d END), 'suppressed') AS decision, runs FROM p""")
def legacy_decisions(spark, sf_dir):
    """Three versions of records in one read, and what each posting comes to."""
    root = fresh_folder(spark, "versions")
    customers, orders, k = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), F.col("o_orderkey") % 6
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("id")
    customers.select(name("c_custkey"), F.lit("2023-01-01").alias("date"), F.lit(1).alias("unknown")).write.json(f"{root}/v1")
    orders.select(
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("run"), name("o_custkey"), F.when(k != 2, "T").alias("title"), F.lit("https://x.example").alias("url"),
        F.when(k == 1, 4.0).when(k == 3, 1.5).alias("score"), F.when(k == 2, "heuristic").when(k == 3, "model").otherwise("ruled").alias("rankStatus"), F.lit("r").alias("reason"), (k == 0).alias("inEmail"),
    ).write.json(f"{root}/v2")
    customers.filter("c_custkey % 10 IN (1, 2)").select(name("c_custkey"), F.when(F.col("c_custkey") % 10 == 1, "published").otherwise("pending").alias("decision")).write.json(f"{root}/v3")
    return migration.decisions(migration.read(spark, f"{root}/v1", f"{root}/v2", f"{root}/v3")).select("id", "decision", "runs")


@query("replayed_snapshot", "SELECT event_id, event_type AS title, '2024-02-0' || (1 + max(event_id % 3) OVER ()) AS run FROM events WHERE event_id % 3 = (SELECT max(event_id % 3) FROM events)")
def replayed_snapshot(spark, sf_dir):
    """The latest of several runs' snapshots, older kinds among them."""
    root, events = fresh_folder(spark, "snapshots"), table(spark, sf_dir, "events")
    for i, path in enumerate(("2024-02-01/raw.json", "2024-02-02/raw.json", "2024-02-03/raw.json", "2024-02-09-raw.json")):
        events.filter(F.col("event_id") % 3 == i % 3).select("event_id", F.col("event_type").alias("title")).write.json(f"{root}/{path}")
    return migration.replay(spark, root, "event_id long, title string").select("event_id", "title", "run")


@query("check_report", """WITH o AS (SELECT count(*) AS rows, count(*) FILTER (o_orderstatus <> 'F') AS s, count(*) FILTER (o_totalprice < 1000) AS p, count(*) FILTER (o_orderdate IS NULL) AS d FROM orders)
  SELECT 'no day is missing' AS name, CASE WHEN d = 0 THEN 'ok' ELSE 'fail' END AS state, d AS broken, rows FROM o UNION ALL SELECT 'prices', CASE WHEN p > 0.5 * rows THEN 'fail' WHEN p > 0 THEN 'warn' ELSE 'ok' END, p, rows FROM o UNION ALL SELECT 'all are filled', CASE WHEN s > 0 THEN 'fail' ELSE 'ok' END, s, rows FROM o UNION ALL SELECT 'enough rows', 'fail', 0, rows FROM o""")
def check_report(spark, sf_dir):
    """Checks gathered while the rows are written."""
    wanted = [checks.Check("no day is missing", F.col("o_orderdate").isNotNull()), checks.Check("prices", F.col("o_totalprice") >= 1_000, spare=0.5), checks.Check("all are filled", F.col("o_orderstatus") == "F"), checks.Check("enough rows", F.lit(True), least=1 << 40)]
    checked = checks.Checked(table(spark, sf_dir, "orders"), wanted)
    checked.rows.write.parquet(fresh_folder(spark, "checked"))
    return checked.report()


@query("delivered_runs", "SELECT DISTINCT o_custkey::VARCHAR AS run_id FROM orders")
def delivered_runs(spark, sf_dir):
    """Messages of runs, several a run and over several batches, delivered once each."""
    root = fresh_folder(spark, "outbox")
    messages = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("message"))
    messages.repartition(4, "position").write.parquet(f"{root}/in")
    stream = spark.readStream.schema("run_id string, position long, message string").option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    stream.writeStream.foreachBatch(outbox.outbox(f"{root}/sent")).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("run_id string").parquet(f"{root}/sent").select("run_id")
