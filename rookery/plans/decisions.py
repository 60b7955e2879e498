"""Queries of ranking, feedback and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rookery.functions.urls import unit_key
from rookery.operators import feedback, ranking
from rookery.plans.postings import CLASSIFIED, classified
from rookery.plans.registry import query, table
from rookery.sources import boards, files, packing


@query("rank_budget", f"""WITH {CLASSIFIED}, k AS (SELECT ordinal, heuristic, CASE WHEN l_suppkey % 3 = 0 THEN (l_partkey % 6)::DOUBLE END AS cached_score FROM c WHERE reason IS NULL),
  n AS (SELECT ordinal, row_number() OVER (ORDER BY heuristic DESC, ordinal) AS n FROM k WHERE cached_score IS NULL QUALIFY n <= 250)
  SELECT ordinal, CASE WHEN cached_score IS NOT NULL THEN 'cache' WHEN n IS NOT NULL THEN 'model' ELSE 'over_budget' END AS rank_status, floor((n - 1) / 25)::BIGINT AS batch FROM k LEFT JOIN n USING (ordinal)""")
def rank_budget(spark, sf_dir):
    kept = classified(spark, sf_dir).filter("reason IS NULL").select("ordinal", "heuristic", "l_suppkey", "l_partkey")
    cache = kept.filter("l_suppkey % 3 = 0").select("ordinal", (F.col("l_partkey") % 6).cast("double").alias("cached_score"))
    return ranking.budgeted(kept, cache, "ordinal", [F.desc("heuristic"), F.asc("ordinal")], 250, 25).select("ordinal", "rank_status", "batch")


_ANSWER = "SELECT user_id * 10 + event_id % 10 AS id, CASE WHEN event_id % 11 = 0 THEN 7.0 ELSE floor(value / 100) END::DOUBLE AS score, CASE WHEN event_type = 'error' THEN 'short' ELSE 'because ' || event_type || ' fits' END AS reason FROM events"


@query("model_rows", f"""WITH a AS ({_ANSWER}), g AS (SELECT *, score BETWEEN 0 AND 5 AND length(reason) >= 12 AS good FROM a),
  t AS (SELECT id, count(*) AS answers, count(*) FILTER (good) AS n, count(DISTINCT CASE WHEN good THEN score END) AS kinds, min(CASE WHEN good THEN score END) AS s FROM g GROUP BY 1),
  u AS (SELECT id, answers, CASE WHEN n = 0 THEN 'invalid' WHEN kinds > 1 THEN 'conflict' WHEN answers > 1 THEN 'recovered' ELSE 'ok' END AS status, s FROM t)
  SELECT id, answers, status, CASE WHEN status IN ('ok', 'recovered') THEN s END AS score FROM u""")
def model_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("id"), F.when(F.col("event_id") % 11 == 0, 7.0).otherwise(F.floor(F.col("value") / 100)).cast("double").alias("score"), F.when(F.col("event_type") == "error", "short").otherwise(F.concat(F.lit("because "), "event_type", F.lit(" fits"))).alias("reason"))
    return ranking.validate(rows, "id")


@query("bonus_and_threshold", f"""WITH {CLASSIFIED}, s AS (SELECT ordinal, watchlist, (l_partkey % 51)::DOUBLE / 10 AS score, CASE l_suppkey % 4 WHEN 0 THEN 'cache' WHEN 1 THEN 'over_budget' ELSE 'model' END AS status, heuristic FROM c WHERE reason IS NULL),
  b AS (SELECT *, CASE WHEN NOT watchlist OR status = 'over_budget' THEN score ELSE least(5.0::DOUBLE, round(score + 0.5, 2)) END AS final FROM s)
  SELECT ordinal, final, round(heuristic::DOUBLE / 20, 1) AS fallback, CASE WHEN status = 'over_budget' THEN 'unscored' WHEN final >= 3.5 THEN 'eligible' ELSE 'below_threshold' END AS decision FROM b""")
def bonus_and_threshold(spark, sf_dir):
    kept = classified(spark, sf_dir).filter("reason IS NULL")
    status = F.when(F.col("l_suppkey") % 4 == 0, "cache").when(F.col("l_suppkey") % 4 == 1, "over_budget").otherwise("model")
    scored = kept.withColumn("status", status).withColumn("score", (F.col("l_partkey") % 51).cast("double") / 10)
    final = scored.withColumn("final", ranking.with_bonus(F.col("score"), F.col("watchlist"), 0.5, F.col("status") == "over_budget"))
    return final.select("ordinal", "final", ranking.fallback(F.col("heuristic")).alias("fallback"), ranking.decision(F.col("status"), F.col("final"), 3.5).alias("decision"))


_SHOWN = f"""{CLASSIFIED}, s AS (SELECT ordinal, company_key, watchlist, title, keyword_score FROM c WHERE reason IS NULL),
  a AS (SELECT DISTINCT lpad(event_id::VARCHAR, 12, '0') AS k FROM events WHERE event_type = 'purchase'), f AS (SELECT s.*, substr(ordinal, 1, 12) IN (SELECT k FROM a) AS added FROM s)"""


def _found(spark, sf_dir):
    shown = classified(spark, sf_dir).filter("reason IS NULL").select("ordinal", "company_key", "watchlist", F.col("match.keywords").alias("keywords"), F.substring("ordinal", 1, 12).alias("k"))
    bought = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("k")).distinct()
    return feedback.evidence(shown, shown.join(bought, "k", "left_semi"), "ordinal")


@query("evidence_gate", f"WITH {_SHOWN} SELECT count(*) AS n_shown, count(*) FILTER (added) AS n_added, count(*) >= 40 AND count(*) FILTER (added) >= 8 AS enough FROM f")
def evidence_gate(spark, sf_dir):
    return feedback.enough(_found(spark, sf_dir))


@query("companies_to_watch", f"WITH {_SHOWN} SELECT company_key, count(*) AS adds FROM f WHERE added AND NOT watchlist GROUP BY 1 HAVING count(*) >= 2")
def companies_to_watch(spark, sf_dir):
    return feedback.companies_to_watch(_found(spark, sf_dir), "company_key", "watchlist")


@query("idle_keywords", f"""WITH {_SHOWN}, k AS (SELECT CASE WHEN title LIKE 'large ring%' THEN 'large ring' WHEN title LIKE 'large%' THEN 'large' WHEN title LIKE '%large' THEN 'large' WHEN title LIKE 'red%' THEN 'red' WHEN title LIKE 'new%' THEN 'new' ELSE 'promo' END AS keyword, added FROM f WHERE keyword_score = 1)
  SELECT keyword, count(*) AS n_shown, count(*) FILTER (added) AS n_added FROM k GROUP BY 1 HAVING count(*) >= 12 AND count(*) FILTER (added) <= 100000""")
def idle_keywords(spark, sf_dir):
    return feedback.idle_keywords(_found(spark, sf_dir), "keywords", adds=100_000)


@query("pack_sources", """WITH RECURSIVE c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS i FROM c),
  f AS (SELECT p_brand, n, i, 0 AS grp, n AS used FROM o WHERE i = 1 UNION ALL SELECT o.p_brand, o.n, o.i, CASE WHEN f.used + o.n <= 300 THEN f.grp ELSE f.grp + 1 END, CASE WHEN f.used + o.n <= 300 THEN f.used + o.n ELSE o.n END FROM f JOIN o ON o.i = f.i + 1)
  SELECT p_brand, n, grp::INT AS "group" FROM f""")
def pack_sources(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return packing.pack_sources(counts, "p_brand", "n", 300)


@query("rotated_pages", "SELECT o_orderkey, o_orderpriority, ((o_orderkey - 17) % (count(*) OVER ()) + count(*) OVER ()) % count(*) OVER () AS place FROM orders")
def rotated_pages(spark, sf_dir):
    """Places of a list that begins elsewhere each day; its length is counted first."""
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", "o_orderpriority", packing.rotated(F.col("o_orderkey"), F.lit(17), F.lit(orders.count())).alias("place"))


@query("unit_keys", "SELECT page_id, 'page:' || regexp_replace(lower(url), '/+$', '') AS key FROM pages")
def unit_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", unit_key(F.lit("page"), F.col("url")).alias("key"))


@query("json_boards", """SELECT 'b' || (p_partkey // 50) AS board, p_name AS title, 'https://x.example.com/' || p_partkey AS url, p_type AS location, DATE '2024-01-01' + (p_size::INT) AS posted_at FROM part""")
def json_boards(spark, sf_dir):
    """Parts as the payloads of JSON boards, a payload a board and shape, parsed by the adapters of three vendors. Boards hold 50 parts, so their number grows with the table."""
    part = table(spark, sf_dir, "part").withColumn("board", F.concat(F.lit("b"), F.floor(F.col("p_partkey") / 50).cast("string"))).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")))
    url = F.concat(F.lit("https://x.example.com/"), F.col("p_partkey").cast("string"))
    third = lambda i: part.filter(F.col("p_partkey") % 3 == i)
    g = third(0).groupBy("board").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("p_name").alias("title"), url.alias("absolute_url"), F.struct(F.col("p_type").alias("name")).alias("location"), F.date_format("day", "yyyy-MM-dd'T'00:00:00'Z'").alias("first_published"))).alias("jobs"))).alias("payload"))
    lv = third(1).groupBy("board").agg(F.to_json(F.collect_list(F.struct(F.col("p_name").alias("text"), url.alias("hostedUrl"), F.struct(F.col("p_type").alias("location")).alias("categories"), (F.unix_timestamp("day") * 1000).alias("createdAt")))).alias("payload"))
    a = third(2).groupBy("board").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("p_name").alias("title"), url.alias("jobUrl"), F.col("p_type").alias("location"), F.lit(False).alias("isRemote"), F.date_format("day", "yyyy-MM-dd").alias("publishedAt"))).alias("jobs"))).alias("payload"))
    found = boards.greenhouse(g).unionByName(boards.lever(lv)).unionByName(boards.ashby(a))
    return found.select("board", "title", "url", "location", "posted_at")


@query("xml_boards", "SELECT 'b' || (s_suppkey // 50) AS board, s_name AS title, 'https://x.example.com/' || s_suppkey AS url, 'n' || s_nationkey AS location FROM supplier")
def xml_boards(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("board", F.concat(F.lit("b"), F.floor(F.col("s_suppkey") / 50).cast("string")))
    out = None
    for i, (item, f) in enumerate(boards.XML_BOARDS.values()):
        tag = lambda n, v: F.concat(F.lit(f"<{n}>"), v, F.lit(f"</{n}>"))
        one = tag(item, F.concat(tag(f["title"], F.concat(F.lit("<![CDATA["), "s_name", F.lit("]]>"))), tag(f["url"], F.concat(F.lit("https://x.example.com/"), F.col("s_suppkey").cast("string"))), tag(f["location"], F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))))
        payload = s.filter(F.col("s_suppkey") % len(boards.XML_BOARDS) == i).groupBy("board").agg(F.concat_ws("\n", F.collect_list(one)).alias("payload"))
        found = boards.xml_items(payload, item, f).select("board", "title", "url", "location")
        out = found if out is None else out.unionByName(found)
    return out


@query("comment_headers", "SELECT o_orderkey, 'Company ' || o_custkey AS company, o_orderpriority AS role, 'https://x.example.com/' || o_orderkey AS url FROM orders WHERE o_orderkey % 4 <> 0")
def comment_headers(spark, sf_dir):
    said = F.when(F.col("o_orderkey") % 4 == 0, "no header here").otherwise(F.concat(F.lit("Company "), F.col("o_custkey").cast("string"), F.lit(" | "), "o_orderpriority", F.lit(" | Remote | https://x.example.com/"), F.col("o_orderkey").cast("string"), F.lit("\nMore text | here")))
    h = boards.comment_header(said)
    return table(spark, sf_dir, "orders").select("o_orderkey", h["company"].alias("company"), h["role"].alias("role"), h["url"].alias("url")).filter("company IS NOT NULL")


@query("card_boards", "SELECT 'b' || (s_suppkey // 50) AS board, s_name AS title, 'https://x.example.com/' || s_suppkey AS url, 'n' || s_nationkey AS location FROM supplier")
def card_boards(spark, sf_dir):
    card = F.format_string('<li class="card"><a href="https://x.example.com/%d"><b>%s</b></a><i>n%d</i></li>', "s_suppkey", "s_name", "s_nationkey")
    pages = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("b"), F.floor(F.col("s_suppkey") / 50).cast("string")).alias("board")).agg(F.concat_ws("", F.collect_list(card)).alias("payload"))
    return boards.html_cards(pages, r'(?s)<li class="card">(.*?)</li>', r"<b>(.*?)</b>", r'href="([^"]+)"', r"<i>(.*?)</i>").select("board", "title", "url", "location")


@query("csv_cells", """SELECT event_id, CASE WHEN regexp_matches(props, '[",\n\r]') THEN '"' || replace(props, '"', '""') || '"' ELSE props END AS cell, substr('''=' || event_type, 1, 500) AS safe FROM events""")
def csv_cells(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", files.csv_cell(F.col("props")).alias("cell"), files.safe_cell(F.concat(F.lit("="), "event_type")).alias("safe"))


@query("board_observations", """WITH r AS (SELECT ts::DATE AS run, user_id AS board, event_id AS attempt, event_type AS outcome, CASE WHEN event_type IN ('purchase', 'view') THEN 1 ELSE 0 END AS n_jobs FROM events)
  SELECT run, board, outcome, n_jobs, attempt FROM r QUALIFY row_number() OVER (PARTITION BY run, board ORDER BY n_jobs DESC, attempt DESC) = 1""")
def board_observations(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("run"), F.col("user_id").alias("board"), F.col("event_id").alias("attempt"), F.col("event_type").alias("outcome"), F.when(F.col("event_type").isin("purchase", "view"), 1).otherwise(0).alias("n_jobs"))
    return files.observations(rows)


@query("dataset_window", "SELECT o_orderkey, o_orderdate::DATE AS first_seen FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-01-01'")
def dataset_window(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("ats"), F.to_date("o_orderdate").alias("first_seen"))
    return files.dataset_rows(rows, ["1-urgent", "2-high"], F.lit("1998-01-01").cast("date"), F.lit("1999-01-01").cast("date")).select("o_orderkey", "first_seen")


@query("facet_split", """WITH f AS (SELECT o_orderpriority AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT facet, sum(n)::BIGINT AS total, max(n) AS largest, count(*) AS n_values FROM f GROUP BY 1)
  SELECT facet, total, largest, row_number() OVER (ORDER BY largest, n_values DESC, facet) = 1 AS chosen FROM g""")
def facet_split(spark, sf_dir):
    """The facet whose largest slice is smallest splits a board that serves no more rows than its cap."""
    f = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("facet"), F.col("o_orderstatus").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    g = f.groupBy("facet").agg(F.sum("n").alias("total"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("n_values"))
    chosen = F.row_number().over(Window.orderBy("largest", F.desc("n_values"), "facet")) == 1
    return g.select("facet", "total", "largest", chosen.alias("chosen"))
