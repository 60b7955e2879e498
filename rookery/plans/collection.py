"""Queries of collection: scans of stored boards, sweeps of directories, a published dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.operators.graphs import fresh_folder
from rookery.plans.registry import query, table
from rookery.sources import dataset, scan
from rookery.streaming import sweep

_UNTIL = "2024-01-31"
_PARTS = """WITH p AS (SELECT p_partkey // 50 AS n, p_partkey, p_name, p_brand, p_size FROM part), b AS (SELECT n, 'b' || n AS board, count(*) AS rows, n % 7 AS how, CASE n % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END AS provider FROM p GROUP BY 1) """


def _stored_boards(spark, sf_dir):
    """Parts as stored answers of boards of 50: whole ones, partial ones, and all the ways in which a board fails."""
    part = table(spark, sf_dir, "part").withColumn("n", F.floor(F.col("p_partkey") / 50))
    url = F.concat(F.lit("https://x.example.com/"), F.col("p_partkey").cast("string"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int"))
    rows = lambda **f: F.collect_list(F.struct(*(v.alias(k) for k, v in f.items())))
    seen = part.groupBy("n").agg(
        rows(title=F.col("p_name"), absolute_url=url, location=F.struct(F.col("p_brand").alias("name")), first_published=day.cast("string")).alias("g"),
        rows(text=F.col("p_name"), hostedUrl=url, categories=F.struct(F.col("p_brand").alias("location")), createdAt=F.unix_timestamp(day.cast("timestamp")) * 1000).alias("l"),
        rows(title=F.col("p_name"), jobUrl=url, location=F.col("p_brand"), publishedAt=day.cast("string")).alias("a"),
    )
    n, how = F.col("n"), F.col("n") % 7
    body = F.when(n % 3 == 0, F.to_json(F.struct(F.col("g").alias("jobs")))).when(n % 3 == 1, F.to_json("l")).otherwise(F.to_json(F.struct(F.col("a").alias("jobs"))))
    own = F.get(F.array(*map(F.lit, ("greenhouse", "lever", "ashby"))), (n % 3).cast("int"))
    home = F.concat(F.get(F.array(*map(F.lit, ("https://boards.greenhouse.io/", "https://jobs.lever.co/", "https://jobs.ashbyhq.com/"))), (n % 3).cast("int")), F.lit("b"), n.cast("string"))
    answers = seen.select(
        F.concat(F.lit("b"), n.cast("string")).alias("board"), F.when(how == 4, "nosuch").when(how != 0, own).alias("provider"), home.alias("url"),
        F.when(how == 1, 404).when(how == 2, 429).when((how == 0) & (n % 2 == 1), 503).when(how != 3, 200).alias("status"), F.when(how == 3, "request aborted").alias("message"),
        F.when(how == 5, "{").when(~how.isin(1, 2, 3) & ~((how == 0) & (n % 2 == 1)), body).alias("body"), (how == 6).alias("incomplete"),
    )
    folder = fresh_folder(spark, "boards")
    answers.write.json(folder)
    return scan.scan(spark, folder)


@query("board_scan", _PARTS + f"""SELECT 'board:' || board AS key, CASE how WHEN 4 THEN 'nosuch' ELSE provider END AS provider, CASE WHEN how IN (1, 2, 3, 5) OR (how = 0 AND n % 2 = 1) THEN 'failed' WHEN how = 4 THEN 'unsupported' WHEN how = 6 THEN 'partial' ELSE 'complete' END AS status,
  CASE WHEN how = 1 THEN 'not_found' WHEN how = 2 THEN 'rate_limit' WHEN how = 3 THEN 'timeout' WHEN how = 4 THEN 'unsupported' WHEN how = 5 THEN 'fetch_error' WHEN how = 0 AND n % 2 = 1 THEN 'http_5xx' END AS error,
  CASE WHEN how = 6 OR (how = 0 AND n % 2 = 0) THEN rows ELSE 0 END AS records, CASE WHEN how = 0 AND n % 2 = 0 THEN DATE '{_UNTIL}' END AS covered_through FROM b""")
def board_scan(spark, sf_dir):
    """A coverage row for each stored board, failed ones included."""
    return scan.units(_stored_boards(spark, sf_dir), F.lit(_UNTIL).cast("date")).select("key", "provider", "status", "error", "records", "covered_through")


@query("scanned_postings", _PARTS + f"""SELECT board, provider, p_name AS title, 'https://x.example.com/' || p_partkey AS url, DATE '2024-01-01' + p_size::INT AS posted_at,
  CASE WHEN NOT regexp_matches(p_name, '\\b(ring|bolt)\\b') THEN 'title' WHEN DATE '2024-01-01' + p_size::INT NOT BETWEEN DATE '2024-01-10' AND DATE '{_UNTIL}' THEN 'window' END AS reason FROM p JOIN b USING (n) WHERE how = 6 OR (how = 0 AND n % 2 = 0)""")
def scanned_postings(spark, sf_dir):
    """Postings of the boards that answered, and why those left out are."""
    found = scan.judged(_stored_boards(spark, sf_dir), ["ring", "bolt"], F.lit("2024-01-10").cast("date"), F.lit(_UNTIL).cast("date"))
    return found.select("board", "provider", "title", "url", "posted_at", "reason")


@query("lever_scan", _PARTS + "SELECT board, rows AS records FROM b WHERE provider = 'lever' AND (how = 6 OR (how = 0 AND n % 2 = 0))")
def lever_scan(spark, sf_dir):
    """The boards of one provider: the source itself leaves the others out."""
    rows = _stored_boards(spark, sf_dir).filter("provider = 'lever' AND place IS NOT NULL")
    return rows.groupBy("board").agg(F.count(F.lit(1)).alias("records"))


@query("error_classes", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'not_found' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'timeout' WHEN 3 THEN 'unsupported' WHEN 4 THEN 'http_5xx' WHEN 5 THEN 'http_403' WHEN 6 THEN 'fetch_error' ELSE 'timeout' END AS error FROM events""")
def error_classes(spark, sf_dir):
    """What failures are, by status and message; the status of a missing page goes before its message, a message of time before other statuses."""
    i = (F.col("event_id") % 8).cast("int")
    status = F.get(F.array(*(F.lit(x).cast("int") for x in (404, 429, None, None, 503, 403, None, 500))), i)
    message = F.get(F.array(*(F.lit(x).cast("string") for x in ("timeout", None, "Deadline reached", "cannot derive API URL", "bad gateway", "", "socket hang up", "AbortError: x"))), i)
    return table(spark, sf_dir, "events").select("event_id", scan.error_class(status, message).alias("error"))


_LINES = """WITH d AS (SELECT o_orderkey AS position, o_custkey AS c, ['ashby', 'greenhouse', 'icims', 'lever', 'workday', 'other'][o_orderkey % 6 + 1] AS vendor, o_orderkey % 10 = 3 AS odd FROM orders) """


@query("directory_sweep", _LINES + """SELECT position, vendor, CASE vendor WHEN 'workday' THEN 't' ELSE 's' END || c AS name, CASE vendor WHEN 'ashby' THEN 'https://jobs.ashbyhq.com/s' || c WHEN 'greenhouse' THEN 'https://job-boards.greenhouse.io/s' || c WHEN 'icims' THEN 'https://careers-s' || c || '.icims.com/jobs/search?ss=1&in_iframe=1'
    WHEN 'lever' THEN 'https://jobs.lever.co/s' || c ELSE 'https://t' || c || '.wd1.myworkdayjobs.com/Site' END AS careers_url FROM d WHERE vendor <> 'other' AND NOT odd AND NOT (vendor = 'lever' AND c % 7 = 0)""")
def directory_sweep(spark, sf_dir):
    """A directory swept chunk by chunk: lines become boards, lines that name none and dead boards are skipped."""
    orders = table(spark, sf_dir, "orders")
    vendor = F.get(F.array(*map(F.lit, ("ashby", "greenhouse", "icims", "lever", "workday", "other"))), (F.col("o_orderkey") % 6).cast("int"))
    c = F.col("o_custkey").cast("string")
    line = F.when(vendor == "workday", F.when(F.col("o_orderkey") % 10 == 3, F.concat(F.lit("t"), c, F.lit("|wd1"))).otherwise(F.concat(F.lit("t"), c, F.lit("|wd1|Site")))).when(F.col("o_orderkey") % 10 == 3, "a slug?").otherwise(F.concat(F.lit("s"), c))
    lines = orders.select(F.col("o_orderkey").alias("position"), vendor.alias("vendor"), line.alias("line"))
    dead = orders.filter("o_custkey % 7 < 2").select(F.lit("lever").alias("vendor"), F.concat(F.lit("https://JOBS.lever.co/s"), c).alias("board"), F.when(F.col("o_custkey") % 7 == 0, 3).otherwise(2).alias("misses")).distinct()
    return sweep.whole_sweep(spark, lines, dead, 5_000).select("position", "vendor", "name", "careers_url")


def stored_dataset(spark, rows, last_updated):
    """Rows as gzipped JSON chunks with the manifest that lists them."""
    folder = fresh_folder(spark, "dataset")
    rows.write.option("compression", "gzip").json(folder)
    names = [r.path.rsplit("/", 1)[1] for r in spark.read.format("binaryFile").load(folder).select("path").collect()]  # one name a chunk
    spark.createDataFrame([(last_updated, names)], dataset.MANIFEST).coalesce(1).write.json(f"{folder}/manifest.json")
    return folder


@query("dataset_lane", """WITH r AS (SELECT o_orderkey, o_custkey, o_orderpriority AS title, ['greenhouse', 'lever', 'workday', 'paylocity', 'other'][o_orderkey % 5 + 1] AS ats, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS seen FROM orders WHERE o_orderkey % 17 <> 0),
  n AS (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN c_name ELSE 'customer' || o_custkey END AS company FROM r LEFT JOIN customer ON c_custkey = o_custkey)
  SELECT 'https://x.example.com/jobs/' || o_orderkey AS url, title, company, o_custkey % 2 = 1 AND ats <> 'paylocity' AS company_is_slug, CASE ats WHEN 'greenhouse' THEN 'https://job-boards.greenhouse.io/customer' || o_custkey WHEN 'lever' THEN 'https://jobs.lever.co/customer' || o_custkey END AS careers_url, seen IS NULL AS uncertain
  FROM n WHERE ats <> 'other' AND title IN ('1-URGENT', '2-HIGH') AND (seen IS NULL OR seen BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-01-01') AND NOT regexp_matches(company, '^Customer#.*4$')""")
def dataset_lane(spark, sf_dir):
    """A published dataset: its manifest, its chunks, the window, the titles, the boards, the names, and once more the filter that looks at names."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    ats = F.get(F.array(*map(F.lit, ("Greenhouse", "lever", "workday", "paylocity", "other"))), (key % 5).cast("int"))
    rows = orders.select(F.when(key % 17 != 0, F.concat(F.lit("https://x.example.com/jobs/"), key.cast("string"))).alias("url"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("customer"), F.col("o_custkey").cast("string")).alias("company"), ats.alias("ats"), F.when(key % 9 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("first_seen"))
    folder = stored_dataset(spark, rows, "2024-01-01T00:00:00Z")
    found = dataset.manifest(spark, folder, "2024-01-01T12:00:00Z")
    good, _ = dataset.records(spark, folder, found.chunks)
    kept = dataset.with_boards(dataset.in_window(good, ["greenhouse", "lever", "workday", "paylocity"], F.lit("1998-01-01").cast("timestamp"), F.lit("1999-01-01").cast("timestamp")).filter(F.col("title").isin("1-URGENT", "2-HIGH")))
    names = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("customer"), F.col("c_custkey").cast("string")).alias("slug"), F.col("c_name").alias("name"))
    lane = dataset.lane(kept, names, lambda df: df.filter(F.col("title").isin("1-URGENT", "2-HIGH") & ~F.col("company").rlike("^Customer#.*4$")))
    return lane.select("url", "title", "company", "company_is_slug", "board.careers_url", "uncertain")


@query("dataset_leftovers", "SELECT count(*) FILTER (o_orderkey % 17 = 0) AS corrupt, count(*) FILTER (o_orderkey % 17 <> 0) AS whole FROM orders")
def dataset_leftovers(spark, sf_dir):
    """Records of a dataset that are kept apart, and those that aren't."""
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 17 != 0, F.concat(F.lit("https://x.example.com/"), F.col("o_orderkey").cast("string"))).alias("url"), F.col("o_orderpriority").alias("title"))
    folder = stored_dataset(spark, rows, "2024-01-01T00:00:00Z")
    good, corrupt = dataset.records(spark, folder, dataset.manifest(spark, folder, "2024-01-02T00:00:00Z").chunks)
    return corrupt.agg(F.count(F.lit(1)).alias("corrupt")).crossJoin(good.agg(F.count(F.lit(1)).alias("whole")))  # a row each


@query("sweep_skips", _LINES + "SELECT vendor, count(*) AS lines, count(*) FILTER (vendor <> 'other' AND NOT odd) AS boards FROM d GROUP BY 1")
def sweep_skips(spark, sf_dir):
    """How many lines of a directory name a board."""
    orders = table(spark, sf_dir, "orders")
    vendor = F.get(F.array(*map(F.lit, ("ashby", "greenhouse", "icims", "lever", "workday", "other"))), (F.col("o_orderkey") % 6).cast("int"))
    line = F.when(F.col("o_orderkey") % 10 == 3, "no/slug").when(vendor == "workday", F.concat(F.lit("t"), F.col("o_custkey").cast("string"), F.lit("|wd5|S"))).otherwise(F.concat(F.lit("s"), F.col("o_custkey").cast("string")))
    named = orders.select(vendor.alias("vendor"), line.alias("line")).withColumn("b", sweep.board_of(F.col("vendor"), F.col("line")))
    return named.groupBy("vendor").agg(F.count(F.lit(1)).alias("lines"), F.count("b").alias("boards"))
