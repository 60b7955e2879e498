"""Queries of the text, url and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.functions import dates, jsons, text, urls
from rookery.operators import sites
from rookery.plans.registry import query, table

_SITE = r"regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\.', '')"


@query("canonical_urls", r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
  k AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(string_split(x, '=')[1], '(?i)^(utm_|ref$|source$|src$|gh_src$|lever-|trackingid$|refid$|trk$|trkinfo$|position$|pagenum$)'))), '&') AS kept FROM p)
  SELECT page_id, 'https://' || regexp_replace(lower(h), '^www\.', '') || CASE WHEN length(p) > 1 THEN regexp_replace(p, '/+$', '') ELSE '/' END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical_url,
  regexp_replace(lower(h), '^www\.', '') AS site, false AS aggregator FROM k""")
def canonical_urls(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(u).alias("canonical_url"), urls.site_key(u).alias("site"), urls.is_aggregator(u).alias("aggregator"))


@query("pages_per_site", rf"WITH s AS (SELECT page_id, {_SITE} AS site FROM pages) SELECT site, count(*) AS pages, min(page_id) AS first_page FROM s GROUP BY 1 HAVING count(*) > 1")
def pages_per_site(spark, sf_dir):
    sites = table(spark, sf_dir, "pages").select("page_id", urls.site_key(F.col("url")).alias("site"))
    return sites.groupBy("site").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page")).filter("pages > 1")


@query("vendor_requisitions", r"""WITH v AS (SELECT page_id, (['boards.greenhouse.io/acme/jobs/' || page_id, 'jobs.lever.co/acme/' || lpad(page_id::VARCHAR, 8, '0'), 'acme.wd5.myworkdayjobs.com/site/job/x/title_R-' || page_id, 'acme.recruitee.com/o/role-' || page_id, 'example.com/' || page_id])[page_id % 5 + 1] AS tail FROM pages)
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'greenhouse:acme:' || page_id WHEN 1 THEN 'lever:acme:' || lpad(page_id::VARCHAR, 8, '0') WHEN 2 THEN 'workday:acme:r-' || page_id WHEN 3 THEN 'recruitee:acme:role-' || page_id END AS requisition,
  substr(sha256(coalesce(CASE page_id % 5 WHEN 0 THEN 'greenhouse:acme:' || page_id WHEN 1 THEN 'lever:acme:' || lpad(page_id::VARCHAR, 8, '0') WHEN 2 THEN 'workday:acme:r-' || page_id WHEN 3 THEN 'recruitee:acme:role-' || page_id END, 'url:https://' || tail)), 1, 16) AS id FROM v""")
def vendor_requisitions(spark, sf_dir):
    """Requisition identities of vendors' urls made from page ids."""
    i = F.col("page_id").cast("string")
    forms = [F.concat(F.lit("https://boards.greenhouse.io/acme/jobs/"), i), F.concat(F.lit("https://jobs.lever.co/acme/"), F.lpad(i, 8, "0")), F.concat(F.lit("https://acme.wd5.myworkdayjobs.com/site/job/x/title_R-"), i), F.concat(F.lit("https://acme.recruitee.com/o/role-"), i), F.concat(F.lit("https://example.com/"), i)]
    made = table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*forms), (F.col("page_id") % 5 + 1).cast("int")).alias("u"))
    return made.select("page_id", urls.requisition(F.col("u")).alias("requisition"), urls.posting_id(F.col("u")).alias("id"))


@query("page_links", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href=["'']([^"''>]+)["'']', 1)) AS link FROM pages) SELECT page_id, count(*) AS links, count(DISTINCT link) AS distinct_links FROM l GROUP BY 1""")
def page_links(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(urls.links(F.col("html"))).alias("link"))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("link").alias("distinct_links"))


_PAGES = """SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN NULL ELSE html || '<a href="/jobs/' || page_id || '">open</a><a class="x" href="team"><b>Join</b> us</a><a href="https://careers.' || regexp_extract(url, '://(?:www\\.)?([^/]+)', 1) || '/">all</a><a href="https://other.example/jobs">jobs</a><a href="/jobs/' || page_id || '/">again</a>' END AS html FROM pages"""


@query("careers_links", rf"""WITH p AS ({_PAGES}), o AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+') AS origin, regexp_extract(url, '://(?:www\.)?([^/]+)', 1) AS site, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '[^/]*$', '') AS folder,
    len(regexp_extract_all(html, '<a ')) AS n, html FROM p WHERE html IS NOT NULL)
  SELECT page_id, (n - 5)::INT AS place, origin || '/jobs/' || page_id AS url FROM o UNION ALL SELECT page_id, (n - 4)::INT, origin || CASE WHEN folder = '' THEN '/' ELSE folder END || 'team' FROM o UNION ALL SELECT page_id, (n - 3)::INT, 'https://careers.' || site || '/' FROM o""")
def careers(spark, sf_dir):
    """Careers links of each page's own site, told by path, host or text; six pages of seven get some besides their own links."""
    site = F.regexp_extract("url", r"://(?:www\.)?([^/]+)", 1)
    more = F.concat(F.lit('<a href="/jobs/'), F.col("page_id").cast("string"), F.lit('">open</a><a class="x" href="team"><b>Join</b> us</a><a href="https://careers.'), site, F.lit('/">all</a><a href="https://other.example/jobs">jobs</a><a href="/jobs/'), F.col("page_id").cast("string"), F.lit('/">again</a>'))
    pages = table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % 7 != 0, F.concat("html", more)))
    return sites.careers_in_pages(pages, "page_id", "html", "url")


@query("page_boards", """WITH s AS (SELECT page_id, page_id % 5 AS k, 'b' || (page_id % 97) AS slug FROM pages WHERE page_id % 6 <> 0)
  SELECT page_id, CASE k WHEN 0 THEN 'lever' WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'breezy' WHEN 3 THEN 'workday' ELSE 'ashby' END AS vendor,
    CASE k WHEN 3 THEN slug || '|wd5|Site' WHEN 4 THEN slug || ' co' ELSE slug END AS slug,
    CASE k WHEN 0 THEN 'https://jobs.lever.co/' || slug WHEN 1 THEN 'https://job-boards.greenhouse.io/' || slug WHEN 2 THEN 'https://' || slug || '.breezy.hr' WHEN 3 THEN 'https://' || slug || '.wd5.myworkdayjobs.com/Site' ELSE 'https://jobs.ashbyhq.com/' || slug || '%20co' END AS careers_url,
    CASE k WHEN 0 THEN 2 ELSE 1 END::BIGINT AS n FROM s""")
def page_boards(spark, sf_dir):
    """Every board that a page names, and how often: pages get links, escaped scripts and embeds of five vendors, and some that name none."""
    slug = F.concat(F.lit("b"), (F.col("page_id") % 97).cast("string"))
    forms = F.array(
        F.concat(F.lit('<a href="https://jobs.lever.co/'), slug, F.lit('">x</a><script>"https:\\/\\/jobs.lever.co\\/'), slug, F.lit('\\/1"</script>')),
        F.concat(F.lit('<iframe src="//boards.greenhouse.io/embed/job_board?for='), slug, F.lit('&amp;b=1"></iframe><a href="https://boards.greenhouse.io/embed">e</a>')),
        F.concat(F.lit('<a href="https://'), slug, F.lit('.breezy.hr/p/1">x</a><a href="https://www.breezy.hr">b</a>')),
        F.concat(F.lit('<a href="https://'), slug, F.lit('.wd5.myworkdayjobs.com/en-US/Site/job/2">x</a>')),
        F.concat(F.lit('https://jobs.ashbyhq.com/'), slug, F.lit('%20co?utm=1 https://jobs.ashbyhq.com/login')),
    )
    pages = table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % 6 == 0, F.col("html")).otherwise(F.concat("html", F.get(forms, (F.col("page_id") % 5).cast("int")))))
    return sites.boards_in_pages(pages, "page_id", "html").withColumnRenamed("count", "n")


def _decoded(sql: str) -> str:
    """The entities of text.decode_entities, in SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    numbers = {"#39": "'", "#34": '"', "#160": " ", "#8211": "–", "#8217": "’", "#38": "&"}
    for name, to in [*list(text.ENTITIES.items())[:-1], *numbers.items(), ("amp", "&")]:
        sql = f"replace({sql}, '&{name};', {quoted(to)})"
    return sql


def _described(sql: str) -> str:
    """text.description, in SQL."""
    sql = f"replace({sql}, chr(13) || chr(10), chr(10))"
    for pattern, to in ((r"[ \t]+\n", "chr(10)"), (r"[ \t]{2,}", "' '"), (r"\n{3,}", "chr(10) || chr(10)"), (r"^\s+|\s+$", "''")):
        sql = f"regexp_replace({sql}, '{pattern}', {to}, 'g')"
    return f"substr({sql}, 1, {text.MAX_DESCRIPTION})"


_STRIPPED = r"regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g')"
_TEXT = rf"regexp_replace(regexp_replace({_STRIPPED}, '(?i)</?({text.BLOCK_TAGS})\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"


@query("html_to_text", "SELECT page_id, " + _described(rf"regexp_replace({_decoded(_TEXT)}, '\n[ \t]+', chr(10), 'g')") + " AS text FROM pages")
def html_to_text(spark, sf_dir):
    """The readable text of every page."""
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("clean_texts", r"""SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r\x{00A0}\x{2028}\x{2029}\x{3000}]+', ' ', 'g'), ' ') AS text FROM documents""")
def clean_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("text"))


@query("descriptions", r"""SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t]+\n', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), 1, 50000) AS description FROM documents""")
def descriptions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.description(F.col("text")).alias("description"))


@query("name_keys", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(strip_accents(lower(coalesce(text, ''))), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), '\b(inc|llc|ltd|limited|corp|corporation|co|gmbh|bv|nv|sa|ag|plc|holdings|group|labs|technologies|technology)\b', ' ', 'g'), '\s+', ' ', 'g')) AS company_key,
  trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\([^)]*\)', ' ', 'g'), '[^a-z0-9+#.]+', ' ', 'g')) AS title_key FROM documents""")
def name_keys(spark, sf_dir):
    """Folded keys of each document's whole text, generic company words included."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.company_key(F.col("text")).alias("company_key"), text.title_key(F.col("text")).alias("title_key"))


@query("company_keys", "SELECT c_custkey, 'customer ' || substr(c_name, 10) AS key FROM customer")
def company_keys(spark, sf_dir):
    """Legal forms and punctuation fold away."""
    form = F.element_at(F.array(*map(F.lit, (", Inc.", " GmbH", " & Co. Holdings", " LLC"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    named = F.regexp_replace(text.company_key(F.concat("c_name", form)), r" and$", "")
    return table(spark, sf_dir, "customer").select("c_custkey", named.alias("key"))


@query("reasons_tidied", r"SELECT conv_id, turn, substr(trim(regexp_replace(regexp_replace(text, '[|<>]', ' ', 'g'), '\s+', ' ', 'g')), 1, 220) AS reason FROM conversations")
def reasons_tidied(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.tidy_reason(F.col("text")).alias("reason"))


@query("name_distances", "SELECT a.p_partkey, least(levenshtein(a.p_name, b.p_name), 3)::INT AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def name_distances(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("_next"))
    return part.join(after, "p_partkey").select("p_partkey", text.bounded_distance(F.col("p_name"), F.col("_next")).alias("distance"))


@query("display_names", "SELECT s_suppkey, 'Supplier ' || substr(s_name, 10) AS name FROM supplier")
def display_names(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.display_name(F.lower("s_name")).alias("name"))


@query("board_titles", "SELECT s_suppkey, s_name AS name FROM supplier")
def board_titles(spark, sf_dir):
    title = F.concat("s_name", F.element_at(F.array(*map(F.lit, (" Careers", " Job Board", " | Jobs at a glance", ""))), (F.col("s_suppkey") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.name_from_title(title).alias("name"))


@query("document_sections", r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
  h AS (SELECT *, regexp_matches(line, '^(?:#{1,6}\s+\S|\*\*[^*]{2,60}\*\*:?$|[A-Z][^.!?]{1,58}:$)') AS head FROM l), g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY n) AS i FROM h),
  s AS (SELECT doc_id, i, max(CASE WHEN head THEN trim(regexp_replace(line, '^#+\s+|\*\*|:$', '', 'g')) ELSE '' END) AS heading, string_agg(line, chr(10) ORDER BY n) FILTER (NOT head) AS body FROM g GROUP BY 1, 2),
  b AS (SELECT doc_id, 0 AS i, '' AS heading, NULL AS body FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE i = 0))
  SELECT doc_id, i::INT AS i, heading, length(regexp_replace(coalesce(body, ''), '^\n+', ''))::INT AS body_chars FROM (SELECT * FROM s UNION ALL SELECT * FROM b)""")
def document_sections(spark, sf_dir):
    """The headings of every document and how much stands below each."""
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sections(F.col("text"))).alias("i", "s"))
    return cut.select("doc_id", "i", F.col("s.heading").alias("heading"), F.length("s.body").alias("body_chars"))


@query("description_excerpts", """WITH e AS (SELECT event_id, event_id % 40 AS k FROM events), p AS (SELECT *, CASE WHEN k > 0 THEN 'responsibilities: ' || rtrim(repeat('do ', k::INT)) ELSE '' END AS r, CASE WHEN k > 0 THEN 'qualifications: ' || rtrim(repeat('know ', k::INT)) ELSE '' END AS q, rtrim(repeat('we are nice ', 20)) AS b FROM e),
  a AS (SELECT *, r || CASE WHEN q = '' THEN '' WHEN length(q) <= 199 - length(r) THEN ' ' || q ELSE ' ' || rtrim(substr(q, 1, (198 - length(r))::INT)) || '…' END AS rq FROM p)
  SELECT event_id, rq || CASE WHEN length(rq) + CASE WHEN rq = '' THEN 0 ELSE 1 END >= 200 THEN '' ELSE CASE WHEN rq = '' THEN '' ELSE ' ' END || rtrim(substr(b, 1, (199 - length(rq) - CASE WHEN rq = '' THEN 0 ELSE 1 END)::INT)) || '…' END AS excerpt FROM a""")
def description_excerpts(spark, sf_dir):
    """Excerpts of two hundred characters: what is to be done and known goes before what a company says of itself."""
    k = (F.col("event_id") % 40).cast("int")
    said = F.concat(F.lit("we are nice " * 20 + "\nRequired Qualifications:\n"), F.repeat(F.lit("know "), k), F.lit("\n\nWhat you'll do\r\n"), F.repeat(F.lit("do\n"), k))
    return table(spark, sf_dir, "events").select("event_id", text.excerpt(said, 200).alias("excerpt"))


@query("sheet_dates", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def sheet_dates(spark, sf_dir):
    """Days written in the forms of spreadsheets read back; day first only where it can't be a month."""
    d = F.col("o_orderdate")
    first = F.when(F.dayofmonth(d) > 12, F.date_format(d, "d/M/yyyy")).otherwise(F.date_format(d, "M/d/yyyy"))
    form = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "yyyy/M/d")).otherwise(first)
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.sheet_date(form).alias("day"))


@query("iso_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def iso_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    form = F.element_at(F.array(*(F.date_format(d, f) for f in ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "MMM d, yyyy", "d-MMM-yyyy"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.iso_date(form).alias("day"))


@query("relative_days", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN DATE '2001-08-02' - ((o_orderkey % 29) + 1)::INT WHEN 1 THEN DATE '2001-08-01' WHEN 2 THEN DATE '2001-08-02' WHEN 3 THEN DATE '2001-08-02' - 7 * (o_orderkey % 4 + 1)::INT END AS day FROM orders""")
def relative_days(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.when(k % 5 == 0, F.concat(F.lit("Posted "), (k % 29 + 1).cast("string"), F.lit(" Days Ago"))).when(k % 5 == 1, "Posted Yesterday").when(k % 5 == 2, "just posted").when(k % 5 == 3, F.concat((k % 4 + 1).cast("string"), F.lit(" weeks ago"))).otherwise("Posted 30+ Days Ago")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.relative_day(said, F.lit("2001-08-02").cast("date")).alias("day"))


@query("epochs_and_ages", """SELECT event_id, date_trunc('second', ts) AS at, greatest(1, ceil((epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', ts))) / 86400))::INT AS age_days,
  CASE WHEN DATE '2024-02-01' - ts::DATE <= 0 THEN 'today' WHEN DATE '2024-02-01' - ts::DATE = 1 THEN 'yesterday' ELSE (DATE '2024-02-01' - ts::DATE) || 'd' END AS label FROM events""")
def epochs_and_ages(spark, sf_dir):
    """Seconds and milliseconds since 1970 read alike; ages up to a fixed day."""
    s = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    at = dates.epoch(F.when(F.col("event_id") % 2 == 0, s).otherwise(s * 1000))
    now = F.lit("2024-02-01").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", at.cast("timestamp_ntz").alias("at"), dates.age_days(at, now).alias("age_days"), dates.age_label(F.to_date("ts"), F.lit("2024-02-01").cast("date")).alias("label"))


@query("annual_pay", "SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN 2080.0 * p_size ELSE 1000.0 * p_size END::DOUBLE AS low, CASE p_partkey % 3 WHEN 2 THEN 2080.0 * p_size ELSE 1000.0 * (p_size + 20) END::DOUBLE AS high FROM part")
def annual_pay(spark, sf_dir):
    n, more = F.col("p_size").cast("string"), (F.col("p_size") + 20).cast("string")
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("$"), n, F.lit("K - $"), more, F.lit("K"))).when(F.col("p_partkey") % 3 == 1, F.concat(n, F.lit(",000 to "), more, F.lit(",000"))).otherwise(F.concat(F.lit("$"), n, F.lit("/hr")))
    pay = dates.annual_pay(said)
    return table(spark, sf_dir, "part").select("p_partkey", pay["low"].alias("low"), pay["high"].alias("high"))


@query("event_props", "SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def event_props(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return parsed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k"))


@query("answers_with_json", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[' || props || ']' WHEN 1 THEN '[' || props || ',' || props || ']' END AS found FROM events")
def answers_with_json(spark, sf_dir):
    """The JSON array in a model's answer, fenced or bare; broken ones give null."""
    p, i = F.col("props"), F.col("event_id") % 3
    said = F.when(i == 0, F.concat(F.lit("Here:\n```json\n["), p, F.lit("]\n```\nDone."))).when(i == 1, F.concat(F.lit("Sure ["), p, F.lit(","), p, F.lit("] ok"))).otherwise(F.concat(F.lit("Sure ["), p, F.lit(",")))
    return table(spark, sf_dir, "events").select("event_id", jsons.extract_json(said).alias("found"))
