"""Normalised graphs in pages: a map of nodes that name each other by key, taken apart into rows and put together again by joins.

A page holds one JSON object of nodes; a node names another as {"__ref": key}. References are followed in rounds: each round joins what was reached last to the nodes and keeps what is new, so cycles end
and a node that many name is one row. Nothing of a page is held in one value but its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.jsons import embedded
from rookery.operators.graphs import cut

# generators are outer ones: below others Spark puts a filter that computes what is exploded, here the reading of a page, a second time


def _once(value: Column) -> Column:
    """The value, computed once a row however many filters and columns read it."""
    return F.explode_outer(F.array(value))


_REF = r'"__ref"\s*:\s*"((?:[^"\\]|\\.)*)"'


def nodes(pages: DataFrame, id_col: str, html_col: str, element_id: str = "__NEXT_DATA__", path: str = "$.props.pageProps.apolloState.data") -> DataFrame:
    """(page, key, node): a row for each node, `node` as JSON text. Pages without readable data have none; of two nodes with one key the last stays, as JSON has it."""
    data = F.get_json_object(embedded(F.col(html_col), element_id), path)
    return pages.select(F.col(id_col).alias("page"), F.explode_outer(F.from_json(data, "map<string,string>")).alias("key", "node")).filter("node IS NOT NULL").dropDuplicates(["page", "key"])


def references(node: Column) -> Column:
    """The keys that a node names, in its order, with escapes undone; each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(node, F.lit(_REF), F.lit(1)), lambda k: F.coalesce(F.get_json_object(F.concat(F.lit('{"k":"'), k, F.lit('"}')), "$.k"), k)))


def reached(nodes_: DataFrame, roots: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(page, key, depth): every node that the roots (page, key) lead to, and by how many steps at least. Names without a node are left out."""
    # what a node names is read once; a round never goes back to the pages
    own = cut(nodes_.select("page", "key", references(F.col("node")).alias("to")), "own")
    known = own.select("page", "key")
    links = own.select("page", "key", F.explode("to").alias("to"))
    links = cut(links.join(known.select("page", F.col("key").alias("to")), ["page", "to"], "left_semi").select("page", "key", "to"), "links")
    found = cut(roots.select("page", "key").distinct().join(known, ["page", "key"], "left_semi").withColumn("depth", F.lit(0)), "reached")
    last, depth = found, 0
    while most_rounds is None or depth < most_rounds:
        depth += 1
        onward = last.join(links, ["page", "key"]).select("page", F.col("to").alias("key")).distinct()
        last = cut(onward.join(found, ["page", "key"], "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found


def role_pages(pages: DataFrame, id_col: str, html_col: str, base: str = "https://wellfound.com") -> tuple[DataFrame, DataFrame]:
    """(pages, postings) of search pages for a role.

    Pages: (page, recognised, total, page_count), recognised if the page knows the role that was asked for. Postings: (page, url, title, company, location, posted_at, description), one for each place in
    which a company of the results lists one; a company without a name, or a posting without number or title, is none.
    """
    own = cut(nodes(pages, id_col, html_col), "nodes")
    talent = F.from_json(F.get_json_object("node", "$.talent"), "map<string,string>")
    asked = own.filter("key = 'ROOT_QUERY'").select("page", _once(talent).alias("t")).filter("t IS NOT NULL")
    role = F.exists(F.map_keys("t"), lambda k: k.rlike(r"^seoLandingPageRole(AndLocation|Remote)\b"))
    found = asked.select("page", role.alias("recognised"), F.try_element_at(F.map_values(F.map_filter("t", lambda k, v: k.startswith("seoLandingPageJobSearchResults"))), F.lit(1)).alias("r")).filter("r IS NOT NULL")
    shape = "totalJobCount long, pageCount int, startups array<struct<__ref:string>>"
    read = found.select("page", "recognised", F.from_json("r", shape).alias("r"))
    firms = read.select("page", F.posexplode_outer("r.startups").alias("i", "s")).select("page", "i", F.col("s.__ref").alias("key")).join(own, ["page", "key"])
    firm = firms.select("page", "i", _once(F.from_json("node", "name string, highlightedJobListings array<struct<__ref:string>>")).alias("f")).filter("f.name <> ''")
    listed = firm.select("page", "i", F.col("f.name").alias("company"), F.posexplode_outer("f.highlightedJobListings").alias("j", "l")).select("page", "i", "j", "company", F.col("l.__ref").alias("key")).join(own, ["page", "key"])
    posting = "id string, title string, slug string, locationNames array<string>, remote boolean, acceptedRemoteLocationNames array<string>, liveStartAt double, description string"
    p = listed.select("page", "i", "j", "company", _once(F.from_json("node", posting)).alias("p")).filter("p.id <> '' AND p.title <> ''")
    places = F.filter(F.coalesce("p.locationNames", F.array().cast("array<string>")), lambda x: x != "")
    where = F.when(F.size("p.acceptedRemoteLocationNames") > 0, F.concat(F.lit("Remote ("), F.array_join("p.acceptedRemoteLocationNames", "; "), F.lit(")"))).otherwise("Remote")
    jobs = p.select(
        "page", F.concat(F.lit(f"{base}/jobs/"), "p.id", F.when(F.col("p.slug").rlike("^[A-Za-z0-9-]+$"), F.concat(F.lit("-"), "p.slug")).otherwise("")).alias("url"), "p.title", "company",
        F.array_join(F.concat(places, F.when(F.col("p.remote"), F.array(where)).otherwise(F.array().cast("array<string>"))), " / ").alias("location"), F.timestamp_seconds("p.liveStartAt").alias("posted_at"), "p.description",
    )
    counted = jobs.groupBy("page").agg(F.count(F.lit(1)).alias("_n"))
    seen = read.join(counted, "page", "left").select("page", "recognised", F.coalesce("r.totalJobCount", "_n", F.lit(0)).alias("total"), F.coalesce("r.pageCount", F.lit(1)).alias("page_count"))
    return seen, jobs
