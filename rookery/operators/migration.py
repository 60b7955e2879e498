"""Records of three versions read as one table, and what becomes of each posting under today's rules.

Version 1 has lists of ids that were seen, version 2 the runs' records of what was shown, version 3 roles with decisions. Fields that a version lacks are null. Reading and deciding again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

V1 = "id string, date string"
V2 = "run string, id string, title string, url string, score double, rankStatus string, reason string, inEmail boolean, heuristicOnly boolean"
V3 = "id string, decision string, title string, url string, score double, rankStatus string"
MODEL, HEURISTIC = ("model", "cached"), ("heuristic", "heuristic_only", "failed", "skipped")


def read(spark: SparkSession, v1: str | None = None, v2: str | None = None, v3: str | None = None) -> DataFrame:
    """(version, run, id, title, url, score, rank_status, reason, in_email, heuristic_only, decision) of folders of JSON lines; rows without an id are none."""
    parts = []
    for version, (schema, path) in enumerate(((V1, v1), (V2, v2), (V3, v3)), 1):
        if path is not None:
            parts.append(spark.read.schema(schema).json(path).withColumn("version", F.lit(version)))
    if not parts:
        raise ValueError("no version is given")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    col = lambda c, kind="string": (F.col(c) if c in rows.columns else F.lit(None)).cast(kind)
    return rows.filter("id <> ''").select(
        "version", F.coalesce(col("run"), col("date")).alias("run"), "id", col("title").alias("title"), col("url").alias("url"), col("score", "double").alias("score"), col("rankStatus").alias("rank_status"), col("reason").alias("reason"),
        F.coalesce(col("inEmail", "boolean"), F.lit(False)).alias("in_email"), F.coalesce(col("heuristicOnly", "boolean"), F.lit(False)).alias("heuristic_only"), col("decision").alias("decision"),
    )


def hidden_by_cap(status: Column, reason: Column) -> Column:
    """Whether only a limit kept the posting from being shown."""
    return F.coalesce(status == "skipped", F.lit(False)) | F.coalesce(reason, F.lit("")).rlike("(?i)capped|overflow|max_rows")


def requeued(in_email: Column, status: Column, reason: Column, heuristic_only: Column, score: Column, least: float = 3.0) -> Column:
    """Whether a posting that was shown goes back to the queue: never sent, and hidden by a cap, judged by a heuristic alone, or good enough."""
    return ~in_email & (hidden_by_cap(status, reason) | heuristic_only | F.coalesce(status.isin(*HEURISTIC), F.lit(False)) | F.coalesce(score >= least, F.lit(False)))


def below_threshold(status: Column, score: Column, least: float = 3.0) -> Column:
    """Whether a model scored it, and too low."""
    return F.coalesce(status.isin(*MODEL) & (score < least), F.lit(False))


def decisions(records: DataFrame, least: float = 3.0) -> DataFrame:
    """(id, decision, runs, version): what each posting comes to by its records in the order of version and run.

    A role of version 3 that is published or acted on stays so. Otherwise the first record of version 2 decides: sent is published, requeued is pending, too low is below_threshold, anything else legacy_processed; later ones publish what is
    pending, put back what has a title and a url, and mark what is too low. An id of version 1 alone is suppressed. A posting has a record a run at most, so what is folded for one id is a mark a run.
    """
    c = F.col
    again = requeued(c("in_email"), c("rank_status"), c("reason"), c("heuristic_only"), c("score"), least)
    whole = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")
    low = below_threshold(c("rank_status"), c("score"), least)
    # one letter a record: Emailed, Requeued (r: without title or url), Low, Other
    mark = F.when(c("version") == 2, F.when(c("in_email"), "E").when(again, F.when(whole, "R").otherwise("r")).when(low, "L").otherwise("O"))
    kept = records.filter("version <> 3 OR decision IS NOT NULL")
    one = kept.groupBy("id").agg(
        F.max(F.when(c("version") == 3, c("decision"))).alias("role"), F.array_join(F.transform(F.array_sort(F.collect_set(F.when(mark.isNotNull(), F.struct("run", mark.alias("m"))))), lambda s: s["m"]), "").alias("marks"),
        F.count_distinct(F.when(c("version") == 2, c("run"))).alias("runs"), F.max("version").alias("version"),
    )
    first = F.substring("marks", 1, 1)
    begun = F.coalesce("role", F.when(first == "E", "published").when(first.isin("R", "r"), "pending").when(first == "L", "below_threshold").when(first == "O", "legacy_processed"))
    rest = F.when(F.col("role").isNull(), F.substring("marks", 2, 1 << 30)).otherwise(F.col("marks"))
    settled = lambda d: d.isin("published", "actioned")
    step = lambda d, m: (
        F.when((m == "E") & (d == "pending"), "published").when((m == "R") & ~settled(d), "pending").when((m == "L") & d.isin("legacy_processed", "pending"), "below_threshold").otherwise(d)
    )
    folded = F.aggregate(F.split(rest, ""), begun, step)
    return one.select("id", F.coalesce(folded, F.lit("suppressed")).alias("decision"), "runs", "version")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(run, path, legacy): the runs that have a snapshot: folders <run>/raw.json, or files <day>-raw.json and <day>.json of older times. Names only are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder).select("path")
    new, old = F.regexp_extract("path", r"/([^/]+)/raw\.json(?:/[^/]*)?$", 1), F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})(?:-raw)?\.json(?:/[^/]*)?$", 1)
    named = files.select(F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit(""))).alias("run"), F.regexp_replace("path", r"(\.json)/[^/]*$", "$1").alias("path"), (new == "").alias("legacy"))
    return named.filter("run IS NOT NULL").distinct()


def replay(spark: SparkSession, folder: str, schema: str, run: str | None = None) -> DataFrame | None:
    """The postings of a run's snapshot, or of the latest; null without one. A snapshot of the new kind goes before an older one of the same name, and any of them before all older ones."""
    found = snapshots(spark, folder)
    found = found if run is None else found.filter(F.col("run") == run)
    chosen = found.orderBy("legacy", F.desc("run"), F.desc("path")).limit(1).collect()
    return spark.read.schema(schema).json(chosen[0].path).withColumn("run", F.lit(chosen[0].run)) if chosen else None
