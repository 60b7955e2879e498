"""The ledger of roles: upserts by key that a rerun doesn't change, and states with a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(ledger: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Later values replace, first_seen stays, posted_at keeps the first known; state says what happened to each role.

    Copies in `incoming` fold to their last by `order` first, so that applying a batch twice changes nothing.
    """
    last = incoming.groupBy(key).agg(F.max_by(F.struct("title", "posted_at", "seen_at"), F.col(order)).alias("n"), F.min("seen_at").alias("_first"))
    both = ledger.join(last, key, "full_outer")
    return both.select(
        key, F.coalesce("n.title", "title").alias("title"), F.coalesce("posted_at", "n.posted_at").alias("posted_at"), F.least("first_seen", "_first").alias("first_seen"), F.greatest("last_seen", "n.seen_at").alias("last_seen"),
        F.when(F.col("first_seen").isNull(), "new").when(F.col("n").isNull(), "kept").otherwise("updated").alias("state"),
    )


def active(hits: DataFrame, key: str, day: str, now: str, quiet_days: int) -> DataFrame:
    """(key, hit_days, last_hit, overdue): one hit for each distinct day; overdue after so many quiet days."""
    days = hits.groupBy(key).agg(F.count_distinct(day).alias("hit_days"), F.max(day).alias("last_hit"))
    return days.withColumn("overdue", F.datediff(F.lit(now).cast("date"), "last_hit") > quiet_days)


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def recovered(observations: DataFrame, committed: DataFrame, run: str, url: str, at: str) -> DataFrame:
    """The newest observation of each url among runs that were never committed; of equal times the later run's."""
    open_ = observations.join(committed.select(run).distinct(), run, "left_anti")
    rest = [c for c in open_.columns if c != url]
    return open_.groupBy(url).agg(F.max_by(F.struct(*rest), F.struct(at, run)).alias("o")).select(url, "o.*")


def merge_shown(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """One day's record: a row that was delivered stays delivered, whatever a later run of the day says."""
    n = now.select(key, F.col("score").alias("_score"), F.col("delivered").alias("_delivered"))
    both = before.join(n, key, "full_outer")
    keep = F.coalesce("delivered", F.lit(False)) & ~F.coalesce("_delivered", F.lit(False))
    return both.select(key, F.when(keep, F.col("score")).otherwise(F.coalesce("_score", "score")).alias("score"), (F.coalesce("delivered", F.lit(False)) | F.coalesce("_delivered", F.lit(False))).alias("delivered"))


def latest(rows: DataFrame, at: str) -> DataFrame:
    """The newest row of a table."""
    return rows.agg(F.max_by(F.struct(*rows.columns), at).alias("r")).select("r.*")


def changes_applied(lists: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """(key, values, missing): additions that are there already change nothing; removals of what isn't there are told."""
    by = changes.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("op") == "add", F.col("value")))).alias("_add"), F.array_sort(F.collect_set(F.when(F.col("op") == "remove", F.col("value")))).alias("_remove"))
    none = F.array().cast("array<string>")
    add, remove = F.coalesce("_add", none), F.coalesce("_remove", none)
    joined = lists.join(by, key, "left")
    return joined.select(key, F.array_sort(F.array_except(F.array_union("values", add), remove)).alias("values"), F.array_sort(F.array_except(remove, "values")).alias("missing"))
