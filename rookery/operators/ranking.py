"""Ranking: what a model's rows are worth, cache and budget, bonus, threshold, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.text import tidy_reason


def budgeted(postings: DataFrame, cache: DataFrame, key: str, order: list[Column], budget: int, batch: int) -> DataFrame:
    """Adds rank_status and batch: cached scores cost nothing; the first `budget` of the others by order are asked, in batches.

    The budget is a number of calls that someone pays for, so the chosen rows are few; they are found as a top-k and joined back.
    """
    known = postings.join(cache.select(key, "cached_score"), key, "left")
    asked = known.filter("cached_score IS NULL").orderBy(*order).limit(budget)
    numbered = asked.withColumn("_n", F.row_number().over(Window.orderBy(*order))).select(key, "_n")
    told = known.join(numbered, key, "left")
    status = F.when(F.col("cached_score").isNotNull(), "cache").when(F.col("_n").isNotNull(), "model").otherwise("over_budget")
    return told.withColumn("rank_status", status).withColumn("batch", F.floor((F.col("_n") - 1) / batch)).drop("_n")


def validate(rows: DataFrame, key: str, least_reason: int = 12) -> DataFrame:
    """(key, answers, status, score): a row counts with a score of 0 to 5 and a reason; agreeing copies are one, differing ones fail."""
    good = F.col("score").between(0, 5) & (F.length(tidy_reason(F.col("reason"))) >= least_reason)
    told = rows.groupBy(key).agg(F.count(F.lit(1)).alias("answers"), F.count_if(good).alias("_good"), F.count_distinct(F.when(good, F.col("score"))).alias("_kinds"), F.min(F.when(good, F.col("score"))).alias("_score"))
    status = F.when(F.col("_good") == 0, "invalid").when(F.col("_kinds") > 1, "conflict").when(F.col("answers") > 1, "recovered").otherwise("ok")
    return told.select(key, "answers", status.alias("status"), F.when(status.isin("ok", "recovered"), F.col("_score")).alias("score"))


def with_bonus(score: Column, watchlist: Column, points: float, heuristic_only: Column) -> Column:
    """Watched companies earn points, up to 5; scores that no model gave earn none."""
    return F.when(score.isNull() | heuristic_only | ~watchlist, score).otherwise(F.least(F.lit(5.0), F.round(score + points, 2)))


def fallback(heuristic: Column) -> Column:
    return F.round(F.coalesce(heuristic, F.lit(40)).cast("double") / 20, 1)


def decision(status: Column, score: Column, least: float) -> Column:
    """Only what a model or the cache scored is published or rejected by the threshold."""
    return F.when(~status.isin("model", "cache") | score.isNull(), "unscored").when(score >= least, "eligible").otherwise("below_threshold")


def cache_key(*parts: Column) -> Column:
    """SHA-256 of what a score depends on: prompt, schema, model, brief, the posting as it is shown."""
    return F.sha2(F.concat_ws("\n", *parts), 256)


def fresh(scored_at: Column, now: Column, hours: int) -> Column:
    """Whether a cached score may still be used."""
    return scored_at >= now - F.expr(f"INTERVAL {hours} HOURS")


def deadline_ms(postings: Column, batch: int, at_once: int, each_ms: int) -> Column:
    return (F.ceil(F.ceil(postings / batch) / at_once) * each_ms).cast("long")


def rate_limited(calls: DataFrame, by: str) -> DataFrame:
    """Two calls or more that all failed fast look like a limit."""
    return calls.groupBy(by).agg(((F.count(F.lit(1)) >= 2) & F.bool_and((F.col("status") == "error") & (F.col("ms") < 15_000))).alias("limited"))
