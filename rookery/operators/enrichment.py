"""Descriptions for postings that lack one: a budget by global position, caches with ages, and what became of each posting."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.operators.graphs import cut

#: Hours that a fetched description, and a failure, are remembered.
FRESH_HOURS, FAILED_HOURS = 24, 1


def numbered(df: DataFrame, order: list[Column], flags: dict[str, Column] | None = None, name: str = "position") -> DataFrame:
    """Adds `name`, the row's place in the global order from 0 on, and for each flag how many rows before it have it.

    Rows are dealt by ranges of the order and written; each range's counts are added up on the driver, a number a range and flag, and a row's place is its range's start and its place within
    the range. No task sees more than a range. `order` has to be total, or equal rows change places from run to run.
    """
    flags = flags or {}
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = cut(df.withColumns({f"_{k}": F.coalesce(c, F.lit(False)).cast("int") for k, c in flags.items()}).repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_all"), *(F.sum(f"_{k}").alias(f"_sum_{k}") for k in flags)).orderBy("_range").collect()  # a row a range
    totals = {c: [0, *accumulate(r[c] for r in counts)] for c in ("_all", *(f"_sum_{k}" for k in flags))}
    rows = [(r["_range"], *(int(totals[c][i]) for c in totals)) for i, r in enumerate(counts)]
    before = spark.createDataFrame(rows, ", ".join(["_range int", "_rows_before long", *(f"_before_{k} long" for k in flags)]))
    within = Window.partitionBy("_range").orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.withColumns({name: F.row_number().over(within) - 1, **{f"_in_{k}": F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)) for k in flags}})
    full = placed.join(F.broadcast(before), "_range").withColumns({name: F.col(name) + F.col("_rows_before"), **{k: F.col(f"_in_{k}") + F.col(f"_before_{k}") for k in flags}})
    return full.drop("_range", "_rows_before", *(x for k in flags for x in (f"_{k}", f"_in_{k}", f"_before_{k}")))


def enriched(jobs: DataFrame, cache: DataFrame, answers: DataFrame, order: list[Column], now: Column, scope: int | None = None, most: int = 100, key: str = "key", enabled: bool = True) -> DataFrame:
    """Adds `outcome`, and fills `description` and `origin` where there is one to be had.

    `jobs` has key, description and supported; `cache` rows (key, ok, description, origin, error, fetched_at), of which the latest a key counts; `answers` rows (key, ok, description, origin, error), one a key.
    In the global order the first `scope` postings come into question, and of those that lack a description on a host that is known, the first `most` are looked up: in the cache, then among the answers. One without either is past the deadline.
    """
    if not enabled:
        return jobs.withColumn("outcome", F.lit("disabled"))
    had = F.coalesce(F.trim("description"), F.lit("")) != ""
    placed = numbered(jobs, order)
    inside = placed if scope is None else placed.withColumn("_scope", F.col("position") < scope)
    in_scope = F.lit(True) if scope is None else F.col("_scope")
    waiting = in_scope & ~had & F.coalesce("supported", F.lit(False))
    ranked = numbered(inside, [F.col("position")], {"waiting": waiting}, name="position")
    state = (
        F.when(~in_scope, "over_enrichment_budget_scope").when(had, "already_present").when(~F.coalesce("supported", F.lit(False)), "unsupported_host").when(F.col("waiting") >= most, "over_max_jobs")
    )
    asked = ranked.withColumn("outcome", state)
    # only postings that are looked up meet the cache, which may be far larger
    wanted = asked.filter("outcome IS NULL").select(F.col(key).alias("_key")).distinct()
    latest = cache.join(wanted, cache[key] == wanted["_key"], "left_semi").groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct("ok", "description", "origin", "error", "fetched_at"), "fetched_at").alias("_c"))
    told = answers.select(F.col(key).alias("_akey"), F.struct("ok", "description", "origin", "error").alias("_a"))
    met = asked.join(latest, (F.col(key) == F.col("_key")) & F.col("outcome").isNull(), "left").join(told, (F.col(key) == F.col("_akey")) & F.col("outcome").isNull(), "left")
    age = (now.cast("double") - F.col("_c.fetched_at").cast("double")) / 3_600
    hit = F.col("_c.ok") & (F.coalesce(F.col("_c.description"), F.lit("")) != "") & (age <= FRESH_HOURS)
    failed = ~F.col("_c.ok") & (age < FAILED_HOURS)
    error = lambda c: F.coalesce(F.col(f"{c}.error"), F.lit("error"))
    found = (
        F.when(F.coalesce(hit, F.lit(False)), "cache_hit").when(F.coalesce(failed, F.lit(False)), F.concat(F.lit("cache_miss_recent_failure:"), error("_c")))
        .when(F.col("_a").isNull(), "past_deadline").when(F.col("_a.ok"), "fetched").otherwise(F.concat(F.lit("fetch_failed:"), error("_a")))
    )
    said = met.withColumn("outcome", F.coalesce("outcome", found))
    pick = lambda c: F.when(F.col("outcome") == "cache_hit", F.col(f"_c.{c}")).when(F.col("outcome") == "fetched", F.col(f"_a.{c}"))
    return said.withColumns({"description": F.coalesce(pick("description"), "description"), "origin": pick("origin")}).drop("_scope", "waiting", "_key", "_akey", "_c", "_a")


def telemetry(rows: DataFrame) -> DataFrame:
    """One row of counts: what an enrichment did."""
    is_ = lambda *xs: F.count_if(F.col("outcome").isin(*xs))
    starts = lambda x: F.count_if(F.col("outcome").startswith(x))
    return rows.agg(
        (is_("fetched") + starts("fetch_failed:")).alias("attempted"), is_("fetched", "cache_hit").alias("succeeded"), (starts("fetch_failed:") + starts("cache_miss_recent_failure:")).alias("failed"), is_("cache_hit").alias("cache_hits"),
        is_("already_present").alias("skipped_existing"), is_("unsupported_host").alias("skipped_unsupported"), is_("over_enrichment_budget_scope", "over_max_jobs").alias("skipped_budget"), is_("past_deadline").alias("past_deadline"),
    )
