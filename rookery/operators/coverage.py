"""Coverage of units of retrieval, windows for the next run, and monotone checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("complete", "partial", "failed", "skipped")


def tally(coverage: DataFrame, by: list[str]) -> DataFrame:
    """Units by status; what has no known status counts as failed. Retrieval is complete if all units are."""
    status = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("failed")
    counts = [F.count_if(status == s).alias(s) for s in STATUSES]
    return coverage.groupBy(*by).agg(*counts, F.bool_and(status == "complete").alias("retrieval_complete"))


def health(lanes: DataFrame, by: str = "lane") -> DataFrame:
    """A lane failed in whole if nothing was completed or begun and something failed or stopped; in part if anything did otherwise."""
    sums = lanes.groupBy(by).agg(*(F.sum(c).alias(c) for c in ("completed", "incomplete", "failed")), F.bool_or("aborted").alias("aborted"))
    whole = (F.col("completed") == 0) & (F.col("incomplete") == 0) & ((F.col("failed") > 0) | F.col("aborted"))
    some = (F.col("incomplete") > 0) | (F.col("failed") > 0) | F.col("aborted")
    return sums.withColumn("outcome", F.when(whole, "failed").when(some, "partial").otherwise("ok"))


def plan_window(covered: Column, start: Column, lookback_days: int, overlap_hours: int, horizon: Column | None = None) -> Column:
    """Where a unit's next window begins: its checkpoint, or the start less the lookback, less the overlap; not later than the horizon."""
    since = F.coalesce(covered, start - F.expr(f"INTERVAL {lookback_days} DAYS")) - F.expr(f"INTERVAL {overlap_hours} HOURS")
    return F.least(since, horizon) if horizon is not None else since


def may_advance(status: Column, covered: Column, errors: Column) -> Column:
    """Complete, or partial with a time up to which all was seen and no error."""
    return (status == "complete") | ((status == "partial") & covered.isNotNull() & (errors == 0))


def advance(checkpoints: DataFrame, units: DataFrame) -> DataFrame:
    """(key, covered_through): each unit's checkpoint moves on, never back; those held stay."""
    moved = units.filter(may_advance(F.col("status"), F.col("covered_through"), F.col("errors"))).groupBy("key").agg(F.max("covered_through").alias("_new"))
    return checkpoints.join(moved, "key", "full_outer").select("key", F.greatest("covered_through", "_new").alias("covered_through"))


def failed_in_each(runs: DataFrame, key: str, run: str, last: int = 3) -> DataFrame:
    """Keys that failed in each of the last `last` runs; none if there were fewer."""
    ranked = runs.select(run).distinct().withColumn("_r", F.dense_rank().over(Window.orderBy(F.desc(run)))).filter(F.col("_r") <= last)
    failures = runs.filter("failed").join(ranked, run).groupBy(key).agg(F.count_distinct(run).alias("failed_runs"))
    return failures.filter(F.col("failed_runs") == last)


def dead_boards(checks: DataFrame, key: str, at: str, gone: str, most: int = 3) -> DataFrame:
    """(key, misses, last): a fold over a key's checks in order. A miss adds one, up to `most`; anything else clears it, unless it is dead already and not found alive.

    Only misses since the last check that found the board matter, so the fold is two aggregates and no ordered list.
    """
    alive = checks.groupBy(key).agg(F.max(F.when(F.col(gone) == "ok", F.col(at))).alias("_alive"))
    since = checks.join(alive, key).filter(F.col("_alive").isNull() | (F.col(at) > F.col("_alive")))
    order = Window.partitionBy(key).orderBy(at)
    run = since.withColumn("_cut", F.sum(F.when(F.col(gone) != "miss", 1).otherwise(0)).over(order)).withColumn("_in", F.sum(F.when(F.col(gone) == "miss", 1).otherwise(0)).over(Window.partitionBy(key, "_cut").orderBy(at)))
    dead = run.withColumn("_dead", F.max(F.when(F.col("_in") >= most, 1).otherwise(0)).over(order))
    last = dead.groupBy(key).agg(F.max_by(F.struct(F.col("_in"), F.col("_dead")), F.col(at)).alias("s"), F.max(at).alias("last_checked"))
    return last.select(key, F.when(F.col("s._dead") == 1, most).otherwise(F.least(F.col("s._in"), F.lit(most))).cast("int").alias("misses"), "last_checked").filter("misses > 0")


def completed_prefix(steps: DataFrame, group: str, index: str, done: str) -> DataFrame:
    """How many steps from the first on are done without a gap."""
    return steps.groupBy(group).agg(F.coalesce(F.min(F.when(~F.col(done), F.col(index))), F.max(index) + 1).alias("cursor"))


def unit(requested_until: Column, covered: Column, status: Column) -> Column:
    """Up to when a unit is covered: as it says, else what was asked for if it is complete."""
    return F.coalesce(covered, F.when(status == "complete", requested_until))


def clamp(since: Column, fetched_from: Column) -> Column:
    """(since, gap_days): a window can't begin before what was fetched; the days between are reported as a gap."""
    return F.struct(F.greatest(since, fetched_from).alias("since"), F.greatest(F.lit(0), F.datediff(fetched_from, since)).alias("gap_days"))


def run_windows(units: DataFrame, key: str, since: str) -> DataFrame:
    """One window a key, from the earliest day that any of its units asks for; without one it is unbounded."""
    return units.groupBy(key).agg(F.min(since).alias("since"), F.count(F.lit(1)).alias("units"), F.min(since).isNull().alias("unbounded"))
