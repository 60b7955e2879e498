"""Evidence from what was shown and what was added, and the proposals that it supports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evidence(shown: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """Every shown or added item once, with both flags."""
    a = added.select(key).distinct().withColumn("_added", F.lit(True))
    s = shown.dropDuplicates([key]).withColumn("shown", F.lit(True))
    return s.join(a, key, "full_outer").withColumn("shown", F.coalesce("shown", F.lit(False))).withColumn("added", F.coalesce("_added", F.lit(False))).drop("_added")


def enough(found: DataFrame, shown: int = 40, added: int = 8) -> DataFrame:
    return found.agg(F.count_if("shown").alias("n_shown"), F.count_if("added").alias("n_added")).withColumn("enough", (F.col("n_shown") >= shown) & (F.col("n_added") >= added))


def companies_to_watch(found: DataFrame, company: str, watched: str, least: int = 2) -> DataFrame:
    return found.filter(F.col("added") & ~F.col(watched)).groupBy(company).agg(F.count(F.lit(1)).alias("adds")).filter(F.col("adds") >= least)


def idle_keywords(found: DataFrame, keywords: str, shown: int = 12, adds: int = 0) -> DataFrame:
    """Keywords that alone brought items to the list at least `shown` times, of which at most `adds` were added."""
    sole = found.filter(F.col("shown") & (F.size(keywords) == 1)).select(F.col(keywords)[0].alias("keyword"), "added")
    return sole.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_shown"), F.count_if("added").alias("n_added")).filter((F.col("n_shown") >= shown) & (F.col("n_added") <= adds))


def costly_exclusions(found: DataFrame, title: str, terms: list[str], least: int = 2) -> DataFrame:
    """Exclusions that would have hidden at least so many added items."""
    from rookery.operators.titles import has_term

    matched = F.filter(F.array(*(F.when(has_term(F.col(title), [t]), F.lit(t)) for t in terms)), lambda x: x.isNotNull())
    return found.filter("added").select(F.explode(matched).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_added")).filter(F.col("n_added") >= least)


OPS = ("add_to_list", "remove_from_list", "set_scalar", "note")


def validate_changes(changes: DataFrame, paths: list[str]) -> DataFrame:
    """Adds problems: what is wrong with a proposed change; an empty list may be applied."""
    problem = lambda bad, said: F.when(bad, F.lit(said))
    told = F.array(problem(~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), "unknown operation"), problem(~F.coalesce(F.col("path").isin(*paths), F.lit(False)), "path not allowed"), problem(F.trim(F.coalesce("value", F.lit(""))) == "", "no value"))
    return changes.withColumn("problems", F.filter(told, lambda x: x.isNotNull()))


def to_apply(approved: DataFrame, applied: DataFrame, key: str) -> DataFrame:
    """Approved changes that the ledger doesn't hold yet."""
    return approved.join(applied.select(key).distinct(), key, "left_anti").dropDuplicates([key])
