"""The filter before ranking: one reason for each rejected posting, a presort score, and the cap for each company."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.text import GENERIC, company_key
from rookery.operators.graphs import cut
from rookery.operators.places import workplace
from rookery.operators.titles import has_term, match_title


@dataclass
class Preferences:
    roles: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    exceptions: dict[str, list[str]] = field(default_factory=dict)
    allow: list[str] = field(default_factory=list)
    block_companies: list[str] = field(default_factory=list)
    seniority: list[str] = field(default_factory=list)
    block_content: list[str] = field(default_factory=list)
    levels: list[str] = field(default_factory=list)
    deprioritise: list[str] = field(default_factory=list)
    least_keywords: int = 0
    remote: str = "rank_lower"  # or include, exclude


def folded(name: str) -> str:
    """company_key of a name that the driver holds."""
    plain = unicodedata.normalize("NFKD", name.lower()).encode("ascii", "ignore").decode().replace("&", " and ")
    words = re.sub(rf"\b({GENERIC})\b", " ", re.sub("[^a-z0-9]+", " ", plain))
    return " ".join(words.split())


def company_blocked(company: Column, blocked: list[str]) -> Column:
    """A blocked name as whole words of the company's, or anywhere in it without spaces if it has five letters or more."""
    key = company_key(company)
    found = F.lit(False)
    for name in blocked:
        plain = folded(name)
        if not plain:
            continue
        found = found | key.rlike(rf"(^| ){plain}( |$)")
        if len(plain.replace(" ", "")) >= 5:
            found = found | F.contains(F.replace(key, F.lit(" "), F.lit("")), F.lit(plain.replace(" ", "")))
    return found


#: So many judged values may be broadcast; where there are more, each row is judged.
BROADCAST_ROWS = 100_000


def _judged_once(rows: DataFrame, by: str, **columns: Column) -> DataFrame:
    """Adds columns that depend on `by` alone: made for each distinct value and sent to every task where the values are few, which is counted first; else made row by row. The rows never move for it."""
    values = cut(rows.select(by).distinct(), "values")
    if values.count() > BROADCAST_ROWS:
        return rows.withColumns(columns)
    once = values.select(F.col(by).alias("_value"), *(c.alias(n) for n, c in columns.items()))
    return rows.join(F.broadcast(once), F.col(by).eqNullSafe(F.col("_value")), "left").drop("_value")


def classify(postings: DataFrame, p: Preferences) -> DataFrame:
    """Adds match, workplace, company_key and reason: the first rule that rejects a posting, null if none does.

    Titles, locations and companies repeat massively, so each is judged once. The postings are written first, as their columns are read several times.
    """
    df = cut(postings, "postings")
    match = match_title(F.col("title"), p.roles, p.keywords, p.exclude, p.exceptions)
    fields = [match[c].alias(c) for c in ("excluded", "roles", "keywords", "score")] + [has_term(F.col("title"), terms).alias(c) for c, terms in (("senior", p.seniority), ("level", p.levels), ("deprioritised", p.deprioritise))]
    df = _judged_once(df, "title", match=F.struct(*fields))
    df = _judged_once(df, "location", workplace=workplace(F.col("location"), p.allow))
    df = _judged_once(df, "company", company_key=company_key(F.col("company")), _blocked=company_blocked(F.col("company"), p.block_companies))
    rules = [
        F.when(F.col("_blocked"), "company"),
        F.when(F.size("match.excluded") > 0, "title excluded"),
        F.when(F.col("workplace") == "other", "location"),
        F.when((F.col("workplace") == "remote") & F.lit(p.remote == "exclude"), "remote"),
        F.when(F.lit(bool(p.roles)) & (F.size("match.roles") == 0), "no role"),
        F.when(F.col("match.score") < p.least_keywords, "keywords"),
        F.when(F.col("match.senior"), "seniority"),
        F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.when(has_term(F.concat_ws(" ", "title", "description"), p.block_content), "content")),
    ]
    return df.withColumn("reason", F.coalesce(*rules)).drop("_blocked")


def heuristic(p: Preferences, today: Column) -> Column:
    """0 to 100, to order what the ranking budget can't hold; of rows that `classify` has judged."""
    age = F.greatest(F.lit(0), F.datediff(today, F.col("posted_at")))
    total = (
        F.lit(40) + F.when(F.col("watchlist"), 30).otherwise(0) + F.least(F.lit(30), 10 * F.col("match.score")) + F.when(F.col("match.level"), 8).otherwise(0)
        + F.when(F.col("workplace") == "office", 8).otherwise(0) - F.when((F.col("workplace") == "remote") & F.lit(p.remote == "rank_lower"), 10).otherwise(0)
        + F.when(age <= 1, 10).when(age <= 3, 6).when(age <= 7, 3).otherwise(0) + F.when(F.coalesce("description", F.lit("")) != "", 3).otherwise(0)
        - F.when(F.col("match.deprioritised"), 15).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def cap_per_company(ranked: DataFrame, most: int, order: list[Column], key: str = "company_key") -> DataFrame:
    """The first `most` of each company in the order; those that stay tell how many more there are. No cap for 0 or less."""
    if most <= 0:
        return ranked.withColumn("more_at_company", F.lit(None).cast("long"))
    # the rows are read twice, so they are written once; a row number under a limit is cut in each partition before the shuffle, and counts are partial sums: no task sorts a whole company
    ranked = cut(ranked, "ranked")
    first = ranked.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_place") <= most).drop("_place")
    more = ranked.groupBy(F.col(key).alias("_company")).agg((F.count(F.lit(1)) - most).alias("_more"))
    return first.join(more, F.col(key).eqNullSafe(F.col("_company"))).withColumn("more_at_company", F.when(F.col("_more") > 0, F.col("_more"))).drop("_company", "_more")
