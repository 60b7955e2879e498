"""Files: sheets as CSV, datasets as gzipped JSON, exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT = ("id", "company", "title", "url", "location", "posted_at", "first_seen", "source", "score", "decision", "reason")


def snake(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with quoted line breaks; headers in snake case, cells trimmed, blank rows left out."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    named = raw.toDF(*(snake(c) for c in raw.columns))
    cells = named.select(*(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in named.columns))
    return cells.filter(F.concat_ws("", *cells.columns) != "")


def dataset_rows(rows: DataFrame, vendors: list[str], since: Column, until: Column) -> DataFrame:
    """Rows of known vendors first seen within the window; undated rows stay."""
    return rows.filter(F.lower("ats").isin(*vendors) & (F.col("first_seen").isNull() | F.col("first_seen").between(since, until)))


def csv_cell(text: Column) -> Column:
    """Quoted only if it has to be."""
    return F.when(text.rlike("[\",\n\r]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def safe_cell(text: Column, most: int = 500) -> Column:
    """What a spreadsheet would take for a formula is made plain text; at most `most` characters."""
    return F.substring(F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text), 1, most)


def export(roles: DataFrame, path: str) -> None:
    """The roles as JSON and CSV, with the fixed columns of an export."""
    out = roles.select(*(F.col(c) if c in roles.columns else F.lit(None).cast("string").alias(c) for c in EXPORT))
    out.write.mode("overwrite").json(f"{path}/roles.json")
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/roles.csv")


def observations(rows: DataFrame) -> DataFrame:
    """One row a board and run: a later empty or failed attempt never replaces one that found something."""
    led = F.struct((F.col("n_jobs") > 0).alias("found"), F.col("attempt"))
    return rows.groupBy("run", "board").agg(F.max_by(F.struct("outcome", "n_jobs", "attempt"), led).alias("o")).select("run", "board", "o.*")
