"""Tables of runs: a run writes its own partition, again if it runs again, and old or committed runs go by the name of their partition, with no file read."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

_DAY = re.compile(r"^(\d{4}-\d{2}-\d{2})")


def create(spark: SparkSession, table: str, columns: str) -> None:
    """A managed table of these columns, partitioned by the run's id."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}, run STRING) USING parquet PARTITIONED BY (run)")


def write(rows: DataFrame, table: str) -> None:
    """Writes the partitions of the runs among `rows`, whole, and leaves the others alone."""
    spark, mode = rows.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")  # tables of the catalog take it from the session only
    try:
        rows.select(*spark.table(table).columns).write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(mode, before)


def runs(spark: SparkSession, table: str) -> list[str]:
    """The ids of the runs that a table holds; a name a run. Partitions are listed with odd letters escaped."""
    return sorted(unquote(r.run) for r in spark.sql(f"SHOW PARTITIONS {table}").selectExpr("substring(partition, 5) AS run").collect())


def day_of(run: str) -> str | None:
    found = _DAY.match(run)
    return found[1] if found else None


def prune(spark: SparkSession, table: str, since: str | None = None, committed: tuple[str, ...] = ()) -> list[str]:
    """Drops runs of days before `since`, and committed ones. A run whose id begins with no day stays unless it is committed. Gives the ids of what went."""
    gone = [r for r in runs(spark, table) if r in set(committed) or (since is not None and (day_of(r) or since) < since)]
    for i in range(0, len(gone), 100):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS " + ", ".join(f"PARTITION (run = {_quoted(r)})" for r in gone[i : i + 100]))
    return gone


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
