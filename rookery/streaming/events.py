"""Streams of events: windows with a watermark, exact once upserts, and boards that die after repeated misses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, folder: str, schema: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def counts_by_window(events: DataFrame, at: str, by: str, late: str = "48 hours", length: str = "1 day") -> DataFrame:
    """Counts of each window and key; rows later than the watermark are left out, others within it counted once by event_id."""
    once = events.withWatermark(at, late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window(at, length), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def misses(most: int = 3):
    """The state of a board: misses in a row, at most `most`; found alive clears it, any other answer does unless it is dead."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for gone in pd.concat(list(frames)).sort_values("event_id")["gone"]:
            n = min(most, n + 1) if gone == "miss" else 0 if gone == "ok" or n < most else n
        state.update((n,))
        yield pd.DataFrame({"key": [key[0]], "misses": [n]})

    return run


def dead_boards(checks: DataFrame, most: int = 3) -> DataFrame:
    """(key, misses) of every board that a batch touched. `checks` has key, event_id, gone."""
    return checks.groupBy("key").applyInPandasWithState(misses(most), "key long, misses int", "misses int", "update", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, key: str):
    """A foreachBatch writer: each batch is a folder of its own, named by its number, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
