"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as every contract of this subpackage defines them.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A table of up to this many rows may be broadcast; beyond it the salted join is used.
BROADCAST_ROWS = 100_000
#: A key is hot when it holds at least one in so many rows, so there are never more hot keys than this.
HOT_KEYS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a fresh local one only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rookery-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: cuts lineage, and survives the loss of any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def attach(left: DataFrame, right: DataFrame, key: str, count: str, left_id: str, total: int) -> DataFrame:
    """Left join on `key` with a `right` of one row a key, where `right[count]` is how many rows of `left` have the key.

    A key that holds more than total / HOT_KEYS rows is dealt over as many salts as it
    holds such shares; the list of those keys is bounded by HOT_KEYS and broadcast. Null keys meet
    nothing and are dealt by `left_id`.
    """
    share = max(1, total // HOT_KEYS)
    salted = right.withColumn("_salts", F.greatest(F.lit(1), F.ceil(F.col(count) / share)).cast("int"))
    hot = salted.filter(F.col("_salts") > 1).select(F.col(key).alias("_hot"), F.col("_salts").alias("_n"))
    # the list is never empty, so that the plan is the same at every size and skew; one salt for a key means none
    one = left.sparkSession.range(1).select(F.lit("0").cast(right.schema[key].dataType).alias("_hot"), F.lit(1).alias("_n"))
    hot = hot.unionByName(one).groupBy("_hot").agg(F.max("_n").alias("_n"))
    dealt = (
        left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.when(F.col(key).isNull() | F.col("_n").isNotNull(), F.pmod(F.xxhash64(left_id, key), F.coalesce("_n", F.lit(1 << 20)))).otherwise(0).cast("int"))
        .drop("_hot", "_n")
    )
    spread = salted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return dealt.join(spread, [key, "_salt"], "left").drop("_salt")


def bounded_batches(spark: SparkSession, rows: int = 1_000, size: int = 16 << 20) -> None:
    """Arrow batches of few rows and bytes, so that a batch of very long texts still fits a worker's memory. Smaller settings of the session stay."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(re.match(r"-?\d+", spark.conf.get(name))[0]) <= most:
            spark.conf.set(name, str(most))


_kept: dict = {}


def kept(key, make):
    """What a Python worker keeps from task to task under `key`, made once; all that was kept under other keys goes first."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Gives back what tasks of other operators kept or left in this worker. Workers outlive their stage, so each operator's tasks begin with this."""
    import gc

    if _kept:
        _kept.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Hands freed memory back to the machine."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: memory is reused, if not given back
        pass
