"""Connected components, for identities and linked records."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that spark.checkpoint.dir names; a local one only where that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="rookery-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether what an execution shuffled goes when it ends; else it stays until the driver happens to collect its memory.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table in the shared folder: cuts lineage and survives lost executors. What was shuffled to write it is freed."""
    spark = df.sparkSession
    path, before = fresh_folder(spark, name), spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each can reach. Labels spread over edges and jump to their labels' labels, until none changes."""
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).filter("u IS NOT NULL AND v IS NOT NULL").distinct(), "edges")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("component")), "labels")
    while True:
        heard = both.join(labels, F.col("u") == F.col("node")).groupBy(F.col("v").alias("node")).agg(F.min("component").alias("heard"))
        spread = labels.join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("component"))
        onward = labels.select(F.col("node").alias("_at"), F.col("component").alias("_on"))
        after = cut(spread.join(onward, F.col("component") == F.col("_at"), "left").select("node", "old", F.coalesce("_on", "component").alias("component")), "labels")
        labels = after.select("node", "component")
        if after.filter("old <> component").isEmpty():
            return labels
