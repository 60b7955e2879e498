"""Sweeps of directories of boards: a directory is read chunk by chunk, each chunk's boards are named and the dead ones skipped, and the place reached is kept.

A directory is a folder of chunk files. Structured Streaming's file source is the cursor: it takes so many chunks a batch, its checkpoint says which are done, and a sweep that was stopped goes on behind the last
batch that was written. A batch that runs again replaces its own folder, so stopping at any point loses and repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators.graphs import cut, fresh_folder

# What a slug looks like, and where the boards of swept vendors live.
SLUG = "^[A-Za-z0-9._-]+$"
SWEPT = {
    "ashby": "https://jobs.ashbyhq.com/%s",
    "greenhouse": "https://job-boards.greenhouse.io/%s",
    "icims": "https://careers-%s.icims.com/jobs/search?ss=1&in_iframe=1",
    "lever": "https://jobs.lever.co/%s",
    "workday": "https://%s.%s.myworkdayjobs.com/%s",
}
DIRECTORY = "position long, vendor string, line string"


def board_of(vendor: Column, line: Column) -> Column:
    """(name, careers_url) of a directory's line: a slug, or tenant|instance|site for workday; null for other vendors and for parts that are no slugs."""
    parts = F.split(line, r"\|", -1)
    made = F.lit(None)
    for v, url in SWEPT.items():
        if v == "workday":
            ok = (F.size(parts) >= 3) & F.forall(F.slice(parts, 1, 3), lambda p: p.rlike(SLUG))
            full = F.format_string(url, F.get(parts, 0), F.get(parts, 1), F.get(parts, 2))
            # a label of a host holds neither dots nor underscores at its edges
            ok &= F.get(parts, 0).rlike("^[A-Za-z0-9-]+$") & F.get(parts, 1).rlike("^[A-Za-z0-9-]+$")
        else:
            ok, full = line.rlike(SLUG), F.format_string(url, line)
            if v == "icims":
                ok &= line.rlike("^[A-Za-z0-9-]+$")
        made = F.when(vendor == v, F.when(ok, F.struct(F.get(parts, 0).alias("name"), full.alias("careers_url")))).otherwise(made)
    return made


def stored_directory(lines: DataFrame, folder: str, chunk: int) -> None:
    """Writes (position, vendor, line) as chunks of `chunk` positions, a file each, in the order of their numbers."""
    numbered = lines.withColumn("chunk", F.floor(F.col("position") / chunk))
    numbered.repartition("chunk").sortWithinPartitions("chunk", "position").write.partitionBy("chunk").parquet(folder)


def alive(entries: DataFrame, dead: DataFrame, most: int = 3) -> DataFrame:
    """Entries whose board isn't known as dead: `dead` has a row (vendor, board, misses) each."""
    gone = dead.filter(F.col("misses") >= most).select(F.col("vendor").alias("_v"), F.lower("board").alias("_b")).distinct()
    return entries.join(gone, (F.col("vendor") == F.col("_v")) & (F.lower("careers_url") == F.col("_b")), "left_anti")


def sweep(spark: SparkSession, directory: str, dead: DataFrame, out: str, checkpoint: str, chunks_at_once: int = 1, most_batches: int | None = None) -> None:
    """Goes on with a sweep from where its checkpoint stands, to the end of the directory or for `most_batches` batches. Boards go to `out`, a folder a batch."""
    lines = spark.readStream.schema(DIRECTORY).option("maxFilesPerTrigger", chunks_at_once).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(directory)

    class Stop(Exception):
        pass

    begun = []

    def write(batch: DataFrame, number: int) -> None:
        if most_batches is not None and len(begun) >= most_batches:
            raise Stop  # this batch isn't committed, so it comes first when the sweep goes on
        begun.append(number)
        named = batch.select("position", "vendor", "line", board_of(F.col("vendor"), F.col("line")).alias("b")).filter("b IS NOT NULL").select("position", "vendor", "b.name", "b.careers_url")
        alive(named, dead).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if most_batches is None or len(begun) < most_batches:
            raise


def swept(spark: SparkSession, out: str) -> DataFrame:
    """The boards that a sweep has reached so far."""
    return spark.read.schema("position long, vendor string, name string, careers_url string, batch int").parquet(out)


#: A whole sweep takes so many batches at most: each has a cost of its own, however few lines it holds.
MOST_BATCHES = 16


def whole_sweep(spark: SparkSession, lines: DataFrame, dead: DataFrame, chunk: int) -> DataFrame:
    """A directory stored, swept from start to end and read back. Batches grow with the directory, and what is dead is found out once for all of them."""
    root = fresh_folder(spark, "sweep")
    stored_directory(lines, f"{root}/directory", chunk)
    chunks = lines.select(F.floor(F.col("position") / chunk)).distinct().count()
    sweep(spark, f"{root}/directory", cut(dead, "dead"), f"{root}/boards", f"{root}/checkpoint", chunks_at_once=max(4, -(-chunks // MOST_BATCHES)))
    return swept(spark, f"{root}/boards")
