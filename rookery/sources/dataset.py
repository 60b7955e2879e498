"""Published datasets of postings: a manifest that lists gzipped JSON chunks, read with a fixed schema, filtered before anything is joined, and backed by sweeps when it is old or unreadable.

A gzip file is one task's work, so a chunk is the unit of parallelism. Records that aren't JSON, or lack a url or a title, are kept apart with their file. Nothing that the lane needs later is
read earlier: vendor, window and title filter the scan; company names are joined to what is left, and the filter that looks at names runs again on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators.sites import boards_in_pages

RECORD = "url string, title string, company string, location string, ats string, first_seen string"
CHUNK = r"^[\w.-]+\.json\.gz$"
MANIFEST = "last_updated string, chunks array<string>"
# Where the boards of vendors live that the dataset names by slug, and what such a slug looks like.
BOARDS = {"ashby": "https://jobs.ashbyhq.com/%s", "bamboohr": "https://%s.bamboohr.com/careers", "greenhouse": "https://job-boards.greenhouse.io/%s", "lever": "https://jobs.lever.co/%s"}
SLUG = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,80}$"


@dataclass(frozen=True)
class Manifest:
    """What a dataset says of itself. `age_hours` is infinite where the day isn't readable; `error` says why it can't be used at all."""

    last_updated: str | None
    chunks: list[str]
    age_hours: float
    error: str | None = None

    def stale(self, max_age_hours: float) -> bool:
        return self.error is not None or self.age_hours > max_age_hours


def manifest(spark: SparkSession, folder: str, now: str) -> Manifest:
    """Reads `manifest.json` of a dataset: one small record, the only thing that reaches the driver."""
    try:
        rows = spark.read.schema(MANIFEST).option("multiLine", True).json(f"{folder}/manifest.json").withColumn("_age", (F.lit(now).cast("timestamp").cast("double") - F.try_to_timestamp("last_updated").cast("double")) / 3_600).collect()
    except Exception as error:  # not there, or not to be read
        return Manifest(None, [], float("inf"), f"manifest: {type(error).__name__}")
    found = rows[0] if rows else None
    if found is None or not found.chunks:
        return Manifest(found.last_updated if found else None, [], float("inf"), "manifest lists no chunks")
    import re

    odd = next((c for c in found.chunks if not re.match(CHUNK, c or "")), None)
    if odd is not None:
        return Manifest(found.last_updated, [], float("inf"), f"unexpected chunk name {odd!r}")
    return Manifest(found.last_updated, list(found.chunks), float("inf") if found._age is None else found._age)


def records(spark: SparkSession, folder: str, chunks: list[str]) -> tuple[DataFrame, DataFrame]:
    """(whole records, corrupt ones as (file, record)) of the chunks that a manifest lists, and of no other file."""
    paths = [f"{folder}/{c}" for c in chunks]
    good = spark.read.schema(RECORD).json(paths).filter("url IS NOT NULL AND title IS NOT NULL")
    raw = spark.read.text(paths).filter("trim(value) <> ''")
    parsed = F.from_json("value", f"{RECORD}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    corrupt = raw.filter(parsed["_bad"].isNotNull() | parsed["url"].isNull() | parsed["title"].isNull()).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("record"))
    return good, corrupt


def in_window(rows: DataFrame, vendors: list[str] | None, since: Column, until: Column) -> DataFrame:
    """Rows of the vendors first seen within the window; rows without a readable day stay, marked as uncertain."""
    seen = F.try_to_timestamp("first_seen")
    own = rows.filter(F.lower("ats").isin(*vendors)) if vendors is not None else rows
    return own.filter(F.coalesce(seen.between(since, until), F.lit(True))).withColumn("first_seen", seen).withColumn("uncertain", F.col("first_seen").isNull())


def with_boards(rows: DataFrame, id_col: str = "url") -> DataFrame:
    """Adds (vendor, slug, careers_url) as `board`: of the vendor and slug that the row names, else of its url."""
    named = F.lit(None)
    for vendor, url in BOARDS.items():
        board = F.struct(F.lit(vendor).alias("vendor"), F.col("company").alias("slug"), F.format_string(url, "company").alias("careers_url"))
        named = F.when((F.lower("ats") == vendor) & F.col("company").rlike(SLUG), board).otherwise(named)
    by_name = rows.withColumn("board", named)
    linked = boards_in_pages(by_name.filter("board IS NULL").select(F.col(id_col).alias("_id")).distinct().withColumn("_html", F.col("_id")), "_id", "_html")
    first = linked.groupBy("_id").agg(F.min(F.struct("vendor", "slug", "careers_url")).alias("_linked"))
    return by_name.join(first, by_name[id_col] == first["_id"], "left").withColumn("board", F.coalesce("board", "_linked")).drop("_id", "_linked")


def lane(rows: DataFrame, names: DataFrame, keep, swept: DataFrame | None = None) -> DataFrame:
    """Filter, name, filter again: `keep(df)` is a filter on title, location and company; `names` has a row (slug, name) each. Rows of sweeps that stand in come after."""
    first = keep(rows)
    named = first.join(names.select(F.lower("slug").alias("_slug"), F.col("name").alias("_name")).dropDuplicates(["_slug"]), F.lower("company") == F.col("_slug"), "left")
    again = keep(named.withColumn("company", F.coalesce("_name", "company")).withColumn("company_is_slug", F.col("_name").isNull() & (F.lower("ats") != "paylocity")).drop("_slug", "_name"))
    return again if swept is None else again.unionByName(swept, allowMissingColumns=True)


def fallback_units(spark: SparkSession, found: Manifest, max_age_hours: float, asked: list[str], fallback: list[str], until: str) -> DataFrame:
    """Coverage rows of a lane: the dataset itself, and for each vendor asked for that no sweep stands in for, a failed one."""
    state = "failed" if found.error else "partial" if found.stale(max_age_hours) else "complete"
    said = found.error or (f"dataset is {found.age_hours:.1f}h old (at most {max_age_hours:g})" if state == "partial" else None)
    rows = [("ats_dataset:manifest", state, until if state == "complete" else None, len(found.chunks), said)]
    if state != "complete":
        rows += [(f"ats_dataset:{v.lower()}", "failed", None, 0, "no sweep stands in for this vendor") for v in asked if v.lower() not in {f.lower() for f in fallback}]
    return spark.createDataFrame(rows, "key string, status string, covered_through string, chunks int, limitation string")
