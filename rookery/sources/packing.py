"""Planning of fetches: groups of sources under a cap, pages by rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack_sources(counts: DataFrame, name: str, count: str, cap: int) -> DataFrame:
    """(name, count, group): next-fit in descending order of count, one larger than the cap alone. The list of sources is folded as one array, as the order demands."""
    row = F.struct((-F.col(count)).alias("minus"), F.col(name).alias("name"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).alias("group"), F.expr("cast(array() as array<struct<name:string,count:bigint,group:int>>)").alias("out"))

    def step(s: Column, r: Column) -> Column:
        n = (-r["minus"]).cast("long")
        fits = (s["group"] >= 0) & (s["used"] + n <= cap)
        group = F.when(fits, s["group"]).otherwise(s["group"] + 1)
        return F.struct(F.when(fits, s["used"] + n).otherwise(n).alias("used"), group.alias("group"), F.concat(s["out"], F.array(F.struct(r["name"].alias("name"), n.alias("count"), group.alias("group")))).alias("out"))

    folded = counts.agg(F.array_sort(F.collect_list(row)).alias("rows")).select(F.explode(F.aggregate("rows", start, step)["out"]).alias("x"))
    return folded.select(F.col("x.name").alias(name), F.col("x.count").alias(count), F.col("x.group").alias("group"))


def rotated(index: Column, start: Column, n: Column) -> Column:
    """The place of an item when the list begins at `start`."""
    return F.pmod(index - start, n)
