"""JSON inside other text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rookery.functions.urls import bound


def embedded(html: Column, element_id: str) -> Column:
    """The body of a script element with the given id."""
    return F.nullif(F.regexp_extract(html, rf"(?s)<script[^>]*id=[\"']{element_id}[\"'][^>]*>(.*?)</script>", 1), F.lit(""))


#: A string with its escapes, a bracket, or a run of anything else.
_TOKEN = r'(?s)"(?:[^"\\]++|\\.)*+(?:"|\z)|[\[\]]|[^"\[\]]++'


def balanced_array(text: Column) -> Column:
    """From the first [ to the ] that closes it, brackets in strings apart; null unless that is JSON."""

    def cut(rest: Column) -> Column:
        # how deep each token leaves us, how long the text is up to there, and where the depth first came back to nothing
        step = lambda s, t: F.struct(
            (s["depth"] + F.when(t == "[", 1).when(t == "]", -1).otherwise(0)).alias("depth"), (s["chars"] + F.length(t)).alias("chars"),
            F.coalesce(s["end"], F.when((t == "]") & (s["depth"] == 1), s["chars"] + 1)).alias("end"),
        )
        none = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("chars"), F.lit(None).cast("int").alias("end"))
        found = F.aggregate(F.regexp_extract_all(rest, F.lit(_TOKEN), F.lit(0)), none, step, lambda s: F.substring(rest, F.lit(1), s["end"]))
        return bound(found, lambda x: F.when(F.try_parse_json(x).isNotNull(), x))

    return F.when(F.contains(text, F.lit("[")), bound(F.regexp_extract(text, r"(?s)\[.*", 0), cut))


def extract_json(text: Column) -> Column:
    """The first JSON array in an answer: that of its first fenced block, else that of the whole text; null without one."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*+(.*?)```", 1)
    return F.coalesce(balanced_array(fenced), balanced_array(text))
