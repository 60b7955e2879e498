"""Keyword lists of any length against texts: terms become three patterns, each a tree of shared beginnings, so a text's cost doesn't grow with the list.

A keyword is a substring of the lower-cased text unless it says otherwise: `word:x` has no letter, mark, digit or underscore beside it, `stem:x` none before it, two or three plain letters are words too. `a + b` needs every part,
in any order. A prefix with nothing behind it matches nothing; blank keywords don't count.

A text is scanned once for each of the three kinds; at each place the longest term is found, and which shorter ones it holds at its beginning is known beforehand, as rows of a small table. That table and the keywords' parts
are joined to what was found, so hundreds of terms cost a hash lookup a match. Texts that repeat are scanned once.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD, STEM, PART = "word", "stem", "part"
_BESIDE = r"[\p{L}\p{M}\p{N}_]"
_PATTERN = {WORD: (f"(?<!{_BESIDE})(?=(", f")(?!{_BESIDE}))"), STEM: (f"(?<!{_BESIDE})(?=(", "))"), PART: ("(?=(", "))")}


def _inside_a_word(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LMN"


def term_of(text: str, short_words: bool = True) -> tuple[str, str] | None:
    """(kind, letters) of a lower-cased term; None for a prefix with nothing behind it."""
    for prefix, kind in (("word:", WORD), ("stem:", STEM)):
        if text.startswith(prefix):
            rest = text[len(prefix) :].strip()
            return (kind, rest) if rest else None
    return (WORD if short_words and re.fullmatch("[a-z]{2,3}", text) else PART, text)


def parts_of(keyword: str, groups: bool = True, short_words: bool = True) -> list[tuple[str, str] | None]:
    """The terms of a keyword, all of which it needs."""
    text = keyword.strip().lower()
    parts = [p.strip() for p in re.split(r"\s+\+\s+", text)] if groups else [text]
    return [term_of(p, short_words) for p in parts if p] or [term_of(text, short_words)]


def tree_pattern(terms: list[str]) -> str:
    """A pattern of alternatives that share their beginnings, the longest first."""
    tree: dict = {}
    for term in terms:
        node = tree
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        quoted = lambda c: c if c.isalnum() else rf"\x{{{ord(c):x}}}"
        ways = []
        for c in sorted(k for k in node if k):
            text, below = c, node[c]
            run = quoted(c)
            while len(below) == 1 and "" not in below:  # one way on: no choice to write
                text, below = next(iter(below.items()))
                run += quoted(text)
            ways.append(run + written(below))
        if not ways:
            return ""
        whole = ways[0] if len(ways) == 1 and "" not in node else "(?:" + "|".join(ways) + ")"
        return whole + ("?" if "" in node else "")

    return written(tree)


@dataclass
class Keywords:
    """A list of keywords, ready to be looked for."""

    listed: list[str]
    groups: bool = True
    short_words: bool = True
    parts: dict[str, list] = field(default_factory=dict)

    def __post_init__(self):
        for k in self.listed:
            if isinstance(k, str) and k.strip():
                self.parts.setdefault(k.strip().lower(), parts_of(k, self.groups, self.short_words))

    def terms(self, kind: str) -> list[str]:
        return sorted({t[1] for ts in self.parts.values() for t in ts if t and t[0] == kind})

    def implied(self) -> list[tuple[str, str, str]]:
        """(kind, found, term): the terms at the beginning of each term that holds them there, itself included."""
        rows = []
        for kind in (WORD, STEM, PART):
            terms = self.terms(kind)
            known = set(terms)
            for term in terms:
                for n in range(1, len(term) + 1):
                    # a word within a longer one needs a border behind it there too
                    if term[:n] in known and (kind != WORD or n == len(term) or not _inside_a_word(term[n])):
                        rows.append((kind, term, term[:n]))
        return rows


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a list that a person wrote: its size is that of the configuration."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def matches(texts: DataFrame, text_col: str, keywords: Keywords) -> DataFrame:
    """(text, keywords): for each distinct text that matches any, its keywords in the order of the alphabet. Null texts match nothing."""
    spark = texts.sparkSession
    distinct = texts.select(F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct()
    lower = F.lower("text")
    scans = []
    for kind in (WORD, STEM, PART):
        if terms := keywords.terms(kind):
            before, after = _PATTERN[kind]
            hits = F.array_distinct(F.regexp_extract_all(lower, F.lit(before + tree_pattern(terms) + after), F.lit(1)))
            scans.append(F.arrays_zip(F.array_repeat(F.lit(kind), F.size(hits)).alias("kind"), hits.alias("found")))
    implied = _small(spark, keywords.implied(), "kind string, found string, term string")
    needed = _small(spark, [(k, len(set(ts)), t[0], t[1]) for k, ts in keywords.parts.items() if all(ts) for t in set(ts)], "keyword string, needs int, kind string, term string")
    if not scans:
        return spark.createDataFrame([], "text string, keywords array<string>")
    hit = distinct.select("text", F.explode(F.concat(*(s.cast("array<struct<kind:string,found:string>>") for s in scans))).alias("h")).select("text", "h.kind", "h.found")
    had = hit.join(implied, ["kind", "found"]).select("text", "kind", "term").join(needed, ["kind", "term"])
    whole = had.groupBy("text", "keyword", "needs").agg(F.count_distinct("kind", "term").alias("n")).filter("n = needs")
    return whole.groupBy("text").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))  # at most the list itself


def title_filter(df: DataFrame, text_col: str, positive: list[str], negative: list[str]) -> DataFrame:
    """Adds `wanted` and `unwanted` (the keywords found) and `kept`: some wanted one or none listed, and no unwanted one. Groups count among the wanted only.

    Distinct texts are judged, and joined back; a text that many rows share is one row of the right side, so the join is dealt by AQE like any other.
    """
    # both sides' rows of a text are one, so that a single join brings them back
    wanted = matches(df, text_col, Keywords(positive)).withColumnRenamed("keywords", "wanted")
    unwanted = matches(df, text_col, Keywords(negative, groups=False)).withColumnRenamed("keywords", "unwanted")
    both = wanted.join(unwanted, "text", "full_outer").withColumnRenamed("text", "_text")
    none = F.array().cast("array<string>")
    found = df.join(both, F.col(text_col) == F.col("_text"), "left").drop("_text").withColumns({"wanted": F.coalesce("wanted", none), "unwanted": F.coalesce("unwanted", none)})
    any_positive = any(isinstance(k, str) and k.strip() for k in positive)
    ok: Column = (F.size("wanted") > 0) if any_positive else F.lit(True)
    return found.withColumn("kept", ok & (F.size("unwanted") == 0))
