"""Titles: terms with word borders of any script, longest match first, exclusions and what cancels them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"[\p{L}\p{M}\p{N}]"


def term_pattern(term: str) -> str:
    """A term's words with any run of separators between them and no letter beside it; a * at its end lets the word go on."""
    open_end = term.endswith("*")
    words = [re.escape(w) for w in re.split(r"[\s\-_/]+", term.rstrip("*").lower()) if w]
    return rf"(?<!{W})" + r"[\s\-_/]+".join(words) + ("" if open_end else rf"(?!{W})")


def has_term(text: Column, terms: list[str]) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(map(term_pattern, terms))) if terms else F.lit(False)


def hits(text: Column, terms: list[str]) -> Column:
    """The distinct terms that a text has, in the order of the list; a term inside a longer one that is there doesn't count."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    longest = sorted(terms, key=lambda t: (-len(t), t))
    found, rest = {}, lower
    for term in longest:  # each match is blanked out before shorter terms look
        found[term] = rest.rlike(term_pattern(term))
        rest = F.regexp_replace(rest, term_pattern(term), " | ")
    return F.filter(F.array(*(F.when(found[t], F.lit(t)) for t in terms)), lambda x: x.isNotNull()) if terms else F.array().cast("array<string>")


def match_title(title: Column, roles: list[str], keywords: list[str], exclude: list[str], exceptions: dict[str, list[str]] | None = None) -> Column:
    """(excluded, roles, keywords, score): an exclusion is cancelled by any of its own exceptions anywhere in the title."""
    exceptions = exceptions or {}
    excluded = F.filter(F.array(*(F.when(has_term(title, [t]) & ~has_term(title, exceptions.get(t, [])), F.lit(t)) for t in exclude)), lambda x: x.isNotNull()) if exclude else F.array().cast("array<string>")
    own = hits(title, keywords)
    return F.struct(excluded.alias("excluded"), hits(title, roles).alias("roles"), own.alias("keywords"), F.size(own).alias("score"))


def weaker_filter(title: Column, roles: list[str], exclude: list[str], exceptions: dict[str, list[str]] | None = None) -> Column:
    """A cheap test that keeps at least what match_title keeps: the longest word of any role, no exclusion that nothing cancels."""
    longest = [max(re.split(r"[\s\-_/]+", r.lower().rstrip("*")), key=len) for r in roles]
    kept = F.lower(title).rlike("|".join(map(re.escape, longest))) if longest else F.lit(True)
    return kept & ~has_term(title, [t for t in exclude if t not in (exceptions or {})])
