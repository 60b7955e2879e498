"""Plans: one registered query for each operator, over the driver's tables."""

from rookery.plans import collection, decisions, lookups, more, postings, runs, state, texts, upkeep, vendors  # noqa: F401  they register their queries
from rookery.plans.registry import ORACLES, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
