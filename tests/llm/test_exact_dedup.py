import hashlib
import re

from rookery.llm import exact_dedup
from tests.llm.helpers import docs_of

ROWS = [(5, "a b"), (3, "a  \n b"), (9, " a b"), (1, None), (2, ""), (7, "x" * 300_000), (8, "x" * 300_000), (4, "only"), (None, "only me"), (6, "twice"), (6, "twice"), (11, "a b")]


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    got = exact_dedup.exact_copies(docs_of(spark, ROWS)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_hot_group_and_small_filter(spark, monkeypatch):
    """A filter that is far too small only sends more rows to the shuffle."""
    monkeypatch.setattr(exact_dedup, "MAX_CELLS", 1 << 15)
    monkeypatch.setattr(exact_dedup, "filter_size", lambda rows: 1 << 15)
    rows = [(i, "copy" if i % 3 == 0 else f"text {i}") for i in range(3_000)]
    got = exact_dedup.exact_copies(docs_of(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_drop_keeps_columns_and_one_of_each(spark):
    kept = exact_dedup.drop_exact_copies(docs_of(spark, ROWS))
    assert kept.columns == docs_of(spark, ROWS).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 9, 1, 7, 4, None, 6, 6, 11], key=str)


def test_empty_table(spark):
    assert exact_dedup.exact_copies(docs_of(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(docs_of(spark, [])).count() == 0
