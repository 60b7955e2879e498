import os
import random
import re
import string
import zlib
from collections import Counter

import pytest

from rookery.llm import spelling
from tests.llm.helpers import docs_of

DATA = "/root/testdata/sf0.01"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def plain_near(words):
    """By wildcards: words that agree but for one place."""
    by, out = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            by.setdefault((w[:i], w[i + 1 :]), set()).add(w)
        for i in range(len(w) + 1):
            by.setdefault((w[:i], w[i:], "gap"), set()).add(w)
    for w in words:
        for i in range(len(w)):
            out[w] |= by[w[:i], w[i + 1 :]] | by.get((w[:i], w[i + 1 :], "gap"), set())
        for i in range(len(w) + 1):
            out[w] |= by.get((w[:i], w[i:]), set())
        out[w].discard(w)
    return out


def plain_rows(counts):
    forms, near = {}, plain_near(counts)
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    rows = set()
    for w, form in forms.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.add((w, form, root, counts[w], len(near[w]), counts.get(form)))
    return rows


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def made_words(seed, n=400):
    rng = random.Random(seed)
    words = {"".join(rng.choice("aeintéÿ×") for _ in range(rng.randint(6, 9))) for _ in range(n)}
    for w in sorted(words)[: n // 2]:
        i = rng.randrange(len(w))
        words |= {w[:i] + "x" + w[i + 1 :], w[:i] + w[i + 1 :] + "y", w[:i] + "q" + w[i:], w[1:] + w[0]}
    return {w: 5 * 6 ** rng.randint(0, 4) + rng.randint(0, 1) for w in words if len(w) >= 6}


@pytest.mark.parametrize("shard,leaf", [(20_000, 64), (10, 2), (1, 1)])
def test_all_near_words_are_found(spark, shard, leaf):
    counts = made_words(3)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling.grouped(words, shard_words=shard, leaf=leaf)) == plain_rows(counts)


def test_permutations_and_very_long_words():
    rng = random.Random(5)
    words = {"".join(rng.sample("aabbccdd", 8)) for _ in range(300)} | {"".join(rng.sample("aabbccdda", 9)) for _ in range(300)} | {"a" * 500, "a" * 501, "a" * 499 + "b"}
    near = plain_near(words)
    for leaf in (1, 64):
        found = {w: set() for w in words}
        queries = sorted(words)
        for q, w in spelling.Trie(queries, leaf).pairs(queries):
            found[queries[q]].add(w)
        assert found == near


def test_odd_rows(spark):
    rows = [(1, "abcdef ABCDEF abcdef ABCdef abcdef"), (1, "abcdef ABCDEF abcdef ABCdef abcdef"), (2, None), (3, ""), (None, "ABCDEG abcdeg abcdeg abcdeg abcdeg abcde"), (4, "Étéééé " * 5 + "İstanbul " * 9 + "x" * 100_000), (5, " \n")]
    want = plain_rows(plain_words(rows))
    assert rows_of(spelling.spelling_variants(docs_of(spark, rows))) == want and any(r[1] for r in want) is False
    assert spelling.spelling_variants(docs_of(spark, [])).collect() == []


def test_a_letter_is_lost_as_the_check_sum_says(spark):
    rows = [(i, "wonderful things happened everywhere") for i in range(20_000)]
    want = plain_rows(plain_words(rows))
    assert rows_of(spelling.spelling_variants(docs_of(spark, rows))) == want and any(r[1] for r in want)


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the driver's tables")
def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_rows(plain_words(docs))
    assert rows_of(spelling.op12_spelling_variants(spark, DATA)) == want and any(r[1] for r in want)
