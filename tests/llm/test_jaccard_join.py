import random
import re

import pytest

from rookery.llm import jaccard_join
from tests.llm.helpers import docs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, any_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if any_ and 100 * both >= 75 * any_:
                root[top(i)] = top(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(top(k), []).append(i)
    least = {t: min((x for x in v if x is not None), default=None) for t, v in ids.items()}
    return sorted(((i, len(sets[k]), least[top(k)] if least[top(k)] is not None else i) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed, n=150):
    """Texts that are copies, chains of small edits, mixes of common passages, and short ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcd") for _ in range(3))
    passages = [[word() for _ in range(rng.randint(5, 30))] for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.45:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = word()
            texts.append("  ".join(w).upper() if kind < 0.1 else " ".join(w))
        elif kind < 0.7:
            texts.append(" ".join(x for p in rng.sample(passages, rng.randint(1, 4)) for x in p))
        else:
            texts.append(" ".join(word() for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 40, 120]))))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return [*rows, (900, None), (901, ""), (3, "a repeated id of its own"), (None, "one two three"), (902, "One Two  three"), (903, "ÉÀ b c d e f"), (904, "éà b c d e f")]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    got = jaccard_join.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_small_blocks_and_batches(spark, monkeypatch):
    """With tiny bounds the batches, buckets and blocks are many, and the result is the same."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    monkeypatch.setattr(jaccard_join, "FLUSH_SHINGLES", 500)
    monkeypatch.setattr(jaccard_join, "BUCKET_SHINGLES", 300)
    rows = corpus(7, 200)
    got = jaccard_join.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_tables_too_large_to_broadcast(spark, monkeypatch):
    for name, value in (("BROADCAST_ROWS", 0), ("MOST_PAGES", 0), ("BLOCK", 16)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus(9, 100)
    got = jaccard_join.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_only_sets_that_are_needed_move(spark, monkeypatch):
    """Whole sets move once as they are written, and no set moves to a join that has no use for it."""
    written, plans = jaccard_join.written, {}
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), written(df, name))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert jaccard_join.near_duplicates(docs_of(spark, corpus(1))).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moves = lambda plan: [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]
    assert moves(plans["sets"]).count("key") == 2  # the keys that are chosen, and the sets
    assert not [x for x in moves(plans["spokes"]) if x == "node"]
    assert "_bits" in plans["late"]


def test_held(spark):
    nodes = [0, 1, 7, 8, 32_767, 32_768, (1 << 33) - 1, 1 << 33, (5 << 33) + 40_000, (5 << 33) + 40_001]
    sets = spark.createDataFrame([(n, [n]) for n in nodes], "node long, hashes array<long>")
    for wanted in (nodes[::2], nodes[1::2], nodes, []):
        got = jaccard_join._held(sets, spark.createDataFrame([(n,) for n in wanted * 2], "node long"))
        assert sorted((r.node, r.hashes) for r in got.collect()) == [(n, [n]) for n in wanted]


def test_keep_one(spark):
    rows = [r for r in corpus(4, 80) if r[0] not in (3, None)]
    kept = jaccard_join.keep_one(docs_of(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in brute(rows) if i == c)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b c d e f")]])
def test_little(spark, rows):
    assert [tuple(r) for r in jaccard_join.near_duplicates(docs_of(spark, rows)).collect()] == brute(rows)


def test_keep_one_tells_rows_apart(spark):
    """Null and repeated ids: one row of each component stays, the first with the smallest id; other rows with the id of one that goes stay."""
    long = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    near = lambda t: t + " tail"
    rows = [
        (9, long[0]), (1, near(long[0])), (9, long[1]),  # 9 goes from the first component, and stays in another
        (2, long[2]), (2, near(long[2])),  # near copies under one id
        (None, long[3]), (3, near(long[3])), (None, long[4]), (None, near(long[4])), (None, long[5]), (None, None), (None, ""), (9, ""),
    ]
    kept = jaccard_join.keep_one(docs_of(spark, rows))
    want = [rows[i] for i in (1, 2, 3, 6, 7, 9, 10, 11, 12)]
    assert kept.columns == docs_of(spark, []).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_keep_one_of_every_component(spark):
    rows = [*corpus(4, 80), *((3, t) for _, t in corpus(4, 20)[:20]), *((None, t) for _, t in corpus(5, 20)[:20])]
    parts = {}
    for k, _, c in brute([(k, t) for k, (_, t) in enumerate(rows)]):
        parts.setdefault(c, []).append(k)
    want = [rows[min(ks, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))] for ks in parts.values()]
    got = [(r.doc_id, r.text) for r in jaccard_join.keep_one(docs_of(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("long_set", [2_048, 6])
def test_first_shingles(spark, monkeypatch, long_set):
    """The exchange by bucket and batch against counts made here; sets of more than `long_set` shingles travel alone."""
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(-60, 60), rng.randint(1, 12))) for _ in range(80)] + [[7]] * 3
    spread = lambda x: x * 0x9E3779B97F4A7C1 % (1 << 64) - (1 << 63)
    sets = [sorted(spread(x) for x in s) for s in sets]
    rows = [(i, len(s), s, -1 - i if len(s) > long_set else i // 16) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, n int, hashes array<long>, batch long").repartition(3)
    found = sorted(tuple(r) for r in jaccard_join._first_shingles(df, 75, 4).collect())
    times = {}
    for s in sets:
        for h in s:
            times[h] = times.get(h, 0) + 1
    expected = []
    for i, s in enumerate(sets):
        order = sorted(s, key=lambda h: (times[h], h))[: len(s) + -75 * len(s) // 100 + 1]
        expected += [(i, h) for h in order if times[h] > 1]
    assert found == sorted(expected)
    assert jaccard_join._first_shingles(df.limit(0), 75, 4).count() == 0
