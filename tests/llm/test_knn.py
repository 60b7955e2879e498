import math
import random

import pytest

from rookery.llm import knn

SCHEMA = "vec_id long, embedding array<double>, label int, v string, shard string, block string, score string, query_id string"


def brute(vectors, queries, k):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    floor = lambda v: [math.floor(256 * x) for x in v]
    rows = [(i, floor(v)) for i, v in vectors if i is not None and ok(v)]
    out = []
    for q, v in queries:
        if q is None or not ok(v):
            continue
        score = lambda w: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(floor(v), w))))  # noqa: E731, B023
        best = sorted((-score(w), i) for i, w in rows if i != q)[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, vectors, k=5, **how):
    df = spark.createDataFrame([(i, v, 0, "a", "b", "c", "d", "e") for i, v in vectors], SCHEMA)
    queries = df.filter("vec_id % 3 = 0")
    got = sorted(map(tuple, knn.top_k(df, queries, k, **how).collect()))
    assert got == brute(vectors, [(i, v) for i, v in vectors if i is not None and i % 3 == 0], k)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    vectors += [(1_000 + i, [0.5] * 6) for i in range(200)]  # ties
    vectors += [(2_000, None), (2_001, []), (2_004, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2_007, [float("nan")] * 6), (2_010, [float("inf")] * 6), (None, [1.0] * 6), (2_013, [2.0, 3.0])]
    run(spark, vectors, shard_rows=90, block_queries=50)
    run(spark, vectors, shard_rows=10_000)


def test_large_numbers_stay_exact(spark):
    rng = random.Random(2)
    run(spark, [(i, [rng.choice([-1, 1]) * rng.random() * 10 ** rng.choice([0, 5, 9, 20]) for _ in range(3)]) for i in range(60)], shard_rows=20)


@pytest.mark.parametrize("vectors", [[], [(0, [1.0])], [(0, [1.0]), (3, [2.0])], [(1, [1.0])]])
def test_little(spark, vectors):
    run(spark, vectors)
