import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rookery.llm import gam
from tests.llm.helpers import docs_of

DATA = "/root/testdata/sf0.01"


def test_features_count_what_they_say():
    x = dict(zip(gam.FEATURES, gam.features(pa.array([b"The cat.\nThe CAT sat!! \xc3\xa9"]))[0]))
    assert x["log_words"] == pytest.approx(np.log1p(6)) and x["distinct_words"] == pytest.approx(5 / 6)
    assert x["upper_share"] == pytest.approx(5 / 15) and x["marked_words"] == pytest.approx(1 / 6)
    assert gam.features(pa.array([b"", b"  \n"])).sum() == 0


def test_score_is_the_sum_of_its_tables():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only a pair of features tells
    model = gam.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.8
    row = x[:1]
    total = model.base + sum(model.tables[f][np.searchsorted(model.edges[f], row[0, f], side="right")] for f in range(4))
    total += sum(t[np.searchsorted(model.coarse[a], row[0, a], side="right"), np.searchsorted(model.coarse[b], row[0, b], side="right")] for a, b, t in model.pairs)
    assert model.score(row)[0] == pytest.approx(1 / (1 + np.exp(-total)))


@pytest.mark.parametrize("y,want", [([], 0.5), ([1, 1], 1.0), ([0], 0.0)])
def test_one_kind_of_label(y, want):
    model = gam.fit(np.zeros((len(y), len(gam.FEATURES))), np.array(y, dtype=float))
    assert model.score(np.zeros((3, len(gam.FEATURES)))) == pytest.approx(np.full(3, want), abs=1e-9)


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    scored = gam.op10_quality_gam(spark, DATA)
    told = scored.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in told])
    assert right > 0.95 and np.mean([r.predicted == 0 for r in told if r.quality == 0]) > 0.9
    assert all(0 <= r.score <= 1 for r in told)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    docs = docs_of(spark, [(1, "fine words"), (2, None), (None, ""), (4, "x " * 100_000), (1, "fine words")])
    model = gam.learn(docs, labels)
    scores = gam.with_score(docs, model, score_col="probability").collect()
    assert len(scores) == 5 and all(0 <= r.probability <= 1 for r in scores)
    assert gam.with_score(docs_of(spark, []), model, score_col="probability").count() == 0
    assert spark.range(9).select(gam.held_out("id").alias("x")).filter(F.col("x")).count() < 9
