import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rookery.llm import rules
from tests.llm.helpers import docs_of

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abé \n\t*# 😀\x1c"), max_size=120), max_size=5))
def test_statistics_against_plain_counts(texts):
    base, shares = rules.statistics(pa.array(texts, pa.string()))
    assert [tuple(r) for r in base.tolist()] == [plain(t) for t in texts] and np.isfinite(shares).all()


def test_windows_stay_within_their_text():
    run = " ".join(f"w{i}" for i in range(8))
    base, _ = rules.statistics(pa.array([run, run, f"{run} {run}", f"{run} x {run} w0", ""]))
    assert base[:, 4].tolist() == [0, 0, 16, 16, 0]


def test_a_row_far_from_the_others_has_a_short_path():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(500, 3)), [[9, 9, 9]]])
    forest = rules.fit_forest(x)
    scores = forest.score(x)
    assert scores[-1] == scores.max() > 0.7 and np.median(scores) < 0.5
    # the length of each path, followed row by row
    lengths = []
    for feature, cut in zip(forest.feature, forest.cut):
        node = 0
        while feature[node] >= 0:
            node = 2 * node + 1 + (x[7, feature[node]] >= cut[node])
        lengths.append(cut[node])
    assert scores[7] == pytest.approx(2 ** -(np.mean(lengths) / rules._mean_path(256)))
    assert rules.fit_forest(x[:1]).score(x).tolist() == [0.5] * len(x)


def test_threshold_has_fewest_wrong_rows():
    rng = np.random.default_rng(2)
    for _ in range(50):
        scores, good = rng.integers(0, 9, 30) / 10, rng.random(30) < 0.7
        at = rules.calibrated(scores, good)
        wrong = lambda t: int(((scores >= t) == good).sum())
        assert wrong(at) == min(wrong(t) for t in [*np.arange(-0.05, 1, 0.1), np.inf])
    assert rules.calibrated(np.array([0.3, 0.9]), np.array([True, True])) == np.inf == rules.calibrated(np.zeros(0), np.zeros(0, bool))


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    texts = ["fine words " * 3, None, "", "x " * 100_000, "fine words " * 3, " ".join(f"word{i}" for i in range(19)), " ".join(f"word{i}" for i in range(20))]
    docs = docs_of(spark, list(zip([1, 2, None, 4, 1, 6, 7], texts)))
    rows = rules.judged(docs, rules.learn(docs, labels)).collect()
    assert sorted(tuple(r[c] for c in rules.BASE) for r in rows) == sorted(map(plain, texts))
    assert {r.doc_id: (r.base_failed, r.kept) for r in rows} == {1: (True, False), 2: (True, False), None: (True, False), 4: (True, False), 6: (True, False), 7: (False, True)}
    assert rules.judged(docs_of(spark, []), rules.learn(docs, labels.limit(0))).count() == 0


def test_threshold_is_counted_over_all_labelled_rows(spark):
    rng = np.random.default_rng(3)
    # the last tenth is unlike the rest, by more or less
    texts = [" ".join("".join(rng.choice(list("abcde"), rng.integers(2, 7))) + "!#9"[: rng.integers(0, 4)] * (i > 540 and rng.random() < i / 600) for _ in range(40)) for i in range(600)]
    docs = docs_of(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, int(i <= 540)) for i in range(600)] + [(5, 0)], "doc_id long, quality int")
    model = rules.learn(docs, labels, most_for_trees=64)
    told = labels.filter(~rules.held_out()).collect()
    scores = {r.doc_id: r.anomaly for r in rules.judged(docs, model).collect()}
    assert len(told) > 300 and model.threshold == rules.calibrated(np.array([scores[t.doc_id] for t in told]), np.array([t.quality == 1 for t in told])) != np.inf
    assert {r.kept for r in rules.judged(docs, model).collect() if r.anomaly >= model.threshold} == {False}


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the driver's tables")
def test_query_against_plain_counts_and_held_out_labels(spark):
    found = {r.doc_id: r for r in rules.op13_quality_rules(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        r, counts = found[d.doc_id], plain(d.text)
        assert tuple(r[c] for c in rules.BASE) == counts
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0]) and not (r.kept and r.base_failed)
    told = spark.read.parquet(f"{DATA}/labels.parquet").filter(rules.held_out()).collect()
    kept = {q: np.mean([found[t.doc_id].kept for t in told if t.quality == q and not found[t.doc_id].base_failed]) for q in (0, 1)}
    assert kept[1] > 0.97 and kept[0] < 0.2
