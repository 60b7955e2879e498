import random
import re

import pytest

from rookery.llm import mixing
from tests.llm.helpers import docs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(seed=1, n=120):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abcdefg") * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 30, 200, 700]))), rng.choice(["hot"] * 4 + ["b", "é", "z"])) for i in range(n)]
    return [*rows, (500, None, "b"), (501, "", None), (502, "w " * 3_000, None), (503, "\t x \n", "tiny"), (None, "no id here", "hot"), (7, "again and again", "hot")]


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """The contract's rule, step by step."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_and_taken(spark):
    rows = rows_of()
    docs = docs_of(spark, rows)
    told, mix = mixing.mix_sources(docs, block_words=16, shard_slots=64)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = brute_targets(sizes)
    by_row = {r["_row"]: r for r in told.collect()}
    assert len(by_row) == len(rows)
    for r in by_row.values():
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
    taken, seen = {}, set()
    for m in mix.collect():
        assert 0 <= m.word_from < m.word_to <= by_row[m["_row"]]["_size"]
        for w in range(m.word_from, m.word_to):
            assert (m["_row"], w, m["pass"]) not in seen  # a word comes once in a pass
            seen.add((m["_row"], w, m["pass"]))
        assert m["pass"] in (0, 1)
        taken[m["_row"]] = taken.get(m["_row"], 0) + m.word_to - m.word_from
    for source, target in want.items():
        got = sum(n for row, n in taken.items() if by_row[row].source == source)
        assert abs(got - target) <= 0.5
    assert all(n <= 2 * by_row[row]["_size"] for row, n in taken.items())


def test_reruns_agree(spark):
    docs = docs_of(spark, rows_of(3, 40))
    key = lambda m: (m.shard, m.source_no, m.slot, m.block, m["_row"], m.word_from, m.word_to)
    first, second = (sorted(map(key, mixing.mix_sources(docs, block_words=8)[1].collect())) for _ in range(2))
    assert first == second and first


def test_splits_and_cores_do_not_show(spark, tmp_path):
    """The same rows in other files, splits and orders take the same words, repeated rows too."""
    rows = [*rows_of(3, 60), *([(9, "the same row again " * 9, "hot")] * 30), *([(None, "no id " * 7, None)] * 20)]
    seen = []
    for parts, order in ((1, 1), (7, -1), (3, 1)):
        docs_of(spark, rows[::order]).repartition(parts).write.parquet(f"{tmp_path}/{parts}")
        told, mix = mixing.mix_sources(spark.read.parquet(f"{tmp_path}/{parts}"), block_words=8, shard_slots=16)
        taken = mix.groupBy("_row").agg(mixing.F.sum(mixing.F.expr("word_to - word_from")).alias("taken"))
        seen.append(sorted(map(tuple, told.join(taken, "_row", "left").select("id", "source", "_size", "target", "taken").collect()), key=str))
    assert seen[0] == seen[1] == seen[2] and any(r[-1] for r in seen[0])


def test_small_sources_meet_their_targets(spark):
    rows = [(i, " ".join(["w"] * (40 + i)), f"s{i:02d}") for i in range(12)]
    told, mix = mixing.mix_sources(docs_of(spark, rows))
    taken = {r["id"]: r.taken for r in mix.groupBy("id").agg(mixing.F.sum(mixing.F.expr("word_to - word_from")).alias("taken")).collect()}
    assert all(abs(taken.get(r["id"], 0) - r.target) <= 0.5 for r in told.collect())


def test_permutation(spark):
    for n in (1, 2, 7, 100, 1_000):
        got = [r.p for r in spark.range(n).withColumn("n", mixing.F.lit(n).cast("long")).select(mixing.permuted("id", "n", "7, 3").alias("p")).collect()]
        assert sorted(got) == list(range(n))
        assert n < 100 or got != list(range(n))
        back = [r.p for r in spark.createDataFrame([(p, n) for p in got], "p long, n long").select(mixing.permuted("p", "n", "7, 3", back=True).alias("p")).collect()]
        assert back == list(range(n))


def test_texts_are_runs_of_their_documents(spark):
    rows = [r for r in rows_of(5, 60) if r[0] is not None and r[0] != 7]
    text = {i: t or "" for i, t, _ in rows}
    out = mixing.mixed_texts(docs_of(spark, rows), block_words=16).collect()
    assert out and all(r.text in text[r.doc_id] and r.n_chars == len(r.text) for r in out)
    words = sum(len(WORD.findall(r.text)) for r in out)
    assert abs(words - 1.5 * sum(len(WORD.findall(t)) for t in text.values())) < 120


@pytest.mark.parametrize("rows", [[], [(1, None), (2, " ")]])
def test_nothing_to_mix(spark, rows):
    told, mix = mixing.mix_sources(docs_of(spark, rows))
    assert told.count() == len(rows) and mix.count() == 0
    assert mixing.mixed_texts(docs_of(spark, rows)).count() == 0


def test_rows_of_one_id_give_their_own_runs(spark):
    """Rows with a null or repeated id are mixed as if each had an id of its own."""
    rows = [(None, " ".join(f"n{k}x{i}" for i in range(50 + k)), "hot") for k in range(8)] + [(7, " ".join(f"r{k}x{i}" for i in range(60 + k)), "b") for k in range(8)]
    out = mixing.mixed_texts(docs_of(spark, rows), block_words=16).collect()
    total = sum(len(WORD.findall(t)) for _, t, _ in rows)
    assert abs(sum(len(WORD.findall(r.text)) for r in out) - 1.5 * total) < 120
    taken = {}
    for r in out:
        assert any(i == r.doc_id and r.text in t and s == r.source for i, t, s in rows) and r.n_chars == len(r.text)
        for w in WORD.findall(r.text):
            taken[w] = taken.get(w, 0) + 1
    assert max(taken.values()) <= 2
