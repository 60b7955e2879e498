import random

import numpy as np

from rookery.llm import packing

SCHEMA = "doc_id long, ids binary, piece string, row string, group string"


def test_best_fit_decreasing_matches_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        length = rng.choice([1, 2, 7, 16, 100])
        lengths = [rng.randint(1, length) for _ in range(rng.randint(0, 80))]
        free, want = [], [None] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [f for f in free if f >= lengths[i]]
            if not fits:
                free.append(length)
                fits = [length]
            free.remove(min(fits))
            free.append(min(fits) - lengths[i])
            want[i] = length - min(fits)
        placed, rows = packing.best_fit_decreasing(lengths, length)
        assert rows == len(free) and [offset for _, offset in placed] == want
        used = {}
        for (row, offset), n in zip(placed, lengths):
            cells = used.setdefault(row, set())
            assert not cells & set(range(offset, offset + n)) and offset + n <= length
            cells |= set(range(offset, offset + n))


def test_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    docs = [(i, rng.integers(0, 60_000, n).astype("<u2").tobytes()) for i, n in enumerate([0, 1, 5, 16, 17, 40, 1_000, 3, 3, 16])]
    docs += [(None, np.arange(20, dtype="<u2").tobytes()), (77, None), (5, docs[5][1])]
    tokens = spark.createDataFrame([(i, x, "a", "b", "c") for i, x in docs], SCHEMA)
    packed = packing.pack(tokens, f"file://{tmp_path}/packed", 2, row_ids=16)
    for m in packed.collect():
        ids, at = np.frombuffer(m.ids, "<u2").reshape(-1, 16), np.frombuffer(m.positions, "<u2").reshape(-1, 16)
        assert len(ids) == len(at) == len(m.cumulative) <= packing.MATRIX_ROWS
        for row, ends in zip(at, m.cumulative):
            assert ends[0] == 0 and all(row[lo:hi].tolist() == list(range(hi - lo)) for lo, hi in zip(ends, ends[1:]))
    segments = packing.unpacked(packed, row_ids=16).collect()
    whole = {}
    for s in sorted(segments, key=lambda s: s.at):
        whole.setdefault(s.doc_key, {}).setdefault(s.at, []).append(bytes(s.ids))
    for i, x in docs:
        if x:
            key = None if i is None else str(i)
            assert b"".join(part[0] for _, part in sorted(whole[key].items())) == x
    assert len(whole["5"][0]) == 2  # a repeated row is packed again
    assert "0" not in whole and "77" not in whole


def test_empty_table(spark, tmp_path):
    assert packing.pack(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none", 3).count() == 0
