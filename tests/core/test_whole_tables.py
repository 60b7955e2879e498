"""Registered queries read whole tables: held against plain Python over small ones."""

import datetime
import random
import re
import unicodedata
from collections import defaultdict

import pytest

from rookery.plans import all_queries

DAY = lambda n: datetime.datetime(2024, 1, n)


@pytest.fixture(scope="module")
def events():
    """(event_id, ts, user_id, event_type, value) rows: users and ids of every remainder, some users early or late only."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        user = rng.randrange(60)
        days = (1, 8) if user < 10 else (21, 30) if user < 20 else (1, 30)
        rows.append((i, DAY(rng.randint(*days)) + datetime.timedelta(minutes=i), user, "error" if user % 9 == 1 else rng.choice(["purchase", "view", "click", "error"]), 5.5 if user % 9 == 1 else float(rng.randrange(500))))
    rows.append((600, DAY(31), 61, "error", 499.5))
    return rows


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, events):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")
    lines = [(1, 17), (2, 17), (2, 35), (3, 35), (4, 4), (5, 5), *((s, 90) for s in range(5, 15)), (5, 5)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").write.parquet(f"{path}/lineitem.parquet")
    return path


def by_user(events):
    found = defaultdict(list)
    for e in events:
        found[e[2]].append(e)
    return found


def rows(spark, sf_dir, name):
    return sorted(map(tuple, all_queries()[name](spark, sf_dir).collect()))


def test_company_identity(spark, sf_dir):
    """Parts 17 and 35 join suppliers 1, 2 and 3; ten suppliers of part 90 join nothing."""
    key = lambda n: f"{n:09d}"
    got = {r[0]: r[1:] for r in rows(spark, sf_dir, "company_identity")}
    assert set(got) == {key(n) for n in range(1, 15)}
    assert {n: got[key(n)] for n in (1, 2, 3)} == {n: (key(2), 3) for n in (1, 2, 3)}
    assert all(got[key(n)] == (key(n), 1) for n in range(4, 15))


def test_lane_health(spark, sf_dir, events):
    lanes = defaultdict(lambda: [0, 0, 0, False])
    for _, ts, _, kind, value in events:
        lane = lanes[ts.date()]
        for i, k in enumerate(("purchase", "click", "error")):
            lane[i] += kind == k
        lane[3] |= value > 499
    outcome = lambda c, i, f, a: "failed" if not c and not i and (f or a) else "partial" if i or f or a else "ok"
    assert rows(spark, sf_dir, "lane_health") == sorted((d, *v, outcome(*v)) for d, v in lanes.items())


def test_rate_limits(spark, sf_dir, events):
    want = sorted((u, len(es) >= 2 and all(e[3] == "error" and e[4] * 1000 < 15000 for e in es)) for u, es in by_user(events).items())
    assert rows(spark, sf_dir, "rate_limits") == want and any(limited for _, limited in want)


def test_ledger_upsert(spark, sf_dir, events):
    want = []
    for u, es in by_user(events).items():
        old, new = [e for e in es if e[1] < DAY(10)], [e for e in es if e[1] >= DAY(10)]
        last, o = (max(new) if new else None), [e[1] for e in old]
        title = last[3] if last else max(old)[3]
        seen = [t for t in (max(o, default=None), last and last[1]) if t]
        want.append((u, title, min(o) if o else last[1], min(e[1] for e in es), max(seen), "new" if not old else "updated" if new else "kept"))
    assert rows(spark, sf_dir, "ledger_upsert") == sorted(want) and {w[5] for w in want} == {"new", "updated", "kept"}


def test_shown_merge(spark, sf_dir, events):
    want = []
    for u, es in by_user(events).items():
        b, n = (max((e for e in es if (e[1] < DAY(15)) == early), default=None) for early in (True, False))
        sold = lambda e: e is not None and e[3] == "purchase"
        want.append((u, int((b if sold(b) and not sold(n) else n or b)[4]), sold(b) or sold(n)))
    assert rows(spark, sf_dir, "shown_merge") == sorted(want)


def test_preference_changes(spark, sf_dir, events):
    want = []
    for u, es in by_user(events).items():
        first = {e[3] for e in es if e[1] < DAY(10)}
        add, remove = {e[3] for e in es if DAY(10) <= e[1] < DAY(20)}, {e[3] for e in es if e[1] >= DAY(20)}
        want.append((u, ",".join(sorted((first | add) - remove)), ",".join(sorted(remove - first))))
    assert rows(spark, sf_dir, "preference_changes") == sorted(want)


GENERIC = "inc llc ltd limited corp corporation co gmbh bv nv sa ag plc holdings group labs technologies technology".split()


def test_name_keys(spark, tmp_path):
    """Generic words fold away wherever they stand, and texts are keyed to their end."""
    texts = ["Acmé, Inc.", "Plain name", "the Group of Labs (old) & C++ .NET", "word " * 40 + "Öwn GmbH tail", "inc", "", None, "Income co-op (sa)"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def keys(text):
        low = (text or "").lower()
        plain = "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c)).replace("&", " and ")
        company = " ".join(w for w in re.findall("[a-z0-9]+", plain) if w not in GENERIC)
        return company, " ".join(re.findall("[a-z0-9+#.]+", re.sub(r"\([^)]*\)", " ", low)))

    assert rows(spark, str(tmp_path), "name_keys") == [(i, *keys(t)) for i, t in enumerate(texts)]
