import hashlib
import random
import re

from rookery.llm import pii

SCHEMA = "doc_id long, text string, kind string, start long, _row long"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum((2 * int(d) - 9 * (int(d) > 4)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    """The base spans by the contract's plain patterns."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    checks = [
        ("email", EMAIL, lambda m: True),
        ("ip", IP, lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", CARD, lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), i, m.end(), kind) for i, (kind, p, ok) in enumerate(checks) for m in p.finditer(text or "") if ok(m)]
    return sorted(found)


def run(spark, rows, monkeypatch=None):
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.catalog.dropTempView("documents")

    class Reader:
        read = type("R", (), {"parquet": staticmethod(lambda path: docs)})

    return {(r.doc_id, r.base_sha256): r for r in pii.op2_pii(Reader, "").collect()}


def check(spark, texts):
    got = run(spark, [(i, t, "x", 5, 7) for i, t in enumerate(texts)])
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = brute(text)
        sha = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in want).encode()).hexdigest()
        assert (i, sha) in got, (text[:200], want)
        row = got[i, sha]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == x for *_, x in want) for k in pii.BASE]
        assert {f"{k}:{s}:{e}" for s, _, e, k in want} <= set(row.spans.split(",")) | {""}


def test_base_spans_match_brute_force(spark):
    rng = random.Random(5)
    pieces = ["a@b.c", "a@b", ".c@d.e", "@", "+1 (509) 555-6973", "+12", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "1", "22", "-", " ", ".", "é", "😀", "x", "_y@z.q-1.w", "+", "(", ")", "00000000000000", "255.255.255.255.1"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    check(spark, [*texts, None, "", "a@b.c_x@y.z", "1.2.3.4.5.6.7.8", "+1--2--3--4--5--6--7--8--9"])


def test_long_runs_take_linear_time(spark):
    """The plain patterns would take quadratic time here, so the counts are known ones."""
    texts = ["1" * 100_000, "a" * 100_000, "1.1" * 30_000, "a@b.c " * 3_000, "+1" * 30_000, "a@" * 30_000]
    got = {doc_id: r for (doc_id, _), r in run(spark, [(i, t, "x", 5, 7) for i, t in enumerate(texts)]).items()}
    assert [got[i].n_email for i in range(6)] == [0, 0, 0, 3_000, 0, 0]
    assert [got[i].n_card for i in range(6)] == [0] * 6


def test_empty_table_and_repeated_rows(spark):
    assert run(spark, []) == {}
    docs = spark.createDataFrame([(1, "a@b.c", "x", 0, 0)] * 3, SCHEMA)
    assert pii.find_pii(docs).filter("kind = 'email'").count() == 3


def test_further_kinds_need_support(spark):
    docs = spark.createDataFrame([(1, "Please call (509) 555-6973 or write to jane at corp dot com. Dr. Maria Lopez, ssn 123-45-6789.", "", 0, 0), (2, "An 12 words 34 of nothing", "", 0, 0)], SCHEMA)
    found = pii.find_pii(docs).filter("kind IS NOT NULL").collect()
    assert all(r.id == 1 for r in found)
    assert {"local_phone", "ssn"} & {r.kind for r in found}
