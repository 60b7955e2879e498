import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.helpers import docs_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_after_another(spark, tmp_path):
    """Every stage's result is held against what went in."""
    words = lambda seed, n: " ".join(f"w{(seed * 7919 + i * i) % 9973}" for i in range(n))
    good = [(i, words(i, 80 + i) + ".") for i in range(40)]
    junk = [(100 + i, " ".join(w.upper() + "!!" for w in words(i, 60).split())) for i in range(20)]
    copies = [(200, good[3][1]), (201, good[3][1].replace(" ", "\n"))]
    near = [(300, good[5][1].replace("w", "W") + " tail")]
    docs = docs_of(spark, [*good, *junk, *copies, *near, (400, None), (401, "")])
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    by = [f for _, f in corpus_pipeline.STAGES]

    def stage(i, df):
        by[i](spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        return spark.read.parquet(f"{tmp_path}/{i}")

    kept = stage(0, docs)
    assert kept.columns == COLUMNS
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i, _ in good} <= ids and not ids & {i for i, _ in junk}
    single = stage(1, kept)
    assert single.columns == COLUMNS and {r.doc_id for r in single.collect()} == ids - {200, 201} - ({401} if {400, 401} <= ids else set())
    apart = stage(2, single)
    assert apart.columns == COLUMNS and {r.doc_id for r in apart.collect()} == {r.doc_id for r in single.collect()} - {300}
    mixed = stage(3, apart)
    assert mixed.columns == COLUMNS
    count = lambda df: df.select(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))))).first()[0]
    assert count(mixed) == pytest.approx(1.5 * count(apart), rel=0.1)
    encoded = stage(4, mixed)
    assert encoded.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and encoded.count() == mixed.count()
    want = mixed.select("doc_id", F.sha2("text", 256).alias("decoded_sha256"))
    assert encoded.select("doc_id", "decoded_sha256").exceptAll(want).isEmpty()


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted({int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))}) == list(range(1, 14))
