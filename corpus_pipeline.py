"""The corpus pipeline: documents pass through five operators, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rookery.llm import bpe, exact_dedup, gam, jaccard_join, mixing
from rookery.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality model scores below one half; what it scores at or above stays as it is."""
    model = gam.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return gam.with_score(docs.select(*COLUMNS), model, score_col="_score").filter(~gam.rejected("_score")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the document with the smallest id."""
    return exact_dedup.drop_exact_copies(docs.select(*COLUMNS)).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near-duplicates the document with the smallest id."""
    return jaccard_join.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each run of words that it takes from a document in one pass, so a document may come up to twice, or in part."""
    return mixing.mixed_texts(docs.select(*COLUMNS)).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes each row of the mix."""
    return bpe.round_trip(docs, *bpe.production_vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]
#: The quality model, the draws and the merges are nothing that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i}")
    return docs
