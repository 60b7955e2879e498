"""Exact top-k search by integer inner product: a KD-tree for each shard of the vectors.

Each component x becomes floor(256 * x). Vectors are dealt to shards by the hash of their id, and a shard's task builds a tree: the
component of the widest spread is split at its median, and each node keeps the tight box around its vectors. A query goes through a tree best-first: the largest inner
product that any point of a box can have bounds what is below it, nodes wait in a heap by that bound, and the search ends when no box can
beat the kth score known. That score is propagated: every query first searches the shard of its own, and
carries its kth score there to all others.

Queries meet shards in blocks: a task has one shard and one block of queries, both of bounded size, and the k best of each shard and query are merged by rank.

Ties go to the smaller id. A query never meets its own id, nor rows that repeat it. Vectors that are null, or hold null or non-finite components, take no part; nor do
null ids. Vectors of another length than the query's score over the components that both have. Scores beyond 64 bits stop at the
limits of long before they are ranked. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.llm.common import written

#: Vectors of a shard and queries of a block, about; vectors of a leaf.
SHARD_ROWS, BLOCK_QUERIES, LEAF = 4_096, 2_048, 256
SCALE, K, EVERY = 256, 5, 50
#: Products of numbers up to this size add up exactly in a double.
EXACT = 1 << 22
LONG = (-(1 << 63), (1 << 63) - 1)


class Tree:
    """A KD-tree over the rows of `points`, whose ids are `ids`."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.points, self.ids = points, ids
        self.low, self.high, self.kids, self.rows, self.least_id = [], [], [], [], []
        self._grow(np.arange(len(points)), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        at, here = len(self.kids), self.points[rows]
        low, high = here.min(0), here.max(0)
        self.low.append(low), self.high.append(high), self.kids.append(None), self.rows.append(rows), self.least_id.append(self.ids[rows].min())
        spread = high - low
        if len(rows) > leaf and spread.max() > 0:
            order = np.argsort(here[:, spread.argmax()], kind="stable")
            half = len(rows) // 2
            self.rows[at] = None
            self.kids[at] = self._grow(rows[order[:half]], leaf), self._grow(rows[order[half:]], leaf)
        return at

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node the largest inner product that a point of the node's box can have."""
        zero = queries.dtype.type(0) if queries.dtype != object else 0
        return np.maximum(queries, zero) @ self.high.T + np.minimum(queries, zero) @ self.low.T

    def search(self, query: np.ndarray, query_id: int, bounds: np.ndarray, k: int, floor=None) -> list[tuple]:
        """The k best (score, -id), best last in the heap's order; `floor` is a kth (score, -id) known from elsewhere, which what is found must reach."""
        best: list[tuple] = []
        open_ = [(-bounds[0], 0)]
        while open_:
            bound, node = heapq.heappop(open_)
            kth = best[0] if len(best) == k else floor
            if kth is not None and floor is not None:
                kth = max(kth, floor)
            if kth is not None and -bound < kth[0]:
                break
            if kth is not None and -bound == kth[0] and -self.least_id[node] < kth[1]:
                continue
            if self.kids[node]:
                for kid in self.kids[node]:
                    if kth is None or bounds[kid] >= kth[0]:
                        heapq.heappush(open_, (-bounds[kid], kid))
                continue
            rows = self.rows[node]
            scores, ids = self.points[rows] @ query, self.ids[rows]
            if scores.dtype == object:
                scores = np.clip(scores, *LONG)
            take = ids != query_id
            if kth is not None:
                take &= scores >= kth[0]
            scores, ids = scores[take], ids[take]
            if len(scores) > k:
                order = np.lexsort((ids, -scores))[:k] if scores.dtype != object else sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
                scores, ids = scores[order], ids[order]
            for pair in zip(scores.tolist(), (-ids).tolist()):
                if len(best) < k:
                    heapq.heappush(best, pair)
                elif pair > best[0]:
                    heapq.heapreplace(best, pair)
        return best


def _whole(vectors: list) -> np.ndarray:
    """floor(256 * x) as numbers that multiply and add exactly: doubles if they are small, else Python integers."""
    width = max(map(len, vectors), default=0)
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    x = np.floor(x * SCALE)
    if x.size and np.abs(x).max() > EXACT:
        x = np.array([[int(y) if np.isfinite(y) else 0 for y in row] for row in x], dtype=object)
    return x


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _searched(k: int):
    def run(key, left, right):
        vectors, queries = left.to_pydict(), right.to_pydict()
        if not vectors["vec_id"] or not queries["query_id"]:
            return FOUND.empty_table()
        points, asked = _whole(vectors["v"]), _whole(queries["v"])
        width = max(points.shape[1], asked.shape[1])
        points, asked = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (points, asked))
        if points.dtype != asked.dtype:
            points, asked = (np.array([[int(x) for x in row] for row in a], dtype=object).reshape(a.shape) for a in (points, asked))
        tree = Tree(points, np.array(vectors["vec_id"], dtype=np.int64))
        bounds = tree.bounds(asked)
        out = {"query_id": [], "vec_id": [], "score": []}
        for q, query_id, score, id_, bound in zip(asked, queries["query_id"], queries["floor_score"], queries["floor_id"], bounds):
            for score, minus in tree.search(q, query_id, bound, k, None if score is None else (score, -id_)):
                out["query_id"].append(query_id)
                out["vec_id"].append(-minus)
                out["score"].append(int(score))
        return pa.Table.from_pydict(out, schema=FOUND)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of `queries` its k best rows of `vectors`, fewer if there are fewer."""

    def usable(df):
        plain = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return plain.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)

    points, asked = usable(vectors), usable(queries).dropDuplicates(["vec_id"])
    shards = max(1, -(-points.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_queries))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    asked = asked.withColumn("home", home).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)))
    dealt = points.select("vec_id", "v", home.alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")).groupBy("shard", "block")
    no_floor = [F.lit(None).cast("long").alias("floor_score"), F.lit(None).cast("long").alias("floor_id")]
    schema = "query_id long, vec_id long, score long"
    q = F.col("vec_id").alias("query_id")
    at_home = dealt.cogroup(asked.select(q, "v", F.col("home").alias("shard"), "block", *no_floor).groupBy("shard", "block")).applyInArrow(_searched(k), schema)
    at_home = written(at_home, "home")
    if shards > 1:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        kth = at_home.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("floor_score"), F.col("vec_id").alias("floor_id"))
        away = asked.join(kth, F.col("vec_id") == F.col("_q"), "left").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).filter("shard <> home")
        rest = dealt.cogroup(away.select(q, "v", "shard", "block", "floor_score", "floor_id").groupBy("shard", "block")).applyInArrow(_searched(k), schema)
        at_home = at_home.unionByName(rest)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return at_home.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


QUERIES = {"op5_exact_top_k": op5_exact_top_k}
ORACLES = {
    "op5_exact_top_k": """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
}
