"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a table of scores, one for each bin of its values, and the strongest pairs
of features have tables over two coarser sets of bins. Tables are learnt by cyclic boosting: round after round every feature in turn adds a
shrunken shallow tree on its own bins, fitted to the residuals of the logistic loss; pairs follow, in the same way, on the
residuals that the single features leave. A text's score is the sum of the table entries of its bins, through the logistic function.

Features are counts over the whole text, made by one pass of numpy over the bytes of an Arrow batch and one over its words.
No label, id, source or language is among them. Null text is empty text and gets the score of an empty text.
The model is fitted on at most `max_labelled` labelled rows, chosen by the hash of their id; statistics of the corpus are
not needed. With no labels, or labels of one kind only, every text gets that kind's share (0.5 without any). Repeated rows get equal scores; repeated labels of
an id count each; null labels don't count. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import bounded_batches, release, text_of

#: Bounds and shape of the model.
MAX_LABELLED = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST_ROWS = 120, 60, 0.15, 3, 5

FEATURES = (
    "log_words", "word_length", "word_length_spread", "upper_share", "digit_share", "mark_share", "marked_words", "end_marks",
    "distinct_words", "most_common_word", "repeated_next_word", "repeated_pairs", "repeated_lines", "line_length", "space_share",
    "short_lines", "other_bytes", "capital_words", "pipe_words", "longest_word",
)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_HIGH = np.arange(256) >= 128
_MARK = ~(_SPACE | _DIGIT | _LETTER | _HIGH)
_PLAIN = np.isin(np.arange(256), np.frombuffer(b".,;:?'()-\"", np.uint8))
_ODD = _MARK & ~_PLAIN
_END = np.isin(np.arange(256), np.frombuffer(b".?", np.uint8))
_ODD_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _word_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key for each word: its bytes as a polynomial, evaluated through running sums."""
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), _ODD_MULTIPLIER)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    # scaled to one common end instead of divided by the power at the start
    return (sums[end] - sums[start]) * powers[len(data) - start]


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    return np.vstack([_features_of(np.frombuffer(x.as_buffer(), np.uint8)) for x in texts]) if len(texts) else np.zeros((0, len(FEATURES)))


def _share(part: float, whole: float) -> float:
    return float(part) / whole if whole else 0.0


def _features_of(data: np.ndarray) -> np.ndarray:
    n = len(data)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    words = len(start)
    if not words:
        return np.zeros(len(FEATURES))
    lengths = end - start
    odd = np.concatenate([[0], np.cumsum(_ODD[data])])
    keys = _word_keys(data, start, end)
    _, counts = np.unique(keys, return_counts=True)
    pairs = keys[:-1] * _ODD_MULTIPLIER + keys[1:]
    breaks = np.flatnonzero(data == 10)
    line_from, line_to = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [n]])
    full = line_to > line_from
    line_from, line_to = line_from[full], line_to[full]
    lines = len(line_from)
    line_keys = _word_keys(data, line_from, line_to)
    last = data[end - 1]
    return np.array([
        np.log1p(words), lengths.mean(), lengths.std(), _share(_UPPER[data].sum(), _LETTER[data].sum()), _share(_DIGIT[data].sum(), n), _share(odd[-1], n),
        _share((odd[end] > odd[start]).sum(), words), _share(_END[last].sum(), words), _share(len(counts), words), _share(counts.max(), words),
        _share((keys[1:] == keys[:-1]).sum(), words), 1 - _share(len(np.unique(pairs)), max(1, len(pairs))), 1 - _share(len(np.unique(line_keys)), lines),
        np.log1p(_share(n, lines)), _share(space.sum(), n), _share((line_to - line_from < 20).sum(), lines), _share(_HIGH[data].sum(), n),
        _share(_UPPER[data[start]].sum(), words), _share(((lengths == 1) & (odd[end] > odd[start])).sum(), words), np.log1p(lengths.max()),
    ])


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: np.ndarray | None = None
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Adds up the entries of every row's bins."""
        total = np.full(len(x), self.base)
        if self.tables is not None:
            for f, edges in enumerate(self.edges):
                total += self.tables[f][np.searchsorted(edges, x[:, f], side="right")]
            for a, b, table in self.pairs:
                total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _sums(bins: np.ndarray, size: int, gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.bincount(bins, gradient, size), np.bincount(bins, weight, size), np.bincount(bins, minlength=size)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int) -> np.ndarray:
    """The steps of a tree on ordered bins: the best cut is made again and again, until there are `leaves` pieces."""
    pieces = [(0, len(g))]

    def best(piece):
        lo, hi = piece
        gs, hs, ns = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1], np.cumsum(n[lo:hi])[:-1]
        g_all, h_all, n_all = g[lo:hi].sum(), h[lo:hi].sum(), n[lo:hi].sum()
        gain = gs**2 / (hs + 1) + (g_all - gs) ** 2 / (h_all - hs + 1) - g_all**2 / (h_all + 1)
        gain[(ns < LEAST_ROWS) | (n_all - ns < LEAST_ROWS)] = -1
        return (gain.max(), lo + int(gain.argmax()) + 1) if len(gain) else (-1, lo)

    while len(pieces) < leaves:
        gain, cut, i = max((*best(p), i) for i, p in enumerate(pieces))
        if gain <= 1e-9:
            break
        lo, hi = pieces[i]
        pieces[i : i + 1] = [(lo, cut), (cut, hi)]
    out = np.zeros(len(g))
    for lo, hi in pieces:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over two features' bins: one cut of the first, then one of the second on either side."""
    best, table = 0.0, np.zeros(g.shape)
    for cut in range(1, g.shape[0]):
        steps, gain = np.zeros(g.shape), 0.0
        for lo, hi in ((0, cut), (cut, g.shape[0])):
            gs, hs, ns = g[lo:hi].sum(0), h[lo:hi].sum(0), n[lo:hi].sum(0)
            step = _tree(gs, hs, ns, 2)
            steps[lo:hi] = step
            gain += (2 * step * gs - step**2 * (hs + 1)).sum()
        if gain > best:
            best, table = gain, steps
    return table, best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts the tables of single features in turn, picks the pairs that would help most, then boosts theirs."""
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else float(y[0])
        return Model(base=60 * (share - 0.5))
    rate = y.mean()
    model = Model(base=float(np.log(rate / (1 - rate))), edges=[_edges(c, BINS) for c in x.T], coarse=[_edges(c, PAIR_BINS) for c in x.T])
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T)]
    model.tables = np.zeros((x.shape[1], BINS))
    total = np.full(len(y), model.base)
    residual = lambda: (y - (p := 1 / (1 + np.exp(-total))), p * (1 - p))
    for _ in range(ROUNDS):
        for f in range(x.shape[1]):
            step = RATE * _tree(*_sums(bins[f], BINS, *residual()), LEAVES)
            model.tables[f] += step
            total += step[bins[f]]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.coarse, x.T)]
    shape = (PAIR_BINS, PAIR_BINS)

    def pair_step(a, b):
        return _pair_tree(*(v.reshape(shape) for v in _sums(coarse[a] * PAIR_BINS + coarse[b], PAIR_BINS**2, *residual())))

    every = [(a, b) for a in range(x.shape[1]) for b in range(a + 1, x.shape[1])]
    strongest = sorted(every, key=lambda p: -pair_step(*p)[1])[:PAIRS]
    tables = {p: np.zeros(shape) for p in strongest}
    for _ in range(PAIR_ROUNDS):
        for a, b in strongest:
            step = RATE * pair_step(a, b)[0]
            tables[a, b] += step
            total += step[coarse[a], coarse[b]]
    model.pairs = [(a, b, table) for (a, b), table in tables.items()]
    return model


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """Fits on labelled rows that are not held out: the `max_labelled` with the smallest hashes of their ids, if there are more.

    Ids that repeat, in `labels` or `docs`, count as rows of their own, so the bound is put on labels and again on the rows that they meet.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & ~F.coalesce(held_out("_id"), F.lit(True)))
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_labelled)
    bounded_batches(docs.sparkSession)

    def run(batches):
        release()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(features(batch.column(2).cast(pa.binary()))), pa.list_(pa.float64()))], names=["_h", "_y", "x"])

    # the chosen rows number `max_labelled` at most, so they may be broadcast
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select(F.xxhash64("_id").alias("_h"), "_y", "_text").mapInArrow(run, "_h long, _y int, x array<double>").orderBy("_h", "_y", "x").limit(max_labelled).toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.array(rows.column("x").to_pylist())
    y = rows.column("_y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the order in which tasks end doesn't show in the sums
    return fit(x[order], y[order])


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents with the probability of label 1."""
    bounded_batches(docs.sparkSession)
    carried = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of fixed size

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        release()
        return pd.Series(carried.value.score(features(pa.array(texts, pa.string()).cast(pa.binary()))))

    return docs.withColumn(score_col, scored(text_of(text_col)))


def rejected(score: str = "score"):
    return F.col(score) < 0.5


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = with_score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (~rejected()).cast("int").alias("predicted"))


QUERIES = {"op10_quality_gam": op10_quality_gam}
ORACLES: dict[str, str] = {}
