"""Quality rules: an isolation forest on the statistics that rules look at.

Each text gives counts (words, symbols, repeated lines, repeated windows of words) and shares of them. A tree of the forest splits a small subsample of
rows by a random statistic at a random place, again and again; a row that ends after few splits is unlike the others. The mean length of a
row's paths, scaled by what a random tree of that size would need, is its anomaly score (near 1: alone, below 0.5: ordinary). The score from which a
document is turned down is calibrated: of all places between the scores of labelled rows it is the one that judges fewest of them wrongly, the higher one
if several do. Rows whose id has the check-sum remainder 1 by 3 take part in neither, so they can show how well it works.

The threshold is calibrated on every labelled row that isn't held out: scores are steps of 1 / STEPS, so Spark counts the rows of each step and the driver gets STEPS + 1 counts at most. A tree is by its
nature grown from few rows; the rows of all trees are dealt from the TREES * SUBSAMPLE ones of those labelled rows with the smallest hashes of their ids. The labels themselves only set the threshold.
Without labels of both kinds nothing is turned down by score. The rules of the base (fewer than 20 words; over 30 % of words in repeated windows) always hold.

Statistics are exact: words, lines and windows of a batch are numbered, not hashed, by numpy and Arrow over its bytes. Null text is empty text: all counts are zero and the
base fails. Repeated rows are judged alike; other columns are ignored; an empty table gives no rows. Batches hold 1,000 rows and 16 MB, or one longer text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import bounded_batches, release, text_of, written
from rookery.llm.gam import held_out

TREES, SUBSAMPLE, SEED = 128, 256, 7
#: Scores are rounded to steps of one by this.
STEPS = 1 << 16
#: The base rules: words at least, and percent of words in repeated windows at most.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbols", "repeated_lines", "repeated_words", "capitals", "digits", "calls", "bare_words", "open_lines")

_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_SYMBOL = np.isin(_BYTES, np.frombuffer(b"#*$%&|<>", np.uint8))
_CAPITAL = (_BYTES >= 65) & (_BYTES <= 90)
_NUMERAL = (_BYTES >= 48) & (_BYTES <= 57)
_CALL = _BYTES == ord("!")
_CLOSED = np.isin(_BYTES, np.frombuffer(b".?", np.uint8))
_LETTERLIKE = _CAPITAL | _NUMERAL | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_STARTS_CHAR = (_BYTES & 0xC0) != 0x80


def _numbered(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each piece of `data`, equal for equal pieces."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return pc.dictionary_encode(pieces).indices.to_numpy().astype(np.int64)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (b.max() + 1) + b, return_inverse=True)[1] if len(a) else a


def _repeated(words: np.ndarray, text_of_word: np.ndarray) -> np.ndarray:
    """Which words lie in a window of WINDOW = 8 words that its text holds twice or more."""
    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) >= WINDOW:
        two = _joined(words[:-1], words[1:])
        four = _joined(two[:-2], two[2:])
        eight = _joined(four[:-4], four[4:])
        at = np.flatnonzero(text_of_word[: -(WINDOW - 1)] == text_of_word[WINDOW - 1 :])
        if len(at):
            _, inverse, counts = np.unique(text_of_word[at] * (eight.max() + 1) + eight[at], return_inverse=True, return_counts=True)
            twice = at[counts[inverse] > 1]
            covered += np.bincount(twice, minlength=len(covered)) - np.bincount(twice + WINDOW, minlength=len(covered))
    return np.cumsum(covered)[:-1] > 0


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text its counts BASE, and its shares FEATURES."""
    n = len(texts)
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    space, edge = _SPACE[data], np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(~space & (np.concatenate([[True], space])[:-1] | edge[:-1]))
    end = np.flatnonzero(~space & (np.concatenate([space, [True]])[1:] | edge[1:])) + 1
    text_of_word = np.searchsorted(offsets, start, "right") - 1

    def running(mask):
        return np.concatenate([[0], np.cumsum(mask)])

    def by_text(mask):
        sums = running(mask)
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def by_text_of_word(mask):
        return np.bincount(text_of_word[mask], minlength=n)

    n_words = np.bincount(text_of_word, minlength=n)
    repeats = by_text_of_word(_repeated(_numbered(data[~space], end - start), text_of_word))
    # lines start a text or follow a line feed; those without words don't count
    line_from = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    line_from = line_from[line_from < len(data)]
    line_to = np.concatenate([line_from[1:], [len(data)]]) if len(line_from) else line_from
    line_to = line_to - (data[line_to - 1] == 10)
    after = np.searchsorted(start, line_to)
    full = np.searchsorted(start, line_from) < after
    line_from, line_to, after = line_from[full], line_to[full], after[full]
    text_of_line = np.searchsorted(offsets, line_from, "right") - 1
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, line_from, 1)
    np.add.at(inside, line_to, -1)
    lines = _numbered(data[np.cumsum(inside)[:-1] > 0], line_to - line_from)
    n_lines = np.bincount(text_of_line, minlength=n)
    distinct = np.unique(text_of_line * (lines.max() + 1) + lines) // (lines.max() + 1) if len(lines) else lines
    dup_lines = n_lines - np.bincount(distinct, minlength=n)
    letters = running(_LETTERLIKE[data])
    word_chars, symbols = by_text(_STARTS_CHAR[data] & ~space), by_text(_SYMBOL[data])
    base = np.column_stack([n_words, word_chars, symbols, dup_lines, repeats]).astype(np.int64).reshape(n, len(BASE))
    words, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    open_lines = np.bincount(text_of_line[~_CLOSED[data[end[after - 1] - 1]]], minlength=n) if len(line_from) else n_lines
    shares = [
        word_chars / words, symbols / words, dup_lines / np.maximum(n_lines, 1), repeats / words, by_text(_CAPITAL[data]) / chars, by_text(_NUMERAL[data]) / chars,
        by_text(_CALL[data]) / words, by_text_of_word(letters[end] == letters[start]) / words, open_lines / np.maximum(n_lines, 1),
    ]
    return base, np.column_stack(shares).reshape(n, len(FEATURES))


def _mean_path(n: np.ndarray | int) -> np.ndarray:
    """Mean length of a path that finds nothing in a random search tree of n rows."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees in heap order: node i has the children 2i + 1 and 2i + 2; a leaf has feature -1 and the length of its path in `cut`."""

    feature: np.ndarray
    cut: np.ndarray
    depth: int
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path) for each row; 0.5 for a forest without trees."""
        if not len(self.feature):
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut in zip(self.feature, self.cut):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (x[rows, f] >= cut[node]), node)
            total += cut[node]
        return 2.0 ** -(total / len(self.feature) / self.scale)


def fit_forest(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> Forest:
    """Isolation trees, each on a random subsample of the rows and to the depth that would part them evenly."""
    size = min(subsample, len(x))
    if size < 2:
        return Forest(np.zeros((0, 1), np.int64), np.zeros((0, 1)), 0, 1.0)
    rng, depth = np.random.default_rng(seed), int(np.ceil(np.log2(size)))
    feature, cut = np.full((trees, 2 ** (depth + 1) - 1), -1), np.zeros((trees, 2 ** (depth + 1) - 1))
    for t in range(trees):
        open_ = [(0, x[rng.choice(len(x), size, replace=False)], 0)]
        while open_:
            node, rows, level = open_.pop()
            low, high = rows.min(0), rows.max(0)
            apart = np.flatnonzero(high > low)
            if level == depth or not len(apart):
                cut[t, node] = level + _mean_path(len(rows))
                continue
            f = rng.choice(apart)
            at = high[f] - (high[f] - low[f]) * rng.random()  # above the lowest, so either side has rows
            feature[t, node], cut[t, node] = f, at
            right = rows[:, f] >= at
            open_ += [(2 * node + 1, rows[~right], level + 1), (2 * node + 2, rows[right], level + 1)]
    return Forest(feature, cut, depth, float(_mean_path(size)))


@dataclass
class Model:
    forest: Forest
    threshold: float


def calibrated(scores: np.ndarray, good: np.ndarray) -> float:
    """The score from which rows are turned down: the one with fewest labelled rows on its wrong side, the highest of several."""
    found, at = np.unique(scores, return_inverse=True)
    return threshold(found, np.bincount(at[good], minlength=len(found)), np.bincount(at[~good], minlength=len(found)))


def threshold(scores: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The same from rising distinct scores and how many good and bad rows have each."""
    if not good.any() or not bad.any():
        return float("inf")
    # turned down from score i on: good rows from there and bad rows before are wrong
    wrong = np.concatenate([np.cumsum(good[::-1])[::-1], [0]]) + np.concatenate([[0], np.cumsum(bad)])
    best = len(wrong) - 1 - int(np.argmin(wrong[::-1]))
    if best == len(scores):
        return float("inf")
    return float(scores[best] if best == 0 else (scores[best - 1] + scores[best]) / 2)


def stepped(scores: np.ndarray) -> np.ndarray:
    return np.round(scores * STEPS) / STEPS


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document its id, the counts BASE and the shares FEATURES."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        release()
        for batch in batches:
            base, shares = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in (*base.T, *shares.T))], names=[id_col, *BASE, *FEATURES])

    schema = ", ".join([f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}", *(f"{c} long" for c in BASE), *(f"{c} double" for c in FEATURES)])
    return docs.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(run, schema)


def _features(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy() for c in FEATURES]).reshape(batch.num_rows, len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_for_trees: int = TREES * SUBSAMPLE) -> Model:
    """A forest of trees that are grown from `most_for_trees` labelled rows that aren't held out, and the threshold that fits all of them."""
    return learnt(written(measured(docs, id_col, text_col), "measured"), labels, id_col, label_col, most_for_trees)


def learnt(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most_for_trees: int = TREES * SUBSAMPLE) -> Model:
    """The model of `measured` rows, which are read twice. No text moves to meet its label."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & ~F.coalesce(held_out("_id"), F.lit(True)))
    told = known.groupBy("_id").agg(F.count_if(F.col("_y") == 1).alias("_good"), F.count_if(F.col("_y") == 0).alias("_bad"))
    met = rows.select(F.col(id_col).alias("_id"), *FEATURES).join(told, "_id").select(F.xxhash64("_id").alias("_h"), "_good", "_bad", *FEATURES)
    chosen = met.orderBy("_h", *FEATURES, "_good", "_bad").limit(most_for_trees).toArrow()
    x, good = _features(chosen), chosen.column("_good").to_numpy() > 0
    forest = fit_forest(x[np.lexsort((*x.T, good))])  # the order in which tasks end doesn't show in the subsamples
    carried = rows.sparkSession.sparkContext.broadcast(forest)

    def score(batches):
        release()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(stepped(carried.value.score(_features(batch)))), batch.column("_good"), batch.column("_bad")], names=["score", "good", "bad"])

    scored = met.drop("_h").mapInArrow(score, "score double, good long, bad long")
    counts = scored.groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("score").toArrow()  # STEPS + 1 rows at most
    return Model(forest, threshold(*(counts.column(c).to_numpy() for c in ("score", "good", "bad"))))


def judged(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document its id, the counts BASE, the shares FEATURES, anomaly (score), base_failed and kept."""
    return judged_rows(measured(docs, id_col, text_col), model)


def judged_rows(rows: DataFrame, model: Model) -> DataFrame:
    """`measured` rows with anomaly, base_failed and kept."""
    carried = rows.sparkSession.sparkContext.broadcast(model)  # trees of fixed size

    def run(batches):
        release()
        for batch in batches:
            scores = stepped(carried.value.forest.score(_features(batch)))
            words, repeats = (batch.column(c).to_numpy() for c in ("n_words", "n_repeat_words"))
            failed = (words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * words)
            columns = [*batch.columns, pa.array(scores), pa.array(failed), pa.array(~failed & (scores < carried.value.threshold))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "anomaly", "base_failed", "kept"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "anomaly double", "base_failed boolean", "kept boolean"])
    return rows.mapInArrow(run, schema)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = written(measured(docs), "measured")  # fifteen numbers a document, so that texts are read once
    return judged_rows(rows, learnt(rows, labels)).select("doc_id", *BASE, "base_failed", "kept", "anomaly")


QUERIES = {"op13_quality_rules": op13_quality_rules}
ORACLES: dict[str, str] = {}
