"""Embedding whitening: the largest principal components by contour integration (FEAST), and every vector's coordinates along them.

Each entry c becomes the whole number x = floor(1024 * c) + 100000. Spark sums up the vectors, then the products of their entries, each less the
nearest whole number to its mean. Both are sums of whole numbers, so the order of tasks doesn't show; what is left of the means, half a unit at most, is
taken off afterwards. The width x width covariance is all that the driver gets: it grows with the vectors' width and not with their number.

Intervals are placed by inertia: after a reduction to tridiagonal form the signs of the pivots of V - shift tell how many
eigenvalues lie above a shift, and halving shifts finds the gaps. For each interval a circle through its ends is integrated numerically: each
node solves a complex shifted system (z - V), the weighted sum projects a random block onto the eigenvectors inside the circle, and Rayleigh-Ritz takes them out of
the block. That repeats until the residuals are at rounding. In the end as many pairs must lie in the interval as its inertia counts say, so none is missed.

Vectors that are null, or hold null or non-finite entries, are dropped; rows that repeat count and return again; a null id stays. A vector shorter than the
longest counts as zero where it has no entry. x and deviation stop at the limits of long. Components without variance are not returned, so a single
vector, or a table of equal ones, gives no rows, and so does an empty table. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import bounded_batches, release

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Nodes of a contour (half of them are solved, the others are their conjugates) and the most rounds of projection.
NODES, ROUNDS = 16, 200
LONG = (1 << 63) - 1
_EPS = np.finfo(float).eps


# the eigenproblem, on a matrix as wide as a vector


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a tridiagonal matrix with the eigenvalues of `v`, by reflections."""
    a = v.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        if size:
            x /= size
            a[k + 1 :, :] -= 2 * np.outer(x, x @ a[k + 1 :, :])
            a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(diagonal: np.ndarray, side: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie above the shift: the positive pivots of the shifted matrix (Sylvester's law of inertia)."""
    above, pivot, least = 0, 1.0, _EPS * (np.abs(diagonal).max() + np.abs(side).max(initial=0) + 1e-300)
    for i, d in enumerate(diagonal):
        pivot = d - shift - (side[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < least:
            pivot = -least
        above += pivot > 0
    return above


def bracket(diagonal: np.ndarray, side: np.ndarray, k: int, low: float, high: float) -> float:
    """The k-th largest eigenvalue to a hundred-thousandth of itself, by halving."""
    least = len(diagonal) * _EPS * (high - low)
    while high - low > max(1e-5 * abs(high), least):
        middle = (low + high) / 2
        low, high = (middle, high) if count_above(diagonal, side, middle) >= k else (low, middle)
    return (low + high) / 2


def contour_pairs(v: np.ndarray, low: float, high: float, count: int, nodes: int = NODES, rounds: int = ROUNDS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenpairs of symmetric `v` between `low` and `high`."""
    width, middle, radius = len(v), (low + high) / 2, (high - low) / 2
    angles = np.pi * (2 * np.arange(nodes // 2) + 1) / nodes
    solves = [(2 / nodes * radius * np.exp(1j * t), np.linalg.inv((middle + radius * np.exp(1j * t)) * np.eye(width) - v)) for t in angles]
    norm = max(abs(low), abs(high))
    block = np.random.default_rng(seed).standard_normal((width, min(width, 2 * count + 8)))
    best, stalled = None, 0
    for _ in range(rounds):
        projected = sum((weight * (inverse @ block)).real for weight, inverse in solves)
        basis = np.linalg.qr(projected)[0]
        values, turn = np.linalg.eigh(basis.T @ v @ basis)
        block = basis @ turn
        inside = np.flatnonzero((values > low) & (values < high))
        if len(inside) == count:
            pairs = values[inside], block[:, inside]
            residual = np.linalg.norm(v @ pairs[1] - pairs[1] * pairs[0], axis=0).max()
            if best is None or residual < best[0] / 2:
                best, stalled = (residual, pairs), 0
            else:
                stalled += 1
            if residual < _EPS * norm or (stalled >= 3 and best[0] < 100 * width * _EPS * norm):
                break
    if best is None or best[0] > 1e-10 * norm:
        raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, but the projection did not settle on them")
    return best[1]


def components(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of `v`, falling, and their eigenvectors as columns; fewer if fewer have variance. The largest entry of each is positive."""
    width = len(v)
    none = np.zeros(0), np.zeros((width, 0))
    top = np.abs(v).sum(1).max(initial=0.0)
    if not top > 0:
        return none
    diagonal, side = tridiagonal(v)
    with_variance = count_above(diagonal, side, 10 * width * _EPS * top)
    k = min(k, with_variance)
    if not k:
        return none
    # the last interval ends in the widest gap at or after the k-th value, looked for further down where values are too close
    seen = min(with_variance, k + 8)
    while True:
        values = np.array([bracket(diagonal, side, i + 1, 0.0, top) for i in range(seen)])
        after = np.append(values[1:], max(0.0, bracket(diagonal, side, seen + 1, -top, top)) if seen < width else 0.0)
        gaps = (values - after) / values
        last = k - 1 + int(np.argmax(gaps[k - 1 : seen]))
        if gaps[last] > 1e-3 or seen == with_variance:
            break
        seen = min(with_variance, 2 * seen)
    # others end wherever values fall to a quarter, and begin no further above their first value than they reach below it
    ends = [i for i in range(last) if after[i] < values[i] / 4] + [last]
    found, first = [], 0
    for i in ends:
        low = (values[i] + after[i]) / 2
        high = values[first] + min(values[first] - low, (values[first - 1] - values[first]) / 2 if first else top)
        if count_above(diagonal, side, high) != first or count_above(diagonal, side, low) != i + 1:
            raise ArithmeticError("inertia counts disagree with the intervals")
        found.append(contour_pairs(v, low, high, i + 1 - first))
        first = i + 1
    values, vectors = np.concatenate([f[0] for f in found]), np.hstack([f[1] for f in found])
    order = np.argsort(-values, kind="stable")[:k]
    vectors = vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)
    return values[order], vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])


# the passes over the vectors


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): the vectors without null or non-finite entries, as doubles."""
    plain = vectors.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v"))
    return plain.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def whole_numbers(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """x of each entry as long, a row for each vector, and which entries there are; the others are those of a zero."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    there = np.arange(width) < lengths[:, None]
    c = np.zeros(there.shape)
    c[there] = lists.flatten().to_numpy(zero_copy_only=False)
    x = np.floor(np.clip(c * SCALE, -(2.0**62), 2.0**62))
    return x.astype(np.int64) + SHIFT, there


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and the sum of each entry's x."""

    def run(batches):
        release()
        for batch in batches:
            width = max(batch.column(0).value_lengths().to_pylist(), default=0)
            x, there = whole_numbers(batch.column(0), width)
            x[~there] = 0
            small = not x.size or int(np.abs(x).max()) < 1 << 40
            sums = x.sum(0).tolist() if small else x.astype(object).sum(0).tolist()
            at = [-1, *range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([len(x), *there.sum(0).tolist()], pa.int64()), pa.array([0, *sums], pa.decimal128(38, 0))], names=["at", "rows", "total"])

    parts = vectors.select("v").mapInArrow(run, "at int, rows long, total decimal(38,0)").groupBy("at").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))
    found = {r["at"]: r for r in parts.collect()}  # a row for each entry of a vector
    n = found.pop(-1)["rows"] if found else 0
    return n, [int(found[i]["total"]) + SHIFT * (n - found[i]["rows"]) for i in range(len(found))]


def _products(vectors: DataFrame, rows_of, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows that `rows_of` makes of a batch, and of the products of their entries: added up in a task, then by Spark."""

    def run(batches):
        release()
        sums = np.zeros((width + 1, width))
        for batch in batches:
            x = rows_of(batch)
            sums[0] += x.sum(0)
            sums[1:] += x.T @ x
        at = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(sums[at]), pa.list_(pa.float64()))], names=["i", "row"])

    parts = vectors.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros((width + 1, width))
    out[parts.column("i").to_numpy(), parts.column("j").to_numpy()] = parts.column("x").to_numpy()
    return out[0], out[1:]


def _centred(n: int, totals: list[int], widest: int):
    """A function from a batch's whole numbers to n * x - S, exact: longs where they hold it, else Python's integers."""
    s = np.array(totals, dtype=object)

    def run(x: np.ndarray) -> np.ndarray:
        most = max(int(np.abs(x).max(initial=0)), widest)
        if n * most < LONG // 2:
            return n * x - s.astype(np.int64)
        return n * x.astype(object) - s

    return run


def _square_sums(y: np.ndarray) -> list[int]:
    most = int(np.abs(y).max()) if y.size else 0
    if most * most * max(1, y.shape[1]) < LONG:
        return (y.astype(np.int64) ** 2).sum(1).tolist()
    return [min(LONG, sum(int(e) * int(e) for e in row)) for row in y]


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """For each usable vector and each component its id, component, n, deviation, whitened, explained and identity_error."""
    bounded_batches(vectors.sparkSession)
    kept = usable(vectors, id_col, vector_col)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, totals = _sums(kept)
    width = len(totals)
    if not width:
        return vectors.sparkSession.createDataFrame([], schema)
    near = np.array([min(max((2 * t + n) // (2 * n), -LONG), LONG) for t in totals], dtype=np.int64)
    sums, products = _products(kept.select("v"), lambda b: (whole_numbers(b.column(0), width)[0] - near).astype(float), width)
    v = products / n - np.outer(sums / n, sums / n)
    values, axes = components((v + v.T) / 2, k)
    k = len(values)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    explained, scaled = values / np.trace(v), axes / np.sqrt(values)
    centred = _centred(n, totals, int(max(abs(t) for t in totals) // n + 1))

    def coordinates(lists):
        y = centred(whole_numbers(lists, width)[0])
        return y, (y / n).astype(float) @ scaled

    means, squares = _products(kept.select("v"), lambda b: coordinates(b.column(0))[1], k)
    error = float(np.abs(squares / n - np.outer(means / n, means / n) - np.eye(k)).max())

    def run(batches):
        release()
        for batch in batches:
            y, w = coordinates(batch.column(1))
            rows = len(w)
            which = pa.array(np.repeat(np.arange(rows), k))
            columns = [
                batch.column(0).take(which), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, n), pa.int64()), pa.array(_square_sums(y), pa.int64()).take(which),
                pa.array(w.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(run, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
ORACLES: dict[str, str] = {}
