"""Exact dedup by two passes over Bloom filters.

The first pass hashes every text and finds, for each cell of a Bloom filter, whether more than one row fell on it. Each task sorts the cells
of its rows and sends them packed, two bytes a cell, by page of the filter; no row or hash of a row shuffles for it, and the cells that more than one row
fell on form a second filter, of hashes that may be repeated. The second pass asks that filter for each row: a row with a cell that only it fell on is
unique and passes straight through, and only the other rows shuffle by hash to find their group.

The filter is broadcast, so its size is bounded (MAX_CELLS). A table of more rows than it was made for gets fewer cells and probes a row, and more
of its unique rows shuffle; the result is the same.

Texts are equal when they are identical after each run of white space became one space. Null
counts as empty text, and all empty texts form one group. Rows that repeat a doc_id with
the same text share their fate: `kept` says whether the id is the group's smallest. A null id
is never the smallest unless the whole group has none; then all its rows are kept. Extra columns
of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import WS, attach, release, text_of, written

#: Cells of the filter for each row, and at least and at most in all (32 MB as bits).
CELLS_PER_ROW = 16
MAX_CELLS = 1 << 28
MIN_CELLS = 1 << 15
#: Cells of a page.
PAGE = 1 << 15
#: Cells that a task holds before it sends them.
FLUSH_CELLS = 2_000_000


def digest(col):
    """SHA-256 of the normalised text, as lowercase hex."""
    return F.sha2(F.regexp_replace(text_of(col), WS, " "), 256)


def probes(rows: int, cells: int) -> int:
    """Fewer probes where a row has few cells, so that the filter doesn't fill."""
    return 3 if cells >= 8 * rows else 2 if cells >= 4 * rows else 1


def _cells(cells: int, n: int) -> list:
    """The n cells of a row's hash: `cells` is a power of two and the step odd, so they differ."""
    return [F.pmod(F.pmod(F.xxhash64("_sha"), F.lit(cells)) + i * (2 * F.pmod(F.xxhash64("_sha", F.lit(1)), F.lit(cells)) + 1), F.lit(cells)) for i in range(n)]


def _packed(cells: np.ndarray) -> pa.RecordBatch:
    """By page, the cells that rows of this task fell on, each once, and those that several did."""
    cells = np.sort(cells)
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    some, again = cells[first], np.diff(np.concatenate([first, [len(cells)]])) > 1
    page, place = some // PAGE, (some % PAGE).astype("<u2")
    cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]])), [len(page)]])
    spans = list(zip(cuts, cuts[1:]))
    return pa.RecordBatch.from_arrays([
        pa.array(page[cuts[:-1]], pa.int64()), pa.array([place[lo:hi].tobytes() for lo, hi in spans], pa.binary()), pa.array([place[lo:hi][again[lo:hi]].tobytes() for lo, hi in spans], pa.binary()),
    ], names=["page", "some", "again"])


def _fallen(batches):
    release()
    held, size = [], 0
    for batch in batches:
        held += [np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
        size += batch.num_rows * batch.num_columns
        if size >= FLUSH_CELLS:
            yield _packed(np.concatenate(held))
            held, size = [], 0
    if size:
        yield _packed(np.concatenate(held))


def _page_bits(table: pa.Table) -> pa.Table:
    """The page's bits of cells that more than one row fell on."""
    some = np.sort(np.concatenate([np.frombuffer(x, "<u2") for x in table.column("some").to_pylist()]))
    bits = np.zeros(PAGE, bool)
    bits[some[1:][some[1:] == some[:-1]]] = True
    for again in table.column("again").to_pylist():
        bits[np.frombuffer(again, "<u2")] = True
    return pa.table({"page": table.column("page").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()] if bits.any() else [None], pa.binary())})


class RepeatFilter:
    """A Bloom filter of the hashes that may occur more than once, broadcast as bits of a bounded size."""

    def __init__(self, hashes: DataFrame, rows: int, cells: int):
        spark = hashes.sparkSession
        self.cells, self.probes = cells, probes(rows, cells)
        fell = hashes.select(*(c.alias(f"c{i}") for i, c in enumerate(_cells(cells, self.probes)))).mapInArrow(_fallen, "page long, some binary, again binary")
        pages = fell.groupBy("page").applyInArrow(_page_bits, "page long, bits binary").filter("bits IS NOT NULL")
        bits = np.zeros(cells // 8, dtype=np.uint8)
        for row in pages.toLocalIterator():  # cells / PAGE pages of 4 kB at most
            bits[row.page * PAGE // 8 : (row.page + 1) * PAGE // 8] = np.frombuffer(row.bits, dtype=np.uint8)
        self.bits = spark.sparkContext.broadcast(bits)

    def may_repeat(self):
        bits = self.bits

        @F.pandas_udf("boolean")
        def asked(*cells: pd.Series) -> pd.Series:
            release()
            found = np.ones(len(cells[0]), dtype=bool)
            for cell in cells:
                at = cell.to_numpy(dtype=np.int64)
                found &= (bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            return pd.Series(found)

        return asked(*_cells(self.cells, self.probes))


def filter_size(rows: int, cells_per_row: int = CELLS_PER_ROW, max_cells: int = MAX_CELLS) -> int:
    return min(max_cells, max(MIN_CELLS, 1 << (max(1, rows * cells_per_row) - 1).bit_length()))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, RepeatFilter]:
    """(id, _sha, keep_id, group_size, kept) of every row, and the filter that told them apart."""
    hashes = written(docs.select(F.col(id_col).alias("_id"), F.unhex(digest(text_col)).alias("_sha")), "hashes")
    total = hashes.count()
    repeat = RepeatFilter(hashes, total, filter_size(total))
    flagged = hashes.withColumn("_flag", repeat.may_repeat())
    straight = flagged.filter(~F.col("_flag")).select("_id", "_sha", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    shuffled = flagged.filter("_flag").select("_id", "_sha")
    found = shuffled.groupBy("_sha").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    grouped = attach(shuffled, found, "_sha", "group_size", "_id", total).select("_id", "_sha", "keep_id", "group_size")
    out = straight.unionByName(grouped).withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")))
    return out, repeat


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, the id that stays for its text, the group's size, whether it stays, the hash."""
    out, _ = groups(docs, id_col, text_col)
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Unique texts never shuffle: they pass from the scan to the output."""
    out, repeat = groups(docs, id_col, text_col)
    hashed = docs.withColumn("_sha", F.unhex(digest(text_col))).withColumn("_flag", repeat.may_repeat())
    straight = hashed.filter(~F.col("_flag"))
    stays = out.filter("kept AND group_size >= 1").select(F.col("_id").alias("_stay"), F.col("_sha").alias("_stay_sha")).distinct()
    repeated = hashed.filter("_flag").join(stays, F.col(id_col).eqNullSafe(F.col("_stay")) & (F.col("_sha") == F.col("_stay_sha")), "left_semi")
    return straight.unionByName(repeated).drop("_sha", "_flag")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {
    "op7_exact_dedup": r"""
WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY text_sha256)
SELECT h.doc_id, g.keep_id, g.group_size, h.doc_id = g.keep_id AS kept, h.text_sha256 FROM h JOIN g USING (text_sha256)
"""
}
