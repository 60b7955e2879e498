"""Token ids packed into rows of fixed length, as binary tables.

Documents are dealt at random to groups of about GROUP_CHARS characters, repeated rows too; each group packs its own, best-fit-decreasing: pieces go from the longest to the
shortest, each into the fullest open row that still has room. A segment tree over the free places of rows finds that row in logarithmic time.
A document longer than a row is first split into pieces of a row's length and a rest, so that
no id is lost; its pieces know their place in it.

A packed row is written as its ids (little-endian, padded with `pad`), the cumulative lengths of its segments (0 first, as variable-length
attention takes them) and positions that start again at 0 with each segment. Rows of a group come in batches, each one matrix of ids.

Documents without ids take no place and are in no row. Null ids are an empty list; repeated ids of documents are
documents of their own. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.bpe import production_vocabulary, read_ranks
from rookery.llm.common import bounded_batches, fresh_path, kept, release, text_of

ROW_IDS, MATRIX_ROWS = 2_048, 64
#: Characters of the documents of a group, about; a longer document is in a group with few others.
GROUP_CHARS = 4_000_000


def _width(n_ids: int) -> int:
    """Bytes of an id: two while all ids and the pad, which is the largest number of the type, fit; else four."""
    return 2 if n_ids < 0xFFFF else 4


class OpenRows:
    """Rows by free places, with a segment tree that finds the least free place that is enough."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = defaultdict(list)

    def _add(self, free: int, n: int) -> None:
        node = free + self.size
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, row: int, free: int) -> None:
        self.rows[free].append(row)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, free) of the fullest row with `need` free places, no longer open; None if there is none."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.size
        self._add(free, -1)
        return self.rows[free].pop(), free


def best_fit_decreasing(lengths: list[int], length: int) -> tuple[list[tuple[int, int]], int]:
    """Each piece's (row, offset), and the number of rows; lengths are 1 to `length`. Ties go by position."""
    open_, rows, placed = OpenRows(length), 0, [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = open_.take(lengths[i])
        if found is None:
            found, rows = (rows, length), rows + 1
        row, free = found
        placed[i] = row, length - free
        if free > lengths[i]:
            open_.put(row, free - lengths[i])
    return placed, rows


PACKED = "group long, matrix int, first_row int, ids binary, cumulative array<array<int>>, positions binary, documents array<array<struct<doc_key:string,piece:int,at:int,length:int>>>"
_SEGMENT = pa.struct([("doc_key", pa.string()), ("piece", pa.int32()), ("at", pa.int32()), ("length", pa.int32())])
_SCHEMA = pa.schema([("group", pa.int64()), ("matrix", pa.int32()), ("first_row", pa.int32()), ("ids", pa.binary()), ("cumulative", pa.list_(pa.list_(pa.int32()))), ("positions", pa.binary()), ("documents", pa.list_(pa.list_(_SEGMENT)))])


def pack(tokens: DataFrame, path: str, groups: int, id_col: str = "doc_id", ids_col: str = "ids", row_ids: int = ROW_IDS, width: int = 2) -> DataFrame:
    """Packs (id, ids binary of little-endian numbers of `width` bytes) and writes the matrices under `path`; gives that table."""

    kind, pad = f"<u{width}", (1 << 8 * width) - 1

    def run(key, batches):
        release()
        # ids are at hand piece by piece; only one matrix of rows is made at a time
        names, data = [], []
        for batch in batches:
            names += batch.column("k").to_pylist()
            data += [np.frombuffer(x or b"", kind) for x in batch.column("ids").to_pylist()]
        order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or "", len(data[i])))
        pieces = [(i, at) for i in order for at in range(0, len(data[i]), row_ids)]
        lengths = [min(row_ids, len(data[i]) - at) for i, at in pieces]
        placed, rows = best_fit_decreasing(lengths, row_ids)
        by_row = [[] for _ in range(rows)]
        for (i, at), n, (row, offset) in zip(pieces, lengths, placed):
            by_row[row].append((offset, i, at, n))
        for matrix, lo in enumerate(range(0, rows, MATRIX_ROWS)):
            part = by_row[lo : lo + MATRIX_ROWS]
            ids, positions = np.full((len(part), row_ids), pad, kind), np.zeros((len(part), row_ids), "<u4" if row_ids > 0xFFFF else "<u2")
            for r, segments in enumerate(part):
                for offset, i, at, n in sorted(segments):
                    ids[r, offset : offset + n] = data[i][at : at + n]
                    positions[r, offset : offset + n] = np.arange(n)
            yield pa.RecordBatch.from_pylist([{
                "group": key[0].as_py(), "matrix": matrix, "first_row": lo, "ids": ids.tobytes(), "positions": positions.tobytes(),
                "cumulative": [[0, *np.cumsum([n for *_, n in sorted(segments)]).tolist()] for segments in part],
                "documents": [[{"doc_key": names[i], "piece": at // row_ids, "at": at, "length": n} for _, i, at, n in sorted(segments)] for segments in part],
            }], _SCHEMA)

    keyed = tokens.select(F.col(id_col).cast("string").alias("k"), F.col(ids_col).alias("ids"))
    # by the row's place in its partition, so that rows which repeat one another go to different groups
    dealt = keyed.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    dealt.groupBy("group").applyInArrow(_arrow(run), PACKED).write.parquet(path)
    return tokens.sparkSession.read.schema(PACKED).parquet(path)


def _arrow(run):
    def whole(key, table):
        made = list(run(key, table.to_batches()))
        return pa.Table.from_batches(made, _SCHEMA) if made else _SCHEMA.empty_table()

    return whole


def token_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) with the byte-level BPE ids of each text as little-endian numbers of `_width` bytes."""
    ranks = read_ranks(path)
    kind, vocabulary = f"<u{_width(max(ranks.values()) + 1)}", docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        import tiktoken

        encoder = kept(("tiktoken", path, pattern), lambda: tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=vocabulary.value, special_tokens={}))
        for batch in batches:
            ids = [np.array(encoder.encode_ordinary(x.as_py()), kind).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    id_kind = docs.select(id_col).schema[0].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {id_kind}, ids binary")


def unpacked(packed: DataFrame, row_ids: int = ROW_IDS, width: int = 2) -> DataFrame:
    """(doc_key, piece, at, length, group, row, offset, ids): the segments, cut out of the matrices by the cumulative lengths."""

    bounded_batches(packed.sparkSession)

    def run(batches):
        release()
        for batch in batches:
            out = []
            for m in batch.to_pylist():
                ids = np.frombuffer(m["ids"], f"<u{width}").reshape(-1, row_ids)
                for r, (ends, segments) in enumerate(zip(m["cumulative"], m["documents"])):
                    for lo, hi, s in zip(ends, ends[1:], segments):
                        out.append({**s, "group": m["group"], "row": m["first_row"] + r, "offset": lo, "ids": ids[r, lo:hi].tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_key", pa.string()), ("piece", pa.int32()), ("at", pa.int32()), ("length", pa.int32()), ("group", pa.int64()), ("row", pa.int32()), ("offset", pa.int32()), ("ids", pa.binary())]))

    return packed.drop("positions").mapInArrow(run, "doc_key string, piece int, at int, length int, group long, row int, offset int, ids binary")


def op9_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a segment: the document, which piece of it, its place in the packed rows, and the SHA-256 of the ids read back from the matrix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    vocabulary, pattern = production_vocabulary()
    width = _width(max(read_ranks(vocabulary).values()) + 1)
    chars = docs.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    packed = pack(token_ids(docs, vocabulary, pattern), fresh_path(spark, "packed"), max(1, -(-chars // GROUP_CHARS)), width=width)
    found = unpacked(packed, width=width)
    return found.select(F.col("doc_key").cast("long").alias("doc_id"), "piece", "at", F.col("length").alias("n_ids"), "group", "row", F.col("offset").alias("row_offset"), F.sha2("ids", 256).alias("ids_sha256"))


QUERIES = {"op9_token_packing": op9_token_packing}
ORACLES: dict[str, str] = {}
