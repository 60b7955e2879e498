"""N-gram Jaccard join: an exact metric-space join of documents by their word shingles.

Jaccard distance is a metric on sets, and two documents link at a distance of at most r = 1 - similarity. Documents that are the
same set are one class and join once. Then:

1. Classes that can't link to any other are told apart at once: a class of n shingles needs ceil(similarity * n) that another class
   has too. Fingerprints of all shingles are dealt to buckets, packed and each once for a batch of texts, so that a shingle in a
   third of all texts is a few entries; what comes back are counts for each text.
2. Pivots are documents. Two sets at a distance below 1 share a shingle, and a linking partner of x shares one of the first
   n - ceil(similarity * n) + 1 shingles of x in the common order (rarest first). Of the sets with such a shingle in common the one of
   the lowest rank is a pivot, and the others are measured against it; those within r link to it. To any other pivot a set is too far to link, so it need
   not be measured.
3. A pivot's region holds the sets measured against it: those for which it is the nearest, and copies of those nearer to another
   pivot. Sets that link share one of their first shingles, so they share that shingle's pivot and meet in its region. Sets that are connected by links already
   need not meet, and a region of one component is done.
4. A region that fits a task is joined there: pairs of different components whose distances to the pivot are within r of each
   other (triangle inequality). Any other region is divided by pivots of its own, taken from its components in turn. All its members are measured against
   all of them, which settles the pivots themselves; the others go to the nearest pivot q, and as copies to those with
   d(x, q') <= d(x, q) + 2r and d(x, q') <= radius(q') + r. Regions are divided again until each fits a task. Where pivots
   don't divide (all members are about as far from all of them), blocks of the region meet in pairs, a task for each.

Components follow from the links by label propagation with pointer jumping. No group of documents is ever in one task
unless its size is bounded; no pairs are dropped.

Texts with fewer words than a shingle are one shingle, texts without words (null, empty) are empty sets, link with nothing and are their own
component. Rows that repeat an id are rows of their own; a component's id is the smallest that isn't null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.llm.common import BROADCAST_ROWS, attach, bounded_batches, release, text_of, trim, written
from rookery.llm.exact_dedup import PAGE, filter_size
from rookery.llm.shingles import mixed, shingle_sets

WIDTH, PERCENT = 5, 75
#: A batch of the first step is sent when it has so many shingles or texts; a bucket gets about so many fingerprints.
FLUSH_SHINGLES, FLUSH_TEXTS, BUCKET_SHINGLES, LEAST_BUCKETS = 1_000_000, 60_000, 1_000_000, 64
#: Sets of a batch whose shingles' frequencies are looked up together, as bits of the node's number; sets of more shingles than LONG_SET are batches of their own.
BATCH_BITS, LONG_SET = 11, 2_048
#: Members, and their shingles, of a region that one task joins.
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
#: Pivots of a region in the first division; twice as many in each further one, up to the limit. Copies are noted as a bit for each level.
PIVOTS, MOST_PIVOTS, LEVELS = 16, 128, 62
#: A division must leave at most this share of the pairs that could meet.
GAIN = 0.5
#: Room for the rounding of distances, which are doubles.
SLACK = 1e-9
NOBODY = 0xFFFF
PROBES = 3
#: A broadcast bitmap of nodes has so many pages of 4 kB at most.
MOST_PAGES = 8_192
#: The row number by which keep_one tells rows apart.
ROW = "_keep_one_row"


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _signature(hashes: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mixed(hashes).sum(dtype=np.uint64)), int(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))


def _key(n: int, signature: tuple[int, int]) -> bytes:
    return n.to_bytes(4, "big") + signature[0].to_bytes(8, "big") + signature[1].to_bytes(8, "big")


def _digests(docs: DataFrame, width: int) -> DataFrame:
    """(id, n_shingles, key): equal keys, equal sets."""

    def run(batches):
        release()
        for batch in batches:
            known = [(len(s), _key(len(s), _signature(s)) if len(s) else None) for s in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in known], pa.int64()), pa.array([k for _, k in known], pa.binary())], names=["id", "n_shingles", "key"])
        trim()

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n_shingles long, key binary")


def _pack(batch_id: int, sets: list[np.ndarray], keys: list[bytes], buckets: int) -> Iterator[dict]:
    """A batch's rows: its fingerprints by bucket, each once with the text that owns it, and what is known of the texts already."""
    hashes = np.concatenate(sets)
    n_sets = len(sets)
    owner = np.repeat(np.arange(n_sets, dtype=np.uint16), [len(s) for s in sets])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    sets.clear()  # they are in `hashes`
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    times = np.diff(np.concatenate([first, [len(hashes)]]))
    repeated = np.repeat(times > 1, times)
    known = np.bincount(owner[repeated], minlength=n_sets).astype(np.uint32)
    once, owners = hashes[first], np.where(times > 1, NOBODY, owner[first]).astype(np.uint16)
    bucket = (once % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    prints, owners, bucket = (once[order] >> np.uint64(32)).astype(np.uint32), owners[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in range(buckets):
        lo, hi = cuts[b], cuts[b + 1]
        told = b == batch_id % buckets
        if hi > lo or told:
            yield {"bucket": b, "batch": batch_id, "owners": owners[lo:hi].tobytes(), "prints": prints[lo:hi].tobytes(), "known": known.tobytes() if told else None, "keys": b"".join(keys) if told else None}


PACKED = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("owners", pa.binary()), ("prints", pa.binary()), ("known", pa.binary()), ("keys", pa.binary())])
#: Buckets whose rows go out together.
PACKED_ROWS = 256


def _packed_batches(batch_id: int, sets: list[np.ndarray], keys: list[bytes], buckets: int) -> Iterator[pa.RecordBatch]:
    rows = []
    for row in _pack(batch_id, sets, keys, buckets):
        rows.append(row)
        if len(rows) == PACKED_ROWS:
            yield pa.RecordBatch.from_pylist(rows, PACKED)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, PACKED)


COUNTED = pa.schema([("batch", pa.int64()), ("owners", pa.binary()), ("counts", pa.binary()), ("known", pa.binary()), ("keys", pa.binary())])


def _may_link(docs: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """(key) of the classes of which enough shingles occur in other texts too; copies in one batch count once."""

    def pack(batches):
        release()
        batch_id, sets, keys, seen, size = TaskContext.get().partitionId() << 32, [], [], set(), 0

        for batch in batches:
            for hashes in shingle_sets(batch.column(1), width):
                if not len(hashes) or (key := _key(len(hashes), _signature(hashes))) in seen:
                    continue
                seen.add(key)
                sets.append(hashes)
                keys.append(key)
                size += len(hashes)
                if size >= FLUSH_SHINGLES or len(sets) >= FLUSH_TEXTS:
                    yield from _packed_batches(batch_id, sets, keys, buckets)
                    batch_id, sets, keys, seen, size = batch_id + 1, [], [], set(), 0
        if sets:
            yield from _packed_batches(batch_id, sets, keys, buckets)
        trim()

    def count(table: pa.Table) -> pa.Table:
        owners = [np.frombuffer(x, np.uint16) for x in table.column("owners").to_pylist()]
        prints = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("prints").to_pylist()])
        owner = np.concatenate(owners)
        order = np.argsort(prints, kind="stable")
        ordered = prints[order]
        same = ordered[1:] == ordered[:-1]
        shared = np.zeros(len(prints), bool)
        shared[order] = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) if len(prints) else False
        shared &= owner != NOBODY
        rows, at = [], 0
        for batch, known, keys, mine in zip(table.column("batch").to_pylist(), table.column("known").to_pylist(), table.column("keys").to_pylist(), owners):
            who, n = np.unique(mine[shared[at : at + len(mine)]], return_counts=True)
            at += len(mine)
            if len(who) or keys is not None:
                rows.append({"batch": batch, "owners": who.astype(np.uint16).tobytes(), "counts": n.astype(np.uint32).tobytes(), "known": known, "keys": keys})
        del owners, prints, owner, order, ordered, same, shared
        trim()
        return pa.Table.from_pylist(rows, COUNTED)

    def total(table: pa.Table) -> pa.Table:
        told = next(r for r in table.select(["known", "keys"]).to_pylist() if r["keys"] is not None)
        shared = np.frombuffer(told["known"], np.uint32).astype(np.int64)
        for who, n in zip(table.column("owners").to_pylist(), table.column("counts").to_pylist()):
            shared[np.frombuffer(who, np.uint16)] += np.frombuffer(n, np.uint32)
        keys = [told["keys"][i : i + 20] for i in range(0, len(told["keys"]), 20)]
        return pa.table({"key": pa.array([k for k, s in zip(keys, shared) if s >= _needed(int.from_bytes(k[:4], "big"), percent)], pa.binary())})

    packed = docs.mapInArrow(pack, "bucket long, batch long, owners binary, prints binary, known binary, keys binary")
    counted = packed.groupBy("bucket").applyInArrow(count, "batch long, owners binary, counts binary, known binary, keys binary")
    return counted.groupBy("batch").applyInArrow(total, "key binary").distinct()


def _sieve(keys: DataFrame, rows: int) -> tuple[int, object]:
    """A Bloom filter of (key, id) pairs as broadcast bits of a bounded size."""
    cells = filter_size(rows)

    @F.pandas_udf("array<long>")
    def cells_of(key: pd.Series, id_: pd.Series) -> pd.Series:
        return pd.Series([[int(x) for x in _probes(k, i, cells)] for k, i in zip(key, id_)])

    fell = keys.select(F.explode(cells_of("key", F.col("id").cast("string"))).alias("_cell"))
    pages = fell.groupBy((F.col("_cell") / PAGE).cast("long").alias("_page")).agg(F.bitmap_construct_agg(F.col("_cell") % PAGE).alias("_bits"))
    bits = np.zeros(cells // 8, dtype=np.uint8)
    for row in pages.toLocalIterator():  # MAX_CELLS (of exact_dedup) / PAGE pages of 4 kB at most
        bits[row._page * PAGE // 8 : (row._page + 1) * PAGE // 8] = np.frombuffer(row._bits, dtype=np.uint8)
    return cells, keys.sparkSession.sparkContext.broadcast(bits)


def _probes(key: bytes, id_: str | None, cells: int) -> np.ndarray:
    base = int.from_bytes(key[4:12], "big") ^ (hash_of(id_) & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        return (mixed(np.uint64(base) + np.arange(1, PROBES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(cells)).astype(np.int64)


def hash_of(value: str | None) -> int:
    import xxhash

    return xxhash.xxh64_intdigest((value or "").encode())


def _sets(docs: DataFrame, chosen: DataFrame, rows: int, width: int) -> DataFrame:
    """(node, key, n, hashes, batch) of the chosen classes, from one of their documents; other texts stay where they are.

    What the filter lets through moves once, by key: whoever has a chosen key has its set, whichever document it is. Nodes are numbers given as the table is written, so no two classes share one. Sets written one after another share a batch.
    """
    cells, bits = _sieve(chosen, rows)

    def run(batches):
        release()
        for batch in batches:
            found = []
            for id_, hashes in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width)):
                if len(hashes):
                    key = _key(len(hashes), _signature(hashes))
                    at = _probes(key, None if id_ is None else str(id_), cells)
                    if ((bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all():
                        found.append({"key": key, "hashes": hashes.view(np.int64)})
            yield pa.RecordBatch.from_pylist(found, pa.schema([("key", pa.binary()), ("hashes", pa.list_(pa.int64()))]))
        trim()

    passed = docs.mapInArrow(run, "key binary, hashes array<long>")
    exact = passed.join(chosen.select("key"), "key", "left_semi")
    one = exact.groupBy("key").agg(F.first("hashes").alias("hashes"))
    numbered = one.select(F.monotonically_increasing_id().alias("node"), "key", F.size("hashes").alias("n"), "hashes")
    batch = F.when(F.col("n") > LONG_SET, -1 - F.col("node")).otherwise(F.shiftright("node", BATCH_BITS))
    return written(numbered.withColumn("batch", batch), "sets")


def _held(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes) of the sets that a join with `nodes` needs: a broadcast bitmap of the nodes leaves all others where they are, up to MOST_PAGES; beyond it all sets move."""
    page, bit, held = F.shiftright("node", PAGE.bit_length() - 1), F.col("node").bitwiseAND(PAGE - 1), sets.select("node", "hashes")
    pages = written(nodes.groupBy(page.alias("_page")).agg(F.bitmap_construct_agg(bit).alias("_bits")), "pages")
    if pages.count() > MOST_PAGES:
        return held
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return held.join(F.broadcast(pages), page == F.col("_page")).filter(F.floor(byte / F.pow(F.lit(2), bit.bitwiseAND(7))) % 2 == 1).select("node", "hashes")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node that has a link; label is the smallest node of its component."""
    both = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        heard = both.join(labels, F.col("u") == F.col("node")).groupBy(F.col("v").alias("node")).agg(F.min("label").alias("heard"))
        spread = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        onward = labels.select(F.col("node").alias("_at"), F.col("label").alias("_on"))
        jumped = spread.join(onward, F.col("label") == F.col("_at"), "left").select("node", "old", F.least("label", F.coalesce("_on", "label")).alias("label"))
        after = written(jumped, "labels")
        changed = after.filter("old <> label").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels


def _linked(both: Column, any_: Column, percent: int) -> Column:
    return 100 * both >= percent * any_


def _measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, pivot, d, linked) of (node, pivot) pairs; a pivot of very many nodes is dealt over salts. Up to BROADCAST_ROWS pairs go to the sets, beyond it the sets move by node, once for nodes and pivots."""
    held, total = sets.select("node", "hashes"), pairs.count()
    near = F.broadcast if total <= BROADCAST_ROWS else lambda df: df
    asked = pairs.groupBy(F.col("pivot").alias("node")).agg(F.count(F.lit(1)).alias("_times"))
    pivots = held.join(near(asked), "node").select(F.col("node").alias("pivot"), "_times", F.col("hashes").alias("_b"))
    left = held.join(near(pairs), "node").select("node", "pivot", F.col("hashes").alias("_a"))
    joined = attach(left, pivots, "pivot", "_times", "node", total).withColumn("_both", F.size(F.array_intersect("_a", "_b")))
    joined = joined.withColumn("_any", F.size("_a") + F.size("_b") - F.col("_both"))
    return joined.select("node", "pivot", (1 - F.col("_both") / F.col("_any")).alias("d"), _linked(F.col("_both"), F.col("_any"), percent).alias("linked"))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _block_links(percent: int):
    """Joins a region, or two of its blocks: pairs of different components that are to meet here and that no bound tells apart."""
    reach = (100 - percent) / 100 + SLACK

    def run(table: pa.Table) -> pa.Table:
        links: list[dict] = []
        node, label, block, copied, d = (table.column(c).to_numpy() for c in ("node", "label", "block", "copied", "d"))
        same_block = len(np.unique(block)) == 1
        if same_block and table.column("b1")[0] != table.column("b2")[0]:
            return pa.Table.from_pylist(links, LINKS)
        sets = [np.sort(x.values.to_numpy()) for x in table.column("hashes")]
        sizes = np.array([len(x) for x in sets])
        meet = (label[:, None] != label[None, :]) & ((copied[:, None] & copied[None, :]) == 0) & (np.abs(np.subtract.outer(d, d)) <= reach)
        if not same_block:
            meet &= block[:, None] != block[None, :]
        meet &= 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
        root = {x: x for x in label.tolist()}

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(meet, 1)))):
            if top(label[i]) != top(label[j]):
                n = _shared(sets[i], sets[j])
                if 100 * n >= percent * (sizes[i] + sizes[j] - n):
                    links.append({"a": int(node[i]), "b": int(node[j])})
                    root[top(label[i])] = top(label[j])
        return pa.Table.from_pylist(links, LINKS)

    return run


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _codes(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32-bit print of each hash, as one number. Two hashes of one code count as one shingle in the order, which stays the same for all sets."""
    hashes = hashes.view(np.uint64)
    return (hashes % np.uint64(buckets)) << np.uint64(32) | hashes >> np.uint64(32)


def _first_shingles(sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(node, h): the shingles of each set up to n - ceil(similarity * n) + 1 in the common order, rarest first, without those that no other set has.

    Each print goes once for a batch to its bucket, where batches' counts are added, and comes back with the sum, so a shingle in a
    third of all sets is one entry a batch. The order only has to be the same everywhere, so prints of 32 bits a bucket do.
    """

    def pack(batches):
        release()
        held, at = [], None

        def sent():
            codes, times = np.unique(_codes(np.concatenate(held), buckets), return_counts=True)
            held.clear()
            bucket = (codes >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            prints, times, ends = codes.astype(np.uint32), times.astype(np.uint32), [*starts[1:], len(codes)]
            for lo in range(0, len(starts), PACKED_ROWS):
                cuts = list(zip(starts[lo : lo + PACKED_ROWS], ends[lo : lo + PACKED_ROWS]))
                yield pa.RecordBatch.from_pydict(
                    {"batch": [at] * len(cuts), "bucket": [int(bucket[i]) for i, _ in cuts], "prints": [prints[i:j].tobytes() for i, j in cuts], "times": [times[i:j].tobytes() for i, j in cuts]}, FREQUENT
                )

        for some in batches:
            for batch, hashes in zip(some.column(0).to_pylist(), some.column(1)):
                if held and batch != at:
                    yield from sent()
                at = batch
                held.append(hashes.values.to_numpy())
        if held:
            yield from sent()
        trim()

    def count(table: pa.Table) -> pa.Table:
        prints = [np.frombuffer(x, np.uint32) for x in table.column("prints").to_pylist()]
        times = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("times").to_pylist()])
        _, which = np.unique(np.concatenate(prints), return_inverse=True)
        times = np.bincount(which, weights=times).clip(max=0xFFFFFFFF).astype(np.uint32)[which]
        cuts = np.cumsum([len(x) for x in prints])[:-1]
        sums = [x.tobytes() for x in np.split(times, cuts)]
        return table.select(["batch", "bucket", "prints"]).append_column("times", pa.array(sums, pa.binary()))

    def first(mine: pa.Table, counts: pa.Table) -> pa.Table:
        node, n = mine.column("node").to_numpy(), mine.column("n").to_numpy().astype(np.int64)
        if not len(node):
            return FIRSTS.empty_table()
        hashes, owner = np.concatenate([x.values.to_numpy() for x in mine.column("hashes")]), np.repeat(np.arange(len(node)), n)
        prints = [np.frombuffer(x, np.uint32) for x in counts.column("prints").to_pylist()]
        known = np.concatenate(prints).astype(np.uint64) | np.repeat(counts.column("bucket").to_numpy().astype(np.uint64), [len(x) for x in prints]) << np.uint64(32)
        times = np.concatenate([np.frombuffer(x, np.uint32) for x in counts.column("times").to_pylist()])
        order = np.argsort(known)
        times = times[order][np.searchsorted(known[order], _codes(hashes, buckets))]
        order = np.lexsort((hashes, times, owner))
        hashes, times = hashes[order], times[order]
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)  # of each shingle in its set's order
        take = (place < (n + percent * n // -100 + 1)[owner]) & (times > 1)
        return pa.table({"node": node[owner[take]], "h": hashes[take]}, FIRSTS)

    packed = sets.select("batch", "hashes").mapInArrow(pack, "batch long, bucket long, prints binary, times binary")
    counted = packed.groupBy("bucket").applyInArrow(count, "batch long, bucket long, prints binary, times binary")
    return sets.select("batch", "node", "n", "hashes").groupBy("batch").cogroup(counted.groupBy("batch")).applyInArrow(first, "node long, h long")


FREQUENT = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("prints", pa.binary()), ("times", pa.binary())])
FIRSTS = pa.schema([("node", pa.int64()), ("h", pa.int64())])


def _shingle_pivots(sets: DataFrame, percent: int) -> DataFrame:
    """(h, members, node, pivot): the sets that share one of their first shingles, and the pivot of each such shingle."""
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    firsts = written(_first_shingles(sets, percent, max(LEAST_BUCKETS, -(-total // BUCKET_SHINGLES))), "firsts")
    ranked = F.struct(F.xxhash64("node").alias("rank"), F.col("node"))
    heads = firsts.groupBy("h").agg(F.min(ranked).alias("head"), F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("node", F.lit(7)) % (1 << 40)).alias("mark"), F.sum(F.xxhash64("node", F.lit(8)) % (1 << 40)).alias("mark2")).filter("members > 1")
    # shingles of the same members are one
    heads = heads.groupBy("members", "mark", "mark2", "head").agg(F.min("h").alias("h")).select("h", "members", F.col("head.node").alias("pivot"))
    heads = written(heads, "heads")
    return written(attach(firsts, heads, "h", "members", "node", firsts.count()).filter("pivot IS NOT NULL"), "placed")


def _regions(distances: DataFrame, labels: DataFrame) -> DataFrame:
    """The regions of the pivots, as (region, node, label, d, copied): each set at home and, as a copy, with every other pivot that it was measured against."""
    told = distances.select(F.col("pivot").alias("region"), "node", "d").join(labels, "node", "left")
    return told.select("region", "node", F.coalesce("label", "node").alias("label"), "d", F.lit(0).cast("long").alias("copied"))


def _divided(big: DataFrame, sets: DataFrame, percent: int, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions divided by pivots of their own: the new regions, the members of those that pivots don't divide, and links to pivots."""
    reach = (100 - percent) / 100 + SLACK
    pivots = min(MOST_PIVOTS, PIVOTS << (level - 1))
    rank = F.xxhash64("node", F.lit(level))
    # row_number under a limit is cut before the shuffle, so no task sorts a whole region
    by_label = big.withColumn("_nth", F.row_number().over(Window.partitionBy("region", "label").orderBy(rank, "node"))).filter(F.col("_nth") <= pivots)
    chosen = by_label.withColumn("_no", F.row_number().over(Window.partitionBy("region").orderBy("_nth", rank, "node"))).filter(F.col("_no") <= pivots).select("region", "node", "label", "size")
    held = _held(sets, big)
    kept = chosen.join(held, "node").groupBy("region", "size").agg(F.collect_list(F.struct("node", "label", "hashes")).alias("_pivots"))
    measured = F.expr(f"""transform(transform(_pivots, p -> struct(p.node AS node, p.label AS label, size(hashes) + size(p.hashes) AS both_sizes, size(array_intersect(p.hashes, hashes)) AS both)),
        p -> struct(p.node AS node, p.label AS label, 1 - p.both / (p.both_sizes - p.both) AS d, 100 * p.both >= {percent} * (p.both_sizes - p.both) AS linked))""")
    members = attach(big.drop("parts", "main", "main_parts", "other_parts").join(held, "node"), kept.select("region", F.col("size").alias("_size"), "_pivots"), "region", "_size", "node", big.count())
    seen = written(members.select("region", "size", "node", "label", "copied", F.col("d").alias("_d"), measured.alias("_seen")), "seen")
    links = seen.select("node", "label", F.explode("_seen").alias("p")).filter("p.linked AND p.label <> label").select(F.col("node").alias("a"), F.col("p.node").alias("b"))
    rest = seen.filter("NOT exists(_seen, p -> p.node = node)").withColumn("_home", F.array_min(F.transform("_seen", lambda p: F.struct(p["d"].alias("d"), p["node"].alias("node")))))
    radius = rest.groupBy("region", F.col("_home.node").alias("q")).agg(F.max("_home.d").alias("_radius"), F.count(F.lit(1)).alias("_at_home"))
    own = rest.select("region", "size", "node", "label", F.col("_home.node").alias("q"), F.col("_home.d").alias("d"), "copied")
    over = rest.withColumn("_p", F.explode(F.filter("_seen", lambda p: (p["node"] > F.col("_home.node")) & (p["d"] <= F.col("_home.d") + 2 * reach))))
    over = over.select("region", "size", "node", "label", F.col("_p.node").alias("q"), F.col("_p.d").alias("d"), F.col("copied").bitwiseOR(F.lit(1 << level)).alias("copied"))
    over = over.join(F.broadcast(radius) if radius.count() <= BROADCAST_ROWS else radius, ["region", "q"]).filter(F.col("d") <= F.col("_radius") + reach)
    made = written(own.unionByName(over.select(own.columns)), "made")
    # pairs that could meet, before and after
    def pairs(df, *by):
        some = df.groupBy("region", "size", "label", *by).agg(F.count(F.lit(1)).cast("double").alias("_n")).groupBy("region", "size", *by).agg((F.sum("_n") * F.sum("_n") - F.sum(F.col("_n") * F.col("_n"))).alias("_n"))
        return some.groupBy("region", "size").agg(F.sum("_n").alias("_pairs"))

    before, after = pairs(rest), pairs(made, "q").select("region", F.col("_pairs").alias("_after"))
    gains = written(before.join(after, "region").select("region", F.col("size").alias("_size"), (F.col("_after") <= GAIN * F.col("_pairs")).alias("_gains")), "gains")
    divided = attach(made, gains, "region", "_size", "node", made.count()).filter("_gains").select(F.xxhash64("region", "q").alias("region"), "node", "label", "d", "copied")
    left = attach(rest.select("region", "size", "node", "label", F.col("_d").alias("d"), "copied"), gains, "region", "_size", "node", rest.count()).filter("NOT _gains").select("region", "node", "label", "d", "copied")
    return divided, left, links


def _sized(regions: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """The members of regions that still have someone to meet, with the region's size, its largest component (main) and the blocks it takes.

    At each level a copy meets only those at home, so it goes if they are all of its own component; a region of one component goes whole.
    """
    copy = F.col("copied").bitwiseAND(F.lit(1 << (level - 1))) != 0
    known = regions.join(sets.select("node", "n"), "node").withColumn("_copy", copy)
    counts = known.groupBy("region", "label", "_copy").agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_n"))
    home = counts.groupBy("region").agg(F.sum("_c").alias("_all"), F.min(F.when(~F.col("_copy"), F.col("label"))).alias("_lo"), F.max(F.when(~F.col("_copy"), F.col("label"))).alias("_hi"))
    stays = ~F.col("_copy") | ((F.col("_lo") != F.col("label")) | (F.col("_hi") != F.col("label")))
    labels = counts.join(home, "region").filter(stays).groupBy("region", "_all", "_lo", "_hi", "label").agg(F.sum("_c").alias("_c"), F.sum("_n").alias("_n"))
    sizes = labels.groupBy("region", "_all", "_lo", "_hi").agg(F.count(F.lit(1)).alias("_labels"), F.sum("_c").alias("size"), F.sum("_n").alias("_n"), F.max(F.struct("_c", "label", "_n")).alias("_main")).filter("_labels > 1")
    blocks = lambda c, n: F.expr(f"cast(greatest(ceil({c} / {BLOCK}.0), ceil({n} / {BLOCK_SHINGLES}.0)) as int)")
    sizes = sizes.select("region", "_all", "_lo", "_hi", "size", F.col("_main.label").alias("main"), blocks("size", "_n").alias("parts"), blocks("_main._c", "_main._n").alias("main_parts"), blocks("(size - _main._c)", "(_n - _main._n)").alias("other_parts"))
    placed = attach(regions, sizes, "region", "_all", "node", regions.count()).filter("size IS NOT NULL").withColumn("_copy", copy)
    return placed.filter(stays).drop("_all", "_lo", "_hi", "_copy")


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Enough links between nodes to connect all that are connected."""
    placed = _shingle_pivots(sets, percent)
    spokes = written(_measured(placed.filter("node <> pivot").select("node", "pivot").distinct(), sets, percent), "spokes")
    itself = placed.select("pivot").distinct().select(F.col("pivot").alias("node"), "pivot", F.lit(0.0).alias("d"), F.lit(False).alias("linked"))
    ab = lambda df: df.filter("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    links, labels = ab(spokes), components(ab(spokes))
    regions, last = _regions(spokes.unionByName(itself), labels), []
    for level in range(1, LEVELS + 1):
        if level > 1:  # what has come together since need not meet again
            labels = components(links)
        renamed = labels.select("node", F.col("label").alias("_now"))
        again = lambda df: df.join(renamed, "node", "left").withColumn("label", F.coalesce("_now", "label")).drop("_now")
        if level > 1:
            last.append(_sized(written(again(left), "left"), sets, level - 1))
        sized = written(_sized(written(again(regions), "regions"), sets, level), "sized")
        big = sized.filter("parts > 1")
        if level == LEVELS or not big.limit(1).count():
            last.append(sized)
            break
        last.append(sized.filter("parts = 1"))
        regions, left, more = _divided(big, sets, percent, level)
        links = links.unionByName(written(more, "more"))
    cut = last[0]
    for more in last[1:]:
        cut = cut.unionByName(more)
    # blocks of a region that is still large meet in pairs, a task for each; members of the largest component have blocks of their own, which needn't meet each other
    few, mine = F.col("parts") == 1, F.col("label") == F.col("main")
    some = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1)))
    cut = cut.withColumn("block", F.when(few, 0).when(mine, some("main_parts")).otherwise(F.col("main_parts") + some("other_parts")).cast("int"))
    others = F.when(few, F.array(F.lit(0))).otherwise(F.sequence(F.when(mine, F.col("main_parts")).otherwise(0), F.col("main_parts") + F.col("other_parts") - 1))
    meet = cut.join(_held(sets, cut), "node").withColumn("other", F.explode(others))
    meet = meet.select("region", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "node", "label", "copied", "d", "hashes")
    late = meet.groupBy("region", "b1", "b2").applyInArrow(_block_links(percent), "a long, b long")
    return links.unionByName(written(late, "late"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for each row; see the module."""
    spark = docs.sparkSession
    bounded_batches(spark)
    lean = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    digests = written(_digests(lean, width), "digests")
    rows, shingles = digests.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    classes = written(digests.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    buckets = max(LEAST_BUCKETS, -(-shingles // BUCKET_SHINGLES))
    may = written(_may_link(lean, width, percent, buckets).join(classes, "key").select("key", F.col("rep").alias("id")), "may")
    sets = _sets(lean, may, may.count(), width)
    labels = components(_links(sets, percent))
    named = labels.join(sets.select("node", "key"), "node").join(classes.select("key", "rep"), "key")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("_nodes"))
    joined = attach(named.select("key", "label"), least, "label", "_nodes", "key", rows).select("key", F.col("component_id").alias("_linked"))
    whole = classes.join(joined, "key", "left").select("key", "copies", F.coalesce("_linked", "rep").alias("component_id"))
    out = attach(digests, whole, "key", "copies", "id", rows)
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that stay, with all their columns: one row of each component.

    Rows are told apart by a written row number, not by id. The row with the smallest id stays, null ids coming after all others; of rows that repeat
    that id, the first by row number.
    """
    rows = written(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, ROW, text_col, **how).select(ROW, F.col("component_id").alias("_component"))
    told = written(found.join(rows.select(F.col(ROW).alias("_at"), F.col(id_col).alias("_id")), F.col(ROW) == F.col("_at")).select(ROW, "_id", "_component"), "told")
    stays = told.groupBy("_component").agg(F.min(F.struct(F.col("_id").isNull().alias("a"), F.col("_id").alias("b"), F.col(ROW).alias("row"))).alias("_first")).select(F.col("_first.row").alias("_stays"))
    goes = written(told.join(stays, F.col(ROW) == F.col("_stays"), "left_anti").select(F.col(ROW).alias("_goes")), "goes")
    return rows.join(goes, F.col(ROW) == F.col("_goes"), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLES = {
    "op4_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [words]
      ELSE [words[i:i + 4] FOR i IN range(1, len(words) - 3)] END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(r.y), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id, n.n
"""
}
