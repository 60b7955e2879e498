"""Mixing sources to target weights, with DataFrame functions only.

Every source is a stream of words: its documents in a pseudorandom order, packed into blocks of
`block_words` words (the last one may be short). The mix is a sequence of slots, dealt to output shards
of `shard_slots` slots; each shard draws the sources of its slots from the multinomial that
the targets give. The slots that a source draws are numbered through all shards; number i takes, in pass
i div blocks, the block to which a pseudorandom permutation of that source and pass maps i mod blocks, so that no
block comes again before all have come. Draws beyond a source's quota are
given to the sources that drew too few, so each source ends on its quota; of its last slot it takes only as many words as its target, rounded to a
whole word, still needs. Blocks are joined to the documents by index.

The order of documents comes from their ids, sources and texts alone, and rows that are alike in these are numbered, so that the mix is the same however
the table is split and read (of rows that are alike in all, any may have any number).

Targets share `share` times all words by weight; none is above `most` times its source's words, and what such
a source can't take is shared out again by weight. Sources come in the order of their code points, null last.
Null text is empty; empty documents and sources take nothing and have 0 in every figure. Rows that repeat an id are rows of their own.
Extra columns of the input are ignored. The sources' table (one row a source) is handled whole by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.llm.common import BROADCAST_ROWS, WORD, attach, text_of, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 128
SHARD_SLOTS = 8_192
#: Documents are ordered within chunks of about so many rows, so that no source is ordered by one task.
CHUNK_ROWS = 512
#: Slots are numbered and permuted in tasks of about so many.
SLOTS_PER_TASK = 50_000
#: Running sums are taken within spans of so many numbers, and over the sums of spans.
SPAN = 4_096
#: Rounds of the swap-or-not permutation.
ROUNDS = 16
#: The unit interval of the draws is cut into so many bins, to find a draw's source by an equal join.
BINS = 1 << 12
SEED = 20_170


def word_count(col: str | Column) -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_rows, source_size, source_no, weight, target) from (source, _size) rows."""
    by_source = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    whole = Window.partitionBy()
    numbered = by_source.withColumn("source_no", F.row_number().over(whole.orderBy(F.asc_nulls_last("source"))) - 1)
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))).withColumn("_most", F.col("source_size") * most)
    # in the order in which a rising level meets the limits, a source is full if the level that the rest would share is above its own
    rising = whole.orderBy(F.col("_most") / F.col("weight"), "source_no")
    before = F.coalesce(F.sum("_most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left_weight = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    full = weighed.withColumn("_all", F.lit(share) * F.sum("source_size").over(whole)).withColumn("_full", (F.col("_all") - before) * F.col("weight") / left_weight >= F.col("_most"))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole)
    full_words = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_most"))).over(whole), F.lit(0))
    target = F.when(F.col("_full"), F.col("_most").cast("double")).otherwise((F.col("_all") - full_words) * F.col("weight") / open_weight)
    return full.select("source", "source_rows", "source_size", "source_no", "weight", target.alias("target"))


def permuted(x: str, n: str, key: str, back: bool = False) -> Column:
    """Where a pseudorandom permutation of 0..n-1 puts x, or what it puts at x (back): the swap-or-not shuffle, which fits any n."""
    step = f"""aggregate(sequence({f'{ROUNDS}, 1, -1' if back else f'1, {ROUNDS}'}), {x}, (x, r) ->
        if((xxhash64({key}, r, greatest(x, pmod(pmod(xxhash64({key}, -r), {n}) - x, {n}))) & 1) = 1, pmod(pmod(xxhash64({key}, -r), {n}) - x, {n}), x))"""
    return F.expr(step)


def before(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Adds the sum of `value` over the rows of the same keys with a smaller `order`, a whole number that is unique among them.

    No task orders more than the rows of a SPAN of numbers, or one sum for each span: SPAN times fewer than all.
    """
    spanned = rows.withColumn("_span", F.expr(f"{order} div {SPAN}"))
    sums = spanned.groupBy(*keys, "_span").agg(F.sum(value).alias("_sum"))
    earlier = sums.select(*keys, "_span", (F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_span")) - F.col("_sum")).alias("_earlier"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_span").orderBy(order)) - F.col(value)
    return spanned.withColumn("_inside", inside).join(earlier, [*keys, "_span"]).withColumn(out, F.col("_earlier") + F.col("_inside")).drop("_span", "_earlier", "_inside")


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds _same, the number of a row among those with its _key: 0 for nearly all. Numbers run through the partitions in which the rows were written."""
    again = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    known = attach(rows, again, "_key", "_n", "_row", max(1, rows.count()))
    here = known.filter("_n IS NOT NULL").withColumn("_part", F.expr("_row div 8589934592"))  # the partition's number stands above the row's 33 bits
    counts = here.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_c"))
    offsets = before(counts, ["_key"], "_part", "_c", "_offset").drop("_c")
    within = here.withColumn("_w", F.row_number().over(Window.partitionBy("_key", "_part").orderBy("_row")) - 1)
    repeated = within.join(offsets, ["_key", "_part"]).withColumn("_same", F.col("_offset") + F.col("_w")).drop("_part", "_w", "_offset")
    return known.filter("_n IS NULL").withColumn("_same", F.lit(0).cast("long")).unionByName(repeated).drop("_n")


def _draws(quotas: DataFrame, slots: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, source_no, _from, _n): the numbers from _from on, _n of them, of a source's slots fall to the shard."""
    spark = quotas.sparkSession
    upto = F.sum("_quota").over(Window.partitionBy().orderBy("source_no"))
    spans = quotas.filter("_quota > 0").withColumn("_to", upto).withColumn("_lo", F.col("_to") - F.col("_quota"))
    binned = spans.select("source_no", "_lo", "_to", F.explode(F.expr(f"sequence(cast(floor(_lo * {BINS}D / {slots}) as long), cast(floor((_to - 1) * {BINS}D / {slots}) as long))")).alias("_bin"))
    drawn = spark.range(slots).select(
        F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(slots)).alias("_u")
    ).withColumn("_bin", F.floor(F.col("_u") * F.lit(float(BINS)) / slots))
    counts = drawn.join(binned, (drawn._bin == binned._bin) & (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_to"))).groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("_drawn"))
    held = before(counts, ["source_no"], "shard", "_drawn", "_from").join(quotas.select("source_no", "_quota"), "source_no")
    held = written(held.withColumn("_n", F.greatest(F.lit(0), F.least("_drawn", F.col("_quota") - F.col("_from")))), "draws")
    # slots drawn beyond a quota, numbered through all shards, go to the sources that drew too few, numbered alike
    freed = held.groupBy("shard").agg(F.sum(F.col("_drawn") - F.col("_n")).alias("_free")).filter("_free > 0")
    freed = before(freed, [], "shard", "_free", "_start").select("shard", F.explode(F.expr("sequence(_start, _start + _free - 1)")).alias("_unit"))
    got = held.groupBy("source_no").agg(F.sum("_n").alias("_got"))
    short = quotas.join(got, "source_no", "left").withColumn("_got", F.coalesce("_got", F.lit(0))).withColumn("_short", F.col("_quota") - F.col("_got")).filter("_short > 0")
    short = short.withColumn("_start", F.sum("_short").over(Window.partitionBy().orderBy("source_no")) - F.col("_short")).select("source_no", F.posexplode(F.expr("sequence(_start, _start + _short - 1)")).alias("_i", "_unit"), "_got")
    given = freed.join(short, "_unit").select("shard", "source_no", (F.col("_got") + F.col("_i")).alias("_from"), F.lit(1).cast("long").alias("_n"))
    return held.filter("_n > 0").select("shard", "source_no", "_from", "_n").unionByName(given)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, row_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Two tables: the documents (_row, id, source, size, source_size, target) and the mix. `row_col` names a written row number, if the input has one.

    A row of the mix is a piece of a block: (shard, source_no, slot, pass, block, _row, id, word_from, word_to), the words
    word_from..word_to-1 of the document. Slot numbers count the source's slots through all shards.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    content = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(source_col).cast("string"), F.col(text_col))
    plain = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("_size"), content.alias("_key"), row.alias("_row"))
    rows = written(plain, "sizes")
    by_source = targets(rows, weights, share, most).withColumn("_blocks", F.ceil(F.col("source_size") / block_words))
    # whole passes and, in the last one, the slots whose words reach the target; the short block counts from where the permutation puts it
    words, full = F.least(F.round("target").cast("long"), F.col("source_size") * most), F.col("_blocks") * block_words
    by_source = by_source.withColumn("_words", words)
    by_source = by_source.withColumn("_pass", F.expr("if(source_size = 0, 0, _words div source_size)")).withColumn("_rest", F.expr("_words - _pass * source_size"))
    by_source = by_source.withColumn("_short_at", F.when(F.col("_blocks") > 0, permuted("(_blocks - 1)", "_blocks", f"{seed}, source_no, _pass", back=True)).otherwise(0)).withColumn("_lack", full - F.col("source_size"))
    plainly = F.ceil(F.col("_rest") / block_words)
    some = F.when(plainly <= F.col("_short_at"), plainly).otherwise(F.greatest(F.col("_short_at") + 1, F.ceil((F.col("_rest") + F.col("_lack")) / block_words)))
    reached = F.col("_some") * block_words - F.when(F.col("_some") > F.col("_short_at"), F.col("_lack")).otherwise(0)
    by_source = by_source.withColumn("_some", F.when(F.col("_rest") > 0, some).otherwise(0)).withColumn("_beyond", F.when(F.col("_some") > 0, reached - F.col("_rest")).otherwise(0)).withColumn("_quota", F.col("_pass") * F.col("_blocks") + F.col("_some"))
    by_source = written(by_source, "sources")
    n_sources, n_rows, slots = by_source.agg(F.count(F.lit(1)), F.sum("source_rows"), F.sum("_quota")).first()
    quotas = by_source
    # null has a key of its own, so that the join is an equal one
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    known = by_source.select(key.alias("_of"), "source_rows", "source_size", "target", "source_no")
    keyed = _numbered(rows).withColumn("_of", key)
    if n_sources <= BROADCAST_ROWS:
        told = keyed.join(F.broadcast(known), "_of", "left")
    else:
        told = attach(keyed, known, "_of", "source_rows", "_row", n_rows or 0)
    told = written(told.drop("_of", "source_rows"), "told")
    # a document's place in its source's stream: words of the chunks before, and of the rows before in its chunk
    chunks = max(1, (n_rows or 0) // CHUNK_ROWS)
    place = F.xxhash64(F.lit(seed), "_key", "_same")
    dealt = told.filter("_size > 0").select("_row", "id", "_size", "source_no", place.alias("_order"), F.col("_key").alias("_then"), "_same").withColumn("_chunk", F.pmod(F.xxhash64("_order", F.lit(seed)), F.lit(chunks)))
    sums = dealt.groupBy("source_no", "_chunk").agg(F.sum("_size").alias("_words"))
    offsets = before(sums, ["source_no"], "_chunk", "_words", "_offset").drop("_words")
    placed = dealt.withColumn("_in", F.sum("_size").over(Window.partitionBy("source_no", "_chunk").orderBy("_order", "_then", "_same", "_row")) - F.col("_size"))
    placed = placed.join(offsets, ["source_no", "_chunk"]).withColumn("_at", F.col("_offset") + F.col("_in"))
    pieces = (
        placed.withColumn("block", F.explode(F.expr(f"sequence(_at div {block_words}, (_at + _size - 1) div {block_words})")))
        .withColumn("word_from", F.greatest(F.lit(0), F.col("block") * block_words - F.col("_at")))
        .withColumn("word_to", F.least(F.col("_size"), (F.col("block") + 1) * block_words - F.col("_at")))
        .withColumn("_in_block", F.greatest(F.lit(0), F.col("_at") - F.col("block") * block_words))
        .select("source_no", "block", "_row", "id", "word_from", "word_to", "_in_block")
    )
    if not slots:
        picks = quotas.limit(0).select(F.lit(0).cast("long").alias("shard"), "source_no", F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("pass"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("_upto"))
    else:
        drawn = _draws(quotas.select("source_no", "_quota"), slots, shard_slots, seed).join(quotas.select("source_no", "_blocks", "_quota", "_short_at", "_lack", "_beyond", "_pass"), "source_no")
        # the last slot of a source ends where its target is reached
        last = F.expr(f"if(slot = _quota - 1, {block_words} - _beyond - if(_quota - 1 - _pass * _blocks = _short_at, _lack, 0), {block_words})")
        picks = (
            drawn.repartition(max(1, -(-slots // SLOTS_PER_TASK)), "shard", "source_no").select("*", F.explode(F.expr("sequence(_from, _from + _n - 1)")).alias("slot"))
            .withColumn("_upto", last)
            .withColumn("pass", F.expr("slot div _blocks"))
            .withColumn("_place", F.expr("slot % _blocks"))
            .withColumn("block", permuted("_place", "_blocks", f"{seed}, source_no, pass"))
            .select("shard", "source_no", "slot", "pass", "block", "_upto")
        )
    # both sides grow with the data, and the counts that picks are made from look small enough to broadcast
    mix = picks.join(pieces.hint("merge"), ["source_no", "block"]).withColumn("word_to", F.least("word_to", F.col("word_from") + F.col("_upto") - F.col("_in_block"))).filter("word_to > word_from")
    return told, mix.drop("_upto", "_in_block")


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: a row for each run of adjoining pieces of one document in one pass, with the columns of documents.

    The text is exactly the run's words and the white space between them; n_chars is counted anew. Rows of `docs` are told apart by a written row
    number, so that rows with a null or repeated doc_id give their own runs only.
    """
    rows = written(docs.select("doc_id", "text", "lang", "source", F.monotonically_increasing_id().alias("_at_row")), "rows")
    _, mix = mix_sources(rows, row_col="_at_row", **how)
    near = Window.partitionBy("_row", "pass").orderBy("word_from")
    runs = (
        mix.select("_row", "pass", "word_from", "word_to")
        .withColumn("_new", F.when(F.lag("word_to").over(near) == F.col("word_from"), 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(near))
        .groupBy("_row", "pass", "_run").agg(F.min("word_from").alias("_from"), F.max("word_to").alias("_to"))
        .groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_from", "_to", "pass"))).alias("_runs"))
    )
    words = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    out = (
        rows.join(runs, F.col("_at_row") == F.col("_row"))
        .withColumn("_words", words)
        .withColumn("_cut", F.explode(F.expr("transform(_runs, r -> array_join(slice(_words, cast(r._from + 1 as int), cast(r._to - r._from as int)), ''))")))
    )
    cut = F.regexp_replace("_cut", r"^[\x20\x09-\x0D]+", "")
    return out.select("doc_id", cut.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, mix = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = mix.groupBy("_row").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    return told.join(taken, "_row", "left").select(F.col("id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


QUERIES = {"op3_mix_sources": op3_mix_sources}
ORACLES: dict[str, str] = {}
