"""Spelling variant grouping: words that differ by one letter, found in a trie of letter counts.

A word becomes a vector of counts: how often it holds letters of each of LEVELS coarse groups, then of each of FINE finer ones. One
inserted, deleted or replaced letter changes such a vector by at most one count more (a surplus) and one less (a deficit). Words are arranged
in a trie, a level for each group in turn, and a search goes down depth-first: a branch is left when the way to it has spent more than one
surplus and one deficit. Words of the leaves that are reached are compared letter by letter.

The upper levels of the trie are dealt by Spark. The counts of the first groups name a shard, as many of them as it takes for the largest shard to hold
at most `shard_words` words; a word goes to its own shard as a member, and as a query to each shard that one surplus and one deficit lead to,
in one of the two directions, since the other one finds the same pair. A task then searches the rest of the trie, all its queries together, so that a
node costs a few numpy calls and not one for each query. A shard reports for each word how many near words it saw and the best of them,
so what is exchanged grows with the words and not with the pairs.

Words are counted over all texts by a partial aggregate, so a word that makes up a third of them is no hot key. Null texts have no words; a null id is
written as an empty one in the check sum; rows that repeat count again; other columns are ignored; an empty table gives no rows. Of near words
with the same count the first in code-point order is the form. Counts in a vector stop at 127, which lets more words through to the comparison and loses none.
Words with equal vectors over all groups (permutations of the same letters) meet by equal halves only, as one change leaves the
first or the last half as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import release, written

LETTERS = "[A-Za-zÀ-ÿ]+"
#: Code points and occurrences that a word needs at least; how many times more often a form occurs than its variant.
LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
#: One run in so many loses a letter.
DELETE_ONE_IN = 199
#: Coarse and fine groups of letters; words of a shard and of a leaf.
LEVELS, FINE, SHARD_WORDS, LEAF = 12, 32, 5_000, 64
MOST = 127

# letters by how often European texts hold them, dealt to the groups there and back so that each group is about as frequent
_BY_USE = "etaoinshrdlcumwfgypbvkjxqz"
_COARSE_OF = {c: (i if i < LEVELS else 2 * LEVELS - 1 - i if i < 2 * LEVELS else i % LEVELS) for i, c in enumerate(_BY_USE)} | {chr(p): p % LEVELS for p in range(0xC0, 0x100)}
_GROUPS = ["".join(c for c, g in _COARSE_OF.items() if g == i) for i in range(LEVELS)]
_COARSE = np.zeros(256, np.int64)
_FINE = np.zeros(256, np.int64)
for _c, _g in _COARSE_OF.items():
    _COARSE[ord(_c)] = _g
    _FINE[ord(_c)] = _BY_USE.index(_c) if _c in _BY_USE else 26 + ord(_c) % (FINE - 26)


def lowered(run: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    plain = F.translate(run, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(run.rlike("[À-Þ]"), plain).otherwise(F.lower(run))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all texts, one run in DELETE_ONE_IN with a letter deleted as the check sum of id and run says."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), F.lit(0))).alias("_run"))
    runs = runs.filter(F.length("_run") >= least_letters).select("_id", lowered(F.col("_run")).alias("_run"))
    h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    words = runs.withColumn("_h", h).select(F.when(F.col("_h") % DELETE_ONE_IN == 0, cut).otherwise(F.col("_run")).alias("word"))
    return words.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def near(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def vectors(words: list[str]) -> np.ndarray:
    """The counts of letters by coarse, then by fine groups, a row for each word."""
    at = np.repeat(np.arange(len(words)), [len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    out = np.zeros((len(words), LEVELS + FINE), np.int8)
    for groups, first, width in ((_COARSE, 0, LEVELS), (_FINE, LEVELS, FINE)):
        counts = np.bincount(at * width + groups[codes], minlength=len(words) * width).reshape(len(words), width)
        out[:, first : first + width] = np.minimum(counts, MOST)
    return out


def _halves(word: str) -> Iterator[tuple]:
    """Keys of which two near words share one: a half of the shorter, at the front or at the back."""
    for n in (len(word), len(word) - 1):
        yield n, 0, word[: n // 2]
        yield n, 1, word[len(word) - (n - n // 2) :]


class Trie:
    """A trie over the words' vectors; its nodes are runs of the words in the order of their vectors."""

    def __init__(self, words: list[str], leaf: int = LEAF):
        found = vectors(words)
        order = np.lexsort(found.T[::-1])
        self.words, self.vectors, self.leaf = [words[i] for i in order], found[order], leaf

    def pairs(self, queries: list[str]) -> Iterator[tuple[int, str]]:
        """(index of query, near word): all of them, by one depth-first walk of all queries together."""
        if self.words and queries:
            none = np.zeros(len(queries), np.int8)
            yield from self._below(0, len(self.words), 0, np.arange(len(queries)), none, none, queries, vectors(queries))

    def _below(self, lo, hi, level, live, surplus, deficit, queries, counts):
        if level == LEVELS:  # the fine groups part the same letters again, with a budget of their own
            surplus, deficit = np.zeros_like(surplus), np.zeros_like(deficit)
        if level == LEVELS + FINE:
            yield from self._same_letters(lo, hi, live, queries)
        elif hi - lo <= self.leaf:
            yield from self._leaf(lo, hi, live, queries, counts)
        else:
            column = self.vectors[lo:hi, level]
            cuts = lo + np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [hi - lo]])
            asked = counts[live, level].astype(np.int16)
            for a, b in zip(cuts, cuts[1:]):
                off = asked - int(self.vectors[a, level])
                more, less = surplus + np.maximum(off, 0), deficit + np.maximum(-off, 0)
                go = np.flatnonzero((more <= 1) & (less <= 1))
                if len(go):
                    yield from self._below(int(a), int(b), level + 1, live[go], more[go].astype(np.int8), less[go].astype(np.int8), queries, counts)

    def _leaf(self, lo, hi, live, queries, counts):
        held = self.vectors[lo:hi, LEVELS:].astype(np.int16)
        for i in range(0, len(live), 512):
            some = live[i : i + 512]
            off = counts[some, LEVELS:].astype(np.int16)[:, None, :] - held[None, :, :]
            fits = (np.maximum(off, 0).sum(2) <= 1) & (np.maximum(-off, 0).sum(2) <= 1)
            for q, w in zip(*np.nonzero(fits)):
                if near(queries[some[q]], self.words[lo + w]):
                    yield int(some[q]), self.words[lo + w]

    def _same_letters(self, lo, hi, live, queries):
        by_half: dict[tuple, list[str]] = {}
        for word in self.words[lo:hi]:
            for key in set(_halves(word)):
                by_half.setdefault(key, []).append(word)
        for q in live.tolist():
            for word in {w for key in set(_halves(queries[q])) for w in by_half.get(key, ())}:
                if near(queries[q], word):
                    yield q, word


def _searched(leaf: int):
    fields = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def run(shard: pa.Table) -> pa.Table:
        release()
        words, ns, member = (shard.column(c).to_pylist() for c in ("word", "n", "member"))
        count_of = dict(zip(words, ns))
        queries = list(dict.fromkeys(words))  # members search their own shard too
        own = {w for w, m in zip(words, member) if m}
        seen: dict[str, tuple[int, int, str]] = {}

        def see(word, other):
            n_near, n, best = seen.get(word, (0, 0, ""))
            n_other = count_of[other]
            if n_other > n or (n_other == n and other < best):
                n, best = n_other, other
            seen[word] = n_near + 1, n, best

        for q, word in Trie(sorted(own), leaf).pairs(queries):
            query = queries[q]
            if query not in own or query < word:  # of two members either would find the other
                see(query, word)
                see(word, query)
        return pa.Table.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[i] for v in seen.values()], f.type) for i, f in enumerate(list(fields)[1:]))], schema=fields)

    return run


def _counts_of_groups(word: str = "word") -> list[Column]:
    return [F.least(F.lit(MOST), F.length(word) - F.length(F.translate(word, letters, ""))).alias(f"g{i}") for i, letters in enumerate(_GROUPS)]


def _depth(words: DataFrame, shard_words: int) -> int:
    """How many of the first groups it takes for every shard to hold at most `shard_words` words."""
    names = [f"g{i}" for i in range(LEVELS)]
    vectors_ = words.select(*_counts_of_groups()).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    largest = vectors_.rollup(*names).agg(F.sum("_n").alias("_n"), F.grouping_id().alias("_g")).groupBy("_g").agg(F.max("_n").alias("_n"))
    fits = [LEVELS - bin(r["_g"]).count("1") for r in largest.collect() if r["_n"] is None or r["_n"] <= shard_words]
    return min(fits, default=LEVELS)


def _ways(depth: int) -> list[tuple[int, ...]]:
    """The changes of the first `depth` counts by one surplus and one deficit at most, those of which the first is a surplus."""
    ways = [(0,) * depth]
    for i in range(depth):
        ways.append(tuple(int(k == i) for k in range(depth)))
        ways += [tuple(int(k == i) - int(k == j) for k in range(depth)) for j in range(i + 1, depth)]
    return ways


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, leaf: int = LEAF) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near words: how many, and the most frequent of them."""
    depth = _depth(words, shard_words)
    ways = F.array(*(F.array(*(F.lit(d) for d in way)).cast("array<int>") for way in _ways(depth)))
    at = F.array(*_counts_of_groups()[:depth]).cast("array<int>")
    dealt = words.select("word", "n", at.alias("_at"), F.explode(ways).alias("_way"))
    dealt = dealt.select("word", "n", F.zip_with("_at", "_way", lambda a, d: a + d).alias("shard"), (~F.exists("_way", lambda d: d != 0)).alias("member"))
    found = dealt.filter(F.forall("shard", lambda c: c >= 0)).groupBy("shard").applyInArrow(_searched(leaf), "word string, n_near long, best_n long, best string")
    best = F.max(F.struct("best_n")).getField("best_n")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best_n"), F.min(F.struct((-F.col("best_n")).alias("k"), "best")).getField("best").alias("best"))
    return merged


def grouped(words: DataFrame, shard_words: int = SHARD_WORDS, leaf: int = LEAF, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of `words` (word, n): its most frequent near word, if that occurs `times` as often."""
    found = words.join(near_words(words, shard_words, leaf), "word", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    forms = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    # forms occur `times` as often at each step, so the way to a root is short and each round doubles what is known of it
    linked = forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        onward = linked.select(F.col("word").alias("_via"), F.col("root").alias("_next"))
        linked = written(linked.join(onward, F.col("root") == F.col("_via"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if not linked.filter("_moved").limit(1).count():
            break
        linked = linked.drop("_moved")
    return forms.join(linked.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of all texts with their forms and roots."""
    return grouped(written(word_counts(docs, id_col, text_col), "words"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLES: dict[str, str] = {}
