"""Personal data, by weak supervision, with DataFrame and SQL functions only.

Patterns propose spans. Four labelers vote on each: a format check, gazetteers (mail domains, calling codes, issuers, ...), the words on the
left and the text on the right. Expectation-maximisation over the counts of vote patterns estimates how far each labeler can be trusted, and the
posteriors train a logistic span classifier whose weights become a plain SQL expression. Spans of the base kinds
(email, ip, card, phone) that pass their format check always stay; spans of the further kinds stay if the classifier says so.

Only counts of (kind, votes, length class) reach the driver: never more than KINDS x 3^4 x 4 rows, whatever the input.

Positions are code points, ends exclusive. Null text is empty text. Matches are leftmost and do not overlap within a kind; a match that fails its
check is dropped and not tried again in part. Rows that repeat an id are separate rows of the result. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.llm.common import text_of, written

_MAIL = "A-Za-z0-9._%+-"
#: kind: (text that must be there at all, pattern). Quantifiers are possessive, and a match starts only where a run of its characters does, so
#: that a long run takes linear time and no deep stack; the matches are those of the plain patterns.
BASE = {
    "email": ("@", rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
FURTHER = {
    "mail_words": (" at ", r"\b[A-Za-z][A-Za-z0-9._-]{1,40} (?:at|\(at\)|\[at\]) [A-Za-z0-9-]{2,40} (?:dot|\(dot\)|\[dot\]) [A-Za-z]{2,10}\b"),
    "local_phone": ("", r"(?<![0-9.-])(?<!\+[0-9 .()-]{0,8})(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"),
    "ssn": ("-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": ("", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "name": (".", r"\b(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?\b"),
}
KINDS = [*BASE, *FURTHER]
DIGIT_KINDS = ("ip", "card", "phone", "local_phone", "ssn", "iban")

# Gazetteers and context words of the labelers.
MAIL_ENDS = "com|org|net|edu|gov|io|info|de|fr|es|it|uk|nl|eu|ch|at|us|ca|br|in|cn|jp|mx"
CALLING_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-9]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|85[0-9]|88[0-9]|96[0-9]|97[0-9]|99[0-9]"
GIVEN_NAMES = "Anna|Anne|Carlos|Claire|David|Elena|Emma|Hans|Jan|Jean|John|Jose|Julia|Karl|Laura|Luis|Maria|Marie|Mark|Martin|Mary|Michael|Paul|Peter|Pierre|Robert|Sarah|Sofia|Thomas|William"
SPEAKS_FOR = r"(?i)\b(?:e-?mail|mail|contact|write|reach|phone|tel|telephone|call|fax|mobile|cell|whatsapp|card|visa|mastercard|amex|payment|pay|ip|host|address|server|client|from|ssn|social|security|iban|account|name|dear|signed|by)\W{1,4}$"
SPEAKS_AGAINST = r"(?i)(?:\b(?:version|ver|build|release|section|isbn|order|invoice|serial|figure|table|chapter|page|hash|checksum)\W{1,3}|[\w#=/])$"
RIGHT_FOR = r"(?i)^\W{1,3}(?:ext|mobile|office|home|work|exp|cvv|cvc|valid|or|and)\b"
RIGHT_AGAINST = r"^(?:\w|[/=])"


def _list(kind: str) -> Column:
    """The kind's matches with their gaps: [(kind, i, match, gap, left, right)], null where there are none."""
    return F.expr(f"""if(size(_m_{kind}) > 0, transform(_m_{kind}, (m, i) -> struct('{kind}' AS kind, i AS i, m AS match, length(_s_{kind}[i]) AS gap,
        right(_s_{kind}[i], 32) AS left, substring(_s_{kind}[i + 1], 1, 16) AS right)), array())""")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, id, kind, i, match, gap, left, right): every pattern's matches; one row without a kind for a document that has none.

    `gap` is the length of the text between the match before (of its kind) and this one: splitting the text at the matches gives the
    gaps, and their running sum the positions, without a search for each match.
    """
    some_digits = F.col("_text").rlike("[0-9]")
    lean = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), text_of(text_col).alias("_text")).withColumn("_digits", some_digits)
    found = []
    for kind, (must, pattern) in {**BASE, **FURTHER}.items():
        here = F.lit(True) if not must else F.contains("_text", F.lit(must))
        here = here & F.col("_digits") if kind in DIGIT_KINDS else here
        found.append(F.when(here, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).alias(f"_m_{kind}"))
    matched = lean.select("_row", "id", "_text", *found)
    cut = [F.when(F.size(f"_m_{kind}") > 0, F.split("_text", pattern, -1)).alias(f"_s_{kind}") for kind, (_, pattern) in {**BASE, **FURTHER}.items()]
    pieces = matched.select("_row", "id", *(f"_m_{k}" for k in KINDS), *cut)
    return pieces.select("_row", "id", F.explode_outer(F.flatten(F.array(*map(_list, KINDS)))).alias("c")).select("_row", "id", "c.*")


def _digits() -> Column:
    return F.regexp_replace("match", "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check: from the right, every second one counts double, less 9 if that is above 9."""
    value = lambda c: F.aggregate(
        F.transform(F.split(F.reverse(c), ""), lambda x, i: F.coalesce(x.try_cast("int"), F.lit(0)) * (1 + i % 2)), F.lit(0), lambda total, x: total + x - F.when(x > 9, 9).otherwise(0)
    )
    return value(digits) % 10 == 0


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(spans: DataFrame) -> DataFrame:
    """Adds the labelers' votes (-1, 0, 1) and the length class."""
    n, kind = F.length(_digits()), F.col("kind")
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    passes = (
        F.when(kind == "ip", F.col("match").rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", F.when(n.between(12, 19), _luhn(_digits())).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .when(kind == "ssn", ~F.col("match").rlike("^(?:000|666|9)|-00-|-0000$"))
        .when(kind == "iban", F.length(F.regexp_replace("match", " ", "")).between(15, 34))
        .otherwise(True)
    )
    known = (
        F.when(kind == "email", _vote(F.col("match").rlike(rf"(?i)\.(?:{MAIL_ENDS})$"), F.col("match").rlike(r"\.[0-9]+$")))
        .when(kind == "ip", _vote(~F.col("match").rlike(r"^0*(?:0|10|127|2[2-5][0-9])\."), F.col("match").rlike(r"^0*(?:0|127|2[2-5][0-9])\.")))
        .when(kind == "card", _vote(F.col("match").rlike("^[3-6]"), F.col("match").rlike("^[0178]")))
        .when(kind == "phone", _vote(F.col("match").rlike(rf"^\+(?:{CALLING_CODES})"), F.col("match").rlike(r"^\+0")))
        .when(kind == "mail_words", _vote(F.col("match").rlike(rf"(?i) (?:{MAIL_ENDS})$"), F.lit(False)))
        .when(kind == "local_phone", _vote(F.col("match").rlike(r"^\(?[2-9]"), F.col("match").rlike(r"^\(?[01]")))
        .when(kind == "name", _vote(F.col("match").rlike(rf"\b(?:{GIVEN_NAMES})\b"), F.lit(False)))
        .otherwise(0)
    )
    return (
        spans.withColumn("v_format", F.when(passes, 1).otherwise(-1))
        .withColumn("v_known", known)
        .withColumn("v_left", _vote(F.col("left").rlike(SPEAKS_FOR), F.col("left").rlike(SPEAKS_AGAINST)))
        .withColumn("v_right", _vote(F.col("right").rlike(RIGHT_FOR), F.col("right").rlike(RIGHT_AGAINST)))
        .withColumn("size_class", F.least(F.lit(3), F.expr("length(match) div 8")))
    )


VOTES = ("v_format", "v_known", "v_left", "v_right")


def reliabilities(patterns: list[tuple], rounds: int = 50) -> tuple[list[float], dict]:
    """Expectation-maximisation: (kind, votes, size class, count) rows to each row's posterior and each labeler's vote shares by truth.

    A span is personal data or not; given that, labelers vote independently. Every kind has its own share of true spans.
    The start trusts each labeler a little; counts are smoothed, so a labeler that never votes stays neutral.
    """
    trust = {(v, y): {1: 0.5, 0: 0.3, -1: 0.2} if y else {1: 0.2, 0: 0.3, -1: 0.5} for v in range(len(VOTES)) for y in (0, 1)}
    share = {kind: 0.5 for kind, *_ in patterns}
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for kind, cast, _, _ in patterns:
            odds = math.log(share[kind] / (1 - share[kind])) + sum(math.log(trust[v, 1][x] / trust[v, 0][x]) for v, x in enumerate(cast))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        for kind in share:
            mine = [(p, n) for p, (k, _, _, n) in zip(post, patterns) if k == kind]
            share[kind] = (1 + sum(p * n for p, n in mine)) / (2 + sum(n for _, n in mine))
        for v, y in trust:
            seen = {1: 1.0, 0: 1.0, -1: 1.0}
            for p, (_, cast, _, n) in zip(post, patterns):
                seen[cast[v]] += n * (p if y else 1 - p)
            trust[v, y] = {x: c / sum(seen.values()) for x, c in seen.items()}
    return post, trust


def _inputs(kind: str, cast: tuple, size: int) -> list[str]:
    return ["bias", f"kind:{kind}", f"size:{size}", *(f"{VOTES[v]}:{x}" for v, x in enumerate(cast) if x)]


def classifier(patterns: list[tuple], post: list[float], rounds: int = 300, rate: float = 1.0, decay: float = 1e-3) -> dict[str, float]:
    """Logistic regression on the posteriors, over rows weighted by count (as shares of all): the weight of each input."""
    weights: dict[str, float] = {}
    total = sum(n for *_, n in patterns) or 1
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for (kind, cast, size, n), p in zip(patterns, post):
            inputs = _inputs(kind, cast, size)
            guess = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(x, 0.0) for x in inputs)))))
            for x in inputs:
                slope[x] = slope.get(x, 0.0) + (p - guess) * n / total
        for x, s in slope.items():
            weights[x] = weights.get(x, 0.0) + rate * (s - decay * weights.get(x, 0.0))
    return weights


def _probability(weights: dict[str, float]) -> Column:
    total = F.lit(weights.get("bias", 0.0))
    for name, weight in sorted(weights.items()):
        what, _, value = name.partition(":")
        if value:
            column = {"kind": "kind", "size": "size_class"}.get(what, what)
            total = total + F.when(F.col(column) == (value if what == "kind" else int(value)), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(_row, id, kind, kind_no, start, end, match, base, probability): the spans that stay; one row without a kind for a document that has none."""
    voted = written(votes(candidates(docs, id_col, text_col)).drop("left", "right"), "spans")
    # at most len(KINDS) * 3**4 * 4 rows
    counted = voted.filter("kind IS NOT NULL").groupBy("kind", *VOTES, "size_class").count().collect()
    patterns = sorted((r["kind"], tuple(r[v] for v in VOTES), r["size_class"], r["count"]) for r in counted)
    post, _ = reliabilities(patterns)
    weights = classifier(patterns, post)
    kind_no = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    before = Window.partitionBy("_row", "kind").orderBy("i")
    placed = (
        voted.repartition("_row")
        .withColumn("end", F.sum(F.col("gap") + F.length("match")).over(before))
        .withColumn("start", F.col("end") - F.length("match"))
        .withColumn("base", F.col("kind").isin(*BASE))
        .withColumn("probability", _probability(weights))
    )
    stays = F.when(F.col("base"), F.col("v_format") == 1).otherwise((F.col("v_format") == 1) & (F.col("probability") >= least))
    # what doesn't stay leaves a row without a kind, so that every document is still there
    keep = lambda c: F.when(stays, F.col(c)).alias(c)
    return placed.withColumn("kind_no", kind_no).select("_row", "id", *map(keep, ("kind", "kind_no", "start", "end", "match", "base", "probability")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = F.struct("start", "kind_no", F.concat_ws(":", "kind", "start", "end").alias("said"))
    joined = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, listed))), lambda x: x["said"]), ",")
    base = F.coalesce("base", F.lit(False))
    counts = [F.count(F.when(base & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE]
    return spans.groupBy("_row", "id").agg(*counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("kind").isNotNull()).alias("spans")).drop("_row").withColumnRenamed("id", "doc_id")


QUERIES = {"op2_pii": op2_pii}
ORACLES: dict[str, str] = {}
