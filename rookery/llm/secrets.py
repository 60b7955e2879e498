"""Secret scan: candidates from plain patterns, and a random forest that removes false positives; DataFrame and SQL functions only.

Candidates are values assigned to a name with a telling part (token = "...", DB_PASSWORD=..., secret_key_base: ...), tokens of known vendors' formats, private key blocks
through their END line (without one, as far as lines of base 64 follow), bearer headers and passwords in urls; all of them whole, however long. For each the forest sees
its length, how likely its character transitions are, how much of it dictionary words cover, the path it stands in (test, example and documentation folders and such),
and the words around it. Transitions and dictionary are counted over the words of all documents: the likelihood of each letter after each other one, and the
DICTIONARY most frequent words of four letters or more.

The forest is trained on labelled findings: a table of the caller's, (match, left, right, path, label) rows of which at most `max_labelled` are taken. Without one, MADE
findings stand in whose labels are known because of how they were made, from a hash of their number: random keys, vendors' tokens, key blocks and passwords as secrets; words of the
dictionary, names, placeholders, counted and repeated patterns, versions, paths, references and checksums as none. They stand in WINDOWS places of real documents, dealt to both
labels alike; some speak of what they are besides: secrets by words or none, at times by one that rather means the contrary, checksums by several words or by their name.
What a neighbouring word or a part of the name means is learnt: the log odds of the labels of the findings that it stands beside. Words within addresses, hosts and paths don't count.
No label follows from a rule over the features. Findings that the forest gives less than `least` are removed.

Trees are trained by Spark's own random forest on DataFrames and read back as SQL expressions, so that scoring is a projection.

Null text is empty text; documents without findings have no rows. Rows that repeat an id give their findings again. The path is the `path_col` of the
input if it is named, else the last thing like a path before the candidate. Positions are code points, ends exclusive. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.llm.common import text_of, written

MAX_LABELLED, TREES, DEPTH, LEAST, SEED = 20_000, 24, 6, 0.5, 97
#: Words of the dictionary; made findings; log likelihood of a transition that isn't between letters.
DICTIONARY, MADE, ODD = 20_000, 4_000, -6.0
#: Characters of the text on either side that the forest may look at.
AROUND = 64

# Names that announce a secret, vendors' formats, signs of placeholders, folders of samples.
NAMES = "api[_-]?key|apikey|access[_-]?key|secret[_-]?key|client[_-]?secret|secret|auth[_-]?token|access[_-]?token|token|passwd|password|pwd|credentials?|private[_-]?key"
VENDORS = (
    r"\bAKIA[0-9A-Z]{16}\b|\bASIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}+\b|\bglpat-[A-Za-z0-9_-]{20,}\b|\bxox[abprs]-[A-Za-z0-9-]{10,}\b|\bAIza[A-Za-z0-9_-]{35}\b"
    r"|\bsk_live_[A-Za-z0-9]{16,}+\b|\brk_live_[A-Za-z0-9]{16,}+\b|\bSG\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}\b|\bnpm_[A-Za-z0-9]{36}\b|\beyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
)
# Loops are possessive wherever what follows can't be part of them, so that long texts need neither stack nor second tries.
IDENTIFIER = "[A-Za-z0-9_-]"
SIGN = r"[\"']?[\x20\t]*+(?>=>|:=|=|:)[\x20\t]*+[\"']?"
#: A whole identifier and its sign, of which the identifier has one of NAMES anywhere; names are looked for only where a sign follows.
NAMED = rf"(?={IDENTIFIER}++{SIGN})(?={IDENTIFIER}*?(?:{NAMES})){IDENTIFIER}++{SIGN}"
_KEY = "[A-Z0-9\\x20]*?PRIVATE KEY(?: BLOCK)?-----"
KEY_BLOCK = rf"-----BEGIN {_KEY}(?:(?:[^-]++|-(?!----(?:BEGIN|END)\x20))*+-----END {_KEY}|(?:(?:\\[nr]|[\s\"'+,])++[A-Za-z0-9+/=]{{40,}}+)*+)"
PATTERN = (
    rf"(?i:(?<!{IDENTIFIER}){NAMED}(?:bearer[\x20\t]++)?)(?:{KEY_BLOCK}|[A-Za-z0-9_./+~=!@#$%^&*-]{{6,}}+)"
    rf"|(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s:@/\"'<>]*+:[^\s:@/\"'<>]{{3,}}+(?=@)"
    rf"|{VENDORS}|(?i:\bbearer[\x20\t]++)[A-Za-z0-9_./+~=-]{{16,}}+|{KEY_BLOCK}"
)
PLACEHOLDER = r"(?i)example|sample|placeholder|changeme|change_me|your[_-]|dummy|fake|redacted|xxxx|\*\*\*\*|\.\.\.\.|<|\$\{|%\(|123456|abcdef|password|secret|test|todo|none|null|true|false|undefined|foobar|lorem"
#: What a path of a url begins with; it is no folder.
HOST = r"^(?:[A-Za-z]+:)?/*[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+(?::[0-9]+)?/"
SAMPLE_PATHS = r"(?i)(?:^|[/._-])(?:tests?|specs?|examples?|samples?|docs?|fixtures?|mocks?|demo|tutorial|templates?)(?:[/._-]|$)"
#: Words that stand alone: no part of an address, a host, a path or a longer name.
ALONE = r"(?<![\w.@/:+-])[a-z][a-z0-9]++(?![@/]|[.:-]\w)"
#: Characters next to a finding whose words count; findings that a word needs to mean anything, and how far its odds must lean; the places in documents where made findings stand.
BESIDE, LEAST_SEEN, MEANT, WINDOWS = 28, 20, 1.5, 2_000


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(_row, id, i, gap, match, left, right, path): the leftmost, non-overlapping matches; gap is the text's length since the one before."""
    lean = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), text_of(text_col).alias("_text"), (F.col(path_col) if path_col else F.lit(None)).cast("string").alias("_path"))
    hit = lean.filter(F.col("_text").rlike(PATTERN)).withColumn("_m", F.regexp_extract_all("_text", F.lit(PATTERN), F.lit(0)))
    cut = hit.select("_row", "id", "_path", "_m", F.split("_text", PATTERN, -1).alias("_s"))
    rows = cut.select("_row", "id", "_path", F.explode(F.expr(f"transform(_m, (m, i) -> struct(i AS i, length(_s[i]) AS gap, m AS match, right(_s[i], {4 * AROUND}) AS far, substring(_s[i + 1], 1, {AROUND}) AS right))")).alias("c")).select("_row", "id", "_path", "c.*")
    near_path = F.regexp_extract("far", r"(?s).*?([A-Za-z0-9_.-]{0,60}(?:/[A-Za-z0-9_.-]{1,60}){1,12})(?!.*/)", 1)
    return rows.withColumn("path", F.coalesce("_path", near_path)).withColumn("left", F.expr(f"right(far, {AROUND})")).drop("_path", "far")


def value() -> Column:
    """The secret itself: the match without the name, the sign and the quote before it."""
    return F.regexp_replace("match", rf"^(?i:bearer[\x20\t]+|{NAMED}(?:bearer[\x20\t]+)?|[a-z][a-z0-9+.-]*+://[^\s:@/]*+:)", "")


def _count(col: str, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern)).cast("double")


FEATURES = ("length", "distinct", "transitions", "digit_letter", "class_changes", "upper_share", "digit_share", "hex_share", "repeats", "word_cover", "placeholder", "vendor", "named", "in_sample_path", "has_path", "near_odds", "name_odds", "quoted")


def language(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[float]]:
    """Counted over the words of all documents: the dictionary (word), and log likelihoods of letter b after letter a at place 26 a + b."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_of(text_col)), F.lit("[a-z]{3,}+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = written(words, "words")
    dictionary = words.filter("length(word) >= 4").orderBy(F.desc("n"), "word").limit(DICTIONARY).select("word")
    pairs = words.select("n", F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    seen = {r.pair: r.n for r in pairs.collect()}  # 26 * 26 rows at most
    letters = "abcdefghijklmnopqrstuvwxyz"
    total = {a: sum(seen.get(a + b, 0) for b in letters) for a in letters}
    return dictionary, [math.log((seen.get(a + b, 0) + 0.5) / (total[a] + 13)) for a in letters for b in letters]


def _words(found: DataFrame) -> DataFrame:
    """(_no, named, word): the words that stand alone beside each finding, and the parts of its name; each once."""
    beside = F.concat(F.expr(f"right(left, {BESIDE})"), F.lit(" \n "), F.expr(f"substring(right, 1, {BESIDE})"))
    alone = F.regexp_extract_all(F.lower(beside), F.lit(ALONE), F.lit(0))
    name = F.lower(F.regexp_replace(F.regexp_extract("match", rf"^(?i)({IDENTIFIER}++)(?={SIGN})", 1), "(?<=[a-z0-9])(?=[A-Z])", "_"))
    each = F.concat(F.transform(F.array_distinct(alone), lambda w: F.struct(F.lit(False).alias("named"), w.alias("word"))), F.transform(F.filter(F.array_distinct(F.split(name, "[_-]+")), lambda w: w != ""), lambda w: F.struct(F.lit(True).alias("named"), w.alias("word"))))
    return found.select("_no", F.explode(each).alias("_w")).select("_no", "_w.named", "_w.word")


def learn_words(labelled: DataFrame) -> DataFrame:
    """(named, word, odds): the log odds of label 1 beside each word, against those of all findings. `labelled` has match, left, right, label; its size bounds the table."""
    known = written(labelled.withColumn("_no", F.monotonically_increasing_id()), "labelled")
    total = known.agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")).first()
    p, n = (total.p or 0.0) + 4, (total.n or 0.0) + 4
    counted = _words(known).join(known.select("_no", "label"), "_no").groupBy("named", "word").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    odds = F.log((F.col("p") + 4 * p / (p + n)) / p) - F.log((F.col("n") + 4 * n / (p + n)) / n)
    told = counted.filter(F.col("p") + F.col("n") >= LEAST_SEEN).select("named", "word", odds.alias("odds"))
    return told.filter(F.abs("odds") >= MEANT)  # less than that is chance


def features(found: DataFrame, dictionary: DataFrame, likely: list[float], odds: DataFrame) -> DataFrame:
    """Adds FEATURES, all double and never null."""
    n = F.greatest(F.lit(1), F.length("_v")).cast("double")
    known = found.withColumn("_v", value()).withColumn("path", F.coalesce("path", F.lit(""))).withColumn("_no", F.monotonically_increasing_id())
    known = written(known, "candidates")
    # a word is one row of the labelled findings' at least LEAST_SEEN, so there are fewer than those findings have words
    spoken = _words(known).join(F.broadcast(odds), ["named", "word"]).groupBy("_no").agg(F.sum(F.when(F.col("named"), F.col("odds"))).alias("_name"), F.sum(F.when(~F.col("named"), F.col("odds"))).alias("_near"))
    known = known.join(spoken, "_no", "left")
    # dictionary words among the value's runs of letters; the dictionary holds DICTIONARY words at most
    runs = known.select("_no", F.explode(F.regexp_extract_all(F.lower("_v"), F.lit("[a-z]{4,}+"), F.lit(0))).alias("word"))
    covered = runs.join(F.broadcast(dictionary), "word").groupBy("_no").agg(F.sum(F.length("word")).alias("_covered"))
    known = known.join(covered, "_no", "left")
    flag = lambda col, pattern: F.col(col).rlike(pattern).cast("double")
    table = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in likely) + "]"), "array<double>")
    letter = lambda at: F.ascii(F.substring(F.lower("_v"), at, F.lit(1))) - 97
    step = lambda i: F.when(letter(i).between(0, 25) & letter(i + 1).between(0, 25), F.get(table, letter(i) * 26 + letter(i + 1))).otherwise(F.lit(ODD))
    chain = F.aggregate(F.when(F.length("_v") > 1, F.sequence(F.lit(1), F.length("_v") - 1)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda total, i: total + step(i))
    return known.select(
        "*", F.length("_v").cast("double").alias("length"),
        (F.size(F.array_distinct(F.split("_v", ""))) / n).alias("distinct"),
        F.coalesce(chain / F.greatest(F.lit(1.0), n - 1), F.lit(ODD)).alias("transitions"),
        (_count("_v", "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])") / n).alias("digit_letter"),
        (_count("_v", "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])") / n).alias("class_changes"),
        (_count("_v", "[A-Z]") / n).alias("upper_share"), (_count("_v", "[0-9]") / n).alias("digit_share"), (_count("_v", "[0-9a-fA-F]") / n).alias("hex_share"),
        (_count("_v", r"(.)(?=\1)") / n).alias("repeats"), (F.coalesce("_covered", F.lit(0)) / n).alias("word_cover"),
        flag("_v", PLACEHOLDER).alias("placeholder"), flag("_v", f"^(?:{VENDORS}|-----BEGIN )").alias("vendor"), flag("match", rf"(?i)^{NAMED}").alias("named"),
        F.regexp_replace("path", HOST, "/").rlike(SAMPLE_PATHS).cast("double").alias("in_sample_path"), (F.length("path") > 0).cast("double").alias("has_path"),
        F.coalesce("_near", F.lit(0.0)).alias("near_odds"), F.coalesce("_name", F.lit(0.0)).alias("name_odds"), flag("right", "^[\"']").alias("quoted"),
    ).drop("_no", "_covered", "_near", "_name")


def windows(docs: DataFrame, text_col: str = "text", most: int = WINDOWS) -> DataFrame:
    """(_w, before, after): a place in each of `most` documents, those with the smallest hashes of their texts; the characters on either side. At least one row."""
    text = text_of(text_col)
    at = F.pmod(F.xxhash64(text, F.lit(SEED)), F.length(text) + 1).cast("int")
    around = F.struct(F.xxhash64(text).alias("h"), F.substring(text, F.greatest(F.lit(1), at - AROUND + 1), F.least(at, F.lit(AROUND))).alias("before"), F.substring(text, at + 1, F.lit(AROUND)).alias("after"))
    chosen = docs.select(around.alias("x")).select("x.*").orderBy("h", "before", "after").limit(most).unionByName(docs.sparkSession.sql("SELECT 0L AS h, '' AS before, '' AS after"))
    # numbered in one task, as there are `most` rows and one
    return chosen.select((F.row_number().over(Window.orderBy("h", "before", "after")) - 1).alias("_w"), "before", "after")


def made_findings(spark: SparkSession, dictionary: DataFrame, count: int = MADE, seed: int = SEED, places: DataFrame | None = None) -> DataFrame:
    """(match, left, right, path, label): findings whose label is known from how they are made, drawn by the hash of their number, in the given places of documents."""
    places = written(places if places is not None else windows(spark.createDataFrame([], "text string")), "windows")
    n_places = places.count()
    i = F.col("id")
    draw = lambda what, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), i), F.lit(n)).cast("int")
    pick = lambda what, values: F.element_at(F.split(F.lit("\x1f".join(values)), "\x1f"), draw(what, len(values)) + 1)
    some = [r.word for r in dictionary.orderBy("word").limit(400).collect()] or ["alpha", "bravo", "delta"]
    sha = lambda what: F.sha2(F.concat(F.lit(f"{seed}{what}"), i.cast("string")), 256)
    b64 = lambda what: F.base64(F.unhex(sha(what)))
    word, word2, word3 = (pick(f"w{k}", some) for k in range(3))
    plain = lambda what: F.regexp_replace(b64(what), "[+/=]", "")
    positives = [
        F.substring(sha("a"), 1, 40), F.substring(sha("a"), F.lit(1), 16 + draw("n", 40)), b64("b"), plain("c"), F.concat(F.lit("AKIA"), F.upper(F.substring(sha("d"), 1, 16))), F.concat(F.lit("ghp_"), F.substring(F.concat(plain("e"), plain("f")), 1, 36)),
        F.concat(F.initcap(word), F.substring(sha("g"), 1, 4), F.lit("!"), F.substring(plain("h"), 1, 6)), F.concat(F.substring(plain("i"), 1, 5), F.lit("-"), F.substring(plain("j"), 1, 6), F.lit("#9")), F.concat(F.lit("sk_live_"), F.substring(plain("k"), 1, 24)),
        F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), b64("l"), b64("m"), F.lit("\n-----END RSA PRIVATE KEY-----")), F.concat(F.lit("eyJ"), plain("o"), F.lit(".eyJ"), plain("p"), F.lit("."), plain("q")), F.concat(plain("r"), plain("s"), plain("t")),
    ]
    negatives = [
        word, F.concat(word, F.lit("_"), word2), F.concat(word, word2, word3), F.concat_ws("-", word, word2, word3), F.concat(F.lit("your_"), word, F.lit("_here")), F.concat(F.lit("example"), F.substring(sha("u"), 1, 12)), F.concat(F.lit("<"), word, F.lit(">")),
        F.repeat(F.substring(sha("v"), 1, 1), 24), F.concat(F.lit("12345678"), F.substring(sha("x"), 1, 2)), F.concat(F.lit("${"), F.upper(word), F.lit("}")), F.concat_ws(".", word, word2, F.lit("get()")), F.concat(F.lit("/"), word, F.lit("/"), word2, F.lit("/"), word3),
        F.concat(F.lit("v1."), draw("y", 30).cast("string"), F.lit("."), draw("z", 30).cast("string")), F.concat(F.initcap(word), F.initcap(word2)), F.concat(F.lit("process.env."), F.upper(word)), F.concat(F.lit("xxxx"), F.lit("xxxxxxxxxxxx")),
    ]
    # random values in places that say that they are none: checksums, commits, fixtures
    spoken = [F.substring(sha("A"), 1, 40), sha("B"), F.concat(F.substring(sha("C"), 1, 8), F.lit("-"), F.substring(sha("C"), 9, 4), F.lit("-4"), F.substring(sha("C"), 14, 3)), b64("D")]
    kinds = len(positives) + len(negatives) + len(spoken)
    of = lambda what, values: F.element_at(F.array(*values), draw(what, len(values)) + 1)
    group = F.when(i % 2 == 0, "p").when(draw("group", kinds - len(positives)) < 2 * len(spoken), "s").otherwise("n")
    names = ["token", "api_key", "password", "DB_PASSWORD", "secret", "SECRET_KEY", "auth_token", "client_secret", "credentials", "private_key"]
    told = ["token_sha256", "key_checksum", "password_hash", "secret-version", "tokenDigest", "api_key_commit"]
    signs = [' = "', "=", ': "', "='", " => \"", ":"]
    rows = spark.range(count).withColumn("group", group)
    made = F.when(F.col("group") == "p", of("p", positives)).when(F.col("group") == "s", of("s", spoken)).otherwise(of("n", negatives))
    sign = pick("sign", signs)
    bare = made.rlike(f"^(?:{VENDORS}|-----BEGIN )") & (draw("bare", 2) == 0)
    contrary = ["for example ", "in the test ", "of version ", "the commit "]
    # a checksum says what it is by several words, or by its name
    by_name = (F.col("group") == "s") & (draw("told", 2) == 0)
    quiet = F.when(draw("said", 3) == 0, F.lit("")).when(draw("said", 3) == 1, F.concat(word3, F.lit(" "), word, F.lit(" "))).otherwise(pick("for", ["production config ", "deploy with ", "export ", "login ", "the live server "]))
    around = (
        F.when(by_name, quiet).when(F.col("group") == "s", pick("against", ["the commit hash is ", "sha256 checksum of a file ", "md5 digest of version ", "replace the sample value ", "the test expects checksum "]))
        .when((F.col("group") == "n") & (draw("quiet", 3) == 0), pick("against", ["for example ", "a placeholder ", "in the test ", "a sample "]))
        .when((F.col("group") == "p") & (draw("quiet", 4) == 0), pick("against", contrary)).otherwise(quiet)
    )
    behind = F.when((F.col("group") == "p") & (draw("behind", 4) == 0), F.concat(pick("contrary", contrary), F.lit(" "))).when((F.col("group") == "n") & (draw("behind", 6) == 0), F.concat(pick("contrary", contrary), F.lit(" "))).otherwise("")
    # secrets lie about in sample folders too, if less often
    folder = F.when(draw("folder", 3) == F.when(F.col("group") != "p", 0).otherwise(F.when(draw("astray", 2) == 0, 0).otherwise(-1)), pick("path", ["tests/fixtures/a.py", "docs/example.md", "examples/demo.sh", "spec/mock.rb"])).when(draw("folder", 3) == 1, pick("path", ["src/main/settings.py", "config/prod.env", "app/server.js", "infra/main.tf"])).otherwise("")
    name = F.when(by_name, pick("toldname", told)).otherwise(pick("name", names))
    close = F.when(bare & ~by_name, " ").when(sign.rlike("[\"']$"), F.regexp_extract(sign, "([\"'])$", 1)).otherwise("\n")
    placed = rows.withColumn("_w", draw("place", n_places)).join(F.broadcast(places), "_w", "left")  # WINDOWS rows and one
    return placed.select(
        F.when(bare & ~by_name, made).otherwise(F.concat(name, sign, made)).alias("match"), F.substring(F.concat("before", F.lit(" "), around), -AROUND, AROUND).alias("left"),
        F.substring(F.concat(close, F.lit(" "), behind, "after"), 1, AROUND).alias("right"), folder.alias("path"), (F.col("group") == "p").cast("double").alias("label"),
    )


def _tree_sql(tree: str) -> str:
    """A tree as Spark prints it, as one SQL expression of the leaf's share of label 1 (0 or 1 where it prints the class)."""
    lines = [x.strip() for x in tree.splitlines() if x.strip().startswith(("If", "Else", "Predict"))]

    def node(at: int) -> tuple[str, int]:
        if lines[at].startswith("Predict"):
            return lines[at].split(":")[1].strip() + "D", at + 1
        _, feature, sign, bound = lines[at].replace("(", "").replace(")", "").removeprefix("If ").split()
        yes, at = node(at + 1)
        no, at = node(at + 1)  # past Else
        return f"CASE WHEN {FEATURES[int(feature)]} {sign} {bound}D THEN {yes} ELSE {no} END", at

    return node(0)[0]


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[str]:
    """A random forest on (label, FEATURES) rows, as one SQL expression a tree."""
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(labelled.select("label", *FEATURES))
    # the labelled rows, MAX_LABELLED at most, lie in one partition in one order, so the trees don't depend on how they were dealt
    assembled = assembled.repartition(1).sortWithinPartitions("label", *FEATURES)
    model = RandomForestClassifier(labelCol="label", featuresCol="_x", numTrees=trees, maxDepth=depth, seed=seed).fit(assembled)
    return [_tree_sql(t.toDebugString) for t in model.trees]


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, max_labelled: int = MAX_LABELLED, least: float = LEAST) -> DataFrame:
    """(_row, id, start, end, value, score, secret) of every candidate; `labelled` has (match, left, right, path, label) rows of known findings, label 1 a secret and 0 none."""
    dictionary, likely = language(docs, text_col)
    dictionary = written(dictionary, "dictionary")
    known = made_findings(docs.sparkSession, dictionary, places=windows(docs, text_col)) if labelled is None else labelled.select("match", "left", "right", "path", F.col("label").cast("double").alias("label")).filter("label IN (0, 1) AND match IS NOT NULL").na.fill("", ["left", "right", "path"]).limit(max_labelled)
    known = written(known, "known")
    odds = written(learn_words(known), "odds")
    forest = train(written(features(known, dictionary, likely, odds).select("label", *FEATURES), "labelled"))
    found = written(features(candidates(docs, id_col, text_col, path_col), dictionary, likely, odds), "findings")
    before = Window.partitionBy("_row").orderBy("i")
    placed = found.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(before))
    scored = placed.withColumn("score", F.expr(f"({' + '.join(f'({t})' for t in forest)}) / {len(forest)}"))
    return scored.select("_row", "id", (F.col("end") - F.length("_v")).alias("start"), "end", F.col("_v").alias("value"), "score", (F.col("score") >= least).alias("secret"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a finding, removed ones too: the document, the value's place and SHA-256, the forest's score, and whether it stays."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", "secret")


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLES: dict[str, str] = {}
