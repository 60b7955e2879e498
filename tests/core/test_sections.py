import random
import re

from pyspark.sql import functions as F

from rookery.functions import text

QUALIFIER = re.compile("(required|minimum|preferred|basic|additional|other|key|core)", re.I)


def is_heading(line, names):
    """Word by word, as a reader would tell."""
    heading = re.sub(r"[:#*\-]+$", "", line.strip()).strip()
    if not heading or len(heading) > 60 or len(heading.split()) > 6 or re.search(r"[\d.!?;]", heading):
        return False
    m = re.search(rf"\b({names})\b", heading, re.I)
    if not m or any(not QUALIFIER.fullmatch(w.replace(",", "")) for w in heading[: m.start()].split()):
        return False
    return len(re.sub(r"[:#*\-\s,]", "", heading[m.end() :])) <= 32


def plain_sections(said):
    out, at = {}, "body"
    for line in (said or "").replace("\r\n", "\n").strip().split("\n"):
        found = next((k for k, names in text.SECTION_NAMES.items() if is_heading(line, names)), None)
        if found:
            at = found
        else:
            out.setdefault(at, []).append(line)
    joined = {k: " ".join(" ".join(v).split()) for k, v in out.items()}
    return {k: v for k, v in joined.items() if v}


def test_sections_line_by_line(spark):
    rng = random.Random(8)
    lines = [
        "Requirements", "Required Qualifications:", "  What you'll do  ", "Skills, Knowledge and Abilities", "Key, core skills", "Competitive pay and more", "5+ years experience", "Experience matters.", "Your impact --", "Pay", "paying", "the role of a cook",
        "Preferred background in a great many different fields", "## Skills", "a line of text", "", " ", "Benefits & Perks:", "must have", "Salary: 5", "Total rewards", "experience experience", "Other", "we look; you have", "Skills" + "x" * 30, "Skills " + "y" * 33, "In this role, you", "\t",
    ]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9))) for _ in range(400)] + ["\r\n".join(lines), "", "Pay"]
    got = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", text.named_sections(F.col("t")).alias("s")).collect()
    for r in got:
        assert r.s == plain_sections(r.t), r.t


def test_excerpts(spark):
    long = "Intro words. " * 40 + "\nPay\n" + "money " * 10 + "\nRequirements:\n" + "know " * 20
    cut = lambda t, n: spark.createDataFrame([(t,)], "t string").select(text.excerpt(F.col("t"), n)).first()[0]
    assert cut(long, 60) == "qualifications: know know know know know know know know kno…" and cut("short  text", 60) == "short text" and cut(None, 5) == ""
    assert cut(long, 200).startswith("qualifications: know") and " compensation: money" in cut(long, 200) and cut(long, 200).endswith("…") and len(cut(long, 200)) <= 200
    assert cut("Pay\nPay\n" * 30, 10) == "Pay Pay Pa" and cut("x" * 50, 10) == "x" * 9 + "…"


def test_many_lines_take_one_pass(spark):
    got = spark.createDataFrame([("# A\n" + "line\n" * 200_000 + "Title Line:\nend",), (None,), ("no heading",), ("# B",), ("\n\n**Bold one**\n\n\nx\n",)], "t string").select(text.sections(F.col("t")).alias("s")).collect()
    assert [[(x.heading, len(x.body)) for x in r.s] for r in got] == [[("", 0), ("A", 999_999), ("Title Line", 3)], [("", 0)], [("", 10)], [("", 0), ("B", 0)], [("", 0), ("Bold one", 2)]]
