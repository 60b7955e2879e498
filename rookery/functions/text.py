"""Texts: folding of names and titles, cleaning, HTML to text, display names."""

from __future__ import annotations

import unicodedata
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from rookery.functions.urls import bound

# Words that don't tell companies apart.
GENERIC = "inc|llc|ltd|limited|corp|corporation|co|gmbh|bv|nv|sa|ag|plc|holdings|group|labs|technologies|technology"


def _unmarked() -> dict[str, str]:
    """Lower-case letters of the Latin blocks whose compatibility decomposition is one plain letter and marks."""
    found = {}
    for c in map(chr, [*range(0xAA, 0x250), *range(0x1E00, 0x1F00), *range(0xFF41, 0xFF5B), 0x2071, 0x207F]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain.isascii() and plain.isalnum() and c == c.lower():
            found[c] = plain
    return found


MARKED, PLAIN = ("".join(x) for x in zip(*sorted(_unmarked().items())))
#: Marks that stand as characters of their own go.
LONE_MARKS = r"[\x{0300}-\x{036F}]+"
MAX_DESCRIPTION = 50_000
#: Entities by name, as HTML 4 has them and apos.
ENTITIES = {**{name: chr(n) for name, n in name2codepoint.items()}, "apos": "'", "nbsp": " "}
BLOCK_TAGS = "p|div|li|ul|ol|br|tr|table|h[1-6]|section|article|header|footer|blockquote|pre|hr"


def clean(text: Column) -> Column:
    """One space for each run of white space of any kind, none at the ends; null is empty."""
    wide = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
    # runs that are one space already, which are nearly all, are no match
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\t-\r{wide}][\t-\r {wide}]*+| [\t-\r {wide}]++", " "))


def company_key(name: Column) -> Column:
    """A company's name without case, marks, punctuation and generic words."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    # ASCII has no marks
    folded = F.when(F.octet_length(lower) == F.char_length(lower), lower).otherwise(F.translate(F.regexp_replace(lower, LONE_MARKS, ""), MARKED, PLAIN))
    words = F.regexp_replace(F.replace(folded, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(words, rf"\b(?:{GENERIC})\b ?", ""))


def title_key(title: Column) -> Column:
    """A title without case, bracketed remarks and punctuation but + # and the full stop."""
    bare = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\([^)]*\)", " ")
    # all but a-z 0-9 + # and the full stop, said by ranges: Java is slow at classes that leave out ranges and single characters together
    return F.trim(F.regexp_replace(bare, r"[\x00-\x22\x24-\x2A\x2C\x2D\x2F\x3A-\x60\x7B-\x{10FFFF}]+", " "))


def description(text: Column, most: int = MAX_DESCRIPTION) -> Column:
    """Tidy horizontal white space, at most one empty line in a row, at most `most` characters."""
    tidy = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    for pattern, to in ((r"[ \t]+\n", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        tidy = F.regexp_replace(tidy, pattern, to)
    return F.substring(tidy, 1, most)


def decode_entities(text: Column) -> Column:
    """Named and numeric entities; unknown ones stay. What comes out of one is not decoded again."""
    pattern = r"(?s)^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});(.*)$"
    names = F.str_to_map(F.lit("\x1f".join(f"{k}\x1e{v}" for k, v in ENTITIES.items())), F.lit("\x1f"), F.lit("\x1e"))
    number = lambda said: F.when(said.rlike("^#[xX]"), F.conv(F.regexp_extract(said, "^#[xX](.*)", 1), 16, 10)).otherwise(F.regexp_extract(said, "^#([0-9]+)", 1)).try_cast("int")
    # a space that doesn't break is a space; what is no character stays as it stands
    of_number = lambda n: F.when(n == 160, " ").when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    decoded = lambda said: F.when(said == "", None).when(said.startswith("#"), bound(number(said), of_number)).otherwise(F.element_at(names, said))
    piece = lambda p: bound(decoded(F.regexp_extract(p, pattern, 1)), lambda d: F.when(d.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(d, F.regexp_extract(p, pattern, 2))))
    cut = F.split(text, "&", -1)
    return F.when(F.contains(text, F.lit("&")), F.concat(cut[0], F.array_join(F.transform(F.slice(cut, F.lit(2), F.size(cut)), piece), ""))).otherwise(text)


def html_to_text(html: Column, most: int = MAX_DESCRIPTION) -> Column:
    """Scripts and styles go, block tags break lines, other tags go, entities are decoded, lines are tidied."""
    text = F.coalesce(html, F.lit(""))
    for name in ("script", "style"):
        text = F.regexp_replace(text, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " ")
    text = F.regexp_replace(text, rf"(?i)</?({BLOCK_TAGS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    return description(F.regexp_replace(decode_entities(text), r"\n[ \t]+", "\n"), most)


def tidy_reason(text: Column, most: int = 220) -> Column:
    """One line without | < >, at most `most` characters."""
    return F.substring(clean(F.regexp_replace(F.coalesce(text, F.lit("")), "[|<>]", " ")), 1, most)


def bounded_distance(a: Column, b: Column, most: int = 2) -> Column:
    """Edit distance, most + 1 where it is above `most`."""
    found = F.levenshtein(a, b, most)
    return F.when(found < 0, most + 1).otherwise(found)


def display_name(slug: Column) -> Column:
    """Words of a slug with capitals first; the rest of each word stays as it is."""
    return F.array_join(F.transform(F.filter(F.split(F.coalesce(slug, F.lit("")), r"[-_\s#]+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def name_from_title(title: Column) -> Column:
    """A company's name from its board's page title: what follows the first separator goes, and words for a job board at the end."""
    head = F.regexp_replace(clean(title), r"\s+[|–—-]\s.*$", "")
    return F.trim(F.regexp_replace(head, r"(?i)\s*\b(careers?|jobs?( board)?|job openings?|current openings?|hiring)\b\s*$", ""))


#: A line that looks like a heading, from its first letter on.
SECTION = r"(?:#{1,6}[^\S\n]+[^\s]|\*\*[^*\n]{2,60}\*\*:?(?=\n|\z)|[A-Z][^.!?\n]{1,58}:(?=\n|\z))"


def sections(text: Column) -> Column:
    """[(heading, body)]: a text cut at lines that look like headings; what comes before the first has an empty one. One pass over the text, however many lines it has."""
    pieces = F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), rf"\n(?={SECTION})")
    heading = lambda p: F.trim(F.regexp_replace(F.regexp_extract(p, r"^[^\n]*", 0), r"^#+\s+|\*\*|:$", ""))
    body = lambda p: F.regexp_replace(p, r"^\n+", "")
    return F.transform(pieces, lambda p, i: F.struct(F.when(i == 0, "").otherwise(heading(p)).alias("heading"), F.when(i == 0, body(p)).otherwise(body(F.regexp_replace(p, r"^[^\n]*", ""))).alias("body")))


# What the sections of a description are called, the words that may stand before, and how long an excerpt is.
SECTION_NAMES = {
    "responsibilities": "responsibilities|what you.?ll do|what you will do|the role|about the role|in this role|your impact",
    "qualifications": "qualifications|requirements|what we.?re looking for|what we look for|you have|you.?ll have|must have|minimum qualifications|preferred qualifications",
    "experience": "experience|background|skills",
    "compensation": "compensation|salary|pay|benefits|perks|total rewards",
}
QUALIFIERS = "required|minimum|preferred|basic|additional|other|key|core"
EXCERPT = 4_000


def _section_line(names: str) -> str:
    """A whole line of up to six words and sixty letters, without digits and ends of sentences, that begins with a name, or with qualifiers before it, and says little after it."""
    short = r"(?=[^\n0-9.!?;]{1,60}[:#*\-]*[^\S\n]*(?:\n|\z))(?=\S+(?:[^\S\n]+\S+){0,5}[^\S\n]*(?:\n|\z))"
    # whether a name stands there is asked first, as most lines have none
    named = rf"(?=(?:(?:{QUALIFIERS}),?[^\S\n]+)*(?:{names})\b)"
    return rf"(?i)(?<=\n)[^\S\n]*+{named}{short}(?:(?:{QUALIFIERS}),?[^\S\n]+)*(?:{names})\b(?:[:#*\-,\s&&[^\n]]*[^:#*\-,\s]){{0,32}}[:#*\-,\s&&[^\n]]*(?=\n|\z)"


def named_sections(text: Column) -> Column:
    """{name: text} of a description: responsibilities, qualifications, experience and compensation, and as `body` what stands under none of them. Sections that come again are put together; white space is one space."""
    marked = F.concat(F.lit("\n"), F.trim(F.replace(F.translate(F.coalesce(text, F.lit("")), "\x1e\x1f", "  "), F.lit("\r\n"), F.lit("\n"))))
    for name, names in SECTION_NAMES.items():
        marked = F.regexp_replace(marked, _section_line(names), f"\x1e{name}\x1f")
    pieces = F.transform(F.split(marked, "\x1e"), lambda p: F.struct(F.when(F.contains(p, F.lit("\x1f")), F.substring_index(p, "\x1f", 1)).otherwise("body").alias("name"), clean(F.substring_index(p, "\x1f", -1)).alias("text")))
    # five names at most
    of = lambda cut, name: F.nullif(F.array_join(F.filter(F.transform(F.filter(cut, lambda s: s["name"] == name), lambda s: s["text"]), lambda t: t != ""), " "), F.lit(""))
    keys = [*SECTION_NAMES, "body"]
    return bound(pieces, lambda cut: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), of(cut, k).alias("value")) for k in keys)), lambda e: e["value"].isNotNull())))


def excerpt(text: Column, most: int = EXCERPT) -> Column:
    """A description that is longer than `most`, cut to it: section by section in the order of their use, the last one with an ellipsis; a shorter one whole."""
    plain = clean(text)

    def cut(sections_: Column) -> Column:
        chunk = lambda k: F.concat(F.lit("" if k == "body" else f"{k}: "), F.try_element_at(sections_, F.lit(k)))
        chunks = F.filter(F.array(*map(chunk, [*SECTION_NAMES, "body"])), lambda c: c.isNotNull())

        def step(out: Column, c: Column) -> Column:
            room = most - F.length(out) - F.when(out != "", 1).otherwise(0)
            taken = F.when(F.length(c) <= room, c).otherwise(F.concat(F.rtrim(F.substring(c, F.lit(1), F.greatest(F.lit(0), room - 1))), F.lit("…")))
            return F.when(room <= 0, out).otherwise(F.concat(out, F.when(out != "", " ").otherwise(""), taken))

        return F.coalesce(F.nullif(F.trim(F.aggregate(chunks, F.lit(""), step)), F.lit("")), F.substring(plain, 1, most))

    return F.when(F.length(plain) <= most, plain).otherwise(bound(named_sections(text), cut))
