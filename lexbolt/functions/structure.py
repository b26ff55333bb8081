"""Structure inside a text as Column expressions: paragraphs, parts, tables, routes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that go, and characters with plain spellings.
DROPPED = "\u00ad\u200b\u200c\u200d\ufeff"  # soft hyphen, zero-width space and joiners, byte order mark
PLAIN = {"\u00a0": " ", "\u2009": " ", "\u202f": " ", "–": "-", "‘": "'", "’": "'", "“": '"', "”": '"'}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalised(text: Column) -> Column:
    """NFC (no built-in function has it), plain quotes, blanks, hyphens and ligatures, runs
    of blanks as one; lines and em dashes stay. Null is empty."""
    out = F.translate(F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_nfc(text)), "".join(PLAIN) + DROPPED, "".join(PLAIN.values()))
    for old, new in LIGATURES.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.coalesce(F.regexp_replace(out, r"[ \t]+", " "), F.lit(""))


def title_case(text: Column) -> Column:
    """First letter of each ASCII word in upper case; AI, EU and GPAI keep theirs."""
    pieces = F.split(F.lower(text), r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    out = F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), "")
    for word in ("AI", "EU", "GPAI"):
        out = F.regexp_replace(out, rf"\b{word.capitalize()}\b", word)
    return out


# ---- paragraphs and parts


def bracketed_markers(text: Column) -> Column:
    """List lines `- a) ` as `(a)` on a line of its own."""
    return F.regexp_replace(text, r"(?dm)^-\s+([a-z0-9ivxIVX]+)\)\s*", "($1)\n")


def numbered_paragraphs(body: Column, entity: Column) -> Column:
    """Array of struct(id, number, text). Text before the first bold number goes; a body
    without one is a single paragraph without id and number."""
    marker = r"^\*\*(\d+)\.\*\*\s*"
    pieces = F.filter(F.split(body, r"(?dm)(?=^\*\*\d+\.\*\*)"), lambda p: p.rlike(marker))

    def row(p: Column) -> Column:
        number = F.regexp_extract(p, marker, 1)
        text = bracketed_markers(stripped(F.regexp_replace(p, marker, "")))
        return F.struct(
            F.when(entity.try_cast("int").isNotNull(), F.format_string("%03d.%03d", entity.try_cast("int"), number.try_cast("int"))).alias("id"),
            number.alias("number"),
            F.concat(number, F.lit(".   "), text).alias("text"),
        )

    none = F.lit(None).cast("string")
    whole = F.array(F.struct(none.alias("id"), none.alias("number"), bracketed_markers(stripped(body)).alias("text")))
    return F.when(F.size(pieces) > 0, F.transform(pieces, row)).otherwise(whole)


def sub_points(text: Column) -> Column:
    """Array of struct(marker, text): parts begin at lines with one lower-case letter in
    brackets; what stands before has no marker; empty parts go."""
    marker = r"^(\([a-z]\))\s*"
    parts = F.transform(
        F.split(text, r"(?dm)(?=^\([a-z]\))"),
        lambda p: F.struct(F.nullif(F.regexp_extract(p, marker, 1), F.lit("")).alias("marker"), stripped(F.regexp_replace(p, marker, "")).alias("text")),
    )
    return F.filter(parts, lambda p: p["text"] != "")


def text_chunks(text: Column) -> Column:
    """The parts with markers where there are any (then the intro isn't a chunk), else the
    whole text: array of struct(marker, text)."""
    marked = F.filter(sub_points(text), lambda p: p["marker"].isNotNull())
    return F.when(F.size(marked) > 0, marked).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("marker"), text.alias("text"))))


def paragraph_estimate(text: Column) -> Column:
    return F.greatest(F.regexp_count(text, F.lit(r"\n\d+\.\s")), F.lit(1))


# ---- tables and markup


def unescaped(text: Column) -> Column:
    for name, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(plain))
    return text


#: Ordered rules, in the syntax that Java's and RE2's expressions share.
MARKDOWN_RULES = [
    (r"(?is)<(script|style|head|nav)\b[^>]*>.*?</(script|style|head|nav)>|<!--.*?-->", ""),
    (r"(?i)<h1[^>]*>", "\n\n# "),
    (r"(?i)<h2[^>]*>", "\n\n## "),
    (r"(?i)<h[3-6][^>]*>", "\n\n### "),
    (r"(?i)<li[^>]*>", "\n- "),
    (r"(?i)<br[^>]*>", "\n"),
    (r"(?i)</?(p|div|ul|ol|table|tr|article|section)(\s[^>]*)?>|</h[1-6]>", "\n\n"),
    (r"(?i)</?(b|strong)>", "**"),
    (r"(?i)</?(i|em)>", "*"),
    (r"<[^>]*>", ""),
    (r"[ \t]+", " "),
    (r" ?\n ?", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"^[ \n]+|[ \n]+$", ""),
]


def html_markdown(html: Column) -> Column:
    """Headings, lists, paragraphs and emphasis of a page as Markdown; scripts, styles,
    comments, head and navigation go."""
    for pattern, new in MARKDOWN_RULES:
        html = F.regexp_replace(html, pattern, new)
    return unescaped(html)


def table_cells(html: Column) -> Column:
    """Rows of cells (array of arrays of clean text) of a table that holds no other table."""
    cell = lambda c: stripped(F.regexp_replace(unescaped(F.regexp_replace(c, r"<[^>]*>", " ")), r"[ \t\x{A0}]+", " "))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1), cell)
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1), cells)


def two_columns(rows: Column) -> Column:
    """struct(left, right) of an amendment's table. The header row and empty rows go, a single
    cell counts for both sides, empty cells of a pair stay, rows of three or more go."""
    def header(r: Column) -> Column:
        joined = F.trim(F.lower(F.array_join(r, " | ")))
        return joined.contains("text proposed by the commission") | joined.isin("amendment", "| amendment", "amendment |")

    kept = F.filter(rows, lambda r: ~header(r) & F.exists(r, lambda c: c != "") & F.size(r).between(1, 2))
    side = lambda at: F.array_join(F.transform(kept, lambda r: F.element_at(r, at)), "\n\n")
    return F.struct(side(1).alias("left"), side(-1).alias("right"))


def marker_lines(rows: Column) -> Column:
    """A table of marker and body as list lines. Of three cells an empty first one is padding;
    without a marker the body stands alone; further lines of a body are indented."""
    usable = F.filter(rows, lambda r: F.size(r).between(2, 3))

    def line(r: Column) -> Column:
        at = F.when((F.size(r) == 3) & (r[0] == ""), 2).otherwise(1)
        marker, body = F.element_at(r, at), F.element_at(r, at + 1)
        return F.when(marker == "", body).otherwise(F.rtrim(F.concat(F.lit("- "), marker, F.lit(" "), F.regexp_replace(body, r"\n(?=[^\n])", "\n  "))))

    return F.array_join(F.filter(F.transform(usable, line), lambda x: x != ""), "\n")


# ---- places, routes and checks of form


def pin_cite(paragraph: Column, letter: Column) -> Column:
    part = lambda c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit("("), c, F.lit(")")))
    return F.concat_ws("", part(paragraph), part(letter))


def location(section: Column, page: Column, note: Column, lang: Column) -> Column:
    at = F.when(F.nullif(section, F.lit("")).isNotNull(), F.concat(F.lit("§"), section))
    mark = F.when(lang == "nl", "vn. ").otherwise("fn. ")
    return F.concat_ws(", ", at, F.concat(F.lit("p. "), page.cast("string")), F.concat(mark, note.cast("string")))


def swap_language(path: Column, lang: str, known: tuple[str, ...] = ("en", "nl")) -> Column:
    """The path under another language's prefix."""
    return F.concat(F.lit(f"/{lang}"), F.regexp_replace(path, rf"^/({'|'.join(known)})(?=/|$)", ""))


def nav_section(path: Column) -> Column:
    out = F.lit("articles")
    for name in ("about", "guidance", "history", "annexes", "recitals"):
        out = F.when(path.startswith(f"/{name}"), name).otherwise(out)
    return out


def index_links(text: Column, folders: tuple[str, ...] = (r"articles/chapter-\d+", "recitals", "cross-references")) -> Column:
    """Links to a folder lead to its index; links to a file beside the page lose their `../`."""
    flat = F.regexp_replace(text, r"\.\./([a-z-]+\.md)", "$1")
    return F.regexp_replace(flat, rf"\(((?:\.\./)?(?:{'|'.join(folders)})/)\)", "($1index.md)")


def valid_celex(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^3\d{4}[RLDC]\d{4}$"), F.lit(False))


def valid_registry_url(url: Column, lang: Column) -> Column:
    """A document of the registry, by a well-formed id and in the language."""
    shape = r"^https://eur-lex\.europa\.eu/legal-content/([A-Z]{2})/TXT/\?uri=CELEX:3\d{4}[RLDC]\d{4}$"
    return F.coalesce(F.regexp_extract(url, shape, 1) == F.upper(lang), F.lit(False))


def valid_site_url(url: Column, lang: Column, site: str) -> Column:
    """The site's home page or one of its articles, in the language."""
    rest = F.when(url.startswith(f"{site}/"), F.substring(url, len(site) + 2, 1_000_000))
    return F.coalesce((F.regexp_extract(rest, r"^([a-z]{2})/(?:article/\d+[a-z]?/)?$", 1) == lang), F.lit(False))
