"""Text functions as Column expressions: they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How instruments are numbered: kind, rule, and the groups of year and number.
INSTRUMENT_RULES = [
    ("R", r"Regulation\s*\(EU\)\s*No\.?\s*(\d+)\s*/\s*(\d{4})", 2, 1),
    ("R", r"Regulation\s*\(EU\)\s*(\d{4})\s*/\s*(\d+)", 1, 2),
    ("R", r"Regulation\s*\(EC\)\s*(?:No\.?\s*)?(\d+)\s*/\s*(\d{4})", 2, 1),
    ("L", r"Directive\s*\(EU\)\s*(\d{4})\s*/\s*(\d+)", 1, 2),
    ("L", r"Directive\s+(\d{4})\s*/\s*(\d+)\s*/\s*(?:EU|EC)", 1, 2),
    ("D", r"Decision\s*\(EU\)\s*(\d{4})\s*/\s*(\d+)", 1, 2),
]
MONTHS = {
    "en": ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"],
    "nl": ["januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december"],
}


def clean(text: Column) -> Column:
    """NBSP to space, runs of blanks to one, white space stripped at both ends; lines stay."""
    spaced = F.regexp_replace(F.translate(text, " ", " "), r"[ \t]{2,}", " ")
    return F.regexp_replace(spaced, r"(?U)^\s+|\s+$", "")


def slugify(text: Column, most: int = 80) -> Column:
    joined = F.regexp_replace(text, r"[^a-zA-Z0-9]+", "-")
    return F.substring(F.lower(F.regexp_replace(joined, r"^-+|-+$", "")), 1, most)


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def cut_at_word(text: Column, most: int = 400) -> Column:
    """At most `most` characters, ended before the last space and marked, if it was longer."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), r" [^ ]*$", ""), F.lit("…"))).otherwise(text)


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def bold_lead(text: Column) -> Column:
    return F.regexp_replace(text, r"^(\d+)\.\s+", "**$1.** ")


def number_key(value: Column, default: int = 0) -> Column:
    """The leading digits as a number, else the default."""
    return F.coalesce(F.regexp_extract(value, r"^(\d+)", 1).try_cast("int"), F.lit(default))


def roman_key(value: Column, highest: int = 40, default: int = 999) -> Column:
    """The place of a roman numeral, from a table that is built from the rule."""
    pairs = [x for n in range(1, highest + 1) for x in (F.lit(roman(n)), F.lit(n))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(value)), F.lit(default))


def roman(n: int) -> str:
    out = ""
    for value, digit in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out, n = out + digit * (n // value), n % value
    return out


def long_date(day: Column, lang: Column) -> Column:
    """An ISO date spelled out; what is no date passes through."""
    parsed = day.try_cast("date")
    names = F.when(lang == "nl", F.array(*map(F.lit, MONTHS["nl"]))).otherwise(F.array(*map(F.lit, MONTHS["en"])))
    return F.coalesce(F.concat(F.dayofmonth(parsed).cast("string"), F.lit(" "), F.element_at(names, F.month(parsed)), F.lit(" "), F.year(parsed).cast("string")), day)


def first_text(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def url_path(url: Column) -> Column:
    """Path of an absolute or relative URL without query and fragment; a trailing index.html goes."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[#?].*$", ""), r"^[a-z]+://[^/]*", "")
    path = F.regexp_replace(bare, r"/index\.html$", "/")
    return F.when(path == "", F.lit("/")).otherwise(path)


def page_key(url: Column) -> Column:
    """One key for all that lead to a page: its path without index file, .html and last slash."""
    return F.regexp_replace(url_path(url), r"(?:/index)?(?:\.html)?/*$", "")


def resolved_path(href: Column, page: Column) -> Column:
    """The path that a link leads to from a page: without query and fragment, relative ones
    from the page's folder, with . and .. taken out. Other schemes give null; what is only a
    query or a fragment leads to the page itself."""
    bare = F.regexp_replace(href, r"[#?].*$", "")
    here = url_path(page)
    folder = F.regexp_replace(here, r"[^/]*$", "")
    whole = F.when(bare == "", here).when(bare.startswith("/"), bare).otherwise(F.concat(folder, bare))
    step = lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(p.isin("", "."), done).otherwise(F.concat(done, F.array(p)))
    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    path = F.concat(F.lit("/"), F.array_join(parts, "/"), F.when(whole.rlike(r"/\.{0,2}$") & (F.size(parts) > 0), "/").otherwise(""))
    return F.when(~bare.rlike(r"^(?:[a-z][a-z0-9+.-]*:|//)"), path)


def article_path(chapter: Column, number: Column) -> Column:
    """chapter-NN/article-NN; number with its suffix, digits padded to two places."""
    padded = lambda c: F.concat(F.lpad(F.regexp_extract(c, r"^(\d*)", 1), 2, "0"), F.regexp_extract(c, r"^\d*(.*)$", 1))
    long = lambda c: F.when(F.length(F.regexp_extract(c, r"^(\d*)", 1)) > 2, c).otherwise(padded(c))
    return F.concat(F.lit("chapter-"), long(chapter.cast("string")), F.lit("/article-"), long(number.cast("string")))


def internal_href(lang: Column, chapter: Column, number: Column, annex: Column) -> Column:
    """Where an article or an annex is read; # where the article's chapter isn't known."""
    article = F.concat(F.lit("/"), lang, F.lit("/articles/chapter-"), chapter.cast("string"), F.lit("/article-"), number, F.lit("/"))
    own = F.concat(F.lit("/"), lang, F.lit("/annexes/annex-"), F.lower(annex), F.lit("/"))
    return F.coalesce(F.when(annex.isNotNull(), own), article, F.lit("#"))


def external_href(celex: Column, lang: Column, article: Column, sites: dict[str, str] | None = None) -> Column:
    """Where an instrument is read, by its registry id: at the site that `sites` names for
    it (its article, if one is meant), else at the registry."""
    out = F.concat(F.lit("https://eur-lex.europa.eu/legal-content/"), F.upper(lang), F.lit("/TXT/?uri=CELEX:"), celex)
    for name, site in (sites or {}).items():
        own = F.concat(F.lit(f"{site}/"), lang, F.lit("/"), F.coalesce(F.concat(F.lit("article/"), article, F.lit("/")), F.lit("")))
        out = F.when(celex == name, own).otherwise(out)
    return out


def in_language(texts: Column, wanted: Column, languages: Column, rest: Column) -> Column:
    """struct(value, lang) from a map of language to text: the wanted language, else the
    document's languages in their order, else the rest (as English). Empty texts don't count."""
    has = lambda lang: F.coalesce(F.try_element_at(texts, lang), F.lit("")) != ""
    found = F.try_element_at(F.filter(F.concat(F.array(wanted), F.coalesce(languages, F.array().cast("array<string>"))), has), F.lit(1))
    return F.when(found.isNotNull(), F.struct(F.try_element_at(texts, found).alias("value"), found.alias("lang"))).otherwise(F.struct(F.coalesce(F.try_element_at(texts, F.lit("en")), rest).alias("value"), F.lit("en").alias("lang")))


def lines_of(text: Column, first: int, count: int, most: int = 200) -> Column:
    """Some lines, joined by spaces, in at most so many characters."""
    return F.substring(F.array_join(F.slice(F.split(text, "\n"), first, count), " "), 1, most)


def block_count(markdown: Column) -> Column:
    """Paragraphs of a document: blocks between blank lines but headings, comments and rules."""
    return F.size(F.filter(F.split(markdown, r"\n\s*\n"), lambda b: (F.trim(b) != "") & ~F.regexp_replace(b, r"^\s+", "").rlike(r"^(?:#|<!--|---)")))


def char_count(lang: Column, left: Column, right: Column) -> Column:
    """Characters of an amendment: in English of the right column alone, else of both."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    return F.when(lang == "en", size(right)).otherwise(size(left) + size(right))


def yaml_text(value: Column) -> Column:
    """A text as YAML reads it back: quoted, with quotes and backslashes escaped; null is null."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def front_matter(texts: dict[str, Column], plain: dict[str, Column] | None = None) -> Column:
    """Texts, then numbers and truth values, as a block of YAML between rules."""
    lines = [F.concat(F.lit(f"{name}: "), yaml_text(value)) for name, value in texts.items()]
    lines += [F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("null"))) for name, value in (plain or {}).items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def styled_block(style: Column, text: Column) -> Column:
    """A paragraph by its style: points become list items, deeper ones indented, numbered
    paragraphs get their number in bold, section titles become headings."""
    indent = F.when(style.rlike("Point2|Point1letter|ManualPointlet"), "  ").when(style.rlike("Point3"), "    ").otherwise("")
    point = style.isin(*(f"li {s}" for s in ("Point0", "Point1", "Point1letter", "Point2", "Point3", "ManualPointlet")))
    numbered = style.isin(*(f"li {s}" for s in ("NumPar1", "ManualNumPar1", "NumPar2", "ManualNumPar2")))
    out = F.when(point, F.concat(indent, F.lit("- "), text)).when(numbered, bold_lead(text)).when(style.contains("SectionTitle"), F.concat(F.lit("### "), text))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(F.coalesce(out, text))


def instrument_id(text: Column) -> Column:
    """Registry id of the first cited instrument: 3, year, kind (R, L or D), four-digit number."""
    found = []
    for kind, rule, year, number in INSTRUMENT_RULES:
        y, n = (F.nullif(F.regexp_extract(text, rule, g), F.lit("")) for g in (year, number))
        found.append(F.when(y.isNotNull(), F.format_string("3%s" + kind + "%04d", y, n.try_cast("int"))))
    return F.coalesce(*found)


#: How targets are written, with groups for the number and its suffix.
_LATIN = "bis|ter|quater|quinquies|sexies|septies|octies|nonies|decies"
_TARGETS = {
    "en": {
        "article": r"\bArticle\s*[—–-]?\s*(\d+)\s*([a-z])?\b",
        "paragraph": r"\b(?:paragraph|point|subparagraph)\s+([\d.]+)\s*([a-z])?\b",
        "recital": r"\bRecital\s+(\d+)\s*([a-z])?\b",
        "annex": r"\bAnnex\s+([IVX]+)\b",
    },
    "nl": {
        "article": r"\bArtikel\s*[—–-]?\s*(\d+)\s*([a-z])?\b",
        "ordinal": rf"\bArtikel\s+\d+\s+({_LATIN})\b",
        "paragraph": rf"\b(?:lid|alinea|punt)\s+([\d.]+)(?:\s+({_LATIN}|[a-z]))?\b",
        "recital": rf"\bOverweging\s+(\d+)(?:\s+({_LATIN}|[a-z]))?\b",
        "annex": r"\bBijlage\s+([IVX]+)\b",
    },
}


def amendment_target(text: Column, lang: Column) -> Column:
    """struct(kind, number, suffix, paragraph, paragraph_suffix) of what an amendment changes:
    article before recital before annex, everything else structural. Only articles have a
    paragraph. The Dutch Latin ordinals (bis, ter) are suffixes. Null is structural; texts
    in a language without rules give null."""

    def parsed(rules: dict[str, str], latin: str | None) -> Column:
        part = lambda kind, group: F.nullif(F.regexp_extract(text, "(?i)" + rules[kind], group), F.lit(""))
        ordinal = F.nullif(F.regexp_extract(text, latin, 1), F.lit("")) if latin else F.lit(None).cast("string")
        none = F.lit(None).cast("string")

        def row(kind: str, number=none, suffix=none, paragraph=none, more=none) -> Column:
            return F.struct(F.lit(kind).alias("kind"), number.alias("number"), F.lower(suffix).alias("suffix"), paragraph.alias("paragraph"), F.lower(more).alias("paragraph_suffix"))

        return (
            F.when(part("article", 1).isNotNull(), row("article", part("article", 1), F.coalesce(part("article", 2), ordinal), part("paragraph", 1), part("paragraph", 2)))
            .when(part("recital", 1).isNotNull(), row("recital", part("recital", 1), part("recital", 2)))
            .when(part("annex", 1).isNotNull(), row("annex", F.upper(part("annex", 1))))
            .otherwise(row("structural"))
        )

    return F.when(lang == "en", parsed(_TARGETS["en"], None)).when(lang == "nl", parsed(_TARGETS["nl"], "(?i)" + _TARGETS["nl"]["ordinal"]))
