"""References in running text: one scan a chunk, any number of rows out.

A reference to articles is a head, a list of numbers with pin-cites and ranges, and a
qualifier that says which instrument is meant. The grammar is recursive over separators, so
it runs over Arrow batches; texts without a word that can
begin a reference are left out before, in generated code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexbolt.operators.postings import BOUND, chunked
from lexbolt.sources.readers import spread
from lexbolt.sources.stores import stored

#: How references look, and what names stand for. Heads and instruments begin
#: with literal letters (what stands before these is looked back at), which a scan can skip to.
ARTICLES = re.compile(r"Article(?<!\wArticle)s?\b[ \t\n\r]*(?=\d)")
ANNEXES = re.compile(r"Annex(?<!\wAnnex)(?:es)?\b[ \t\n\r]*(?=[IVXLCDM])")
HEADS = re.compile(r"A(?:rticle(?<!\wArticle)s?\b[ \t\n\r]*(?=\d)|nnex(?<!\wAnnex)(?:es)?\b[ \t\n\r]*(?=[IVXLCDM]))")
PIN = r"(?:\s*\((\d+[a-z]?)\)(?:\s*\(([a-z])\)(?:\s*\(([ivxlcdm]+)\))?)?)?"
_SEPARATOR = r"\s*(,|(?i:\band\b|\bto\b)|–|—)\s*"
#: Of a list the first item, and a further one behind its separator.
ARTICLE = [re.compile(rf"{before}(\d+[a-z]?){PIN}") for before in ("()", _SEPARATOR)]
ANNEX = [re.compile(rf"{before}([IVXLCDM]+)\b{PIN}") for before in ("()", _SEPARATOR)]
RANGE_WORDS = ("to", "–", "—")
THIS_REGULATION = re.compile(r"\s*(?:of|under|in)\s+this\s+Regulation\b", re.IGNORECASE)
OF = re.compile(r"\s*(?:of|under|in)\s+(?:the\s+)?", re.IGNORECASE)
INSTRUMENTS = [
    ("R", "Regulation (EU) No {n}/{y}", re.compile(r"Regulation\s*\(EU\)\s*No\.?\s*(?P<n>\d+)\s*/\s*(?P<y>\d{4})")),
    ("R", "Regulation (EU) {y}/{n}", re.compile(r"Regulation\s*\(EU\)\s*(?P<y>\d{4})\s*/\s*(?P<n>\d+)")),
    ("R", "Regulation (EC) No {n}/{y}", re.compile(r"Regulation\s*\(EC\)\s*(?:No\.?\s*)?(?P<n>\d+)\s*/\s*(?P<y>\d{4})")),
    ("L", "Directive (EU) {y}/{n}", re.compile(r"Directive\s*\(EU\)\s*(?P<y>\d{4})\s*/\s*(?P<n>\d+)")),
    ("L", "Directive {y}/{n}/{s}", re.compile(r"Directive\s+(?P<y>\d{4})\s*/\s*(?P<n>\d+)\s*/\s*(?P<s>EU|EC)")),
    ("D", "Decision (EU) {y}/{n}", re.compile(r"Decision\s*\(EU\)\s*(?P<y>\d{4})\s*/\s*(?P<n>\d+)")),
]
ALIASES = {
    "GDPR": ("32016R0679", "GDPR"),
    "General Data Protection Regulation": ("32016R0679", "GDPR"),
    "LED": ("32016L0680", "LED"),
    "Law Enforcement Directive": ("32016L0680", "LED"),
    "ePrivacy Directive": ("32002L0058", "ePrivacy Directive"),
    "ePrivacy": ("32002L0058", "ePrivacy Directive"),
    "NIS2 Directive": ("32022L2555", "NIS2 Directive"),
    "NIS2": ("32022L2555", "NIS2 Directive"),
    "DSA": ("32022R2065", "DSA"),
    "Digital Services Act": ("32022R2065", "DSA"),
    "DMA": ("32022R1925", "DMA"),
    "Digital Markets Act": ("32022R1925", "DMA"),
    "DORA": ("32022R2554", "DORA"),
    "Open Data Directive": ("32019L1024", "Open Data Directive"),
}
OWN_ID, GDPR_ID = "32024R1689", "32016R0679"
#: The widest range that is expanded, and how far behind a list its qualifier may reach.
WIDEST, WINDOW = 50, 220
#: How many parts of texts a worker remembers, and how long they are at most.
REMEMBERED, SHORT = 1 << 14, 400

_LONGEST_FIRST = sorted(ALIASES, key=len, reverse=True)
_AFTER_OF = re.compile("|".join(rf"{re.escape(n)}\b" for n in _LONGEST_FIRST), re.IGNORECASE)
_BARE = re.compile(r"\s+(" + "|".join(rf"\b{re.escape(n)}\b" for n in _LONGEST_FIRST) + ")")
_NAMED = [(n.lower(), re.compile(rf"\b(?:the\s+)?{re.escape(n)}\b", re.IGNORECASE)) for n in _LONGEST_FIRST]
_BY_NUMBER = [(name.split()[0], letter, name, rule) for letter, name, rule in INSTRUMENTS]
_BY_NAME = {n.lower(): (celex, short, short) for n, (celex, short) in ALIASES.items()}
_MAY_REFER = r"\bArticle|\bAnnex|Regulation\s*\(|Directive[\s(]|Decision\s*\(|(?i:" + "|".join(map(re.escape, _LONGEST_FIRST)) + ")"
#: Letters that a rule without regard to case takes for others, though lower() doesn't.
_ODD_CASE = re.compile("[\u0130\u0131\u017f\u212a]")

FIELDS = ["raw", "kind", "target_kind", "target", "paragraph", "letter", "subparagraph", "celex", "short_name", "official_name"]

Span = tuple[int, int]
#: What an instrument is: celex, short name, official name.
About = tuple[str | None, str | None, str | None]
UNSAID: About = (None, None, None)


@lru_cache(1 << 16)
def _of_number(letter: str, name: str, parts: tuple[tuple[str, str], ...]) -> About:
    said = dict(parts)
    return f"3{said['y']}{letter}{int(said['n']):04d}", None, name.format(**said)


def _numbered(m: re.Match, letter: str, name: str) -> About:
    """What an instrument with a number is."""
    return _of_number(letter, name, tuple(m.groupdict().items()))


def _kind(celex: str | None) -> str:
    return "internal" if celex in (None, OWN_ID) else "external_gdpr" if celex == GDPR_ID else "external_other"


def listed(text: str, at: int, item: list[re.Pattern], ranges: bool) -> tuple[list[tuple], list[Span], int]:
    """The items of a list that begins at `at` as (target, paragraph, letter, subparagraph),
    the place of each, and where the list ends.

    One separator is taken between items, so a list ends at a doubled one. With `ranges`, a
    range fills in the numbers up to its end, which loses its pin-cite; one wider than
    WIDEST ends the list before its end, and a backward one counts as a plain item.
    """
    first, further = item
    found, spans, end, before = [], [], at, None
    m = first.match(text, at)
    while m:
        joined, *said = m.groups()
        if ranges:
            number = int(said[0] if said[0][-1].isdecimal() else said[0][:-1])
            step = number - before if joined and joined.lower() in RANGE_WORDS else 0
            if step > WIDEST:
                break
        else:
            number = step = 0
        span = m.span(2)[0], m.end()
        if step > 0:
            found += [(str(before + k), None, None, None) for k in range(1, step + 1)]
            spans += [span] * step
        else:
            found.append(tuple(said))
            spans.append(span)
        before, end = number, m.end()
        m = further.match(text, end)
    return found, spans, end


def qualified(text: str, at: int) -> tuple[About, Span | None]:
    """What a list that ends at `at` refers to, and where that is said: this regulation, an
    instrument by number, or one by a name. After "of", "under" or "in" a name may be in any
    case; right behind the list only as it is spelled."""
    window = text[at : at + WINDOW]
    of = OF.match(window)
    if of and (own := THIS_REGULATION.match(window)):
        return UNSAID, (at, at + own.end())
    start = of.end() if of else 0
    if window[start : start + 1] in ("R", "D"):
        for letter, name, rule in INSTRUMENTS:
            if m := rule.match(window, start):
                return _numbered(m, letter, name), (at + start, at + m.end())
    by_of = _AFTER_OF.match(window, start) if of else None
    bare = _BARE.match(window) if window[:1].isspace() else None
    if by_of and (not bare or len(by_of[0]) >= len(bare[1])):
        return _BY_NAME[by_of[0].lower()], (at + start, at + by_of.end())
    return (_BY_NAME[bare[1].lower()], (at, at + bare.end())) if bare else (UNSAID, None)


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _spans_of(text: str, folded: str, name: str) -> Iterator[Span]:
    """Where a name stands as words of its own, in any case, with "the" before it."""
    at = folded.find(name)
    while at >= 0:
        start, end = at, at + len(name)
        if (not at or not _in_word(text[at - 1])) and not _in_word(text[end : end + 1]):
            gap = at
            while gap and text[gap - 1].isspace():
                gap -= 1
            if gap < at and folded[max(0, gap - 3) : gap] == "the" and (gap == 3 or not _in_word(text[gap - 4])):
                start = gap - 3
            yield start, end
            at = folded.find(name, end)
        else:
            at = folded.find(name, at + 1)


def named(text: str) -> list[tuple[int, About, Span]]:
    """Every instrument that is named, the own one too, with the rank of its rule: by number,
    then by names that don't begin or end inside what was found."""
    found: dict[Span, tuple[int, About]] = {}
    for rank, (word, letter, name, rule) in enumerate(_BY_NUMBER):
        for m in rule.finditer(text) if word in text else ():
            found.setdefault(m.span(), (rank, _numbered(m, letter, name)))
    folded = text.lower()
    plain = len(folded) == len(text) and (text.isascii() or not _ODD_CASE.search(text))
    for rank, (name, rule) in enumerate(_NAMED, len(_BY_NUMBER)):
        if name in folded:
            for span in _spans_of(text, folded, name) if plain else (m.span() for m in rule.finditer(text)):
                if not _touches(span, found):
                    found[span] = rank, _BY_NAME[name]
    return [(rank, about, span) for span, (rank, about) in found.items()]


def _touches(span: Span, others) -> bool:
    """Whether the span begins or ends inside another; one that encloses others doesn't."""
    start, end = span
    for s, e in others:
        if s <= start < e or s < end <= e:
            return True
    return False


def _read(part: str) -> tuple[list[tuple], list[tuple], list[tuple[int, tuple]]]:
    """Of a text without a head but at its beginning: the references to articles, to annexes,
    and with their ranks to instruments."""
    articles, annexes, handled = [], [], []
    if head := ARTICLES.match(part):
        items, handled, end = listed(part, head.end(), ARTICLE, ranges=True)
        about, said = qualified(part, end)
        kind = _kind(about[0])
        lead, tail = (part[: said[1] if said else end].strip(), kind, "article"), UNSAID if kind == "internal" else about
        articles = [lead + item + tail for item in items]
        if said:
            handled.append(said)
    elif head := ANNEXES.match(part):
        items, handled, end = listed(part, head.end(), ANNEX, ranges=False)
        lead = part[:end].strip(), "internal", "annex"
        annexes = [lead + item + UNSAID for item in items]
    others = [(rank, about, span) for rank, about, span in named(part) if about[0] != OWN_ID and not _touches(span, handled)]
    return articles, annexes, [(rank, (part[slice(*span)], _kind(about[0]), "instrument", None, None, None, None, *about)) for rank, about, span in others]


_remembered = lru_cache(REMEMBERED)(_read)


def found_references(text: str | None) -> list[tuple]:
    """All references of a text as FIELDS: articles, annexes, then instruments that are
    named apart from these. All of a list share one raw, which reaches through the
    qualifier. What is unqualified is internal.

    A text is read in parts that begin at its heads: no list, qualifier or name holds a head,
    and before a head there is no letter. Short parts, which recur, are remembered.
    """
    text = text or ""
    cuts = [m.start() for m in HEADS.finditer(text)]
    articles, annexes, others = [], [], []
    for start, end in zip([0, *cuts], [*cuts, len(text)]):
        if start < end:
            part = text[start:end]
            a, b, c = _remembered(part) if end - start <= SHORT else _read(part)
            articles += a
            annexes += b
            others += c
    if len(others) > 1:
        others.sort(key=itemgetter(0))
    return articles + annexes + [r for _, r in others]


def references_in(text: str | None) -> list[dict]:
    """found_references with names."""
    return [dict(zip(FIELDS, r)) for r in found_references(text)]


def found_in(chunks: DataFrame, find: Callable[[str], list[tuple]], fields: list[str], gate: str) -> DataFrame:
    """The columns of `chunks` but text, place (in the chunk), and `fields` of all that
    `find` finds. Texts that don't match `gate` aren't sent to Python. A text at which
    `find` fails gives one row with the error in place of all else."""
    kept = [c for c in chunks.columns if c != "text"]
    rows = chunks.where(F.col("text").rlike(gate)).select(*kept, "text")
    out = rows.select(*kept, F.lit(0).alias("place"), *[F.lit("").cast("string").alias(f) for f in [*fields, "error"]]).schema
    failed = (None,) * len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, places, found, errors = [], [], [], {}
            for text in b.column(len(kept)).to_pylist():
                try:
                    own = find(text)
                except Exception as e:  # a text must not end the job
                    own, errors[len(found)] = [failed], repr(e)
                sizes.append(len(own))
                places += range(len(own))
                found += own
            owner = pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int64())
            columns = [pa.array(c, pa.string()) for c in zip(*found)] or [pa.nulls(0, pa.string())] * len(fields)
            error = pa.array([errors.get(i) for i in range(len(found))], pa.string()) if errors else pa.nulls(len(found), pa.string())
            yield pa.RecordBatch.from_arrays([*[c.take(owner) for c in b.columns[: len(kept)]], pa.array(places, pa.int32()), *columns, error], [*kept, "place", *fields, "error"])

    return spread(rows).mapInArrow(run, StructType([StructField(f.name, f.dataType, True) for f in out.fields]))


def references(chunks: DataFrame) -> DataFrame:
    """Rows of found_references for chunks (source, text and any other columns); references of
    a source to itself go."""
    rows = found_in(chunks, found_references, FIELDS, _MAY_REFER)
    own = (F.col("kind") == "internal") & (F.col("target_kind") == "article") & (F.col("target") == F.col("source").cast("string"))
    return rows.where(~F.coalesce(own, F.lit(False)))


def mistagged(refs: DataFrame) -> DataFrame:
    """References whose kind and instrument (celex) disagree: of the GDPR's kind without its id,
    or with its id and of another kind."""
    return refs.where((F.col("kind") == "external_gdpr") != F.coalesce(F.col("celex") == GDPR_ID, F.lit(False)))


def _leading(value: Column) -> Column:
    return F.coalesce(F.regexp_extract(value, r"^(\d+)", 1).try_cast("int"), F.lit(0))


def forward_index(refs: DataFrame, external: bool = False, bound: int = BOUND) -> DataFrame:
    """source, chunk, first, refs: the internal (or the external) references of each source by
    place in the source, target and raw, in numbered chunks of at most `bound`. `refs` may have
    the columns at_paragraph and at_letter that say where its chunk stands."""
    side = refs.where(F.col("error").isNull() & (F.col("kind").startswith("external") if external else F.col("kind") == "internal"))
    text = lambda c: F.coalesce(c, F.lit(""))
    place = [f(F.col(c)) for c, f in (("at_paragraph", _leading), ("at_letter", text)) if c in refs.columns]
    order = [*place, _leading(F.col("target")), text(F.col("target")), text(F.col("raw")), F.col("place")]
    return chunked(side, ["source"], order, FIELDS, "refs", bound, keep=True)


def reverse_index(refs: DataFrame, bound: int = BOUND) -> DataFrame:
    """target, chunk, first, refs: for each article that is referred to, who does so, as (raw,
    source, paragraph, letter) by the source's number, raw and place, in numbered chunks of at
    most `bound`. A source without a leading number comes first."""
    inner = refs.where("kind = 'internal' AND target_kind = 'article'").withColumn("source", F.col("source").cast("string"))
    order = [_leading(F.col("source")), F.col("raw"), F.col("source"), F.col("place")]
    return chunked(inner, ["target"], order, ["raw", "source", "paragraph", "letter"], "refs", bound, keep=True)


_TALLIED = ["kind", "target_kind", "celex", "short_name", "source", "target"]


def tallied(refs: DataFrame) -> DataFrame:
    """How many references there are of each kind, instrument, source and target, and how many
    chunks failed: what counters and coverage need, counted in the tasks and stored."""
    return stored(refs.groupBy(*_TALLIED, F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n")), "tallies")


def counters(refs: DataFrame) -> DataFrame:
    """counter, value, n: references by kind, by target kind (internal ones), by instrument
    (external ones), by source and by name."""
    return counters_of(tallied(refs))


def counters_of(tallies: DataFrame) -> DataFrame:
    """The counters of stored tallies, in one pass of grouping sets."""
    rows = tallies.where("not failed").select(
        "kind", F.when(F.col("kind") == "internal", F.col("target_kind")).alias("target_kind"), F.when(F.col("kind") != "internal", F.coalesce("celex", F.lit("(none)"))).alias("celex"),
        F.col("source").cast("string").alias("source"), "short_name", F.col("n").alias("of"),
    )
    names = ["kind", "target_kind", "celex", "source", "short_name"]
    ids = {n: sum(1 << (len(names) - 1 - i) for i, m in enumerate(names) if m != n) for n in names}
    sets = rows.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(F.sum("of").alias("n"), F.grouping_id().alias("g"))
    counter, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n in names:
        counter, value = F.when(F.col("g") == ids[n], n).otherwise(counter), F.when(F.col("g") == ids[n], F.col(n)).otherwise(value)
    return sets.select(counter.alias("counter"), value.alias("value"), "n").where("value IS NOT NULL")


def coverage(refs: DataFrame) -> DataFrame:
    """measure, n: how many references there are of either side, and how many sources have
    some, how many articles are referred to, and how many chunks failed."""
    return coverage_of(tallied(refs))


def coverage_of(tallies: DataFrame) -> DataFrame:
    """The measures of stored tallies."""
    internal, external = F.col("kind") == "internal", F.col("kind") != "internal"
    total = lambda of: F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0))
    one = tallies.agg(
        total(internal).alias("internal"), total(external).alias("external"),
        F.countDistinct(F.when(internal, F.col("source"))).alias("sources_internal"), F.countDistinct(F.when(external, F.col("source"))).alias("sources_external"),
        F.countDistinct(F.when(internal & (F.col("target_kind") == "article"), F.col("target"))).alias("articles_cited"), total(F.col("failed")).alias("failed"),
    )
    return one.unpivot([], one.columns, "measure", "n")
