"""Citations of articles in guidance documents: only where the act itself is in view."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexbolt.functions.text import cut_at_word, sentences
from lexbolt.operators.citations import found_in
from lexbolt.operators.postings import BOUND, chunked
from lexbolt.operators.relations import asof_backward
from lexbolt.sources.readers import by_keys
from lexbolt.sources.stores import stored

#: How guidance cites, and what puts the act in view.
IN_VIEW = r"(?i)(AI\s*Act|Regulation\s*\(EU\)\s*2024/1689|AI[-\s]*verordening)"
SINGLE = re.compile(r"\b(?:Articles?|Artikel(?:en)?)\s+(\d{1,3})(?:\s*\(\s*(\d+[a-z]?)\s*\))?(?:\s*(?:,\s*point\s+)?\(\s*([a-z])\s*\))?", re.IGNORECASE)
MORE = re.compile(r"(?:,\s*\(\s*(\d+[a-z]?)\s*\)|\s*(?:and|en)\s*\(\s*(\d+[a-z]?)\s*\))", re.IGNORECASE)
SEVERAL = re.compile(r"\b(?:Articles|Artikelen)\s+(\d{1,3})(?:\s*,\s*(\d{1,3}))?(?:\s*,\s*(\d{1,3}))?(?:\s*(?:and|en)\s*(\d{1,3}))?", re.IGNORECASE)
DUTCH = re.compile(r"\bartikel(?:en)?\s+(\d{1,3})(?:,?\s+lid\s+(\d+))?(?:,?\s+onder\s+([a-z]))?", re.IGNORECASE)
REACH, CONTEXT, ARTICLES = 120, 400, (1, 113)

FIELDS = ["form", "start", "end", "article", "paragraph", "letter", "raw"]


def in_view(text: Column) -> Column:
    return F.coalesce(text.rlike(IN_VIEW), F.lit(False))


def candidates(text: str) -> list[tuple]:
    """All that could be a citation, each form by itself, as FIELDS: of lists (two to
    four numbers) a row a number, of single ones also a row for each paragraph in brackets
    that follows within REACH characters, and the Dutch form with lid and onder."""
    row = lambda form, m, *said: (form, str(m.start()), str(m.end()), *said)
    several = ((m, [n for n in m.groups() if n]) for m in SEVERAL.finditer(text))
    out = [row("list", m, n, None, None, m[0]) for m, numbers in several if len(numbers) > 1 for n in numbers]
    for m in SINGLE.finditer(text):
        after = (a or b for a, b in MORE.findall(text, m.end(), m.end() + REACH))
        out += [row("single", m, *m.groups(), m[0]), *(row("more", m, m[1], p, None, f"Article {int(m[1])}({p})") for p in after)]
    return out + [row("dutch", m, *m.groups(), m[0]) for m in DUTCH.finditer(text)]


def cited(chunks: DataFrame, key: list[str]) -> DataFrame:
    """The columns of `chunks` but text, place, article (a number), paragraph, letter, raw.
    `key` tells chunks apart; the Dutch form counts in Dutch ones alone.

    What touches a list is hidden by it: the last list that starts before a candidate's end is
    found in one window over places. A Dutch form without lid or onder counts only for an
    article that no other form, and no Dutch one before it, has in the chunk.
    """
    found = found_in(chunks, candidates, FIELDS, r"(?i)\barti(?:cle|kel)").where((F.col("form") != "dutch") | (F.col("lang") == "nl"))
    found = by_keys(stored(found, "candidates"), *key)  # both windows share this shuffle
    is_list, start, end = F.col("form") == "list", F.col("start").cast("int"), F.col("end").cast("int")
    by_place = W.partitionBy(*key).orderBy(F.when(is_list, start).otherwise(end), is_list).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = found.withColumn("article", F.col("article").cast("int")).withColumn("reach", F.max(F.when(is_list, end)).over(by_place))
    found = found.where(is_list | F.col("reach").isNull() | (F.col("reach") <= start))
    same = W.partitionBy(*key, "article")
    is_dutch = F.col("form") == "dutch"
    bare = is_dutch & F.col("paragraph").isNull() & F.col("letter").isNull()
    others = F.count_if(~is_dutch).over(same) + F.count_if(is_dutch).over(same.orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    return found.withColumn("others", others).where(~bare | (F.col("others") == 0)).drop("form", "start", "end", "reach", "others", "error")


def chunks_in_view(pages: DataFrame, notes: DataFrame) -> DataFrame:
    """doc, lang, page, note, sentence, text: the notes, and the sentences of pages (doc,
    lang, page, text), that have the act in view."""
    kept = notes.where(in_view(F.col("text"))).select("doc", "lang", "page", F.col("number").cast("int").alias("note"), F.lit(0).alias("sentence"), "text")
    parts = pages.where(in_view(F.col("text"))).select("doc", "lang", "page", F.lit(None).cast("int").alias("note"), F.posexplode(sentences(F.col("text"))).alias("sentence", "text"))
    return kept.unionByName(parts.where(in_view(F.col("text"))))


def guidance_citations(pages: DataFrame, notes: DataFrame, sections: DataFrame) -> DataFrame:
    """doc, lang, section, page, note, article, paragraph, letter, raw, context: a row for
    each article, paragraph and letter at each place, the first that cites it (notes before
    text, then by sentence and place). `sections` (doc, number, page) gives the last section
    that starts at the page or before. Articles that the act doesn't have go."""
    chunks = chunks_in_view(pages, notes).withColumn("context", cut_at_word(F.trim("text"), CONTEXT)).withColumn("own", F.xxhash64("text"))
    rows = cited(chunks, ["doc", "lang", "page", "note", "sentence", "own"]).drop("own")
    rows = stored(rows.where(F.col("article").between(*ARTICLES)), "citations")
    # Sections and citations of a document meet in one order: of a page the sections first.
    start = sections.select("doc", "page", F.col("number").cast("string").alias("mark"), F.lit(0).alias("rank"))
    both = rows.withColumn("rank", F.lit(1)).unionByName(start, allowMissingColumns=True)
    placed = asof_backward(both, F.col("rank") == 0, F.col("rank") == 1, "doc", ["page", "rank"], "mark").withColumnRenamed("last_marker", "section")
    key = ["doc", "lang", "page", "note", "section", "article", "paragraph", "letter"]
    first = W.partitionBy(*key).orderBy("sentence", "place")
    found = placed.withColumn("n", F.row_number().over(first)).where("n = 1")
    return found.select("doc", "lang", "section", "page", "note", "article", "paragraph", "letter", "raw", "context")


def by_article(citations: DataFrame, bound: int = BOUND) -> DataFrame:
    """article, chunk, first, citations: of each article, by document, language, section (as
    text), page, note and raw, in numbered chunks of at most `bound`."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    order = [text("doc"), text("lang"), text("section"), number("page"), number("note"), text("raw")]
    return chunked(citations, ["article"], order, ["doc", "lang", "section", "page", "note", "paragraph", "letter", "raw"], "citations", bound, keep=True)
