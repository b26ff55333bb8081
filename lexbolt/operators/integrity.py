"""Integrity of rendered pages and of indexes: every check is a row of a suite.

Pages are rows of url and html. Links are found in generated code by one scan; where a link
leads is compared by one key a page, so that no list of candidate files is tried one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexbolt.functions.text import page_key, resolved_path
from lexbolt.operators.postings import chunked
from lexbolt.operators.relations import check

#: Where links stand in a page, and schemes that leave the site.
ANCHOR = r'(?i)<a\s[^>]*href="([^"]+)"'
LINK = r"(?i)(<link\s[^>]*>)"
REFRESH = r'(?i)<meta\s[^>]*http-equiv="refresh"[^>]*content="[^"]*url=([^";]+)'
LEAVES = r"^(?:https?://|//|mailto:|tel:|javascript:)"


def _attribute(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, rf'(?i)\s{name}="([^"]*)"', 1), F.lit(""))


def page_links(pages: DataFrame) -> DataFrame:
    """url, kind (anchor, alternate, canonical, refresh), lang (of alternates), href."""
    none = F.lit(None).cast("string")
    one = lambda kind, lang, href: F.struct(F.lit(kind).alias("kind"), lang.alias("lang"), href.alias("href"))
    anchors = F.transform(F.regexp_extract_all("html", F.lit(ANCHOR), 1), lambda h: one("anchor", none, h))
    tags = F.regexp_extract_all("html", F.lit(LINK), 1)
    rel = lambda t, word: F.coalesce(_attribute(t, "rel"), F.lit("")).contains(word)
    alternates = F.transform(F.filter(tags, lambda t: rel(t, "alternate") & _attribute(t, "hreflang").isNotNull()), lambda t: one("alternate", _attribute(t, "hreflang"), F.coalesce(_attribute(t, "href"), F.lit(""))))
    canonical = F.transform(F.filter(tags, lambda t: rel(t, "canonical") & _attribute(t, "href").isNotNull()), lambda t: one("canonical", none, _attribute(t, "href")))
    refresh = F.transform(F.slice(F.regexp_extract_all("html", F.lit(REFRESH), 1), 1, 1), lambda h: one("refresh", none, F.trim(h)))
    return pages.select("url", F.inline(F.concat(anchors, alternates, canonical, refresh)))


def internal_links(links: DataFrame) -> DataFrame:
    """Anchors and refreshes that stay on the site, with path: where they lead. Links inside
    the page stay out."""
    inner = links.where(F.col("kind").isin("anchor", "refresh") & ~F.col("href").rlike(LEAVES) & ~F.col("href").startswith("#"))
    return inner.withColumn("path", resolved_path(F.col("href"), F.col("url")))


def dangling_links(pages: DataFrame, classes: list[tuple[str, str]] = ()) -> DataFrame:
    """url, href, kind, class: internal links that lead to no page. The class is that of the
    first rule whose expression the path matches, else unexpected."""
    known = pages.select(page_key(F.col("url")).alias("key")).distinct()
    broken = internal_links(page_links(pages)).withColumn("key", page_key(F.col("path"))).join(known, "key", "left_anti")
    label = F.lit("unexpected")
    for name, rule in reversed(list(classes)):
        label = F.when(F.col("path").rlike(rule), name).otherwise(label)
    return broken.select("url", "href", "kind", label.alias("class"))


def alternate_failures(pages: DataFrame, langs: list[str], first: str, origin: str) -> DataFrame:
    """url, failure: pages that lack an alternate, whose x-default isn't that of the first
    language, or whose alternates lead to no page. Redirect stubs are left out."""
    links = page_links(pages.where(F.length("html") > 0))
    stubs = links.where("kind = 'refresh'").select("url").distinct()
    last = F.max_by("href", "href")
    found = links.where("kind = 'alternate'").groupBy("url").pivot("lang", [*langs, "x-default"]).agg(last)
    rows = pages.where(F.length("html") > 0).select("url").distinct().join(stubs, "url", "left_anti").join(found, "url", "left")
    lacks = [F.when(F.col(n).isNull(), F.lit(f"lacks {n}")) for n in [*langs, "x-default"]]
    other = F.when(F.col("x-default") != F.col(first), F.lit("x-default differs"))
    wanted = rows.select("url", F.explode(F.array_compact(F.array(*lacks, other))).alias("failure"))
    targets = rows.select("url", F.explode(F.array(*[F.struct(F.lit(n).alias("lang"), F.col(n).alias("href")) for n in langs])).alias("t")).select("url", "t.*").where("href IS NOT NULL")
    known = pages.select(page_key(F.col("url")).alias("key")).distinct()
    here = F.when(F.col("href").startswith(origin), page_key(F.col("href")))
    lost = targets.withColumn("key", here).join(known, "key", "left_anti")
    return wanted.unionByName(lost.select("url", F.concat(F.lit("no page for "), "lang").alias("failure")))


def both_ways(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str] = ("missing", "spurious")) -> DataFrame:
    """Distinct keys of one side alone: those of the left are missing, those of the right
    spurious. Null is a value."""
    a, b = left.select(*keys), right.select(*keys)
    return a.subtract(b).withColumn("side", F.lit(names[0])).unionByName(b.subtract(a).withColumn("side", F.lit(names[1])))


#: Markers of a page that are looked for together.
MARKERS = 1024


def without_marker(index: DataFrame, pages: DataFrame, key: str, marker: str, body: str) -> DataFrame:
    """Rows of the index whose page is missing or doesn't contain their marker.

    A page's markers are gathered first, in lists of at most MARKERS, and meet its body once a
    list; an automaton of all of a list finds them in one scan of the body. Pages with one key
    count together: a marker is there if one of them has it. A null marker is nowhere.
    """
    kinds = [index.schema[c] for c in (key, marker)]
    wanted = index.select(key, marker).where(F.col(marker).isNotNull()).distinct()
    lists = chunked(wanted, [key], [F.col(marker)], [marker], "__markers", MARKERS).select(key, F.col(f"__markers.{marker}").alias("__markers"))
    bodies = lists.join(pages.select(key, F.col(body).alias("__body")), key).select(key, "__markers", "__body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, there = [], []
            for i, (markers, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2))):
                found = contained(markers, text.as_py() or "")
                owner += [i] * len(found)
                there += found
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), pa.array(there, pa.string())], [key, marker])

    found = bodies.mapInArrow(run, StructType(kinds)).distinct().withColumn("__there", F.lit(True))
    return index.join(found, [key, marker], "left").where("__there IS NULL").select(*index.columns)


def contained(markers: list[str], text: str) -> list[str]:
    """Which of the markers are in the text."""
    if len(markers) < 8:
        return [m for m in markers if m in text]
    import ahocorasick

    machine = ahocorasick.Automaton()
    for m in filter(None, markers):
        machine.add_word(m, m)
    machine.make_automaton()
    there = {m for _, m in machine.iter(text)} if len(machine) else set()
    return [m for m in markers if m in there or not m]


def counted(name: str, rows: DataFrame, expected: int | DataFrame) -> DataFrame:
    """A check that there are just so many rows: a number, or as many as another table has."""
    n = rows.agg(F.count("*").alias("n"))
    wanted = expected.agg((-F.count("*")).alias("n")) if isinstance(expected, DataFrame) else rows.sparkSession.range(1).select(F.lit(-expected).cast("long").alias("n"))
    off = n.unionByName(wanted).agg(F.abs(F.sum("n")).alias("failures"))
    return off.select(F.lit(name).alias("name"), F.when(F.col("failures") == 0, "PASS").otherwise("FAIL").alias("status"), "failures")


def skipped(spark, name: str) -> DataFrame:
    return spark.range(1).select(F.lit(name).alias("name"), F.lit("SKIP").alias("status"), F.lit(0).cast("long").alias("failures"))


def suite(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def catalogue_failures(rows: DataFrame, keys: list[str], catalogue: DataFrame) -> DataFrame:
    """Counts by key that differ from the catalogue's (keys and n); a key that either lacks
    counts 0."""
    have = rows.groupBy(*keys).agg(F.count("*").alias("have"))
    both = have.join(catalogue.select(*keys, F.col("n").alias("want")), keys, "full_outer").fillna(0, ["have", "want"])
    return both.where("have <> want")


def unknown_languages(docs: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Documents whose array of languages is null, empty or has others than those allowed."""
    known = F.array(*map(F.lit, allowed))
    return docs.where(F.coalesce(F.size(column), F.lit(0)).__eq__(0) | (F.size(F.array_except(column, known)) > 0))


def index_checks(index: DataFrame, docs: DataFrame, langs: list[str], articles: tuple[int, int]) -> DataFrame:
    """Five rules of an index (article, doc, lang, raw, location) and its size."""
    number = F.col("article").cast("string").try_cast("int")
    total = index.agg(F.count("*").alias("failures")).select(F.lit("entries").alias("name"), F.lit("INFO").alias("status"), "failures")
    return suite(
        total,
        check("documents known", index.join(docs.select("doc").distinct(), "doc", "left_anti")),
        check("articles valid", index.where(~F.coalesce(number.between(*articles), F.lit(False)))),
        check("languages valid", index.where(~F.coalesce(F.col("lang").isin(langs), F.lit(False)))),
        check("citations given", index.where(F.coalesce("raw", F.lit("")) == "")),
        check("locations given", index.where(F.col("location").isNull())),
    )


def asserted(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows; the job fails with the message at the first that doesn't meet the condition."""
    ok = F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return rows.where(ok)


def link_suite(pages: DataFrame, origin: str, langs: list[str], sitemap: DataFrame, broken: list[tuple[str, str]] = (), routes: list[tuple[str, str, int | DataFrame]] = (), home: str = "/") -> DataFrame:
    """The checks of a rendered site: dangling links (classes of `broken` are only SOFT),
    alternates, canonical links, redirects, language of the page, empty pages, the site map
    both ways, numbers of pages by route, and the home page."""
    links = page_links(pages)
    dangling = dangling_links(pages, broken)
    known = pages.select(page_key(F.col("url")).alias("key")).distinct()
    canonical = links.where("kind = 'canonical'")
    refresh = internal_links(links).where("kind = 'refresh'").withColumn("key", page_key(F.col("path")))
    lang = F.regexp_extract("html", r'(?i)<html[^>]*\slang="([^"]+)"', 1)
    in_path = F.regexp_extract(F.col("url"), rf"^(?:[a-z]+://[^/]*)?/({'|'.join(langs)})(?:/|$)", 1)
    listed = sitemap.select(page_key(F.col("loc")).alias("key")).distinct()
    return suite(
        check("links resolve", dangling.where("class = 'unexpected'")),
        check("links known to be broken", dangling.where("class <> 'unexpected'"), soft=True),
        check("alternates", alternate_failures(pages, langs, langs[0], origin)),
        check("canonical is the page", canonical.where(page_key(F.col("href")) != page_key(F.col("url")))),
        check("redirects resolve", refresh.join(known, "key", "left_anti")),
        check("language of the page", pages.where((in_path != "") & (lang != in_path))),
        check("no empty page", pages.where(F.coalesce(F.length("html"), F.lit(0)) == 0)),
        check("site map leads to pages", listed.join(known, "key", "left_anti")),
        check("pages are in the site map", known.join(listed, "key", "left_anti"), soft=True),
        check("home page", known.where(F.col("key") == page_key(F.lit(home))).agg(F.count("*").alias("n")).where("n = 0")),
        *[counted(f"route {name}", pages.where(F.col("url").rlike(rule)), n) for name, rule, n in routes],
    )
