"""Suites of checks over documents, pages and indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexbolt.operators import crawl as W
from lexbolt.operators import integrity as I
from lexbolt.operators import relations as R
from lexbolt.operators import tags as T
from lexbolt.plans.base import SQL, made, query
from lexbolt.sources.readers import table

c = F.col


def _check(name: str, failing: str, soft: bool = False) -> str:
    """SQL of a row of a suite, from that of its failing rows."""
    return f"SELECT '{name}' AS name, CASE WHEN n = 0 THEN 'PASS' ELSE '{'SOFT' if soft else 'FAIL'}' END AS status, n AS failures FROM (SELECT count(*) AS n FROM ({failing}))"


@query(" UNION ALL ".join([
    _check("labels resolve", "SELECT 1 FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)"),
    _check("unique document ids", "SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1"),
    _check("languages known", "SELECT 1 FROM documents WHERE lang NOT IN ('en', 'fr', 'de')"),
    _check("orders have customers", "SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"),
    _check("texts collapse", "SELECT 1 FROM documents WHERE length(text) > 400 AND NOT contains(text, chr(10))", soft=True),
    _check("twenty-five nations", "SELECT 1 WHERE (SELECT count(*) FROM nation) <> 25"),
    _check("sizes as counted", "SELECT 1 FROM documents WHERE n_chars IS DISTINCT FROM length(text)"),
    _check("counts as catalogued", "SELECT 1 FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) FULL JOIN (SELECT unnest(range(0, 6)) AS k, 5 AS want) ON k = n_regionkey WHERE coalesce(n, 0) <> coalesce(want, 0)"),
    _check("second language present", "SELECT 1 WHERE NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'de')"),
    _check("third language absent", "SELECT 1 FROM documents WHERE lang = 'nl'"),
    "SELECT 'not shipped' AS name, 'SKIP' AS status, 0 AS failures",
]))
def quality_suite(spark, sf_dir):
    """Each table is read once: documents with labels by document, orders with customers by
    customer, nations by region."""
    d = table(spark, sf_dir, "documents")
    known = F.array(*map(F.lit, ("en", "fr", "de")))
    tests = {
        "unknown": ("documents", F.coalesce(~F.array_contains(known, c("lang")), F.lit(True))), "flat": ("documents", (F.length("text") > 400) & ~F.contains("text", F.lit("\n"))),
        "missized": ("documents", ~c("n_chars").eqNullSafe(F.length("text"))), "second": ("documents", c("lang") == "de"), "third": ("documents", c("lang") == "nl"),
    }
    docs = R.key_counts({"documents": (d, "doc_id"), "labels": (table(spark, sf_dir, "labels"), "doc_id")}, tests)
    docs = docs.withColumn("absent", (c("second") == 0).cast("int"))
    orders = R.key_counts({"orders": (table(spark, sf_dir, "orders"), "o_custkey"), "customer": (table(spark, sf_dir, "customer"), "c_custkey")}, {})
    catalogue = spark.range(6).select(c("id").cast("int").alias("n_regionkey"), F.lit(5).alias("want"))
    by_region = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("have")).join(catalogue, "n_regionkey", "full_outer").fillna(0, ["have", "want"])
    nations = by_region.agg(F.abs(F.sum("have") - 25).alias("off"), F.count_if(c("have") != c("want")).alias("uncatalogued"))
    return I.suite(
        R.measured(docs, {"labels resolve": "lost_labels", "unique document ids": "dup_documents", "languages known": "unknown", "texts collapse": "flat", "sizes as counted": "missized", "second language present": "absent", "third language absent": "third"}, soft=("texts collapse",)),
        R.measured(orders, {"orders have customers": "lost_orders"}),
        R.measured(nations, {"twenty-five nations": "off", "counts as catalogued": "uncatalogued"}),
        I.skipped(spark, "not shipped"),
    )


_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {n}" for s, n in (("PASS", "passed"), ("FAIL", "failed"), ("SOFT", "soft"), ("SKIP", "skipped")))


@query(f"SELECT *, CASE WHEN failed > 0 THEN 'FAIL' WHEN soft > 0 THEN 'CAVEATS' ELSE 'PASS' END AS verdict FROM (SELECT {_COUNTS} FROM ({SQL['quality_suite']}))")
def suite_verdict(spark, sf_dir):
    return R.verdict(quality_suite(spark, sf_dir))


@query(f"SELECT '# Checks' || chr(10) || chr(10) || '| check | status | failures |' || chr(10) || '|-|-|-|' || chr(10) || string_agg('| ' || name || ' | ' || status || ' | ' || failures || ' |', chr(10) ORDER BY name) AS markdown FROM ({SQL['quality_suite']})")
def suite_report(spark, sf_dir):
    return R.report(quality_suite(spark, sf_dir), "Checks")


# ---- rendered pages: the pages' own links, and links written from their ids

#: A site made of the pages: page k has an alternate in the other language, a canonical link,
#: links to its neighbours, one beyond the last, one that is known to be broken, and some stubs.
_HEAD = "'<html lang=\"' || if(page_id % 11 = 0, 'xx', 'en') || '\"><head><link rel=\"alternate\" hreflang=\"en\" href=\"https://s.example/en/p' || page_id || '/\"><link rel=\"alternate\" hreflang=\"nl\" href=\"https://s.example/nl/p' || (page_id % 40) || '/\"><link rel=\"alternate\" hreflang=\"x-default\" href=\"https://s.example/' || if(page_id % 7 = 0, 'nl', 'en') || '/p' || page_id || '/\"><link rel=\"canonical\" href=\"https://s.example/en/p' || if(page_id % 13 = 0, 0, page_id) || '/index.html\">'"
_REFRESH = "if(page_id % 10 = 3, '<meta http-equiv=\"refresh\" content=\"0; url=/en/p' || (page_id + 1) || '/\">', '')"
_BODY = "'</head><a class=\"x\" href=\"../p' || (page_id + 1) || '/#top\">n</a><a href=\"#here\">h</a><a href=\"mailto:x\">m</a><a href=\"https://else.example/\">o</a><a href=\"/old/p' || page_id || '\">b</a></html>'"


def _site(spark, sf_dir):
    english = made(spark, sf_dir, "pages", url="'https://s.example/en/p' || page_id || '/'", html=f"{_HEAD} || {_REFRESH} || {_BODY}")
    dutch = made(spark, sf_dir, "pages", k="page_id % 40", page_id="page_id").where("page_id < 40").select(F.expr("'https://s.example/nl/p' || page_id || '/index.html'").alias("url"), F.expr("'<html lang=\"nl\"><meta http-equiv=\"refresh\" content=\"0; url=/en/p' || page_id || '/\"></html>'").alias("html"))
    return english.unionByName(dutch)


_LAST = "SELECT page_id FROM pages WHERE page_id + 1 NOT IN (SELECT page_id FROM pages)"


@query(f"SELECT 'https://s.example/en/p' || page_id || '/' AS url, '../p' || (page_id + 1) || '/#top' AS href, 'anchor' AS kind, 'unexpected' AS class FROM ({_LAST}) UNION ALL SELECT 'https://s.example/en/p' || page_id || '/', '/old/p' || page_id, 'anchor', 'old' FROM pages UNION ALL SELECT 'https://s.example/en/p' || page_id || '/', '/en/p' || (page_id + 1) || '/', 'refresh', 'unexpected' FROM ({_LAST}) WHERE page_id % 10 = 3")
def dangling_links(spark, sf_dir):
    return I.dangling_links(_site(spark, sf_dir), [("old", "^/old/")])


@query(f"SELECT class, count(*) AS n FROM ({SQL['dangling_links']}) GROUP BY class")
def broken_by_class(spark, sf_dir):
    return dangling_links(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"))


_FOUND = "SELECT 'https://s.example/en/p' || page_id || '/' AS url, page_id FROM pages WHERE page_id % 10 <> 3"


@query(f"SELECT url, 'x-default differs' AS failure FROM ({_FOUND}) WHERE page_id % 7 = 0 UNION ALL SELECT url, 'no page for nl' FROM ({_FOUND}) WHERE page_id % 40 NOT IN (SELECT page_id FROM pages WHERE page_id < 40)")
def alternate_failures(spark, sf_dir):
    return I.alternate_failures(_site(spark, sf_dir), ["en", "nl"], "en", "https://s.example")


def _sitemap(spark, sf_dir):
    return made(spark, sf_dir, "pages", page_id="page_id", loc="'https://s.example/en/p' || (page_id + 5) || '/'").drop("page_id")


@query(" UNION ALL ".join([
    _check("links resolve", f"SELECT 1 FROM ({SQL['dangling_links']}) WHERE class = 'unexpected'"),
    _check("links known to be broken", "SELECT 1 FROM pages", soft=True),
    _check("alternates", f"SELECT 1 FROM ({SQL['alternate_failures']})"),
    _check("canonical is the page", "SELECT 1 FROM pages WHERE page_id % 13 = 0 AND page_id <> 0"),
    _check("redirects resolve", f"SELECT 1 FROM ({_LAST}) WHERE page_id % 10 = 3"),
    _check("language of the page", "SELECT 1 FROM pages WHERE page_id % 11 = 0"),
    _check("no empty page", "SELECT 1 WHERE false"),
    _check("site map leads to pages", "SELECT 1 FROM pages WHERE page_id + 5 NOT IN (SELECT page_id FROM pages)"),
    _check("pages are in the site map", "SELECT 1 FROM pages WHERE page_id NOT IN (SELECT page_id + 5 FROM pages) UNION ALL SELECT 1 FROM pages WHERE page_id < 40", soft=True),
    _check("home page", "SELECT 1 WHERE false"),
    _check("route en", "SELECT 1 WHERE false"),
    "SELECT 'route nl' AS name, CASE WHEN n = 40 THEN 'PASS' ELSE 'FAIL' END AS status, abs(n - 40) AS failures FROM (SELECT count(*) AS n FROM pages WHERE page_id < 40)",
]))
def link_suite(spark, sf_dir):
    return I.link_suite(_site(spark, sf_dir), "https://s.example", ["en", "nl"], _sitemap(spark, sf_dir), [("old", "^/old/")], [("en", "/en/", table(spark, sf_dir, "pages")), ("nl", "/nl/", 40)], home="/en/p1/")


@query(r"""SELECT page_id, 'anchor' AS kind, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]+)"', 1)) FROM pages) GROUP BY page_id""")
def page_link_counts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(c("page_id").alias("url"), "html")
    return I.page_links(pages).groupBy(c("url").alias("page_id"), "kind").agg(F.count("*").alias("n"))


#: A site over the pages' ids: page k links to 2k, 2k + 1 and beyond what there is, unless 7
#: divides it, so that some pages can't be reached.
_LINKS = "if(page_id % 7 = 0, '', '<a href=\"/en/p' || (2 * page_id) || '/\">a</a><a class=\"x\" href=\"../p' || (2 * page_id + 1) || '/#x\">b</a><a href=\"https://else.example/\">c</a>')"


@query("""WITH RECURSIVE e AS (SELECT page_id AS s, unnest([2 * page_id, 2 * page_id + 1]) AS t FROM pages WHERE page_id % 7 <> 0),
 r AS (SELECT CAST(1 AS BIGINT) AS page, 0 AS distance UNION SELECT e.t, r.distance + 1 FROM r JOIN e ON e.s = r.page JOIN pages p ON p.page_id = e.t),
 best AS (SELECT page, min(distance) AS distance FROM r GROUP BY page),
 gone AS (SELECT e.t, min(best.distance) + 1 AS distance FROM e JOIN best ON best.page = e.s WHERE e.t NOT IN (SELECT page_id FROM pages) GROUP BY e.t)
 SELECT 'https://s.example/en/p' || page_id || '/' AS url, CAST(distance AS INTEGER) AS distance, CASE WHEN distance IS NULL THEN 'unreachable' ELSE 'reached' END AS state FROM pages LEFT JOIN best ON best.page = page_id
 UNION ALL SELECT '/en/p' || t, CAST(distance AS INTEGER), 'missing' FROM gone""")
def pages_reached(spark, sf_dir):
    pages = made(spark, sf_dir, "pages", page_id="page_id", url="'https://s.example/en/p' || page_id || '/'", html=_LINKS).drop("page_id")
    return W.crawled(pages, ["/en/p1/"])


@query(r"""SELECT page_id, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS heading, nullif(trim(regexp_extract(html, '(?s)<h1>[^<]*</h1>.*?<b>([^<]*)', 1)), '') AS after, (len(regexp_extract_all(html, '<li>')))::BIGINT AS items FROM pages""")
def heading_paragraphs(spark, sf_dir):
    marks = T.tag_rows(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html")
    return T.next_after(marks, "page_id", "h1", "b", count="li")


@query(r"""SELECT page_id, tag, max(depth)::BIGINT AS deepest, count(*) AS n FROM (SELECT page_id, tag, sum(CASE WHEN close THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, tag ORDER BY pos) AS depth, close FROM
 (SELECT page_id, m.pos, regexp_extract(m.raw, '</?([a-z0-9]+)', 1) AS tag, starts_with(m.raw, '</') AS close FROM
 (SELECT page_id, unnest(list_transform(range(1, len(x) + 1), lambda i: {'pos': i, 'raw': x[i]})) AS m FROM (SELECT page_id, regexp_extract_all(html, '</?[a-z][a-z0-9]*[^>]*>') AS x FROM pages))) WHERE tag IN ('ul', 'li', 'div', 'article')) WHERE NOT close GROUP BY page_id, tag""")
def tag_depths(spark, sf_dir):
    marks = T.tag_rows(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html")
    return T.depths(marks, "page_id", ["ul", "li", "div", "article"]).where("NOT close").groupBy("page_id", "tag").agg(F.max("depth").alias("deepest"), F.count("*").alias("n"))


_INDEX = "SELECT event_id, value, event_type, user_id FROM events"


@query("SELECT 'entries' AS name, 'INFO' AS status, count(*) AS failures FROM events UNION ALL " + " UNION ALL ".join([
    _check("documents known", "SELECT 1 FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)"),
    _check("articles valid", "SELECT 1 FROM events WHERE event_type = 'error' OR NOT (floor(value) BETWEEN 1 AND 113)"),
    _check("languages valid", "SELECT 1 FROM events WHERE event_type NOT IN ('click', 'view', 'error')"),
    _check("citations given", "SELECT 1 FROM events WHERE event_id % 9 = 0"),
    _check("locations given", "SELECT 1 FROM events WHERE event_id % 10 = 0"),
]))
def index_checks(spark, sf_dir):
    index = made(spark, sf_dir, "events", article="if(event_type = 'error', 'x', string(bigint(floor(value))))", doc="user_id", lang="event_type", raw="if(event_id % 9 = 0, '', 'r')", location="if(event_id % 10 = 0, null, event_id)")
    docs = made(spark, sf_dir, "customer", doc="c_custkey").where("doc % 2 = 0")
    return I.index_checks(index, docs, ["click", "view", "error"], (1, 113))
