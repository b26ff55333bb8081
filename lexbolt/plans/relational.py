"""Joins, sets, aggregations, windows and sorts over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexbolt.functions import text as X
from lexbolt.operators import integrity as I
from lexbolt.operators import lookups as U
from lexbolt.operators import postings as P
from lexbolt.operators import relations as R
from lexbolt.operators import search as E
from lexbolt.plans.base import made, query
from lexbolt.sources.readers import table
from lexbolt.sources.stores import shared_folder

c = F.col

# ---- links and paths


@query("""SELECT target, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM
 (SELECT page_id, regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)), '[#?].*$', '') AS target FROM pages) GROUP BY target""")
def link_inverted_index(spark, sf_dir):
    return R.link_inverted_index(table(spark, sf_dir, "pages"))


@query("""SELECT target, n_links FROM (SELECT target, count(*) AS n_links FROM
 (SELECT regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)), '[#?].*$', '') AS target FROM pages) GROUP BY target) ORDER BY n_links DESC, target LIMIT 20""")
def topk_links(spark, sf_dir):
    return R.link_inverted_index(table(spark, sf_dir, "pages")).select("target", "n_links").orderBy(F.desc("n_links"), "target").limit(20)


_TARGETS = "SELECT DISTINCT page_id, regexp_replace(unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)), '[#?].*$', '') AS target FROM pages"


@query(f"SELECT target, page_id // 32768 + 1 AS bucket, count(*) AS n, string_agg(page_id, ',' ORDER BY page_id) AS pages FROM ({_TARGETS}) GROUP BY 1, 2")
def link_page_sets(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), 1)).alias("href"))
    links = links.select("page_id", F.regexp_replace("href", r"[#?].*$", "").alias("target"))
    sets = P.members(P.bitmaps(links, ["target"], "page_id"), ["target"], "pages")
    return sets.select("target", "bucket", F.size("pages").cast("long").alias("n"), F.array_join("pages", ",").alias("pages"))


@query(r"""SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path, regexp_extract(p, '^/(en|fr|de|es)(/|$)', 1) AS lang_prefix FROM
 (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[#?].*$', ''), '^[a-z]+://[^/]*', ''), '/index\.html$', '/') AS p FROM pages)""")
def canonical_paths(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", X.url_path(c("url")).alias("path"))
    return p.withColumn("lang_prefix", F.regexp_extract("path", r"^/(en|fr|de|es)(/|$)", 1))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<p>')) AS n_paragraphs, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading FROM pages""")
def html_blocks(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("<p>")).alias("n_paragraphs"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"))


# ---- lookups


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name = 'small ring' ORDER BY p_partkey LIMIT 1")
def point_lookup(spark, sf_dir):
    return U.lookup(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_name", "small ring", ["p_partkey"])


@query("SELECT s_suppkey, s_name FROM (SELECT s_suppkey, upper(s_name) AS s_name FROM supplier) WHERE s_name = 'SUPPLIER#000000007'")
def point_lookup_folded(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.upper("s_name").alias("s_name"))
    return U.lookup(rows, "s_name", "supplier#000000007", ["s_suppkey"], fold=True)


@query("SELECT l_partkey, count(*) AS n, string_agg(l_orderkey || '.' || l_linenumber, ' ' ORDER BY l_orderkey, l_linenumber) AS amendments FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' GROUP BY l_partkey")
def amendments_of_each(spark, sf_dir):
    rows = U.of(table(spark, sf_dir, "lineitem"), l_returnflag="R", l_linestatus="O")
    one = U.listed(rows, ["l_partkey"], [c("l_orderkey"), c("l_linenumber")], ["l_orderkey", "l_linenumber"], "a")
    text = F.transform("a", lambda r: F.concat(r["l_orderkey"].cast("string"), F.lit("."), r["l_linenumber"].cast("string")))
    return one.select("l_partkey", F.size("a").cast("long").alias("n"), F.array_join(text, " ").alias("amendments"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 99 AND o_orderstatus = 'P'")
def foreign_key_filter(spark, sf_dir):
    return U.of(table(spark, sf_dir, "orders"), o_custkey=99, o_orderstatus="P").select("o_orderkey", "o_orderstatus")


def _places(chunks, by, name, *fields):
    """A row an entry of chunks, with its place in the whole list; an empty chunk gives one of nulls."""
    rows = chunks.select(*by, "first", F.posexplode_outer(name).alias("i", "entry"))
    return rows.select(*by, (c("first") + c("i")).alias("place"), *[c(f"entry.{f}").alias(f) for f in fields])


@query("SELECT c_custkey, CASE WHEN o_orderkey IS NOT NULL THEN row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 END AS place, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def index_defaults(spark, sf_dir):
    index = P.chunked(U.of(table(spark, sf_dir, "orders"), o_orderstatus="P").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], [c("o_orderkey")], ["o_orderkey"], "orders")
    rows = U.with_default(table(spark, sf_dir, "customer").select("c_custkey"), index, ["c_custkey"], "orders")
    return _places(rows, ["c_custkey"], "orders", "o_orderkey")


@query("SELECT CAST(p_partkey AS VARCHAR) AS number, p_name AS title, TRY_CAST(regexp_extract(p_brand, '(\\d*)$', 1) AS INTEGER) AS chapter, CASE WHEN p_size > 25 THEN NULL ELSE p_size END AS size FROM part")
def row_projection(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("embedded", F.array("p_type")).drop("embedded", "p_retailprice")
    return rows.select(c("p_partkey").cast("string").alias("number"), c("p_name").alias("title"), F.regexp_extract("p_brand", r"(\d*)$", 1).try_cast("int").alias("chapter"), F.when(c("p_size") <= 25, c("p_size")).alias("size"))


@query("SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations WHERE length(text) > 0")
def unnest_with_parent(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("length(text) > 0").select("conv_id", "turn", F.split("text", " ").alias("words"))
    return U.exploded(rows, "words", "word")


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN 'Titel ' || doc_id WHEN lang IN ('fr', 'es') THEN source ELSE 'd' || doc_id END AS value, CASE WHEN lang IN ('de', 'fr', 'es') THEN lang ELSE 'en' END AS resolved_lang FROM documents")
def language_walk(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    texts = F.create_map(F.lit("de"), F.when(c("lang") == "de", F.concat(F.lit("Titel "), c("doc_id").cast("string"))).otherwise(""), F.coalesce(F.when(c("lang").isin("fr", "es"), c("lang")), F.lit("xx")), c("source"))
    found = X.in_language(texts, F.lit("de"), F.array(F.lit("fr"), F.lit("es")), F.concat(F.lit("d"), c("doc_id").cast("string")))
    return d.select("doc_id", found.alias("t")).select("doc_id", c("t.value").alias("value"), c("t.lang").alias("resolved_lang"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '/nl/annexes/annex-iv/' WHEN p_size % 7 = 0 THEN '#' ELSE '/nl/articles/chapter-' || p_size || '/article-' || p_partkey || '/' END AS href,
 CASE WHEN p_size % 2 = 0 THEN 'https://own.example/en/' || CASE WHEN p_size % 4 = 0 THEN 'article/' || p_partkey || '/' ELSE '' END ELSE 'https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:3' || p_partkey END AS outside FROM part""")
def reference_hrefs(spark, sf_dir):
    rows = made(spark, sf_dir, "part", p_partkey="p_partkey", number="string(p_partkey)", chapter="if(p_size % 7 = 0, null, p_size)", annex="if(p_size % 5 = 0, 'IV', null)", celex="if(p_size % 2 = 0, 'own', '3' || p_partkey)", article="if(p_size % 4 = 0, string(p_partkey), null)")
    outside = X.external_href(c("celex"), F.lit("en"), c("article"), {"own": "https://own.example"})
    return rows.select("p_partkey", X.internal_href(F.lit("nl"), c("chapter"), c("number"), c("annex")).alias("href"), outside.alias("outside"))


@query("SELECT lang, source, count(*) AS n FROM documents WHERE source <> 'src0' AND lang IN ('en', 'de') GROUP BY lang, source")
def facet_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("langs", F.array("lang"))
    return rows.where((c("source") != "src0") & F.arrays_overlap("langs", F.array(F.lit("en"), F.lit("de")))).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def facet_domain(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").where("source IS NOT NULL").distinct()


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'snapshot' WHEN event_type = 'view' THEN 'gap' ELSE 'neither' END AS state FROM events")
def presence_states(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return U.states(e.select("event_id"), e.where("event_type = 'click'"), e.where("event_type IN ('view', 'click')"), ["event_id"])


# ---- joins


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def dangling_refs(spark, sf_dir):
    return R.dangling(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


_DAYS = "SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE event_type = "


@query(f"SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day, CASE WHEN a.day IS NULL THEN 'left' ELSE 'right' END AS missing_in FROM ({_DAYS}'click') a FULL OUTER JOIN ({_DAYS}'view') b ON a.user_id = b.user_id AND a.day = b.day WHERE a.day IS NULL OR b.day IS NULL")
def presence_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    return R.presence_gaps(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id", "day"])


#: Which regions a stage looks at, as a program's literal; one of them looks at none.
_STAGES = {0: [0, 3], 1: [1], 2: [], 3: [2, 4, 9], 4: None}
_STAGE_ROWS = ", ".join(f"({k}, {r})" for k, v in _STAGES.items() for r in v or ["NULL"])


@query(f"SELECT c_custkey, region, n_name FROM customer JOIN (VALUES {_STAGE_ROWS}) AS s(stage, region) ON c_custkey % 5 = stage LEFT JOIN nation ON n_regionkey = region AND n_nationkey = c_nationkey")
def adjacency_literal(spark, sf_dir):
    edges = U.edges_of(U.literal_adjacency(spark, _STAGES, "stage", "regions"), "stage", "regions", "region")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (c("c_custkey") % 5).cast("int").alias("stage"))
    nations = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("c_nationkey"), c("n_regionkey").alias("region"), "n_name")
    return customers.join(F.broadcast(edges), "stage").join(nations, ["region", "c_nationkey"], "left").select("c_custkey", "region", "n_name")


def _parts_of_orders(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("ids"))


@query("SELECT DISTINCT l_orderkey, p_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size < 40")
def adjacency_join(spark, sf_dir):
    entities = table(spark, sf_dir, "part").where("p_size < 40").select("p_partkey", "p_name", c("p_partkey").cast("string").alias("number"))
    return U.related(_parts_of_orders(spark, sf_dir), "l_orderkey", "ids", entities, "number").drop("number")


@query("SELECT CAST(l_partkey AS VARCHAR) AS id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) - 1 AS place, l_orderkey AS entry FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)")
def adjacency_inverse(spark, sf_dir):
    chunks = U.inverted(_parts_of_orders(spark, sf_dir), "l_orderkey", "ids", "orders")
    return chunks.select("id", "first", F.posexplode("orders").alias("i", "entry")).select("id", (c("first") + c("i")).alias("place"), "entry")


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p_name, '') AS p_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 30) ON p_partkey = l_partkey")
def lookup_with_title(spark, sf_dir):
    titles = table(spark, sf_dir, "part").where("p_size < 30").select(c("p_partkey").alias("l_partkey"), "p_name")
    return U.with_title(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), titles, "l_partkey", "p_name")


@query("SELECT lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY d.doc_id) - 1 AS place, d.doc_id FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 1")
def joined_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    lists = U.joined_lists(docs, table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", ["lang", "source"], [c("doc_id")], ["doc_id"], "docs")
    return _places(lists, ["lang", "source"], "docs", "doc_id")


@query("SELECT DISTINCT l_partkey AS s, l_suppkey AS t FROM lineitem EXCEPT SELECT l_suppkey, l_partkey FROM lineitem")
def reverse_edge_symmetry(spark, sf_dir):
    return U.without_reverse(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'spurious' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def id_set_parity(spark, sf_dir):
    return I.both_ways(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def id_intersection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


_SIGNED = "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(floor(value) AS BIGINT) AS pin FROM events WHERE event_type = "


@query(f"SELECT *, 'missing' AS side FROM ({_SIGNED}'click' EXCEPT {_SIGNED}'view') UNION ALL SELECT *, 'spurious' FROM ({_SIGNED}'view' EXCEPT {_SIGNED}'click')")
def signature_asymmetry(spark, sf_dir):
    e = made(spark, sf_dir, "events", user_id="user_id", day="string(to_date(ts))", pin="bigint(floor(value))", event_type="event_type")
    return I.both_ways(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id", "day", "pin"])


@query("SELECT p.page_id, 'href=\"/' || x.w || '\"' AS needle FROM pages p, (VALUES ('the'), ('and'), ('nowhere')) AS x(w) WHERE NOT contains(p.html, 'href=\"/' || x.w || '\"')")
def forward_markers(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    index = pages.select("page_id", F.explode(F.array(*[F.lit(f'href="/{w}"') for w in ("the", "and", "nowhere")])).alias("needle"))
    return I.without_marker(index, pages, "page_id", "needle", "html")


_MARKS = "SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS href FROM pages"


@query(f"SELECT page_id, needle FROM (SELECT page_id + 1 AS page_id, 'href=\"' || href || '\"' AS needle FROM ({_MARKS})) x WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id = x.page_id AND contains(p.html, x.needle))")
def neighbour_markers(spark, sf_dir):
    """The links of a page that the page after it lacks; those of the last have no page."""
    pages = table(spark, sf_dir, "pages")
    hrefs = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), 1)))
    index = pages.select((c("page_id") + 1).alias("page_id"), hrefs.alias("href")).select("page_id", F.concat(F.lit('href="'), "href", F.lit('"')).alias("needle"))
    return I.without_marker(index, pages, "page_id", "needle", "html")


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def union_distinct_routes(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(c("n_name").alias("name")).union(table(spark, sf_dir, "region").select("r_name")).distinct()


@query("SELECT l.lang, d.doc_id, '/' || l.lang || '/' || d.doc_id AS path FROM documents d CROSS JOIN (VALUES ('en'), ('nl')) AS l(lang) WHERE length(d.text) > 0")
def route_cross_product(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.explode(F.array(F.lit("en"), F.lit("nl"))).alias("lang"))
    return rows.select("lang", "doc_id", F.concat(F.lit("/"), "lang", F.lit("/"), c("doc_id").cast("string")).alias("path"))


_SIDES = r"""SELECT page_id, regexp_extract(url, '^https?://[^/]*/([a-z][a-z])/', 1) AS l1, regexp_extract(html, '<html lang="([^"]+)"', 1) AS l2, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t1, CASE WHEN page_id % 3 = 0 THEN regexp_extract(html, '<h1>([^<]*)</h1>', 1) || '*' ELSE regexp_extract(html, '<h1>([^<]*)</h1>', 1) END AS t2 FROM pages"""


@query(f'SELECT page_id, \'lang\' AS field, l1 AS "left", l2 AS "right" FROM ({_SIDES}) WHERE l1 IS DISTINCT FROM l2 UNION ALL SELECT page_id, \'title\', t1, t2 FROM ({_SIDES}) WHERE t1 IS DISTINCT FROM t2')
def field_parity(spark, sf_dir):
    pages, first = table(spark, sf_dir, "pages"), lambda column, rule: F.regexp_extract(column, rule, 1)
    url = pages.select("page_id", first("url", r"^https?://[^/]*/([a-z][a-z])/").alias("lang"), first("html", r"<title>([^<]*)</title>").alias("title"))
    body = pages.select("page_id", first("html", r'<html lang="([^"]+)"').alias("lang"), F.when(c("page_id") % 3 == 0, F.concat(first("html", r"<h1>([^<]*)</h1>"), F.lit("*"))).otherwise(first("html", r"<h1>([^<]*)</h1>")).alias("title"))
    return U.differing(url, body, "page_id", ["lang", "title"])


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 99 END AS stage_order FROM orders")
def stage_order_join(spark, sf_dir):
    stages = spark.createDataFrame([("O", 1), ("F", 2)], "o_orderstatus string, n int")  # the stages, a fixed table
    return table(spark, sf_dir, "orders").join(F.broadcast(stages), "o_orderstatus", "left").select("o_orderkey", F.coalesce("n", F.lit(99)).alias("stage_order"))


@query("SELECT e.event_id, coalesce(c.c_name, p.p_name, s.s_name) AS target FROM events e LEFT JOIN customer c ON e.event_type IN ('signup', 'click') AND c.c_custkey = e.user_id LEFT JOIN part p ON e.event_type = 'view' AND p.p_partkey = e.user_id LEFT JOIN supplier s ON e.event_type IN ('purchase', 'error') AND s.s_suppkey = e.user_id")
def polymorphic_fk(spark, sf_dir):
    one = lambda name, key, title: table(spark, sf_dir, name).select(c(key).alias("key"), c(title).alias("title"))
    sides = {("signup", "click"): one("customer", "c_custkey", "c_name"), ("view",): one("part", "p_partkey", "p_name"), ("purchase", "error"): one("supplier", "s_suppkey", "s_name")}
    return R.polymorphic(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), "event_type", "user_id", sides).select("event_id", c("title").alias("target"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def shared_keys(spark, sf_dir):
    return U.shared_keys(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS sibling FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey")
def sibling_self_join(spark, sf_dir):
    rows = U.siblings(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", [c("o_orderdate"), c("o_orderkey")])
    return rows.select("o_custkey", "o_orderkey", F.explode("siblings").alias("sibling"))


@query("SELECT a.o_custkey, a.o_orderstatus, coalesce(string_agg(DISTINCT b.o_orderstatus, ',' ORDER BY b.o_orderstatus), '') AS others FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus <> b.o_orderstatus GROUP BY a.o_custkey, a.o_orderstatus")
def version_matrix(spark, sf_dir):
    return U.other_versions(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus").withColumn("others", F.array_join("others", ","))


@query("""SELECT p.event_id, max(s.event_id) AS last_marker FROM events p LEFT JOIN events s ON s.user_id = p.user_id AND s.event_type = 'signup'
 AND (s.ts, s.event_id) = (SELECT (max((x.ts, x.event_id))) FROM events x WHERE x.user_id = p.user_id AND x.event_type = 'signup' AND (x.ts, x.event_id) <= (p.ts, p.event_id))
 WHERE p.event_type = 'purchase' GROUP BY p.event_id""")
def asof_section(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return R.asof_backward(e, c("event_type") == "signup", c("event_type") == "purchase", "user_id", ["ts", "event_id"], "event_id").select("event_id", "last_marker")


# ---- aggregations


@query("SELECT p_size, count(*) AS n, string_agg(p_partkey, ',' ORDER BY p_partkey) AS numbers, arg_min(p_name, p_partkey) AS p_name, min(p_partkey) || CASE WHEN count(*) > 1 THEN '–' || max(p_partkey) ELSE '' END AS label, count(*) FILTER (p_type = 'ECONOMY') AS economy FROM part GROUP BY p_size")
def chapter_rollup(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("number", c("p_partkey").cast("string"))
    some = parts.groupBy("p_size").agg(F.count_if(c("p_type") == "ECONOMY").alias("economy"))
    return U.chapters(parts, "number", "p_size", ["p_name"]).join(some, "p_size").withColumn("numbers", F.array_join("numbers", ","))


@query("SELECT d.lang, count(*) AS n, count(l.doc_id) AS labelled, count(*) FILTER (l.toxic = 1) AS toxic, count(*) FILTER (l.quality = 1) AS good FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang")
def conditional_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").withColumn("known", F.lit(1)), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("known").alias("labelled"), F.count_if(c("toxic") == 1).alias("toxic"), F.count_if(c("quality") == 1).alias("good"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS y, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber), (l_suppkey), (year(l_shipdate)))")
def multi_counter_grouping_sets(spark, sf_dir):
    rows = made(spark, sf_dir, "lineitem", l_returnflag="l_returnflag", l_linestatus="l_linestatus", l_linenumber="l_linenumber", l_suppkey="l_suppkey", y="year(l_shipdate)")
    return rows.groupingSets([[c(x)] for x in rows.columns], *[c(x) for x in rows.columns]).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT count(DISTINCT l.doc_id) AS covered, (SELECT count(*) FROM documents) AS total FROM labels l")
def coverage(spark, sf_dir):
    total = table(spark, sf_dir, "documents").select(F.lit(None).cast("long").alias("doc_id"), F.lit(1).alias("d"))
    both = table(spark, sf_dir, "labels").select("doc_id", F.lit(None).cast("int").alias("d")).unionByName(total)
    return both.agg(F.countDistinct("doc_id").alias("covered"), F.count("d").alias("total"))


@query("SELECT user_id, bool_or(event_type = 'signup') AS signed, bool_or(event_type = 'error' AND value > 50) AS failed FROM events GROUP BY user_id")
def presence_flags(spark, sf_dir):
    failed = (c("event_type") == "error") & (c("value") > 50)
    return U.presence(table(spark, sf_dir, "events"), ["user_id"], signed=c("event_type") == "signup", failed=failed)


_TURNS = "SELECT conv_id, count(*) AS n FROM conversations WHERE role = "


@query(f'SELECT conv_id, a.n AS "left", b.n AS "right" FROM ({_TURNS}\'user\' GROUP BY 1) a JOIN ({_TURNS}\'assistant\' GROUP BY 1) b USING (conv_id) WHERE a.n <> b.n ORDER BY abs(a.n - b.n) DESC, conv_id LIMIT 50')
def count_divergence(spark, sf_dir):
    turns = lambda role: table(spark, sf_dir, "conversations").where(c("role") == role).groupBy("conv_id").agg(F.count("*").alias("n"))
    return U.divergence(turns("user"), turns("assistant"), "conv_id", "n", 50)


@query("SELECT page_id, CASE WHEN l = 'en' THEN coalesce(length(html), 0) ELSE coalesce(length(url), 0) + coalesce(length(html), 0) END AS char_count FROM (SELECT *, regexp_extract(html, '<html lang=\"([^\"]+)\"', 1) AS l FROM pages)")
def char_counts(spark, sf_dir):
    lang = F.regexp_extract("html", r'<html lang="([^"]+)"', 1)
    return table(spark, sf_dir, "pages").select("page_id", X.char_count(lang, c("url"), c("html")).cast("long").alias("char_count"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def stage_type_pivot(spark, sf_dir):
    kinds = ["click", "view", "purchase"]
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).pivot("event_type", kinds).count().fillna(0, kinds)


# ---- windows, sorts and limits


@query("SELECT p_partkey, lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS prev_key, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS next_key FROM part")
def prev_next(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey")
    return R.neighbours(rows, ["p_brand"], ["p_partkey"], "p_partkey").drop("p_brand")


@query("SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations")
def heading_context(spark, sf_dir):
    return R.carried(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], heading=(c("role") == "user", c("turn"))).drop("role")


@query("""SELECT l_orderkey, l_linenumber, chapter, CASE WHEN chapter IS NULL OR section >= chapter THEN section END AS section FROM (SELECT l_orderkey, l_linenumber,
 max(CASE WHEN l_linenumber % 3 = 1 THEN l_linenumber END) OVER w AS chapter, max(CASE WHEN l_returnflag = 'A' THEN l_linenumber END) OVER w AS section FROM
 (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def nested_context(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    found = R.nested_context(rows, ["l_orderkey"], ["l_linenumber"], c("l_linenumber") % 3 == 1, c("flag") == "A", c("l_linenumber"))
    return found.select("l_orderkey", "l_linenumber", "chapter", "section")


@query(r"SELECT doc_id FROM (SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(lower(regexp_replace(text, '\s+', ' ', 'g'))))")
def dedupe_first(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(F.regexp_replace("text", r"\s+", " "))).alias("k"))
    return R.least_of_each(keyed, ["k"], "doc_id").select("doc_id")


@query("SELECT event_id, event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def first_of_each(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    return R.first_of_each(rows, ["user_id", "event_type"], [F.desc("value"), "event_id"]).drop("value")


@query("SELECT conv_id || '.' || turn AS id, n, s AS start, coalesce(lead(s) OVER (PARTITION BY conv_id, turn ORDER BY s), length(text)) AS \"end\" FROM (SELECT conv_id, turn, text, unnest(list_transform(range(1, len(string_split(text, '. ')) ), lambda i: length(array_to_string(string_split(text, '. ')[1:i], '. ')))) AS s, unnest(range(0, len(string_split(text, '. ')) - 1)) AS n FROM conversations)")
def marker_spans(spark, sf_dir):
    rows = made(spark, sf_dir, "conversations", id="conv_id || '.' || turn", text="text")
    return U.line_spans(rows, "id", "text", r"\. ")


@query("SELECT d.source, sum(l.toxic) AS toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source ORDER BY toxic DESC, d.source LIMIT 5")
def topk_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.sum("toxic").alias("toxic")).orderBy(F.desc("toxic"), "source").limit(5)


@query("SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 99 END, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 99 END, o_orderkey) AS ordered FROM orders GROUP BY o_custkey")
def multi_key_sort_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("number", c("o_orderkey").cast("string"))
    order = U.stage_order(c("o_orderstatus"), {"O": 1, "F": 2}, c("o_orderpriority"), ["1-URGENT", "2-HIGH"], c("number"))
    return U.listed(rows, ["o_custkey"], order, ["number"], "l").select("o_custkey", F.array_join("l.number", ",").alias("ordered"))


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY d DESC, o_orderkey)[1:3], ',') AS newest FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y%m%d') END AS d FROM orders) GROUP BY o_custkey")
def newest_heads(spark, sf_dir):
    rows = made(spark, sf_dir, "orders", o_custkey="o_custkey", o_orderkey="o_orderkey", day="if(o_orderkey % 7 = 0, null, date_format(o_orderdate, 'yyyy-MM-dd'))")
    plain = F.replace(F.coalesce(c("day"), F.lit("")), F.lit("-"), F.lit(""))
    order = [-F.coalesce(plain.try_cast("int"), F.lit(0)), c("o_orderkey")]  # newest first, no date last
    return U.heads(rows, ["o_custkey"], order, ["o_orderkey"], 3, "l").select("o_custkey", F.array_join("l.o_orderkey", ",").alias("newest"))


@query("SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN n % 5 = 0 THEN '' ELSE CAST(n AS VARCHAR) END DESC, doc_id) AS place FROM (SELECT doc_id, n_chars AS n FROM documents) QUALIFY place <= 20")
def newest_first_top(spark, sf_dir):
    rows = made(spark, sf_dir, "documents", doc_id="doc_id", day="if(n_chars % 5 = 0, null, string(n_chars))").orderBy(*U.newest_first(c("day"), c("doc_id"))).limit(20)
    return R.numbered(rows, U.newest_first(c("day"), c("doc_id")), "place").drop("day")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || ':20260428'), doc_id LIMIT 10")
def seeded_sample(spark, sf_dir):
    return U.sampled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 10, 20260428)


@query(r"SELECT token, count(DISTINCT id) AS n_docs, count(*) AS n FROM (SELECT conv_id * 1000 + turn AS id, unnest(string_split_regex(lower(text), '[\s\-]+')) AS token FROM conversations) WHERE token <> '' GROUP BY token")
def search_terms(spark, sf_dir):
    return U.token_index(made(spark, sf_dir, "conversations", id="conv_id * 1000 + turn", text="text"), "id", "text")


@query(r"SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[\s\-]+')) AS token FROM documents) WHERE token IN ('the', 'and') GROUP BY doc_id HAVING count(DISTINCT token) = 2")
def search_all_words(spark, sf_dir):
    return U.search(table(spark, sf_dir, "documents"), "doc_id", "text", ["The", "and"])


_ASKED = {"common": ["the", "AND"], "mixed": ["der", "que", "la", "worthless"], "rare": ["worthless"], "none": ["qqqq"], "law": ["software", "license", "free"]}
_ASKED_ROWS = ", ".join(f"('{q}', '{w.lower()}')" for q, words in _ASKED.items() for w in words)


@query(rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\s\-]+'), lambda x: x <> '') AS w FROM documents),
 n AS (SELECT count(*) AS docs, sum(len(w)) / count(*) AS mean FROM d), t AS (SELECT r, doc_id, len(w) AS length, unnest(w) AS term FROM d),
 tf AS (SELECT r, doc_id, length, term, count(*) AS c FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS docs FROM tf GROUP BY term), q(query, term) AS (VALUES {_ASKED_ROWS}),
 s AS (SELECT query, r, doc_id, round(sum(ln(1 + (n.docs - df.docs + 0.5) / (df.docs + 0.5)) * (c * 2.2) / (c + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY query, r, doc_id)
 SELECT query, CAST(rank AS INTEGER) AS rank, doc_id AS key, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 20""")
def search_ranked(spark, sf_dir):
    folder = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    E.write_index(table(spark, sf_dir, "documents"), "doc_id", "text", folder)
    return E.ranked(spark, folder, _ASKED)
