"""What readers and writers do, written to the shared folder and read back, each with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexbolt.operators import integrity as I
from lexbolt.plans.base import made, query
from lexbolt.sources import readers, stores, writers
from lexbolt.sources.readers import table

c = F.col


def _folder(spark, name: str) -> str:
    return f"{stores.shared_folder(spark)}/files/{name}-{uuid.uuid4().hex}"


# ---- readers


_SUPPLIER = "string(s_suppkey)"
_ENTITY = "to_json(named_struct('number', string(s_suppkey), 'title', s_name, 'tags', array(string(s_nationkey))))"


def _entity_files(spark, sf_dir):
    """A JSON file a supplier; every ninth isn't JSON, and in every tenth a number is an object."""
    text = f"CASE WHEN s_suppkey % 9 = 0 THEN '{{\"number\": ' WHEN s_suppkey % 10 = 0 THEN '{{\"number\": \"' || s_suppkey || '\", \"tags\": {{\"a\": 1}}}}' ELSE {_ENTITY} END"
    folder = _folder(spark, "entities")
    writers.many_files(made(spark, sf_dir, "supplier", value=text), folder)
    return f"{folder}/*.txt"


_SHAPE = "number string, title string, tags array<string>"


@query("SELECT CAST(s_suppkey AS VARCHAR) AS number, s_name AS title, CAST(s_nationkey AS VARCHAR) AS tag FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 10 <> 0")
def entity_scan(spark, sf_dir):
    rows = readers.json_entities(spark, _entity_files(spark, sf_dir), _SHAPE)
    return rows.select("number", "title", F.try_element_at("tags", F.lit(1)).alias("tag"))


@query("SELECT count(*) AS n, count(DISTINCT s_suppkey) AS files FROM supplier WHERE s_suppkey % 9 = 0 OR s_suppkey % 10 = 0")
def entity_rejects(spark, sf_dir):
    return readers.json_rejects(spark, _entity_files(spark, sf_dir), _SHAPE).agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS number, 'line 1' || chr(10) || s_name AS text FROM supplier")
def text_files(spark, sf_dir):
    """A Markdown file a supplier in a folder of its number: files are enumerated, each is read whole."""
    folder = _folder(spark, "texts")
    rows = made(spark, sf_dir, "supplier", number=_SUPPLIER, value="'line 1' || chr(10) || s_name")
    writers.many_files(rows, folder, "number")
    found = readers.whole_texts(spark, folder, "*.txt")
    return found.select(F.regexp_extract("file", r"number=([^/]*)/", 1).alias("number"), F.rtrim(F.replace("text", F.lit("\u0003"), F.lit(""))).alias("text"))


@query("SELECT url AS loc FROM pages")
def site_map_pages(spark, sf_dir):
    folder = _folder(spark, "maps")
    rows = table(spark, sf_dir, "pages").select(c("url").alias("loc"))
    rows.write.format("xml").option("rootTag", "urlset").option("rowTag", "url").save(folder)
    return readers.site_map(spark, folder)


# ---- writers


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, o_orderkey, o_orderstatus FROM orders")
def ordered_entities(spark, sf_dir):
    """Ordered JSON keeps its order over the files' names and lines."""
    folder = _folder(spark, "ordered")
    writers.ordered_json(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), folder, ["o_orderkey"])
    lines = spark.read.schema("o_orderkey long, o_orderstatus string").json(folder)
    lines = lines.select("*", c("_metadata.file_name").alias("file"), c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a block of a file
    placed = lines.join(sizes.withColumn("before", before).drop("n"), ["file", "block"])
    return placed.select((c("before") + c("line") - c("first")).alias("place"), "o_orderkey", "o_orderstatus")


@query("SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN 'new' ELSE p_name END AS v FROM part UNION ALL SELECT -p_partkey, 'added' FROM part WHERE p_size = 7")
def merged_by_key(spark, sf_dir):
    old = made(spark, sf_dir, "part", k="p_partkey", v="p_name", s="p_size")
    changes = old.where("s % 3 = 0").select("k", F.lit("new").alias("v")).unionByName(old.where("s = 7").select((-c("k")).alias("k"), F.lit("added").alias("v")))
    return writers.merged(old.drop("s"), changes, ["k"])


@query("SELECT p_partkey AS k, lang, CASE WHEN lang = 'en' OR p_size % 2 = 0 THEN 'new' ELSE p_name END AS title FROM part, (VALUES ('en'), ('nl')) AS l(lang)")
def manifest_upsert(spark, sf_dir):
    rows = made(spark, sf_dir, "part", k="p_partkey", m="map('nl', p_name)", new="if(p_size % 2 = 0, map('en', 'new', 'nl', 'new'), map('en', 'new'))")
    both = writers.merged_maps(rows.select("k", "m"), rows.select("k", c("new").alias("m")), "k", "m")
    return both.select("k", F.explode("m").alias("lang", "title"))


@query("SELECT c_custkey AS k, '# ' || c_custkey AS text FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def pages_to_create(spark, sf_dir):
    have = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(c("o_custkey").alias("k")).distinct()
    return writers.missing(made(spark, sf_dir, "customer", k="c_custkey"), have, "k", F.concat(F.lit("# "), c("k").cast("string")))


@query("SELECT 'http://s/' || page_id AS url, href, 'unexpected' AS class FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]+)\"', 1)) AS href FROM pages)")
def link_report_rows(spark, sf_dir):
    folder = _folder(spark, "report")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("http://s/"), c("page_id").cast("string")).alias("url"), "html")
    writers.link_report(I.dangling_links(pages), folder)
    return spark.read.schema("class string, href string, url string").json(folder)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey BETWEEN 0 AND 4")
def asserted_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    return I.asserted(rows, c("n_regionkey").between(0, 4), "a nation is of no region").select("n_nationkey", "n_name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 50 = 3 THEN 'moved' WHEN c_custkey % 50 = 4 THEN 'patched' ELSE c_name END AS title FROM customer WHERE c_custkey % 11 <> 0")
def published_refresh(spark, sf_dir):
    """A version, a second that differs in some rows, and a patch of others."""
    folder = _folder(spark, "published")
    first = made(spark, sf_dir, "customer", c_custkey="c_custkey", title="c_name")
    stores.publish_changed(first, folder, "c_custkey")
    second = first.where("c_custkey % 11 <> 0").withColumn("title", F.when(c("c_custkey") % 50 == 3, "moved").otherwise(c("title")))
    stores.publish_changed(second, folder, "c_custkey")
    stores.patch(spark, folder, "c_custkey", second.where("c_custkey % 50 = 4").withColumn("title", F.lit("patched")))
    return stores.published(spark, folder)


@query("SELECT count(*) AS n, count(*) FILTER (c_custkey % 2 = 0) AS even FROM customer")
def full_refresh(spark, sf_dir):
    folder = _folder(spark, "refresh")
    stores.publish(table(spark, sf_dir, "customer").select("c_custkey").limit(10), folder)
    stores.publish(table(spark, sf_dir, "customer").select("c_custkey"), folder)
    return stores.published(spark, folder).agg(F.count("*").alias("n"), F.count_if(c("c_custkey") % 2 == 0).alias("even"))
