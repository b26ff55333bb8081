"""Readers: tables, JSON entities, whole texts, HTML links and XML site maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores, if their source is so small that its splits are fewer; a
    large source has enough of them and isn't shuffled."""
    spark = rows.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size < cores * split else rows


#: Rows of a partition where a task sorts or gathers them.
TASK_ROWS = 1_000_000


def by_keys(rows: DataFrame, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows dealt by a hash of keys over as many partitions as hold `task_rows` each on
    average (the session's number at least): rows are counted first, since compressed sizes,
    by which Spark would merge partitions, say little of what a task must hold. Windows and
    groups over these keys and more share this shuffle."""
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // task_rows)), *keys)


#: The column for text that isn't JSON of the stated schema.
CORRUPT = "_corrupt"


def json_entities(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file an entity; the file name comes along, order is up to the query. Files that
    aren't JSON, or not of the schema, give no row here: see json_rejects."""
    return _entities(spark, path, schema).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def json_rejects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, text, found: the files that json_entities leaves out, with what stands in them and
    what could be read of it as JSON."""
    rows = _entities(spark, path, schema)
    found = F.to_json(F.struct(*[c for c in rows.columns if c not in (CORRUPT, "file")]))
    # Spark parses no file for the corrupt column alone, so the condition names the others too.
    return rows.where(F.col(CORRUPT).isNotNull() & (F.coalesce(F.length(found), F.lit(0)) >= 0)).select("file", F.col(CORRUPT).alias("text"), found.alias("found"))


def _entities(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # A pattern for names is a filter over one listing; as a glob it would be a path a file.
    folder, _, pattern = path.rpartition("/")
    read = spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if "*" in pattern and not any(x in folder for x in "*?[{"):
        read, path = read.option("pathGlobFilter", pattern), folder
    return read.json(path).withColumn("file", F.col("_metadata.file_path"))


def whole_texts(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))  # else a task a folder
    try:
        found = read.text(path, wholetext=True)  # lists the files at once
    finally:
        spark.conf.set(name, before)
    return found.select(F.col("_metadata.file_path").alias("file"), F.regexp_extract(F.col("_metadata.file_name"), r"(\d+[a-z]?)\.[a-z]+$", 1).alias("number"), F.col("value").alias("text"))


def site_map(spark: SparkSession, path: str, row: str = "url") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).schema("loc string").load(path)


def site_maps(spark: SparkSession, index: str, place: Callable[[str], str] = str) -> DataFrame:
    """loc: the pages of all site maps that an index lists (at most 50,000 by the protocol,
    so their names come to the driver); `place` says where a map's file is."""
    files = [place(r["loc"]) for r in site_map(spark, index, "sitemap").collect()]
    return spark.read.format("xml").option("rowTag", "url").schema("loc string").load(",".join(files)) if files else spark.createDataFrame([], "loc string")


def map_entries(rows: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """Nested map blobs as rows; empty maps drop out."""
    return rows.select(*[c for c in rows.columns if c != column], F.explode(column).alias(key, value))
