"""Writers: ordered JSON, manifests with checksums, merges and changed rows only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexbolt.functions.text import front_matter


def ordered_json(rows: DataFrame, path: str, order: list[str], one_file: bool = False) -> None:
    """Lines with sorted keys in a total order, over as many files as the range sort gives
    (their names are in order); a single file only for small reports. Overwrites."""
    ordered = rows.select(*sorted(rows.columns)).orderBy(*order)
    (ordered.coalesce(1) if one_file else ordered).write.mode("overwrite").json(path)


def many_files(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Small text files of the one column besides `by`: a file a row, with `by` in a folder of
    its value. Rows are dealt over all cores, since a file costs far more than its text. Files
    without folders are moved into place by the tasks, each its own as it ends (a task that
    fails between may leave some; its repetition writes the same names); folders by the driver
    at the end, since a move is all they cost there and tasks would make each a second time."""
    write = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).write
    if by:
        write.option("lineSep", "\u0003").partitionBy(by).text(path)
    else:
        write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("maxRecordsPerFile", 1).text(path)


def pretty_json(rows: DataFrame, path: str, order: list[str], most: int = 100_000) -> None:
    """One indented array in a local file, for reports of at most `most` rows."""
    found = rows.orderBy(*order).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} rows; use ordered_json")
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps([r.asDict(True) for r in found], sort_keys=True, indent=2, ensure_ascii=False) + "\n")


def manifest(rows: DataFrame, key: str, content: str) -> DataFrame:
    return rows.select(key, F.sha2(content, 256).alias("sha256"), F.length(content).alias("char_count"))


def changed(rows: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """Rows that are new or differ from the stored manifest."""
    own = rows.withColumn("sha256", F.sha2(content, 256))
    return own.join(stored.select(key, "sha256"), [key, "sha256"], "left_anti")


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: new rows win, old ones with other keys stay."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def patched(text, marker: str, addition: str):
    """Adds a section once: text that has the marker stays as it is."""
    return F.when(text.contains(marker), text).otherwise(F.concat(text, F.lit(addition)))


def entity_documents(rows: DataFrame, path: Column, texts: dict[str, Column], plain: dict[str, Column], body: Column) -> DataFrame:
    """path, markdown (front matter, then the body), json, sha256 and char_count: a row an
    entity in both of its forms."""
    fields = F.struct(*[v.alias(k) for k, v in {**texts, **plain}.items()], body.alias("body_md"))
    out = rows.select(path.alias("path"), F.concat(front_matter(texts, plain), F.lit("\n"), body).alias("markdown"), F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))
    return out.withColumn("sha256", F.sha2("markdown", 256)).withColumn("char_count", F.length("markdown"))


def write_entities(documents: DataFrame, folder: str) -> None:
    """Entity documents in a folder for each chapter (the first part of their paths); what
    was there before goes."""
    part = documents.withColumn("folder", F.regexp_extract("path", r"^([^/]*)/", 1))
    part.write.mode("overwrite").partitionBy("folder").parquet(folder)


def counts(**tables: DataFrame) -> DataFrame:
    """kind, n: the manifest's block of counts."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def merged_maps(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Upsert inside a map: keys of a row's new map win, its other keys and other rows stay."""
    both = old.select(key, F.col(column).alias("__old")).join(new.select(key, F.col(column).alias("__new")), key, "full_outer")
    kept = F.map_filter(F.coalesce("__old", F.create_map().cast(old.schema[column].dataType)), lambda k, _: ~F.coalesce(F.map_contains_key(F.coalesce("__new", F.create_map().cast(old.schema[column].dataType)), k), F.lit(False)))
    return both.select(key, F.map_concat(kept, F.coalesce("__new", F.create_map().cast(old.schema[column].dataType))).alias(column))


def with_tables(folder: str, **tables: DataFrame) -> None:
    """Adds or replaces tables of a folder, a table a key; all others stay as they are."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def missing(wanted: DataFrame, existing: DataFrame, key: str, body: Column) -> DataFrame:
    """Rows to create, with their text: those wanted whose key isn't there. Nothing that
    exists is touched."""
    return wanted.join(existing.select(key), key, "left_anti").withColumn("text", body)


def link_report(broken: DataFrame, path: str) -> None:
    """Broken links as JSON lines, by link and page."""
    ordered_json(broken.select("url", "href", "class"), path, ["href", "url"])


def coverage_report(coverage: DataFrame, counters: DataFrame, title: str, total: int, top: int = 20) -> DataFrame:
    """One row, markdown: measures, then a table a counter, largest first; of sources the
    first `top`. Counters are pre-aggregated: a row a value."""
    line = F.concat(F.lit("- "), F.replace("measure", F.lit("_"), F.lit(" ")), F.lit(": **"), F.col("n").cast("string"), F.lit("**"), F.when(F.col("measure").rlike("^(sources|articles)_"), f" / {total}").otherwise(""))
    head = coverage.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("measure", line.alias("t")))), lambda s: s["t"]), "\n").alias("head"))
    rank = F.row_number().over(W.partitionBy("counter").orderBy(F.desc("n"), "value"))
    rows = counters.withColumn("rank", rank).where((F.col("counter") != "source") | (F.col("rank") <= top))
    row = F.struct("rank", F.concat(F.lit("| `"), "value", F.lit("` | "), F.col("n").cast("string"), F.lit(" |")).alias("t"))
    tables = rows.groupBy("counter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda s: s["t"]), "\n").alias("t"))
    block = F.concat(F.lit("## "), "counter", F.lit("\n\n| value | n |\n|-|-|\n"), "t")
    whole = tables.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("counter", block.alias("t")))), lambda s: s["t"]), "\n\n").alias("tables"))
    text = F.concat(F.lit(f"# {title}\n\n"), "head", F.when(F.col("tables") != "", F.concat(F.lit("\n\n"), "tables")).otherwise(""), F.lit("\n"))
    return head.withColumn("k", F.lit(1)).join(whole.withColumn("k", F.lit(1)), "k").select(text.alias("markdown"))
