"""Relational operators over documents, pages and events, DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexbolt.operators.segments import BOUND, last_markers


def link_inverted_index(pages: DataFrame) -> DataFrame:
    """target, n_links, n_pages: links by target, from one scan of two columns."""
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), 1)).alias("href"))
    links = links.select("page_id", F.regexp_replace("href", r"[#?].*$", "").alias("target"))
    return links.groupBy("target").agg(F.count("*").alias("n_links"), F.countDistinct("page_id").alias("n_pages"))


def presence_gaps(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are on one side only, with the side that lacks them."""
    a = left.select(*keys).distinct().withColumn("__l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("__r", F.lit(True))
    both = a.join(b, keys, "full_outer")
    return both.where("__l is null or __r is null").select(*keys, F.when(F.col("__l").isNull(), "left").otherwise("right").alias("missing_in"))


def asof_backward(events: DataFrame, is_marker, is_probe, by: str, at: list[str], value: str, bound: int = BOUND) -> DataFrame:
    """For each probe the last marker's value at or before it, without a join; keys of over
    `bound` rows by segments. Rows that are neither don't reach the shuffle."""
    rows = events.where(is_marker | is_probe)
    return last_markers(rows, [by], at, {"last_marker": (is_marker, F.col(value))}, bound).where(is_probe)


def neighbours(rows: DataFrame, by: list[str], order: list, key: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn("prev_key", F.lag(key).over(w)).withColumn("next_key", F.lead(key).over(w))


def least_of_each(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """by and the smallest key of each group: combined map-side, so a hot group is no task."""
    return rows.groupBy(*by).agg(F.min(key).alias(key))


def first_of_each(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """Whole rows, where the order isn't that of one column."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """The place of each row in a total order, from 1. For few rows: one task numbers them."""
    return rows.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("long"))


def carried(rows: DataFrame, by: list[str], order: list, bound: int = BOUND, **marks) -> DataFrame:
    """Adds for each mark (condition, value) the value at the last row that met it; keys of
    over `bound` rows by segments."""
    return last_markers(rows, by, order, marks, bound)


def nested_context(rows: DataFrame, by: list[str], order: list, is_chapter, is_section, value, bound: int = BOUND) -> DataFrame:
    """Adds chapter and section: the last heading of either kind; a section ends with its
    chapter (a row that begins a chapter may begin a section of it). `order` is total: a
    heading's place is told from a chapter's by it."""
    at = F.struct(*order)
    marks = {"__chapter": (is_chapter, F.struct(value.alias("v"), at.alias("at"))), "__section": (is_section, F.struct(value.alias("v"), at.alias("at")))}
    rows = last_markers(rows, by, order, marks, bound)
    since = F.col("__chapter").isNull() | (F.col("__section.at") >= F.col("__chapter.at"))
    return rows.withColumn("chapter", F.col("__chapter.v")).withColumn("section", F.when(since, F.col("__section.v"))).drop("__chapter", "__section")


def polymorphic(rows: DataFrame, kind: str, key: str, targets: dict) -> DataFrame:
    """Adds title: of the table that the row's kind names, by its key. `targets` has tables of
    distinct key and title by the kinds that use them; all meet the rows in one join."""
    both = None
    for kinds, side in targets.items():
        tagged = side.select(F.explode(F.array(*map(F.lit, kinds))).alias(kind), F.col("key").alias(key), "title")
        both = tagged if both is None else both.unionByName(tagged)
    return rows.join(both, [kind, key], "left")


def dangling(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known, key, "left_anti")


def check(name: str, failures: DataFrame, soft: bool = False) -> DataFrame:
    """A row of a quality suite: name, status, failures. A soft check warns in place of failing."""
    status = F.when(F.col("failures") == 0, "PASS").otherwise("SOFT" if soft else "FAIL")
    return failures.agg(F.count("*").alias("failures")).select(F.lit(name).alias("name"), status.alias("status"), "failures")


def verdict(suite: DataFrame) -> DataFrame:
    """One row: checks by status, and FAIL if any failed, else CAVEATS if any is soft, else PASS."""
    n = lambda status: F.count_if(F.col("status") == status)
    out = F.when(F.col("failed") > 0, "FAIL").when(F.col("soft") > 0, "CAVEATS").otherwise("PASS")
    return suite.agg(n("PASS").alias("passed"), n("FAIL").alias("failed"), n("SOFT").alias("soft"), n("SKIP").alias("skipped")).withColumn("verdict", out)


def measured(counts: DataFrame, checks: dict[str, str], soft: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a suite from one row of counts: each check's name by the column that has its
    failures; those in `soft` warn in place of failing. However many checks, `counts` is one
    pass over its table."""
    one = [F.struct(F.lit(name).alias("name"), F.coalesce(F.col(column), F.lit(0)).cast("long").alias("failures"), F.lit("SOFT" if name in soft else "FAIL").alias("bad")) for name, column in checks.items()]
    rows = counts.select(F.inline(F.array(*one)))
    return rows.select("name", F.when(F.col("failures") == 0, "PASS").otherwise(F.col("bad")).alias("status"), "failures")


def key_counts(sides: dict[str, tuple[DataFrame, str]], checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row for tables that share a key: `sides` has each table and its key's name, `checks`
    the side and condition of checks by row. Columns: n_<side> (rows), dup_<side> (keys of
    more than one row), lost_<side> (rows whose key no other side has), and one a check. Each
    table is scanned once, and its rows are combined by key before they meet."""
    both = None
    for side, (rows, key) in sides.items():
        own = [F.count("*").alias(f"n_{side}"), *[F.count_if(test).alias(name) for name, (s, test) in checks.items() if s == side]]
        counted = rows.groupBy(F.col(key).alias("__key")).agg(*own)
        both = counted if both is None else both.unionByName(counted, allowMissingColumns=True)
    names = [c for c in both.columns if c != "__key"]
    by_key = both.groupBy("__key").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    out = [F.sum(c).alias(c) for c in names] + [F.count_if(F.col(f"n_{s}") > 1).alias(f"dup_{s}") for s in sides]
    for s in sides:
        others = [F.col(f"n_{o}") for o in sides if o != s]
        alone = F.col("__key").isNull() | (sum(others[1:], others[0]) == 0) if others else F.lit(False)
        out.append(F.sum(F.when(alone, F.col(f"n_{s}"))).alias(f"lost_{s}"))
    return by_key.agg(*out)


def report(suite: DataFrame, title: str) -> DataFrame:
    """One row: the suite as a Markdown table in the order of its names. A suite has a row a
    check, so one task holds it."""
    line = F.concat(F.lit("| "), F.col("name"), F.lit(" | "), F.col("status"), F.lit(" | "), F.col("failures").cast("string"), F.lit(" |"))
    lines = F.array_sort(F.collect_list(F.struct("name", line.alias("line"))))
    head = f"# {title}\n\n| check | status | failures |\n|-|-|-|\n"
    return suite.agg(F.concat(F.lit(head), F.array_join(F.transform(lines, lambda s: s["line"]), "\n")).alias("markdown"))
