"""Marked-up text as rows of tags in document order, and what stands next to what.

Built-in functions all the way: a text is cut behind its tags by one expression, so that a row
is a tag with the text before it; depth and adjacency are windows over a document's tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A tag, open or close; comments, declarations and what stands in scripts aren't tags.
TAG = r"</?[a-z][a-z0-9]*[^>]*>"


def tag_rows(docs: DataFrame, key: str, markup: str) -> DataFrame:
    """key, pos (from 1), tag, close, before (the text since the tag before, trimmed). A text
    without tags, and a null one, has no rows."""
    raw = F.regexp_extract_all(markup, F.lit(f"({TAG})"), 1)
    between = F.split(markup, TAG)
    both = F.transform(raw, lambda t, i: F.struct((i + 1).alias("pos"), t.alias("raw"), F.trim(F.get(between, i)).alias("before")))
    rows = docs.select(key, F.inline(both))
    return rows.select(key, "pos", F.regexp_extract("raw", "</?([a-z0-9]+)", 1).alias("tag"), F.startswith("raw", F.lit("</")).alias("close"), "before")


def depths(tags: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """The tags of some kinds with depth: how many of their kind are open, they included when
    they open. One that is never closed stays open."""
    w = W.partitionBy(key, "tag").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return tags.where(F.col("tag").isin(kinds)).withColumn("depth", F.sum(F.when(F.col("close"), -1).otherwise(1)).over(w))


def next_after(tags: DataFrame, key: str, heading: str, wanted: str, count: str) -> DataFrame:
    """key, heading, after, items: each heading's text with the text that begins the first
    `wanted` after it but before the next heading (null if there is none, or if it is empty),
    and how many `count` open in the document. Two windows: the text behind a tag is
    that before the tag after it, and a heading sees the nearest wanted one ahead."""
    in_order = W.partitionBy(key).orderBy("pos")
    text = F.coalesce(F.lead("before").over(in_order), F.lit(""))
    opens = ~F.col("close")
    rows = tags.withColumn("text", text).withColumn("items", F.count_if(opens & (F.col("tag") == count)).over(W.partitionBy(key)))
    rows = rows.where(opens & F.col("tag").isin(heading, wanted))
    place = F.struct("pos", "tag", "text")
    ahead = F.first(F.when(F.col("tag") == wanted, place), ignorenulls=True).over(in_order.rowsBetween(1, W.unboundedFollowing))
    stop = F.first(F.when(F.col("tag") == heading, F.col("pos")), ignorenulls=True).over(in_order.rowsBetween(1, W.unboundedFollowing))
    rows = rows.withColumn("ahead", ahead).withColumn("stop", stop).where(F.col("tag") == heading)
    near = F.when(F.col("stop").isNull() | (F.col("ahead.pos") < F.col("stop")), F.nullif(F.col("ahead.text"), F.lit("")))
    return rows.select(key, F.col("text").alias("heading"), near.alias("after"), "items")
