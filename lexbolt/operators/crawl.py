"""Reachability over links: an iterated frontier with a stored table a round.

Only pages found in the last round go on (semi-naive), against those seen in all rounds; both
are distributed tables, and what comes to the driver is whether the frontier is empty. A
round is a job, so the number of jobs is the largest distance, not the number of pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexbolt.functions.text import page_key
from lexbolt.operators.integrity import internal_links, page_links
from lexbolt.sources.stores import stored


def link_edges(pages: DataFrame) -> DataFrame:
    """source, target: distinct keys of pages and of where their internal links lead."""
    links = internal_links(page_links(pages))
    edges = links.select(page_key(F.col("url")).alias("source"), page_key(F.col("path")).alias("target"))
    return edges.where("source IS NOT NULL AND target IS NOT NULL AND source <> target").distinct()


def distances(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """page, distance: the least number of links from a page of `start` (page) to each page
    that can be reached, those of `start` at 0; with `most`, no further than that."""
    edges = stored(edges.select("source", "target"), "edges")
    rounds = [stored(start.select("page").where("page IS NOT NULL").distinct().withColumn("distance", F.lit(0)), "frontier")]
    while (most is None or len(rounds) <= most) and not rounds[-1].isEmpty():
        ahead = rounds[-1].join(edges, F.col("page") == F.col("source")).select(F.col("target").alias("page")).distinct()
        seen = reduce(DataFrame.unionByName, rounds).select("page")
        rounds.append(stored(ahead.join(seen, "page", "left_anti").withColumn("distance", F.lit(len(rounds))), "frontier"))
    return reduce(DataFrame.unionByName, rounds)


def crawled(pages: DataFrame, homes: list[str], most: int | None = None) -> DataFrame:
    """url, distance, state: every page with its least number of links from the home pages;
    `unreachable` where no chain of links leads there. Then broken ends: url (the key that a
    reached page links to), distance and state `missing`."""
    known = pages.select("url", page_key(F.col("url")).alias("page"))
    start = pages.sparkSession.createDataFrame([(h,) for h in homes], "page string").select(page_key(F.col("page")).alias("page"))
    edges = stored(link_edges(pages), "edges")
    inner = edges.join(known.select(F.col("page").alias("target")).distinct(), "target", "left_semi")
    reached = stored(distances(inner, start.join(known.select("page").distinct(), "page", "left_semi"), most), "reached")
    pages_found = known.join(reached, "page", "left").select("url", "distance", F.when(F.col("distance").isNull(), "unreachable").otherwise("reached").alias("state"))
    ends = edges.join(known.select(F.col("page").alias("target")).distinct(), "target", "left_anti")
    ends = ends.join(reached, F.col("source") == F.col("page")).groupBy("target").agg((F.min("distance") + 1).alias("distance"))
    return pages_found.unionByName(ends.select(F.col("target").alias("url"), "distance", F.lit("missing").alias("state")))
