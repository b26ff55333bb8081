"""Connected components of an edge table by alternating large and small stars.

Each round is two pre-aggregated shuffles of the edges and halves the longest chains at
least; rounds are written to the shared folder, so lineage stays short and a lost executor
costs one round. Nothing is collected but a count and a checksum for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexbolt.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for each node that has an edge
    to another; `edges` has columns u and v. Self-links are ignored."""
    edges = materialize(edges.where("u <> v").select("u", "v").distinct(), "edges")
    mark = F.expr("struct(count(*), bit_xor(xxhash64(u, v)), sum(pmod(xxhash64(v, u), 1000003)))").alias("m")
    seen = edges.agg(mark).first()[0]
    for _ in range(rounds):
        if not seen[0]:
            break
        done, edges = edges, materialize(_small_star(_large_star(edges)), "edges")
        discard(done)
        now = edges.agg(mark).first()[0]
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
