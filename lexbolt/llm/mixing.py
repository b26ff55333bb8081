"""Operator 10, mixing sources to target weights by a multivariate-hypergeometric tree.

Each source's documents fall into permuted blocks. A source's target fixes how often all
of its blocks are drawn, which prefix of the permuted blocks is drawn once more, and how
far into the blocks after it that goes: exact quotas in blocks. The quotas of all sources are
split among the output shards by a binary tree. At each node the left half gets a
multivariate-hypergeometric draw of the node's blocks (as if that many had been drawn
blindly from all), the right half the rest, so every block lands in exactly one shard and
each shard mixes like the whole. A shard then takes the next blocks of each source's
permuted order, and orders its documents by a hash.

A node of the tree has a row for each CHUNK of its sources. A source has at least LEAST_BLOCKS
blocks and at most MAX_BLOCKS, so windows over blocks are bounded however many documents there
are, and the shards' number grows with that of the blocks. A document's block follows from a
hash of its own columns; blocks and their draws are a small table, and so are the documents
drawn from blocks that are cut. While their rows are few enough (they are counted) these
tables are broadcast, and texts are shuffled once, to their shards; beyond that texts meet
them in shuffled joins that spread a hot source evenly.
Everything runs in built-in functions, seeded by hashes of ids: reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexbolt.llm.common import KEY, OWN, id_key, keyed, materialize, table, text_of, word_count

BLOCK_DOCS, LEAST_BLOCKS, MAX_BLOCKS = 128, 8, 1 << 20
SHARD_BLOCKS, CHUNK = 32, 256
SEED = 20260
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and how often a word may be taken.
TOTAL, REPEATS = 1.5, 2


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, row (tells repeated rows apart)."""
    return docs.select(
        "doc_id", "source", word_count(text_of()).alias("size"),
        F.monotonically_increasing_id().alias("row"), F.xxhash64(text_of()).alias("h64"),
    )


def targets(rows: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, repeats: float = REPEATS) -> DataFrame:
    """A row a source: sid (0 from the first by code point, null last), source,
    source_size, docs, target.

    Weights repeat along the sources. Where a share passes `repeats` times the source's
    size it stops there and the excess goes to the others by weight: in ascending order
    of limit / weight a prefix of the sources stops, and the level of the first that
    doesn't stop holds for all after it. The windows see a row a source.
    """
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("sid", rank.cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("sid") % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * float(repeats))
    by = W.orderBy(F.col("most") / F.col("weight"), "sid")
    before = F.coalesce(F.sum("most").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by.rowsBetween(W.currentRow, W.unboundedFollowing))
    everything = W.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) * float(total) - before) / rest)
    s = s.withColumn("at", F.row_number().over(by)).withColumn("free", F.col("weight") * F.col("level") <= F.col("most"))
    level = F.min(F.when(F.col("free"), F.struct("at", "level"))).over(everything)["level"]
    share = F.when(level.isNotNull(), F.least("most", F.col("weight") * level)).otherwise(F.col("most"))
    return s.withColumn("target", share).select("sid", "source", "source_size", "docs", "target")


def _let(value: Column, then) -> Column:
    """`then` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _log_factorial(x: Column) -> Column:
    """Stirling's series; exact to 4e-6 from 2 on."""
    series = (x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(x < 2, F.lit(0.0)).otherwise(series)


def hypergeometric(pool: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many marked items are among `drawn` of `pool`, at the quantile u (all doubles).

    The distribution is summed over 10 standard deviations and 10 items on either side of
    its mean, beyond which nothing is left in double precision; so the work grows with the
    root of the quota.
    """
    mean = drawn * marked / pool
    sd = F.sqrt(mean * (1 - marked / pool) * (pool - drawn) / F.greatest(pool - 1, F.lit(1.0)))
    low = F.greatest(F.lit(0.0), drawn - (pool - marked), F.floor(mean - 10 * sd - 10).cast("double"))
    high = F.least(marked, drawn, F.ceil(mean + 10 * sd + 10).cast("double"))
    f = _log_factorial

    def log_p(k: Column) -> Column:
        return -(f(k) + f(marked - k) + f(drawn - k) + f(pool - marked - drawn + k))

    ks = F.sequence(low.cast("long"), high.cast("long"))
    terms = F.transform(ks, lambda n: F.struct(n.cast("double").alias("k"), log_p(n.cast("double")).alias("p")))

    def pick(terms: Column) -> Column:  # terms: k and its probability but for a factor
        start = F.struct((u * F.aggregate(terms["p"], F.lit(0.0), lambda s, p: s + p)).alias("left"), F.lit(-1.0).alias("k"))

        def step(s: Column, t: Column) -> Column:
            return F.struct((s["left"] - t["p"]).alias("left"), F.when(s["left"] >= 0, t["k"]).otherwise(s["k"]).alias("k"))

        return F.aggregate(terms, start, step, lambda s: s["k"])

    def scaled(terms: Column) -> Column:
        top = F.array_max(terms["p"])
        return _let(top, lambda m: F.transform(terms, lambda t: F.struct(t["k"].alias("k"), F.exp(t["p"] - m).alias("p"))))

    return _let(_let(terms, scaled), pick)


def _drawn_of(pools: Column, drawn: Column, u) -> Column:
    """How many of `drawn` fall to each of `pools` (an array of doubles), one after the other:
    each a hypergeometric draw among what is still to be drawn from what is still there.
    `u` gives the quantile by the place in the array."""
    start = F.struct(F.aggregate(pools, F.lit(0.0), lambda s, p: s + p).alias("pool"), drawn.alias("drawn"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        p = x["p"]
        got = (
            F.when((p == 0) | (s["drawn"] == 0), F.lit(0.0))
            .when(s["drawn"] == s["pool"], p)
            .when(s["pool"] == p, s["drawn"])
            .otherwise(hypergeometric(s["pool"], p, s["drawn"], u(x["i"])))
        )
        return _let(got, lambda g: F.struct((s["pool"] - p).alias("pool"), (s["drawn"] - g).alias("drawn"), F.concat(s["out"], F.array(g)).alias("out")))

    return F.aggregate(F.transform(pools, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), start, step, lambda s: s["out"])


def _quantile(*of) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / float(1 << 53)


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """shard, sid, quota from rows of sid and quota.

    A node of the tree has a row for each `chunk` of its sources: what the left half gets is
    split among the chunks first (if there are several), then in each among its sources. A
    row keeps the sources alone that it has blocks of, so a level holds no more entries than
    there are blocks, however many sources and shards.
    """
    whole = quotas.where("quota > 0").groupBy(F.floor(F.col("sid") / chunk).alias("chunk"))
    tree = whole.agg(F.array_sort(F.collect_list(F.struct("sid", F.col("quota").cast("double").alias("quota")))).alias("quotas"))
    tree = tree.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "chunk", "quotas")
    several = (quotas.agg(F.max("sid")).first()[0] or 0) >= chunk
    some = lambda xs: F.filter(xs, lambda x: x["quota"] > 0)
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        inner = tree.withColumn("mid", F.expr("lo + (hi - lo) div 2").cast("int"))
        pool = F.aggregate("quotas", F.lit(0.0), lambda s, q: s + q["quota"])
        share = lambda of: F.floor(of * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("double")
        if several:
            parts = inner.groupBy("lo", "hi", "mid").agg(F.array_sort(F.collect_list(F.struct("chunk", pool.alias("pool")))).alias("parts"))
            of_chunk = _drawn_of(F.col("parts.pool"), share(F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["pool"])), lambda i: _quantile(F.lit(seed + 5), "lo", "hi", F.get("parts", i)["chunk"]))
            parts = parts.select("lo", "hi", F.inline(F.arrays_zip(F.col("parts.chunk").alias("chunk"), of_chunk.alias("drawn"))))
            inner = inner.join(parts, ["lo", "hi", "chunk"])
        else:
            inner = inner.withColumn("drawn", share(pool))
        left = _drawn_of(F.col("quotas.quota"), F.col("drawn"), lambda i: _quantile(F.lit(seed), "lo", "hi", F.get("quotas", i)["sid"]))
        inner = inner.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, left))
        part = lambda of: some(F.zip_with("quotas", "left", lambda x, g: F.struct(x["sid"].alias("sid"), of(x["quota"], g).alias("quota"))))
        halves = F.array(
            F.struct(F.col("lo"), F.col("mid").alias("hi"), part(lambda q, g: g).alias("quotas")),
            F.struct(F.col("mid").alias("lo"), F.col("hi"), part(lambda q, g: q - g).alias("quotas")),
        )
        leaf = F.array(F.struct("lo", "hi", "quotas"))
        tree = inner.select("chunk", F.explode(F.when(F.col("left").isNull(), leaf).otherwise(halves)).alias("n")).select("n.lo", "n.hi", "chunk", "n.quotas").where(F.size("quotas") > 0)
    return tree.select(F.col("lo").alias("shard"), F.explode("quotas").alias("q")).select("shard", "q.sid", F.col("q.quota").cast("long").alias("quota"))


def _placed(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """`rows` (doc_id, source, size, h64 and others) with the columns of their source, and with
    key and block."""
    named = rows.withColumnRenamed("source", "name").join(sources, F.col("name").eqNullSafe(F.col("source")), "left").drop("source").withColumnRenamed("name", "source")
    named = named.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size", "h64"))
    return named.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), "blocks"))


def plan(rows: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, repeats: float = REPEATS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Stored tables from the stored table `rows` of sized(): sources (with sid, blocks,
    target), placed (`rows` with source, key and block), drawn (sid, block, whole and cut:
    arrays of (epoch, shard) of the draws of all of the block and of the one in part), and
    in_cut (row: those that the draw in part takes)."""
    s = targets(rows, weights, total, repeats)
    blocks_of = F.least(F.lit(MAX_BLOCKS), F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.least("docs", F.lit(LEAST_BLOCKS))))
    s = s.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    s = s.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("blocks", blocks_of.cast("long"))
    sources = materialize(s, "sources")
    placed = materialize(_placed(rows, sources, seed), "placed")

    # Blocks: the prefix that the partial epoch draws, and those after it that it draws in part: as many as hold what is left in
    # documents no longer than the source's mean, so that some such document is left over or what is left is filled.
    short = F.sum(F.when(F.col("size") * F.col("docs") <= F.col("source_size"), F.col("size")).otherwise(0))
    blocks = placed.groupBy("sid", "block", "epochs", "rest").agg(F.sum("size").alias("words"), short.alias("short"))
    block_order = F.xxhash64(F.lit(seed + 2), "sid", "block")
    by = W.partitionBy("sid").orderBy(block_order, "block")
    blocks = blocks.withColumn("upto", F.sum("words").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    blocks = blocks.withColumn("left", F.col("rest") - (F.col("upto") - F.col("words")))
    whole = F.col("left") >= F.col("words")
    blocks = blocks.withColumn("cut_left", F.max(F.when(~whole & (F.col("left") > 0), F.col("left"))).over(W.partitionBy("sid")))
    blocks = blocks.withColumn("before", F.coalesce(F.sum(F.when(~whole, F.col("short"))).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumn("part", F.when(whole, "whole").when(F.col("before") < F.col("cut_left"), "cut"))
    n_epochs = F.col("epochs") + F.when(F.col("part").isNull(), 0).otherwise(1)
    units = blocks.where(n_epochs > 0).select("sid", "block", F.col("epochs").alias("whole_epochs"), "part", "cut_left", F.explode(F.sequence(F.lit(0), (n_epochs - 1).cast("int"))).alias("epoch"))
    units = units.withColumn("cut", F.coalesce((F.col("epoch") == F.col("whole_epochs")) & (F.col("part") == "cut"), F.lit(False)))
    order = W.partitionBy("sid").orderBy("epoch", F.xxhash64(F.lit(seed + 3), "sid", "epoch", "block"), "block")
    units = materialize(units.withColumn("at", F.row_number().over(order).cast("long") - 1), "units")

    # Quotas, split among the shards; a shard takes the next units of each source.
    quotas = units.groupBy("sid").agg(F.count("*").alias("quota"))
    split = split_quotas(quotas, max(1, math.ceil(units.count() / SHARD_BLOCKS)), seed)
    upto = F.sum("quota").over(W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow))
    runs = split.where("quota > 0").withColumn("end", upto)
    slots = runs.select("sid", "shard", F.explode(F.sequence(F.col("end") - F.col("quota"), F.col("end") - 1)).alias("at"))
    draw = F.struct("epoch", "shard")
    of = lambda test: F.array_sort(F.collect_list(F.when(test, draw)))  # noqa: E731  (repeats + 1 at most)
    drawn = units.join(slots, ["sid", "at"]).groupBy("sid", "block").agg(of(~F.col("cut")).alias("whole"), of(F.col("cut")).alias("cut"), F.max(F.when(F.col("cut"), F.col("cut_left"))).alias("cut_left"))
    drawn = materialize(drawn, "drawn")

    # Documents of the blocks drawn in part: longest first each that still fits, then one of the shortest left out if that comes
    # closer. Of one size as many as fit, the first by hash; so a source is one row with an entry a size, however large its blocks.
    cut = placed.join(drawn.where("cut_left IS NOT NULL").select("sid", "block", "cut_left"), ["sid", "block"])
    cut = materialize(cut.select("sid", "block", "key", "row", "size", "cut_left"), "cut")
    sizes = cut.groupBy("sid", "size").agg(F.count("*").alias("n"), F.max("cut_left").alias("cut_left"))
    sizes = sizes.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"), F.max("cut_left").alias("cut_left"))
    start = F.struct(F.col("cut_left").cast("double").alias("left"), F.array().cast("array<struct<size:bigint,take:bigint>>").alias("taken"), F.lit(None).cast("long").alias("next"))

    def step(s: Column, x: Column) -> Column:
        fit = F.when(x["size"] > 0, F.greatest(F.lit(0), F.least(x["n"], F.floor(s["left"] / x["size"])))).otherwise(x["n"])
        return _let(fit, lambda take: F.struct(
            (s["left"] - take * x["size"]).alias("left"),
            F.concat(s["taken"], F.array(F.struct(x["size"].alias("size"), take.alias("take")))).alias("taken"),
            F.when(take < x["n"], x["size"]).otherwise(s["next"]).alias("next"),
        ))

    def close(s: Column) -> Column:
        more = F.coalesce(s["next"] - s["left"] < s["left"], F.lit(False))
        return F.transform(s["taken"], lambda x: F.struct(x["size"].alias("size"), (x["take"] + F.when(more & (x["size"] == s["next"]), 1).otherwise(0)).alias("take")))

    taken = sizes.select("sid", F.explode(F.aggregate("sizes", start, step, close)).alias("x")).select("sid", "x.size", "x.take").where("take > 0")
    nth = F.row_number().over(W.partitionBy("sid", "size").orderBy(block_order, "block", "key", "row"))
    in_cut = cut.withColumn("nth", nth).join(taken, ["sid", "size"]).where("nth <= take").select("row")
    return sources, placed, drawn, materialize(in_cut, "in-cut")


def draws(rows: DataFrame, **how) -> DataFrame:
    """row, doc_id, source, size, source_size, target of the stored table `rows` with draws, an
    array of (epoch, shard)."""
    _, placed, drawn, in_cut = plan(rows, **how)
    docs = placed.join(drawn.drop("cut_left"), ["sid", "block"], "left").join(in_cut.withColumn("taken", F.lit(True)), "row", "left")
    return docs.select("row", "doc_id", "source", "size", "source_size", "target", _both("taken").alias("draws"))


def _both(taken: str) -> Column:
    """The draws of a document's block, those in part if it is taken by them."""
    none = F.array().cast("array<struct<epoch:int,shard:int>>")
    return F.concat(F.coalesce("whole", none), F.when(F.coalesce(taken, F.lit(False)), F.coalesce("cut", none)).otherwise(none))


#: Rows of a table of some 100 bytes a row that are broadcast at most.
FEW_ROWS = 1_000_000


def _small(rows: DataFrame) -> DataFrame:
    """The stored table, broadcast if its rows, which are counted, are few."""
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else rows


def mix_plan(docs: DataFrame, **how) -> DataFrame:
    """A row for each row of `docs`: doc_id, size, source_size, target, taken, shards.

    taken is size times the number of draws; shards lists the output shard of each draw.
    Null text has no words, a null source is a source of its own (last), null or repeated
    ids and repeated rows are drawn like any others. Documents without words may be drawn
    and take 0. Documents are drawn whole; a source's words miss its target by less than the
    mean of its documents' words, or, where documents no longer than that don't suffice to
    fill what is left, by up to half of the shortest longer one. No rows give no rows.
    """
    out = draws(materialize(sized(docs), "sized"), **how)
    return out.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.size("draws")).alias("taken"), F.col("draws.shard").alias("shards"),
    )


def mix(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """The mixed rows: the columns of `docs` (of any names), a row for each draw, in the
    shards' order.

    Of rows that repeat id, source and text as many take part in a draw in part as that takes,
    the first by a hash of all their columns. Rows are shuffled once, to their shards, while the
    tables of blocks and of documents in cut blocks are small; see the module.
    """
    sources, placed, drawn, in_cut = plan(materialize(sized(docs), "sized"), seed=seed, **how)
    cut = placed.join(drawn.where("cut_left IS NOT NULL").select("sid", "block"), ["sid", "block"], "left_semi").join(in_cut.withColumn("in", F.lit(1)), "row", "left")
    cut = cut.groupBy(*id_key(), _mark(F.col("h64"), F.col("source")).alias("__mark")).agg(F.count("in").alias("__take"), F.count("*").alias("__same"))
    cut = materialize(cut.where("__take > 0"), "cut-keys")

    # The row as it is, and beside it what places it.
    own = keyed(docs, _mark(F.xxhash64(text_of()), F.col("source"))).withColumn("__size", word_count(F.coalesce(F.col(f"{OWN}.text"), F.lit(""))))
    rows = own.select(OWN, *KEY, F.col(f"{OWN}.doc_id").alias("doc_id"), F.col("__size").alias("size"), F.col("__mark.h64").alias("h64"), F.col(f"{OWN}.source").alias("source"))
    rows = _placed(rows, _small(sources.select("sid", "source", "blocks")), seed).select(OWN, *KEY, "sid", "block")
    rows = rows.join(_small(drawn.select("sid", "block", "whole", "cut")), ["sid", "block"], "left").drop("sid", "block").join(_small(cut), KEY, "left")
    part = F.coalesce(F.col("__take") < F.col("__same"), F.lit(False))
    order = W.partitionBy(*KEY).orderBy(F.xxhash64(OWN))
    numbered = rows.where(part).withColumn("__taken", F.row_number().over(order) <= F.col("__take"))
    rows = rows.where(~part).withColumn("__taken", F.col("__take").isNotNull()).unionByName(numbered)
    rows = rows.select(OWN, *KEY, F.explode(_both("__taken")).alias("__draw"))
    rows = rows.withColumn("__shard", F.col("__draw.shard")).withColumn("__order", F.xxhash64(F.lit(seed + 4), "__draw", *KEY))
    return rows.repartition("__shard").sortWithinPartitions("__shard", "__order").select(f"{OWN}.*")


def _mark(h64: Column, source: Column) -> Column:
    return F.struct(h64.alias("h64"), source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("source"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))
