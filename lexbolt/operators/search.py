"""Full-text search: stored postings, ranked by BM25, the best found by bounds on blocks.

Documents are numbered in blocks of BLOCK_DOCS at most, as they are read. A posting row is what
a block has of a term: places in the block with their counts, and two numbers that bound the
score of all of them. A row without term lists the block's keys and lengths. A task inverts its
blocks before anything is shuffled, so neither words nor texts are. Rows are stored in folders by
a hash of the term, sorted by term inside a file, so a search reads the folders of its own terms. Scoring goes in two passes: the blocks with the best sums
of bounds are scored first, which gives each query a score that its k-th best has at least;
then only blocks whose sum of bounds reaches it are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from lexbolt.sources.stores import stored

SEPARATOR, BLOCK_DOCS, SHARDS = r"[\s\-]+", 256, 64
#: The folder of the rows that list blocks.
LISTS = -1
K1, B = 1.2, 0.75
#: Blocks of a query that are scored to find its first limit; digits of a score that count.
FIRST_BLOCKS, DIGITS = 4, 6
#: Words whose postings a task sorts when the index is written.
TASK_WORDS = 1_000_000


def terms_of(text: Column, separator: str = SEPARATOR) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), separator), lambda t: t != "")


def _shard(term: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def _inverted(block_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of key, row and terms as posting rows, and a row a block that lists it. This is a
    grouping inside a task, which a DataFrame can't say without a shuffle of all words."""

    def lists(starts: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)

    def block(docs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first, n = docs.column("row")[0].as_py(), docs.num_rows
        lengths = docs.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
        words = docs.column("terms").flatten().dictionary_encode()
        # A number for each word and document, so that equal ones are counted and words stay together.
        pairs, counts = np.unique(words.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
        codes, places = np.divmod(pairs, n)
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        keys = docs.column("key")

        def rows(term: pa.Array, *rest: pa.Array) -> pa.RecordBatch:
            size = len(term)
            names = ["term", "block", "n", "most", "shortest", "places", "counts", "keys", "lengths"]
            return pa.RecordBatch.from_arrays([term.cast(pa.string()), pa.array(np.full(size, first)), *rest], names)

        if len(starts):
            sizes, most, least = np.diff(np.append(starts, len(pairs))), np.maximum.reduceat(counts, starts), np.minimum.reduceat(lengths[places], starts)
            none = [pa.nulls(len(starts), pa.list_(keys.type)), pa.nulls(len(starts), pa.list_(pa.int32()))]
            numbers = [pa.array(x, pa.int32()) for x in (sizes, most, least)]
            yield rows(words.dictionary.take(pa.array(codes[starts])), *numbers, lists(starts, pa.array(places, pa.int32())), lists(starts, pa.array(counts, pa.int32())), *none)
        whole = np.zeros(1, np.int32)
        number, none = pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int32()))
        yield rows(pa.nulls(1, pa.string()), pa.array([n], pa.int32()), number, number, none, none, lists(whole, keys), lists(whole, pa.array(lengths)))

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block_docs):
                yield from block(batch.slice(at, block_docs))

    return inverted


def write_index(docs: DataFrame, key: str, text: str, folder: str, block_docs: int = BLOCK_DOCS, shards: int = SHARDS, separator: str = SEPARATOR) -> None:
    """Stores `postings` (shard, term, block, n, most, shortest, places, counts; in shard LISTS
    block, n, keys, lengths), `terms` (shard, term, docs) and `corpus` (one row: docs, length,
    shards). A block's name is the number of its first document. Null text is empty; a row is a
    document, whatever its key."""
    spark = docs.sparkSession
    read = docs.select(F.col(key).alias("key"), terms_of(F.col(text), separator).alias("terms"))
    read.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("length"), F.lit(shards).alias("shards")).write.mode("overwrite").parquet(f"{folder}/corpus")
    # As many partitions as the words need, not as the session has; a shard's blocks are dealt over several.
    words = spark.read.parquet(f"{folder}/corpus").first()["length"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // TASK_WORDS))
    shape = StructType.fromDDL("term string, block long, n int, most int, shortest int, places array<int>, counts array<int>")
    shape = shape.add(StructField("keys", ArrayType(read.schema["key"].dataType))).add(StructField("lengths", ArrayType(IntegerType())))
    blocks = read.select("key", F.monotonically_increasing_id().alias("row"), "terms").mapInArrow(_inverted(block_docs), shape)
    blocks = blocks.withColumn("shard", F.when(F.col("term").isNull(), LISTS).otherwise(_shard(F.col("term"), shards)))
    blocks = blocks.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(-(-2 * tasks // shards))))
    dealt = blocks.repartition(tasks, "shard", "slice").drop("slice").sortWithinPartitions("shard", "term", "block")
    dealt.write.mode("overwrite").partitionBy("shard").parquet(f"{folder}/postings")
    found = spark.read.parquet(f"{folder}/postings").where(F.col("shard") != LISTS).groupBy("shard", "term").agg(F.sum("n").alias("docs"))
    found.repartitionByRange("shard", "term").sortWithinPartitions("shard", "term").write.mode("overwrite").partitionBy("shard").parquet(f"{folder}/terms")


def _bm25(idf: Column, count: Column, length: Column, mean: Column) -> Column:
    return idf * (count * (K1 + 1)) / (count + K1 * (1 - B + B * length / mean))


def ranked(spark: SparkSession, folder: str, queries: dict[str, list[str]], k: int = 20, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """query, rank, key, score: the k best documents of each query (a short list of words; a
    document needs one of them), by score (to DIGITS digits), then key. Words that no
    document has score nothing; a query without known words gives no rows."""
    folded = {q: sorted({w.lower() for w in words}) for q, words in queries.items()}
    wanted = spark.createDataFrame([(q, w) for q, words in folded.items() for w in words], "query string, term string")
    words = sorted({w for ws in folded.values() for w in ws})
    corpus = spark.read.parquet(f"{folder}/corpus").first()
    known = spark.createDataFrame([(w,) for w in words], "term string")
    own = [r[0] for r in known.select(_shard(F.col("term"), corpus["shards"])).distinct().collect()]  # a number a word
    mine = F.col("shard").isin(own) & F.col("term").isin(words)
    idf = F.log(1 + (F.lit(corpus["docs"]) - F.col("docs") + 0.5) / (F.col("docs") + 0.5))
    terms = spark.read.parquet(f"{folder}/terms").where(mine).select("term", idf.alias("idf")).join(F.broadcast(wanted), "term")
    mean = F.lit(max(1, corpus["length"]) / max(1, corpus["docs"]))
    heads = spark.read.parquet(f"{folder}/postings").where(mine).select("term", "block", "most", "shortest")
    bounds = heads.join(F.broadcast(terms), "term").groupBy("query", "block").agg(F.sum(_bm25(F.col("idf"), F.col("most"), F.col("shortest"), mean)).alias("bound"))
    bounds = stored(bounds.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy(F.desc("bound"), "block"))), "bounds")

    def scored(blocks: DataFrame) -> DataFrame:
        listed = spark.read.parquet(f"{folder}/postings").where(F.col("shard") == LISTS).select("block", "keys", "lengths")
        rows = spark.read.parquet(f"{folder}/postings").where(mine).select("term", "block", "places", "counts").join(F.broadcast(terms), "term")
        rows = rows.join(blocks.select("query", "block"), ["query", "block"], "left_semi").join(listed, "block")
        entry = lambda p, n: F.struct((F.col("block") + p).alias("row"), F.get("keys", p).alias("key"), n.alias("count"), F.get("lengths", p).alias("length"))
        rows = rows.select("query", "term", "idf", F.explode(F.zip_with("places", "counts", entry)).alias("e"))
        score = F.round(F.sum(_bm25(F.col("idf"), F.col("e.count"), F.col("e.length"), mean)), DIGITS)
        rows = rows.groupBy("query", F.col("e.row").alias("row"), F.col("e.key").alias("key")).agg(score.alias("score"))
        order = W.partitionBy("query").orderBy(F.desc("score"), "key", "row")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = stored(scored(bounds.where(F.col("nth") <= first_blocks)), "first")
    limits = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("limit"))
    others = bounds.where(F.col("nth") > first_blocks).join(F.broadcast(limits), "query").where(F.col("bound") >= F.col("limit") - 10.0**-DIGITS)
    both = first.unionByName(scored(others))
    order = W.partitionBy("query").orderBy(F.desc("score"), "key", "row")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "key", "score")
