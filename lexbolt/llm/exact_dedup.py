"""Operator 7, exact dedup: frequent digests are removed map-side, the rest by a shuffle.

1. Every text is squeezed and digested in one scan; only ids and digests are kept
   (a narrow table in the shared folder), so no text is ever shuffled to find copies.
2. A Misra-Gries summary (Spark's approx_top_k, which keeps a bounded number of
   counters per task and merges them) names every digest that may hold more than
   1/HOT_SHARE of the rows. Its counts never fall short, so none is missed.
3. The exact winner and size of each such digest come from a pre-aggregated count over
   the rows; verified like this they are a table of at most HOT_SHARE rows and are
   broadcast, and their copies are decided where they lie.
4. All other digests, each with a bounded share of the rows, take one ordinary shuffle.

Texts are equal when SHA-256, length and a second hash of the squeezed text agree.
Everything runs in built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexbolt.llm.common import id_key, materialize, only, squeezed, table, text_of

#: A digest counts as frequent from this share of the rows on; the summary's counters.
HOT_SHARE = 1024
COUNTERS = 8192
KEY = ["h64", "digest", "octets"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (tells repeated rows apart), and the key of the squeezed text."""
    norm = squeezed(text_of(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64("norm").alias("h64"),
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.octet_length("norm").cast("long").alias("octets"),
    )


def frequent(keys: DataFrame, share: int = HOT_SHARE, counters: int = COUNTERS) -> DataFrame:
    """h64 of each digest that may hold over 1/share of the rows: at most `share` rows,
    whatever the input, as estimates below the share are left out."""
    top = keys.agg(F.expr(f"approx_top_k(h64, {share}, {counters})").alias("top"), F.count("*").alias("rows"))
    return (
        top.select(F.explode("top").alias("t"), "rows")
        .where((F.col("t.count") * share > F.col("rows")) & (F.col("t.count") > 1))
        .select(F.col("t.item").alias("h64"))
    )


def assign(keys: DataFrame, share: int = HOT_SHARE, counters: int = COUNTERS) -> DataFrame:
    """Adds keep_id, group_size and kept. `keys` must be a stored table (see digests)."""
    hot = materialize(frequent(keys, share, counters), "frequent")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    winners = (
        keys.join(F.broadcast(hot), "h64")  # at most `share` rows
        .groupBy(*KEY)
        .agg(first.alias("first"), F.count("*").alias("group_size"))
    )
    hot_rows = keys.join(F.broadcast(winners), KEY)  # a row or, if h64 collides, a few for each row of hot
    w = W.partitionBy(*KEY)
    cold_rows = (
        keys.join(F.broadcast(hot), "h64", "left_anti")
        .withColumn("first", first.over(w))
        .withColumn("group_size", F.count("*").over(w))
    )
    return hot_rows.unionByName(cold_rows).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        *KEY,
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and empty texts are copies of each other. Of equal texts
    the smallest doc_id stays (null ids last); of rows that repeat it as well, one does.
    Columns other than doc_id and text aren't looked at. No rows give no rows.
    """
    keys = materialize(digests(docs), "digests")
    return assign(keys).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with their own columns: one of each group of copies.
    Columns of any name pass through. The rows themselves are shuffled once."""
    keys = materialize(digests(docs), "digests")
    stay = assign(keys).where("kept").select(*id_key(), F.col("digest").alias("__mark"))
    return only(docs, F.unhex(F.sha2(squeezed(text_of()), 256)), stay)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
k AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, k.keep_id, k.group_size, d.doc_id = k.keep_id AS kept, d.text_sha256
FROM d JOIN k USING (text_sha256)
"""
