"""Lists of unbounded length as numbered chunks of bounded length, sets as bitmaps.

A key may hold a third of all rows, so no key is gathered: rows are sorted by ranges of key
and order, and each sorted partition is cut into chunks of one key and at most `bound` rows
as its Arrow batches pass, without another shuffle. A key's chunks are then numbered with a running count, from a row a
chunk, so the place of any entry is known without the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, StructField, StructType

from lexbolt.sources.stores import stored

BOUND = 1024


def chunked(rows: DataFrame, by: list[str], order: list[Column], fields: list[str], name: str = "entries", bound: int = BOUND, keep: bool = False) -> DataFrame:
    """by, chunk (from 0), first (how many entries come before it), and `name`: an array of at
    most `bound` structs of `fields`, in the given order. Ties are ordered by the fields. A
    null key is a key; no rows give no chunks. `keep` stores the rows first: ranges are found
    by a pass of its own, which would do again what made them."""
    at = [f"__o{i}" for i in range(len(order))]
    keyed = rows.select(*by, *[o.alias(a) for o, a in zip(order, at)], F.struct(*fields).alias("__row"))
    keyed = stored(keyed, "to-chunk") if keep else keyed
    ranged = keyed.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, *at, "__row").sortWithinPartitions(*by, *at, "__row")
    cut = ranged.select(*by, F.monotonically_increasing_id().alias("__block"), F.col("__row").alias(name))
    kinds = [StructField(f.name, f.dataType, True) for f in cut.schema.fields[:-1]] + [StructField(name, ArrayType(cut.schema[name].dataType))]
    chunks = cut.mapInArrow(lambda batches: _cut(batches, bound), StructType(kinds))
    earlier = W.partitionBy(*by).orderBy("__block")
    first = F.coalesce(F.sum(F.size(name)).over(earlier.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return chunks.select(*by, (F.row_number().over(earlier) - 1).alias("chunk"), first.alias("first"), name)


def _cut(batches: Iterator[pa.RecordBatch], bound: int) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (key columns, running number, entry) those that follow each other with one
    key as lists of at most `bound`; a batch ends a list. A slice a list, no row by itself."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        begins = np.zeros(n, bool)
        begins[0] = True
        for key in b.columns[:-2]:
            code = key.dictionary_encode(null_encoding="encode").indices.to_numpy()
            begins[1:] |= code[1:] != code[:-1]
        starts = np.flatnonzero(begins)
        of = np.repeat(starts, np.diff(starts, append=n))
        at = np.flatnonzero((np.arange(n) - of) % bound == 0)
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, n), pa.int32()), b.columns[-1])
        yield pa.RecordBatch.from_arrays([c.take(pa.array(at)) for c in b.columns[:-1]] + [lists], b.schema.names)


def extent(chunks: DataFrame, by: list[str], name: str = "entries") -> DataFrame:
    """by, chunks, n: how many chunks and entries a key has."""
    return chunks.groupBy(*by).agg(F.count("*").alias("chunks"), F.sum(F.size(name)).cast("long").alias("n"))


def entries_at(chunks: DataFrame, wanted: DataFrame, by: list[str], name: str = "entries") -> DataFrame:
    """The entries at the places that `wanted` (by, at) asks for; others than there are give none."""
    both = wanted.join(chunks, by)
    inside = (F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.size(name))
    return both.where(inside).select(*by, "at", F.get(name, (F.col("at") - F.col("first")).cast("int")).alias("entry"))


# ---- sets of numbers


def bitmaps(rows: DataFrame, by: list[str], number: str) -> DataFrame:
    """by, bucket, bits: the distinct numbers (not negative) of a key as bitmaps of 32,768
    numbers each, merged in the tasks before they are shuffled; a row a key and bucket."""
    n = F.col(number).cast("long") + 1  # buckets count from 1
    kept = rows.where(F.col(number) >= 0)
    return kept.groupBy(*by, F.bitmap_bucket_number(n).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"))


def union_of(sets: DataFrame, by: list[str]) -> DataFrame:
    """Bitmaps of coarser keys from those of finer ones."""
    return sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def sizes(sets: DataFrame, by: list[str]) -> DataFrame:
    return sets.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def members(sets: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, bucket and `name`: the numbers of each bitmap in ascending order, 32,768 at most."""
    digits = F.split(F.hex("bits"), "(?<=\\G..)")  # bytes of two digits
    full = F.filter(F.transform(digits, lambda d, i: F.struct(i.alias("i"), F.conv(d, 16, 10).cast("int").alias("byte"))), lambda x: x["byte"] > 0)
    ones = lambda byte: F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.call_function("getbit", byte, b) == 1)
    found = F.flatten(F.transform(full, lambda x: F.transform(ones(x["byte"]), lambda b: x["i"] * 8 + b)))
    base = (F.col("bucket") - 1) * 32768
    return sets.select(*by, "bucket", F.transform(found, lambda x: base + x.cast("long")).alias(name))
