"""Running state over keys of any size, by a segmented scan.

A window over a key is one task, whatever the key holds. Where some key has more rows than
`bound` (counted first, in the tasks), rows are sorted by ranges of key and order and stored,
and each sorted partition is cut into segments of SEGMENT rows. A first pass takes the last
marker inside each segment; a second, over one row a key and segment, carries it to the
segments after; rows that saw no marker in their own segment take the carried one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexbolt.sources.stores import stored

BOUND, SEGMENT = 1_000_000, 65_536


def is_hot(rows: DataFrame, by: list[str], bound: int = BOUND) -> bool:
    """Whether some key has more than `bound` rows; counts are combined before the shuffle."""
    return not rows.groupBy(*by).count().where(F.col("count") > bound).isEmpty()


def last_markers(rows: DataFrame, by: list[str], order: list, marks: dict[str, tuple[Column, Column]], bound: int | None = BOUND, segment: int = SEGMENT) -> DataFrame:
    """Adds for each mark (condition, value) the value at the last row at or before that met it.

    Rows that tie in the order are in any order among them. A null key is a key. A value that
    is null where the condition holds isn't taken. `bound` None says that keys are known to be
    bounded (by what one task has already held), and nothing is counted.
    """
    values = {name: F.when(condition, value) for name, (condition, value) in marks.items()}
    if bound is None or not is_hot(rows, by, bound):
        w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return rows.select("*", *[F.last(v, ignorenulls=True).over(w).alias(name) for name, v in values.items()])
    names, own = list(marks), rows.columns
    key = F.struct(*[F.col(b).alias(f"k{i}") for i, b in enumerate(by)])
    at = [F.lit(o) if not isinstance(o, (str, Column)) else (F.col(o) if isinstance(o, str) else o) for o in order]
    keyed = rows.select(F.struct(*own).alias("__row"), key.alias("__key"), *[o.alias(f"__o{i}") for i, o in enumerate(at)], *[v.alias(f"__m{i}") for i, v in enumerate(values.values())])
    by_order = ["__key", *[f"__o{i}" for i in range(len(at))]]
    ranged = keyed.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by_order).sortWithinPartitions(*by_order)
    cut = stored(ranged.withColumn("__at", F.monotonically_increasing_id()).withColumn("__segment", F.floor(F.col("__at") / segment)), "segments")

    inside = W.partitionBy("__key", "__segment").orderBy("__at").rowsBetween(W.unboundedPreceding, W.currentRow)
    own_last = cut.select("__row", "__key", "__segment", *[F.last(f"__m{i}", ignorenulls=True).over(inside).alias(f"__m{i}") for i in range(len(names))])
    ends = cut.groupBy("__key", "__segment").agg(*[F.max_by(f"__m{i}", F.when(F.col(f"__m{i}").isNotNull(), F.col("__at"))).alias(f"__m{i}") for i in range(len(names))])
    before = W.partitionBy("__key").orderBy("__segment").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("__key", "__segment", *[F.last(f"__m{i}", ignorenulls=True).over(before).alias(f"__c{i}") for i in range(len(names))])
    both = own_last.join(carried, ["__key", "__segment"])
    return both.select("__row.*", *[F.coalesce(f"__m{i}", f"__c{i}").alias(name) for i, name in enumerate(names)])
