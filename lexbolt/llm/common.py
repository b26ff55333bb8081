"""What the operators of this subpackage share: tables, the shared folder, text rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: White space in every rule of this subpackage, and what is not, as Java and RE2 read it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in
    spark.checkpoint.dir. Only a local session may go without; then a temporary
    folder is set, since driver and executors are one process there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = f"file://{tempfile.mkdtemp(prefix='lexbolt-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    path = f"{shared_dir(spark)}/lexbolt/{name}-{uuid.uuid4().hex}"
    if _made.get() is not None:
        _made.get().append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what is stored inside, once it is left without an error: for callers that
    have written their results by then. Without it tables stay until the caller of an
    operator, whose results are read lazily, empties the folder."""
    token = _made.set([])
    try:
        yield
        for path in _made.get():
            delete(spark, path)
    finally:
        _made.reset(token)


#: Bytes of a batch on its way to Python: a batch is held several times over, in the JVM's
#: buffers and in the worker, and its rows may be long texts.
BATCH_BYTES = 4 << 20


def _bytes(said: str) -> int:
    """A size as Spark reads it: 67108864b, 64m, 1g."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", said.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Runs what is run inside with Arrow batches of BATCH_BYTES, or fewer if so set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    if 0 < _bytes(before) <= BATCH_BYTES:
        yield
        return
    spark.conf.set(name, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, cut from
    its lineage, and still there when executors are lost. The size of the files is
    known to the planner, so later joins broadcast only what is measured as small."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table from `materialize` that nothing reads any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        delete(df.sparkSession, folder)


#: The row as it is, and a key of it; no other column is beside them, so that columns of any
#: name pass through an operator unseen.
OWN, KEY = "__own", ["__none", "__id", "__mark"]


def id_key() -> list[Column]:
    """doc_id as two columns that are never null, for joins and windows that share a shuffle."""
    doc_id = F.col("doc_id").cast("long")
    return [doc_id.isNull().alias("__none"), F.coalesce(doc_id, F.lit(0)).alias("__id")]


def keyed(docs: DataFrame, mark: Column) -> DataFrame:
    """OWN and KEY: doc_id (null or not) and `mark`, which tells rows with one id apart."""
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    return docs.select(row.alias(OWN), *id_key(), mark.alias("__mark"))


def only(docs: DataFrame, mark: Column, stay: DataFrame) -> DataFrame:
    """The rows of `docs`, as they are, whose KEY is in `stay`; of rows that repeat a key
    one. Join and window share one shuffle of the rows."""
    rows = keyed(docs, mark).join(stay.select(*KEY), KEY, "left_semi")
    first = W.partitionBy(*KEY).orderBy(F.xxhash64(OWN))
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(f"{OWN}.*")


#: Bits of the map that tells what can't be in a table: 8 MB, however large the table.
MAP_BITS = 1 << 26


def may_be_in(rows: DataFrame, column: str) -> Callable[[np.ndarray], np.ndarray]:
    """Of longs: whether they may be among those of the stored table `rows`. A bit a value,
    so it is never wrong about what is in; of what isn't, the more passes the fuller the map
    gets. Put before an exact join it keeps rows that can't match out of the shuffle. It is for
    use inside a Python step that is there anyway: a step of its own is a second worker a
    task, and workers stay with an executor for as long as it runs Python."""
    place = F.expr(f"`{column}` & {MAP_BITS - 1}")
    words = rows.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 AS int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # MAP_BITS / 64 rows at most
    bits = np.zeros(MAP_BITS // 64, np.int64)
    bits[found["w"].to_numpy()] = found["b"].to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def known(v: np.ndarray) -> np.ndarray:
        return (sent.value[(v & (MAP_BITS - 1)) >> 6] >> (v & 63)) & 1 == 1

    return known


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(name: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def squeezed(text: Column) -> Column:
    """Each run of white space as one space. Single spaces, the most common run by
    far, aren't matched, so that almost nothing has to be replaced."""
    return F.regexp_replace(text, rf"{SPACE}{{2,}}|[\x09-\x0D]", " ")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")
