"""Tables stored between stages, and folders that are published whole.

`stored` cuts a lineage by a Parquet table in the folder that spark.checkpoint.dir names, so
it is still there when executors are lost. `publish` and `publish_changed` write a new version
beside the present one and then swap one small pointer file: readers see either version whole,
and a failed write leaves the old one as it was.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none gets a
    temporary one (driver and executors are one process there); a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lexbolt-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows, computed once and read back; their size is known to the planner."""
    path = f"{shared_folder(rows.sparkSession)}/stored/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


# ---- versioned folders

POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _read(spark: SparkSession, path: str) -> str | None:
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _swap(spark: SparkSession, folder: str, content: str) -> None:
    """Puts `content` in place of the pointer by renaming a file written beside it."""
    fs, at = _files(spark, f"{folder}/{POINTER}")
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTER}.{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    stream.write(bytearray(content.encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    context.rename(new, at, overwrite)  # replaces the old pointer in one step


def current(spark: SparkSession, folder: str) -> dict | None:
    """What the pointer says: the version, and of each part the folder that holds it."""
    said = _read(spark, f"{folder}/{POINTER}")
    return None if said is None else json.loads(said)


def published(spark: SparkSession, folder: str, parts: list[int] | None = None) -> DataFrame:
    """The present version as one table; with `parts` only those."""
    now = current(spark, folder)
    if now is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    paths = [f"{folder}/{path}" for part, path in now["parts"].items() if parts is None or int(part) in parts]
    kind = StructType.fromJson(now["schema"])
    return spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)


def publish(rows: DataFrame, folder: str) -> dict:
    """Full refresh: the rows in place of all that was there."""
    version = f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{version}")
    said = {"version": version, "parts": {"0": version}, "schema": rows.schema.jsonValue(), "buckets": 0, "digests": {}}
    _swap(rows.sparkSession, folder, json.dumps(said))
    return said


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn("__bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int"))


def _digests(rows: DataFrame) -> dict[str, str]:
    """A digest of each bucket's rows, whatever their order; a bucket a row at the driver."""
    row = F.to_json(F.struct(*[c for c in rows.columns if c != "__bucket"]), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    digest = F.sha2(F.concat_ws(",", F.count("*").cast("string"), *sums), 256)
    return {str(r[0]): r[1] for r in rows.groupBy("__bucket").agg(digest.alias("d")).collect()}


def _write_buckets(rows: DataFrame, changed: list[int], folder: str) -> str:
    version = f"v-{uuid.uuid4().hex}"
    rows.where(F.col("__bucket").isin(changed)).repartition(F.col("__bucket")).write.partitionBy("__bucket").parquet(f"{folder}/{version}")
    return version


def publish_changed(rows: DataFrame, folder: str, key: str, buckets: int = 32) -> list[int]:
    """The rows in place of those there, where only buckets of keys whose content differs are
    written; all others stay the files they are. Returns the buckets written.

    A bucket's content is compared by a digest of its rows that doesn't depend on their order,
    kept in the pointer; the number of buckets bounds what comes to the driver. Rows that
    leave a bucket empty count as a change.
    """
    spark = rows.sparkSession
    now = current(spark, folder)
    kept = _bucketed(stored(rows, "to-publish"), key, buckets)
    digests = _digests(kept)
    kind = rows.schema.jsonValue()
    same = now is not None and now["buckets"] == buckets and StructType.fromJson(now["schema"]).simpleString() == rows.schema.simpleString()
    before, parts = (now["digests"], now["parts"]) if same else ({}, {})
    changed = sorted(int(b) for b in digests.keys() | before.keys() if digests.get(b) != before.get(b))
    if changed or not same:
        version = _write_buckets(kept, changed, folder)
        parts = {b: path for b, path in parts.items() if int(b) not in changed} | {str(b): f"{version}/__bucket={b}" for b in changed if str(b) in digests}
        _swap(spark, folder, json.dumps({"version": version, "parts": parts, "schema": kind, "buckets": buckets, "digests": digests}))
    return changed


def patch(spark: SparkSession, folder: str, key: str, changes: DataFrame) -> list[int]:
    """Rows of `changes` in place of those with their keys (and new ones beside them): reads and
    writes the buckets of these keys alone. Returns the buckets written; a second run, which
    changes nothing, writes none."""
    now = current(spark, folder)
    n = now["buckets"]
    touched = [r[0] for r in _bucketed(changes, key, n).select("__bucket").distinct().collect()]  # n at most
    there = published(spark, folder, touched)
    merged = stored(there.join(changes.select(key), key, "left_anti").unionByName(changes), "patched")
    rows = _bucketed(merged.select(*there.columns), key, n)
    digests = _digests(rows)
    changed = sorted(int(b) for b in digests if digests[b] != now["digests"].get(b))
    if changed:
        version = _write_buckets(rows, changed, folder)
        now["parts"] |= {str(b): f"{version}/__bucket={b}" for b in changed}
        now["digests"] |= {str(b): digests[str(b)] for b in changed}
        _swap(spark, folder, json.dumps(now | {"version": version}))
    return changed


def forget_old(spark: SparkSession, folder: str) -> list[str]:
    """Deletes the versions that the pointer no longer needs; only when no reader holds one."""
    needed = {path.split("/")[0] for path in current(spark, folder)["parts"].values()}
    fs, at = _files(spark, folder)
    old = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName() not in needed]
    for name in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
    return sorted(old)
