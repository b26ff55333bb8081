"""Operator 4, WARC: a content-addressed archive.

A payload's bytes are stored once, in the response record of its group, addressed by a
strong digest (SHA-256 with the length; SHA-1 in base32 goes into the headers, as WARC
names it, and is recomputed from the bytes whenever the archive is read). The exact header
block of every original record is kept in a table of its own. Rows that share a payload
become revisit records that hold headers only; `reconstruct` joins the headers with the
stored payloads on the strong digest and gives the original records back byte for byte.

Archives are real WARC 1.1 files: Spark's text writer puts one record a line, with the
record's last byte, a line feed, as the line separator. So any file system that Spark
writes to holds them and a task that is lost is simply written again. Files are read with
the binary reader, inflated as they are read and cut by Content-Length.

Who is the response is decided on a narrow table of digests, pre-aggregated, so that a
payload that fills a third of the rows costs a row a task; the payloads then meet that
decision in a join that adaptive execution can split.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexbolt.llm.common import BATCH_BYTES, materialize, new_path, table, text_of

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of the records of a file at most, unless it has a single one. Records are written by
#: classes of length, each up to CLASS_STEP times the one before: those of up to SHORT_BYTES
#: first, those of over FILE_BYTES last, so that long records don't make small files of the
#: others. These are 8 classes, of which those that occur are written.
FILE_BYTES, SHORT_BYTES, CLASS_STEP = 64 << 20, 16 << 10, 4
#: Rows that take one copy of a payload when records are put together again.
SHARE_ROWS = 4096


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _base32(sha1_hex: Column) -> Column:
    """Base32 of a SHA-1 in hex: 32 digits of 5 bits, from the bit string of its 4-byte words."""
    words = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 8 * k, 8), 16, 2), 32, "0") for k in range(5)]
    bits = F.concat(*words)
    digit = lambda k: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substring(bits, 1 + 5 * k, 5), 2, 10).cast("int") + 1, F.lit(1))
    return F.concat(*[digit(k) for k in range(32)])


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field that is null is left out. Line ends in a value become spaces."""
    parts = [F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n")) for name, value in fields]
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(p, F.lit("")) for p in parts], F.lit("\r\n"))


def _header(kind: str, refers_to: Column | None, length: Column) -> Column:
    return _lines(
        ("WARC-Type", F.lit(kind)),
        ("WARC-Record-ID", _urn(F.col("page_id"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32(F.col("sha1")))),
        *([] if refers_to is None else [("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", _urn(refers_to))]),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", length),
    )


def _digested(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), text_of("html").alias("payload"))
    rows = rows.withColumn("octets", F.octet_length("payload").cast("long")).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    return rows.withColumn("sha1", F.sha1("payload"))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """The archive in the folder `path`: `headers`, a Parquet table with a row for each row of
    `pages` (page_id, sha256, octets, the exact header block of its record, and the SHA-256
    of the whole record), and `warc`, gzipped WARC files that hold each payload once.

    Of rows with equal payloads of at least `least_bytes` that with the largest page_id is
    the response (null ids count as the smallest); rows that repeat its id are responses too.
    """
    rows = _digested(pages).withColumn("header", _header("response", None, F.col("octets")))
    record = F.sha2(F.concat("header", "payload", F.lit("\r\n\r\n")), 256)
    kept = rows.select("page_id", "sha256", "octets", F.encode("header", "UTF-8").alias("header"), F.unhex(record).alias("record_sha256"))
    kept.write.parquet(f"{path}/headers")
    headers = pages.sparkSession.read.parquet(f"{path}/headers")
    shared = headers.where(F.col("octets") >= least_bytes).groupBy("sha256", "octets").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
    shared = materialize(shared.where("n > 1").drop("n"), "shared-payloads")
    octets, bounds = F.col("octets"), [SHORT_BYTES]
    while bounds[-1] < FILE_BYTES:
        bounds.append(bounds[-1] * CLASS_STEP)
    kind = sum(((octets > b).cast("int") for b in bounds), F.lit(0))
    present = sorted({r[0] for r in headers.select(kind).distinct().collect()} | {0})  # one a class; revisits are short

    rows = rows.join(shared, ["sha256", "octets"], "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    rows = rows.withColumn("revisit", revisit)
    line = F.when(F.col("revisit"), _header("revisit", F.col("response_id"), F.lit(0))).otherwise(F.concat("header", "payload"))
    for n in present:
        most = bounds[n] if n < len(bounds) else FILE_BYTES
        out = rows.where(F.when(F.col("revisit"), 0).otherwise(kind) == n).select(F.concat(line, F.lit("\r\n\r")).alias("value"))
        out.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, FILE_BYTES // most)).text(f"{path}/warc/class={n}")


class _Inflated:
    """The bytes of a gzip file (of any number of members) as they are asked for."""

    def __init__(self, packed: bytes):
        self.rest, self.member, self.held = packed, zlib.decompressobj(31), b""

    def _more(self) -> bool:
        if self.member.eof:
            self.rest = self.member.unused_data
            if not self.rest:
                return False
            self.member = zlib.decompressobj(31)
        got = self.member.decompress(self.rest, 1 << 20)
        self.rest = self.member.unconsumed_tail
        self.held += got
        return bool(got) or self.member.eof

    def until(self, mark: bytes) -> bytes | None:
        """Up to the mark and with it; None at the end of the file."""
        while (end := self.held.find(mark)) < 0:
            if not self._more():
                if self.held:
                    raise ValueError("the file ends inside a header")
                return None
        out, self.held = self.held[: end + len(mark)], self.held[end + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            self.held = b""
            if not self._more():
                raise ValueError("the file ends inside a record")
            parts.append(self.held)
            have += len(self.held)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]


def parse(packed: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header block, content) of each record of a gzipped file, which is inflated as far as
    it is read; ValueError if it is damaged."""
    data = _Inflated(packed)
    while (head := data.until(b"\r\n\r\n")) is not None:
        length = field(head, "Content-Length") or ""
        if not head.startswith(b"WARC/") or not length.isdigit():
            raise ValueError("no WARC record where one should start")
        body = data.take(int(length))
        if data.take(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its Content-Length says")
        yield head, body


def field(header: bytes, name: str) -> str | None:
    for line in header.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.decode().lower() == name.lower():
            return value.strip().decode()
    return None


def _id(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if name in ("", "none") else int(name)


_READ = "page_id long, record_type string, digest string, refers_to long, octets long, sha256 binary, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record in the files. Payloads are verified against the digest in
    their headers; sha256 is taken from the bytes found. Without `payloads` these aren't
    returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

        def batch(out: list) -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], _READ.replace(",", "").split()[::2])

        for b in batches:
            for packed in b.column(0):
                out, size = [], 0
                for head, body in parse(packed.as_py()):
                    digest, kind = (field(head, "WARC-Payload-Digest") or "").removeprefix("sha1:"), field(head, "WARC-Type")
                    full = kind == "response"
                    if full and base32_sha1(body) != digest:
                        raise ValueError(f"a payload differs from its digest {digest}")
                    sha256 = hashlib.sha256(body).digest() if full else None
                    out.append((_id(field(head, "WARC-Record-ID")), kind, digest, _id(field(head, "WARC-Refers-To")), len(body) if full else None, sha256, body if full and payloads else None))
                    size += len(body)
                    if size > BATCH_BYTES or len(out) >= 4096:
                        yield batch(out)
                        out, size = [], 0
                yield batch(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{path}/warc").select("content")
    return files.mapInArrow(run, _READ)


def reconstruct(spark: SparkSession, path: str, found: DataFrame | None = None) -> DataFrame:
    """page_id, record_sha256 (as it was written) and record, the bytes of the original
    record, for each row archived: its header with the payload that its digest names.

    A payload shared by many rows is dealt to as many tasks as these rows fill.
    """
    found = read(spark, path) if found is None else found
    headers = spark.read.parquet(f"{path}/headers")
    shares = headers.groupBy("sha256", "octets").agg(F.ceil(F.count("*") / SHARE_ROWS).cast("int").alias("shares"))
    shares = materialize(shares.where("shares > 1"), "hot-payloads")  # of SHARE_ROWS rows, one at most
    key = ["sha256", "octets", "share"]
    dealt = lambda df, share: df.join(shares, key[:2], "left").fillna(1, ["shares"]).withColumn("share", share).drop("shares")
    rows = dealt(headers, F.pmod(F.xxhash64("header"), "shares").cast("int"))
    stored = found.where("record_type = 'response'").select("sha256", "octets", "payload", F.xxhash64("page_id").alias("of"))
    stored = dealt(stored, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    stored = stored.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("of"))).where("n = 1").drop("n", "of")  # repeated ids
    full = rows.join(stored, key)
    return full.select("page_id", "record_sha256", F.concat("header", "payload", F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"))


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes `pages` as an archive and reads it back: a row for each row of `pages`.

    Null html is an empty payload, shared like any other; a null url leaves out its header.
    Repeated ids and rows are records of their own. Payload size and digest of a revisit
    come from the response it refers to, by a join. restored says whether the records of
    the page, put together again, have the digest that they were written with. Other columns
    aren't looked at. No rows give no rows.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, least_bytes)
    found = materialize(read(spark, path, payloads=False).drop("payload"), "warc-index")
    stored = found.where("record_type = 'response'").groupBy("page_id", "digest").agg(F.max("octets").alias("full"))
    stored = stored.withColumnsRenamed({"page_id": "of", "digest": "d"})
    revisits = found.where("record_type = 'revisit'").join(stored, (F.col("refers_to").eqNullSafe(F.col("of"))) & (F.col("digest") == F.col("d")))
    both = found.where("record_type = 'response'").withColumn("full", F.col("octets")).unionByName(revisits.drop("of", "d"))
    again = reconstruct(spark, path).select(F.col("page_id").alias("of"), (F.unhex(F.sha2("record", 256)) == F.col("record_sha256")).alias("same"))
    again = again.groupBy("of").agg(F.min("same").alias("restored"))
    both = both.join(again, F.col("page_id").eqNullSafe(F.col("of")), "left")
    restored = F.coalesce("restored", F.lit(False)).alias("restored")
    return both.select("page_id", F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", restored)


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))
