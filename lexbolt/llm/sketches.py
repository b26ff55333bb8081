"""Operator 6, document fingerprints: threshold-scaled sketches.

A sketch keeps every 5-word shingle hash below a fixed fraction of the hash range, and the
smallest. What is kept depends on the shingle alone, so sketches merge by union, and
containment of a short document in a very long one is estimated without bias (a fixed-size
sketch would hold almost nothing of the short one). Words are lower-cased and split at white space;
fewer than five make one shingle.

The edited twin of a document takes the start of the document after it, by descending
doc_id. Documents are dealt into buckets of consecutive ids (a range exchange of ids and
hashes alone gives the bounds, each the first document of its bucket) and each bucket also
gets the first document of the next one, so a single shuffle of the texts
brings every document beside its successor; a task then streams its sorted rows and holds
one document at a time. Nothing depends on partitions being the same when a lost one is
computed again, as buckets are a function of doc_id.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbolt.llm.common import materialize, shuffle_width, table, text_of
from lexbolt.llm.tokens import EliasFano

WORDS, FRACTION, SEED = 5, 2, 6
#: Bits of a hash. Of two texts that keep n and m hashes some n m / 2^31 agree by chance.
HASH_BITS = 32
_WORD_CACHE: dict[str, int] = {}
_CACHE_WORDS = 400_000
_P = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes, cached in the worker up to a bounded number of words."""
    if len(_WORD_CACHE) > _CACHE_WORDS:
        _WORD_CACHE.clear()
    get, out = _WORD_CACHE.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w.encode(), SEED)
            if len(w) <= 64:
                _WORD_CACHE[w] = h
        out.append(h)
    return np.array(out, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit multiplicative hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of the text's shingles, ascending."""
    h = _word_hashes(text.lower().split())
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        total = total * _P + h[k : k + n]
    return np.unique(_mixed(total) >> np.uint64(64 - HASH_BITS))


def kept_of(h: np.ndarray, fraction: int = FRACTION) -> np.ndarray:
    """Those of ascending hashes that a sketch keeps."""
    return h[: np.searchsorted(h, np.uint64((1 << HASH_BITS) // fraction))]


def sketch(text: str, words: int = WORDS, fraction: int = FRACTION) -> str:
    """The smallest hash in hex, a colon, then every hash under 1/fraction, Elias-Fano coded
    (2 + log2(range / hashes) bits a hash) in base64; ":" without words."""
    h = shingles(text, words)
    return _written(h[:1], kept_of(h, fraction))


def _written(least: np.ndarray, kept: np.ndarray) -> str:
    head = f"{int(least[0]):08x}:" if len(least) else ":"
    if not len(kept):
        return head
    ef = EliasFano.of(kept)
    return head + base64.b64encode(len(kept).to_bytes(4, "little") + bytes([ef.low_bits]) + ef.low.tobytes() + ef.high.tobytes()).decode()


def _least(fingerprint: str) -> np.ndarray:
    part = fingerprint.split(":")[0]
    return np.array([int(part, 16)] if part else [], np.uint64)


def kept_hashes(fingerprint: str) -> np.ndarray:
    raw = base64.b64decode(fingerprint.split(":")[1])
    if not raw:
        return np.zeros(0, np.uint64)
    n, low_bits = int.from_bytes(raw[:4], "little"), raw[4]
    low = -(-n * low_bits // 8)
    bits = np.frombuffer(raw, np.uint8, offset=5)
    return EliasFano(n, low_bits, bits[:low], bits[low:], bits[:0]).all().astype(np.uint64)


def merge(fingerprints: list[str]) -> str:
    """The sketch of the union of the shingles: of whole documents, or of parts of one that
    overlap by a shingle less a word."""
    none = [np.zeros(0, np.uint64)]
    least, kept = (np.unique(np.concatenate(none + [of(f) for f in fingerprints])) for of in (_least, kept_hashes))
    return _written(least[:1], kept)


def shingle_count(fingerprint: str, fraction: int = FRACTION) -> int:
    """Estimated number of distinct shingles."""
    return max(len(kept_hashes(fingerprint)) * fraction, int(fingerprint != ":"))


def compare(a: str, b: str) -> tuple[float, float, float]:
    """Estimated resemblance, and containment of a in b and of b in a; 0 to 1.

    Of two sketches that keep nothing (few shingles) only the smallest hashes are left to
    tell: they agree with the probability of the resemblance. Texts without words are alike.
    """
    return _compared(_least(a), kept_hashes(a), _least(b), kept_hashes(b))


def _compared(least: np.ndarray, x: np.ndarray, least_other: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    if not len(x) and not len(y):
        same = float(least.tolist() == least_other.tolist())
        return same, same, same
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common), common / max(1, len(x)), common / max(1, len(y))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, guest: every document in its bucket of consecutive ids, and
    each bucket's first document once more as a guest at the end of the bucket before it
    (the very first at the end of the last). Order: descending id, nulls last, then by a
    hash of the text, so that a hot id or many nulls are cut into buckets like others."""
    mark = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.select("*", F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("down"), mark.alias("mark"))
    place = ["none", "down", "mark"]
    narrow = rows.select(*place).repartitionByRange(4 * shuffle_width(docs.sparkSession), *place)
    narrow = materialize(narrow.withColumn("range", F.spark_partition_id()), "ranges")
    first = F.min(F.struct(*place)).alias("first")
    bounds = sorted(tuple(r["first"]) for r in narrow.groupBy("range").agg(first).collect())  # a row a bucket

    @F.pandas_udf("struct<bucket:int,host:int>")
    def placed(none, down, mark):
        import pandas as pd

        keys = list(zip(none.tolist(), down.tolist(), mark.tolist()))
        bucket = [bisect_right(bounds, k) - 1 for k in keys]
        host = [((b - 1) % len(bounds)) if bounds[b] == k else -1 for b, k in zip(bucket, keys)]
        return pd.DataFrame({"bucket": pd.Series(bucket, dtype="int32"), "host": pd.Series(host, dtype="int32")})

    rows = rows.withColumn("at", placed(*place))
    own = F.struct(F.col("at.bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("at.host").alias("bucket"), F.lit(True).alias("guest"))
    places = F.when(F.col("at.host") < 0, F.array(own)).otherwise(F.array(own, guest))
    rows = rows.select("doc_id", "text", *place, F.explode(places).alias("p")).select("doc_id", "text", "p.bucket", "p.guest", *place)
    spread = rows.repartition(2 * shuffle_width(docs.sparkSession), "bucket")
    return spread.sortWithinPartitions("bucket", "guest", *place).select("doc_id", "text", "bucket", "guest")


def edited_pairs(docs: DataFrame, words: int = WORDS, fraction: int = FRACTION) -> DataFrame:
    """A row for each row of `docs`; see op6. Further columns: contained_edited (the share
    of the document's shingles in its edited text) and contained_next.

    Null text counts as empty: n_chars 0, the sketch ":", alike to texts without words only.
    Rows with equal ids follow each other by a hash of the text; null ids come last. Columns
    other than doc_id and text aren't looked at. A lone document is
    its own successor. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # id, text, hashes, bucket; done after it: guests of the same bucket are over
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next"]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
        for b in batches:
            out = []
            for doc_id, text, bucket, guest in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[3] != bucket:
                    raise RuntimeError("a bucket ended without the document after it")
                if guest and not held:
                    continue  # ids that repeat the guest's
                mark = shingles(text, words)
                if held:
                    twin = edited(held[1], text)
                    own, other = held[2], shingles(twin, words)
                    kept, kept_other = kept_of(own, fraction), kept_of(other, fraction)
                    near, inside, _ = _compared(own[:1], kept, other[:1], kept_other)
                    near_next, inside_next, _ = _compared(own[:1], kept, mark[:1], kept_of(mark, fraction))
                    out.append((held[0], len(held[1]), hashlib.sha256(twin.encode()).hexdigest(), _written(own[:1], kept), _written(other[:1], kept_other), near, near_next, inside, inside_next))
                held = None if guest else (doc_id, text, mark, bucket)
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)
        if held:
            raise RuntimeError("a bucket ended without the document after it")

    shape = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"
    return in_order(docs).mapInArrow(run, shape)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))
