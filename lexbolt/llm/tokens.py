"""Operator 2, token ids as binary segments with Elias-Fano document boundaries.

Documents are dealt by ranges of doc_id (then of a hash of the text), so partition k holds the k-th run of the corpus in
ascending order; each task encodes its sorted documents and cuts segments of about
SEGMENT_TOKENS ids. A segment is one self-contained byte string:

    magic "LXTOK1\\0\\0", then little-endian u64: documents, ids, bytes an id (2 or 4),
    low bits l, bytes of the high part; then document ids (i64), validity of these
    (a bit each), low part, high part, select samples (u32), the ids, and a CRC-32 of all.

The boundaries (ends of documents in the id array) are Elias-Fano coded: l low bits each in
a packed array, the high part in unary in a bit string, 2 + l bits a document in all, with
the position of each 256th one kept for select. There is no table of 64-bit offsets.

Segments are stored in Parquet as a binary column (any file system that Spark writes to
will do; executors need no local files), with their place and length beside them, so the
ids before a segment are summed without opening it. `export` writes them as plain files.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexbolt.llm.common import new_path, shuffle_width, table, text_of

END_ID = 1
SEGMENT_TOKENS = 1 << 21
MAGIC = b"LXTOK1\0\0"
SAMPLE_EVERY = 256
_NO_ID = -(1 << 63)
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


# ---- the tokenizer

#: Of texts in these characters the library's normaliser only lower-cases and splits at
#: white space, so that words can be encoded apart and kept (tests compare both ways).
_PLAIN = re.compile(r"[\t-\r -ɏ]*")
_CACHE_WORDS = 300_000
_encoders: dict[str, Encoder] = {}


class Encoder:
    """The library's ids of whole texts, with a bounded memory of words met before."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model, self.known = self.full.model, {}  # of words and of their pieces, which have the same ids as words
        self.dtype = np.dtype("<u2" if self.full.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet of byte-level BPE
        hidden = [b for b in range(256) if b not in set(visible)]
        self.alphabet = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.by_word = self._is_split_like_words()

    def _is_split_like_words(self) -> bool:
        """Whether the words' way gives the library's ids for this vocabulary at all."""
        probe = "It's a TEST, naïve Straße; 3.14 élan\tvers\n l'été %%% $$$ «x» we'll"
        ids = self.full.encode(probe, add_special_tokens=False).ids
        try:
            return np.frombuffer(b"".join(map(self._word, probe.lower().split())), self.dtype).tolist() == ids
        except Exception:
            return False

    def _piece(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            coded = piece if piece.isascii() else piece.encode().decode("latin-1")
            ids = [t.id for t in self.model.tokenize(coded.translate(self.alphabet))]
            found = array(self.code, ids).tobytes() if LITTLE else np.array(ids, self.dtype).tobytes()
            if len(piece) <= 64:
                self.known[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        if word.isalpha():  # one piece
            return self._piece(word)
        known, parts = self.known, self.pieces(word)
        found = b"".join([known.get(p) or self._piece(p) for p in parts])
        if len(word) <= 64:
            known[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids' bytes, in self.dtype."""
        if not self.by_word or "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        known, words = self.known, text.lower().split()
        if len(known) > _CACHE_WORDS:
            known.clear()
        found = list(map(known.get, words))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self._word(words[i])
        return b"".join(found)


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---- Elias-Fano


class EliasFano:
    """A non-decreasing sequence of non-negative numbers in 2 + log2(last / length) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v, n = values.astype(np.uint64), len(values)
        last = int(v[-1]) if n else 0
        low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(n + (last >> low_bits) + 1, np.uint8)
        unary[ones] = 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(unary, bitorder="little"), ones[::SAMPLE_EVERY].astype("<u4"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def select(self, i: int) -> int:
        """The i-th number, from the sample before it and a scan of the bytes that follow."""
        at, left = int(self.samples[i // SAMPLE_EVERY]), i % SAMPLE_EVERY
        byte = at >> 3
        skip = int(np.bitwise_count(np.uint8(int(self.high[byte]) & ((1 << (at & 7)) - 1))))
        left += skip  # ones wanted from the start of this byte
        while (ones := int(np.bitwise_count(self.high[byte]))) <= left:
            left, byte = left - ones, byte + 1
        place = byte * 8 + [k for k in range(8) if self.high[byte] >> k & 1][left]
        return (place - i << self.low_bits) | int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        ones = np.nonzero(np.unpackbits(self.high, bitorder="little"))[0][: self.n]
        i = np.arange(self.n)
        return (ones - i << self.low_bits) | self._low(i)


# ---- segments


def pack(doc_ids: list, ids: list[bytes], dtype: np.dtype) -> bytes:
    """A segment of documents, each the bytes of its ids."""
    ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // dtype.itemsize
    ef = EliasFano.of(ends)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    head = np.array([len(ids), int(ends[-1]) if len(ends) else 0, dtype.itemsize, ef.low_bits, len(ef.high)], "<u8")
    own = np.array([_NO_ID if x is None else x for x in doc_ids], "<i8")
    body = b"".join([MAGIC, head.tobytes(), own.tobytes(), np.packbits(known).tobytes(), ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes(), *ids])
    return body + zlib.crc32(body).to_bytes(4, "little")


class Segment:
    """Read access to the bytes of a segment; nothing but the header is decoded at first."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("not a segment, or a damaged one")
        self.n, self.n_ids, width, low_bits, high = np.frombuffer(data, "<u8", 5, 8).tolist()
        at = 48
        parts = []
        for count, kind in ((self.n, "<i8"), (-(-self.n // 8), "u1"), (-(-self.n * low_bits // 8), "u1"), (high, "u1"), (-(-self.n // SAMPLE_EVERY), "<u4"), (self.n_ids, f"<u{width}")):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        self._own, self._known, low, unary, samples, self.ids = parts
        self.ends = EliasFano(self.n, low_bits, low, unary, samples)

    def doc_ids(self) -> list:
        known = np.unpackbits(self._known)[: self.n]
        return [int(x) if k else None for x, k in zip(self._own, known)]

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encodes and stores; see the module. Rows with equal ids are ordered by a hash of their
    texts, null ids come first. A document longer than a segment has a segment of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        own, ids, size = [], [], 0

        def flush() -> pa.RecordBatch:
            columns = [[shard], [number], [len(own)], [size // enc.dtype.itemsize], [pack(own, ids, enc.dtype)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "segment", "documents", "tokens", "data"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = enc.encode(text.as_py()) + end
                own.append(doc_id)
                ids.append(found)
                size += len(found)
                if size >= segment_tokens * enc.dtype.itemsize:
                    yield flush()
                    own, ids, size, number = [], [], 0, number + 1
        if own:
            yield flush()

    # Rows of one id (or of none) are dealt by their texts, and equal rows by their places, so no id is one task.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("h64"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange(shuffle_width(docs.sparkSession), "doc_id", "h64", "place").sortWithinPartitions("doc_id", "h64", "place")
    ordered.select("doc_id", "text").mapInArrow(run, "shard int, segment int, documents long, tokens long, data binary").write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard, segment, place: from the stored segments."""
    stored = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, segment, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = Segment(data.as_py())
                ends = s.ends.all()
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                crc = [zlib.crc32(s.ids[i:j].astype("<u4").tobytes()) for i, j in zip(starts.tolist(), ends.tolist())]
                n = s.n
                columns = [np.full(n, shard, np.int32), np.full(n, segment, np.int32), np.arange(n), s.doc_ids(), starts, (ends - starts).astype(np.int64), crc]
                kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "segment", "place", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = stored.select("shard", "segment", "data").mapInArrow(run, "shard int, segment int, place long, doc_id long, at long, n_tokens long, ids_crc32 long")
    # Sums of shards first (as many as there were partitions), then inside each shard.
    earlier = lambda by: F.coalesce(F.sum("tokens").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = stored.groupBy("shard").agg(F.sum("tokens").alias("tokens")).select("shard", earlier(W.orderBy("shard")).alias("shard_base"))
    bases = stored.select("shard", "segment", earlier(W.partitionBy("shard").orderBy("segment")).alias("base"))
    bases = bases.join(shards, "shard").select("shard", "segment", (F.col("base") + F.col("shard_base")).alias("base"))
    joined = docs.join(bases, ["shard", "segment"])
    return joined.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard", "segment", "place")


def export(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Writes the segments as files in a local or mounted folder, one after the other."""
    names = []
    for row in spark.read.parquet(path).orderBy("shard", "segment").toLocalIterator():
        names.append(f"{folder}/{row['shard']:06d}-{row['segment']:06d}.tok")
        with open(names[-1], "wb") as f:
            f.write(row["data"])
    return names


def token_index(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes `docs` and reads the index back: a row for each row of `docs`. Null text
    counts as empty and gives the end id alone. No rows give no rows."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, path, tokenizer or vocabulary(), end_id)
    return read(spark, path)


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index(table(spark, sf_dir, "documents"))
