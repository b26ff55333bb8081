"""Operator 9, best-fit packing into sequences of several permitted lengths.

Documents are counted in tokens (with an end id) and cut at the longest permitted length;
pieces of just that length are sequences by themselves. The rest is dealt by a hash into
groups of about GROUP_PIECES, so a task packs a bounded number of pieces whatever document
or source they come from, and each group is packed by variable-capacity best-fit:

- pieces come longest first; a piece goes into the open bin, of any size, that it fills best;
- if none has room, a bin is opened, of the size that costs least a token: each permitted
  size is filled up on trial by the longest pieces still to come, and its cost spread over
  what it would hold;
- finally each bin is downsized to the smallest permitted size that holds its contents.

The cost of a bin is its size plus a fixed OVERHEAD, so padding and many short sequences
both count. Open bins are found by one bit a free length, in a constant time a piece.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbolt.llm.common import materialize, table, text_of
from lexbolt.llm.tokens import encoder, vocabulary

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 64
GROUP_PIECES = 20_000


def cost(size: int) -> int:
    return size + OVERHEAD


def opened(n: int, sizes: tuple[int, ...], left: dict[int, int], bits: int) -> int:
    """The size that costs least a token for a new bin whose first piece is n long: each is
    filled up by the longest pieces still to come (`left`: length to number; `bits`: a bit a
    length) that fit, downsized to what it holds, and its cost spread over that. Of equal
    ones the smaller."""
    best = None
    for size in sizes[bisect_left(sizes, n) :]:
        room, rest = size - n, bits
        while room and (rest := rest & ((1 << room + 1) - 1)):
            top = rest.bit_length() - 1
            room -= top * min(left[top], room // top)
            rest &= (1 << top) - 1
        held = size - room
        price = cost(sizes[bisect_left(sizes, held)]) / held
        if best is None or price < best[0]:
            best = price, size
    return best[1]


def best_fit(lengths: list[int], sizes: tuple[int, ...] = LENGTHS) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each piece and the size of each bin; no piece is empty or longer than
    the last size."""
    sizes = tuple(sorted(sizes))
    left: dict[int, int] = {}
    for n in lengths:
        left[n] = left.get(n, 0) + 1
    coming = sum(1 << n for n in left)
    free: dict[int, list[int]] = {}  # free length: bins
    bits, fill, places = 0, [], [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        left[n] -= 1
        if not left[n]:
            coming &= ~(1 << n)
        above = bits >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                bits &= ~(1 << room)
        else:
            b, room = len(fill), opened(n, sizes, left, coming)
            fill.append(0)
        places[i] = b, fill[b]
        fill[b] += n
        if room > n:
            free.setdefault(room - n, []).append(b)
            bits |= 1 << room - n
    return places, [sizes[bisect_left(sizes, n)] for n in fill]


def token_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, row, n_tokens with the end id, stored."""
    path = tokenizer or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode(t.as_py())) // enc.dtype.itemsize + 1 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
    return materialize(counted.withColumn("row", F.monotonically_increasing_id()), "lengths")


def pack(lengths: DataFrame, sizes: tuple[int, ...] = LENGTHS) -> DataFrame:
    """doc_id, row, piece, start, length, sequence, capacity, offset for each piece of the
    stored table `lengths` (doc_id, row, n_tokens); sequence numbers are unique."""
    most = max(sizes)
    pieces = F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / most).cast("long") - 1)
    cut = lengths.where("n_tokens > 0").select("doc_id", "row", "n_tokens", F.explode(pieces).alias("piece"))
    cut = cut.withColumn("start", F.col("piece") * most).withColumn("length", F.least(F.lit(most), F.col("n_tokens") - F.col("start"))).drop("n_tokens")
    groups = max(1, -(-lengths.count() // GROUP_PIECES))
    whole = cut.where(F.col("length") == most)
    columns = ["doc_id", "row", "piece", "start", "length"]
    # Sequences of whole pieces are numbered from the upper half by a unique running number.
    whole = whole.select(*columns, (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence"), F.lit(most).alias("capacity"), F.lit(0).cast("long").alias("offset"))

    def run(key, t):
        places, shrunk = best_fit(t["length"].to_pylist(), sizes)
        base = key[0].as_py() << 32
        out = t.select(columns)
        for name, values, kind in (
            ("sequence", [base + b for b, _ in places], pa.int64()),
            ("capacity", [shrunk[b] for b, _ in places], pa.int32()),
            ("offset", [at for _, at in places], pa.int64()),
        ):
            out = out.append_column(name, pa.array(values, kind))
        return out

    rest = cut.where(F.col("length") < most).withColumn("g", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    rest = rest.groupBy("g").applyInArrow(run, "doc_id long, row long, piece long, start long, length long, sequence long, capacity int, offset long")
    return rest.unionByName(whole)


def pack_documents(docs: DataFrame, sizes: tuple[int, ...] = LENGTHS, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece of each row of `docs`: doc_id, piece, start (in the document's
    ids), length, sequence, capacity, offset (in the sequence).

    Null and empty texts are an end id alone. Repeated rows and ids are packed like others.
    Columns other than doc_id and text aren't looked at. No rows give no rows.
    """
    return pack(token_lengths(docs, tokenizer), sizes).drop("row")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
