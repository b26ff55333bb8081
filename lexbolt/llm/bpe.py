"""Operator 11, byte-level BPE encoding and decoding by rank files, in padded numpy matrices.

A text is cut by the pattern; a piece that is a token of its own has its id at once. The
other pieces that a batch meets for the first time are laid out as rows of matrices, a
matrix for each class of lengths (powers of two), one byte's id a cell, padded on the right.
Each round merges in every row the leftmost of its pairs with the least rank: ranks of
neighbours come from a hashed table of all pairs that make a token, the cells behind the
merge move up by one, the two ranks beside it are looked up anew, and rows with nothing left
to merge leave the matrix. A row of n bytes takes n rounds at most, so pieces beyond
LONG_BYTES, for which that would grow by the square, take a heap of pairs instead, which
merges in the same order.

Workers keep the ids of a bounded number of pieces. Ids are stored as little-endian unsigned
32-bit integers in a binary column; `decode` turns such columns into bytes again.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbolt.llm.common import table, text_of

LONG_BYTES = 1024
#: Cells of a matrix at most, pieces in a worker's memory, pieces of a text handled at a time.
MATRIX_CELLS, KEPT_PIECES, CHUNK_PIECES = 1 << 20, 300_000, 1 << 17
NONE = np.int64(1) << 62  # the rank of what isn't a token


class Pairs:
    """Ranks of pairs of ids by an open-addressed hash table in two arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(len(ranks) * 2).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE)
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        while len(keys):  # all that met a free slot at once; of those that met the same one the last stays
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            put = self.keys[at] == keys
            self.ranks[at[put]] = ranks[put]
            keys, ranks, at = keys[~put], ranks[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where a pair makes no token or either is -1."""
        keys = left << 32 | right
        at, out = self._slot(keys), np.full(keys.shape, NONE)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        keys, at, flat = keys.reshape(-1)[open_], at.reshape(-1)[open_], out.reshape(-1)
        while len(open_):
            there = self.keys[at]
            hit = there == keys
            flat[open_[hit]] = self.ranks[at[hit]]
            on = ~hit & (there >= 0)
            open_, keys, at = open_[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


class Codec:
    """Ids of texts and texts of ids by a rank file (base64 token, rank; a line each)."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).finditer
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        found = [(u, v, rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (u := self.ranks.get(token[:i])) is not None and (v := self.ranks.get(token[i:])) is not None]
        self.pairs = Pairs(*np.array(found, np.int64).reshape(-1, 3).T)
        self.pair_ranks = {(u, v): rank for u, v, rank in found}
        self.known: dict[str, bytes] = {}

    # ---- merges

    def _rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The ids' bytes of pieces of `width` bytes at most, by one matrix."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        cells = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_ids[cells], -1)
        ranks = self.pairs.of(ids[:, :-1], ids[:, 1:])
        out, row = np.full(ids.shape, -1), np.arange(len(pieces))
        while len(row):
            at = ranks.argmin(1)  # the leftmost of the least
            least = ranks[np.arange(len(row)), at]
            on = least < NONE
            if not on.all():
                out[row[~on], : ids.shape[1]] = ids[~on]
                ids, ranks, row, at, least = ids[on], ranks[on], row[on], at[on], least[on]
                if not len(row):
                    break
            n, w = ids.shape
            k = np.arange(n)
            ids[k, at] = least  # a token's id is its rank
            behind = np.arange(w - 1) > at[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            right = np.minimum(at + 1, w - 1)
            ranks[k, at] = np.where(at + 1 < w, self.pairs.of(ids[k, at], ids[k, right]), NONE)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs.of(ids[left, at[left] - 1], ids[left, at[left]])
            used = int((ids >= 0).sum(1).max())
            if used < w:  # columns that no row needs any more
                ids, ranks = ids[:, : max(2, used)], ranks[:, : max(1, used - 1)]
        flat, counts = out[out >= 0].astype("<u4").tobytes(), (out >= 0).sum(1)
        ends = (np.cumsum(counts) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _heap(self, piece: bytes) -> bytes:
        """The same merges for one long piece: the least pair, of equal ones the leftmost."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.pair_ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] is None or j >= n or rank((ids[i], ids[j])) != r:  # the pair has changed
                continue
            ids[i], ids[j], after[i] = r, None, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (right := rank((r, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (right, i))
            if before[i] >= 0 and (left := rank((ids[before[i]], r))) is not None:
                heapq.heappush(heap, (left, before[i]))
        return np.array([x for x in ids if x is not None], "<u4").tobytes()

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids' bytes of each piece, which isn't empty."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > LONG_BYTES:
                out[i] = self._heap(p)
            else:
                classes.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, rows in classes.items():
            step = max(1, MATRIX_CELLS // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._rows([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    # ---- texts

    def _ids(self, chunks: list[list[str]]) -> list[bytes]:
        """The ids' bytes of lists of pieces; what is new among them is merged at once."""
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        new = list(set().union(*chunks) - self.known.keys())
        self.known.update(zip(new, self.merged([p.encode() for p in new])))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in chunks]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids' bytes of each text; long texts go piece by piece, in chunks."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            match = (m.group() for m in self.split(text))
            pieces = list(islice(match, CHUNK_PIECES))
            if len(pieces) < CHUNK_PIECES:
                held.append(pieces)
                size += len(pieces)
                if size < CHUNK_PIECES:
                    continue
                pieces = []
            yield from self._ids(held)
            held, size = [], 0
            if pieces:
                parts = []
                while pieces:
                    parts += self._ids([pieces])
                    pieces = list(islice(match, CHUNK_PIECES))
                yield b"".join(parts)
        yield from self._ids(held)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _mapped(rows: DataFrame, schema: str, of) -> DataFrame:
    """The last column of `rows` as binary, by `of` its values; the others as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = b.num_columns - 1
            out = pa.array(list(of(x.as_py() for x in b.column(last))), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:last], out], b.schema.names)

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of each row of `docs`.

    Null text counts as empty and has no ids; null and repeated ids and repeated rows are
    encoded like any others; other columns, whatever their names, aren't looked at. No rows
    give no rows. A text may be of any length: it is handled in chunks of its pieces.
    """
    rows = docs.select("doc_id", text_of().alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _mapped(rows, f"doc_id {kind}, ids binary", lambda texts: codec(ranks, pattern).encode(texts))


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and data (binary): the bytes that the ids stand for. Null ids give none."""
    rows = encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("data"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _mapped(rows, f"doc_id {kind}, data binary", lambda ids: map(codec(ranks, pattern).decode, ids))


def coded(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of `docs`, whose ids are
    decoded again."""
    rows = encode(docs, ranks, pattern)
    rows = rows.select(F.struct("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256")).alias("doc_id"), "ids")
    return decode(rows, ranks, pattern).select("doc_id.*", F.sha2("data", 256).alias("decoded_sha256"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return coded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
