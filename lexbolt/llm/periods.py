"""Operator 12, periodic runs of words by repeated k-gram masking and Main-Lorentz.

A run is a maximal stretch of words with smallest period q, at least `least_words` and
`times` periods long. A run of L words overlaps itself, shifted by q, in L - q words, which
is never less than k = the least of max(least_words, times q) - q over all q. So each word of
a run is in a k-gram that occurs again in the same document (the first L - q words by the
k-grams that come again q later, the last L - q by those that came q before), and words in no
such k-gram are masked: they can't join runs. K-grams are compared by 64-bit hashes; equal
hashes of different k-grams only leave words that might have been masked.

The surviving segments of many documents are laid end to end, each behind a word of its own
that is nowhere else, and go through Main-Lorentz together, a level of its recursion at a
time in numpy. At half-width w the centres are the odd multiples of w. A run whose most
central position (that divisible by the highest power of two) is the centre m lies within m
- w and m + w, so its period is at most 2 w / times, and half of its periods are on one side
of m: for each period q the longest common extensions of m and m + q (or m - q and m), ahead
and back, give the run. Two words that must agree rule out nearly all pairs of centre and
period first. Extensions come from ranks of all stretches of 1, 2, 4, ... words, by doubling
up to the length at which no stretch repeats; they are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbolt.llm.common import WORD, table, text_of

LEAST_WORDS, TIMES = 6, 4
#: Bytes of text that are handled together; a longer text is handled alone.
GROUP_BYTES = 1 << 20


def overlap(least_words: int = LEAST_WORDS, times: int = TIMES) -> int:
    """k: the least overlap of a run with itself, shifted by its period."""
    return min(max(least_words, times * q) - q for q in range(1, least_words + 1))


def surviving(ids: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which words are in a k-gram that occurs more than once in its document."""
    n = len(ids) - k + 1
    on = np.zeros(len(ids) + 1, np.int64)
    if n > 0:
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        hashes = (doc[:n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        for j in range(k):
            hashes = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) + mixed[j : j + n]
        at = np.flatnonzero(doc[:n] == doc[k - 1 :])
        hashes = hashes[at]
        ordered = np.sort(hashes)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            place = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
            at = at[twice[place] == hashes]
            on[at] += 1
            np.subtract.at(on, at + k, 1)
    return np.cumsum(on[:-1]) > 0


class Extensions:
    """Longest common extensions in a sequence, from ranks of its stretches of 2^j items."""

    def __init__(self, items: np.ndarray):
        self.ranks = [np.unique(items, return_inverse=True)[1].astype(np.int32)]
        size = 1
        while 2 * size <= len(items):
            r = self.ranks[-1]
            pair = r[:-size].astype(np.int64) * len(items) + r[size:]
            pair = pair[: len(items) - 2 * size + 1]
            kinds, rank = np.unique(pair, return_inverse=True)
            if len(kinds) == len(pair):  # no stretch of this length repeats
                break
            self.ranks.append(rank.astype(np.int32))
            size *= 2

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items from i and from j > i on agree."""
        got = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            r = self.ranks[level]
            a, b = i + got, j + got
            agree = (b < len(r)) & (r[np.minimum(a, len(r) - 1)] == r[np.minimum(b, len(r) - 1)])
            got += agree.astype(np.int64) << level
        return got

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items up to and with i, and up to j > i, agree."""
        got = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            r = self.ranks[level]
            a, b = i - got - (1 << level) + 1, j - got - (1 << level) + 1
            agree = (a >= 0) & (b < len(r)) & (r[np.clip(a, 0, len(r) - 1)] == r[np.clip(b, 0, len(r) - 1)])
            got += agree.astype(np.int64) << level
        return got


def _distinct(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches found by several periods (multiples of the smallest) that with the smallest."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[first], end[first], period[first]


def runs_of(items: np.ndarray, longest: int, least_words: int = LEAST_WORDS, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs of `items`, none of which is longer than `longest`."""
    n, found = len(items), [(np.zeros(0, np.int64),) * 3]
    lce = Extensions(items)
    width = 1
    while width < n:
        periods = np.arange(1, min(2 * width, longest) // times + 1)
        need = (times * periods + 1) // 2 - periods  # items that agree with those a period on, on the larger side
        centres = np.arange(width, n, 2 * width)
        bases = []
        for towards in (1, -1) if len(periods) else ():
            m, q = np.repeat(centres, len(periods)), np.tile(periods, len(centres))
            for offset in (np.minimum(need, 1), need):  # the first and the last of them, if there are any
                by = np.tile(offset, len(centres)) if len(m) == len(centres) * len(periods) else offset[q - 1]
                i = m + by - 1 if towards > 0 else m - by
                other = i + q if towards > 0 else i - q
                agree = (by == 0) | ((other < n) & (other >= 0) & (items[np.clip(i, 0, n - 1)] == items[np.clip(other, 0, n - 1)]))
                m, q = m[agree], q[agree]
            base = m if towards > 0 else m - q
            fits = (base >= 0) & (base + q <= n)
            bases.append((base[fits], q[fits]))
        if bases:
            base, q = (np.concatenate(x) for x in zip(*bases))
            start, end = base - lce.back(base - 1, base + q - 1), base + q + lce.ahead(base, base + q)
            keep = end - start >= np.maximum(least_words, times * q)
            found.append(_distinct(start[keep], end[keep], q[keep]))
        width *= 2
    return _distinct(*(np.concatenate(x) for x in zip(*found)))


def runs_of_documents(ids: np.ndarray, sizes: np.ndarray, least_words: int = LEAST_WORDS, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start (in the concatenated `ids`), length and period of all runs, by document,
    start and period. `sizes`: the words of each document."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    on = surviving(ids, doc, overlap(least_words, times))
    edge = np.ones(len(ids) + 1, bool)
    edge[1:-1] = doc[1:] != doc[:-1]
    start = np.flatnonzero(on & (edge[:-1] | ~np.append(False, on[:-1])))
    end = np.flatnonzero(on & (edge[1:] | ~np.append(on[1:], False))) + 1
    long_enough = end - start >= least_words
    start, end = start[long_enough], end[long_enough]
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    lengths = end - start
    places = np.cumsum(lengths + 1) - lengths  # behind the segment's own word
    at = np.arange(int((lengths + 1).sum())) - np.repeat(places - start, lengths + 1)
    items = ids[at.clip(0)]
    items[places - 1] = -1 - np.arange(len(places))
    first, last, period = runs_of(items, int(lengths.max()), least_words, times)
    first_word = at[first]
    order = np.lexsort((period, first_word))
    first_word, length, period = first_word[order], (last - first)[order], period[order]
    return doc[first_word], first_word, length, period


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The place of the first and the words of documents of about GROUP_BYTES."""
    at, size, words = 0, 0, []
    for i, text in enumerate(batch.column(1)):
        data = text.as_py().encode()
        words.append(data.split())  # at the same six characters as WORD
        size += len(data)
        if size >= GROUP_BYTES:
            yield at, words
            at, size, words = i + 1, 0, []
    if words:
        yield at, words


def collapse(docs: DataFrame, least_words: int = LEAST_WORDS, times: int = TIMES) -> DataFrame:
    """doc_id, runs (an array of start, length, period in words, by start and period) and
    collapsed (the words that are in no run behind its first period, one space between
    them) of each row of `docs`.

    Null text counts as empty, which has no runs and stays empty; null and repeated ids and
    repeated rows are rows like any others; other columns, whatever their names, aren't
    looked at. No rows give no rows. A text may be of any length; its words are held in one
    task, and numbers of them for each doubling up to its longest repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, words in _grouped(b):
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                flat = [w for own in words for w in own]
                numbers = dict(zip(dict.fromkeys(flat), range(len(flat))))
                ids = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
                doc, start, length, period = runs_of_documents(ids, sizes, least_words, times)
                gone = np.zeros(len(flat) + 1, np.int64)
                np.add.at(gone, start + period, 1)
                np.subtract.at(gone, start + length, 1)
                kept = np.cumsum(gone[:-1]) == 0
                ends = np.cumsum(sizes)
                texts = []
                for own, i, j in zip(words, (ends - sizes).tolist(), ends.tolist()):
                    stay = kept[i:j]
                    texts.append(b" ".join(own if stay.all() else [own[x] for x in np.flatnonzero(stay).tolist()]))
                offsets = np.append(0, np.cumsum(np.bincount(doc, minlength=len(words)))).astype(np.int32)
                fields = [pa.array(x.astype(np.int64)) for x in (start - (ends - sizes)[doc], length, period)]
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(words)), runs, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select("doc_id", text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents (by a CRC-32 of the id) repeat a
    stretch of their own words up to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", text_of().alias("text"), h.alias("h"), F.expr("h div 10").alias("g"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    parts = F.struct("g", words.alias("words"), F.size(words).cast("long").alias("n"))
    looped = F.element_at(F.transform(F.array(parts), _looped), 1)
    return rows.select("doc_id", F.when(F.col("h") % 10 == 0, looped).otherwise(F.col("text")).alias("text"))


def _looped(x):
    g, words, n = x["g"], x["words"], x["n"]
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    word = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return F.when(n == 0, F.lit("")).otherwise(F.array_join(word, " "))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (of equal ones the first, then that of the smallest
    period; nulls if there is none) and digests of all runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), lines.alias("lines"), "collapsed")
    length, period = -F.col("top.less"), F.col("top.period")
    return rows.select(
        "doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * -top.less div top.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(collapse(with_loops(table(spark, sf_dir, "documents"))))


#: Runs by a join of equal k-grams instead of Main-Lorentz. `crc` is CRC-32 bit by bit.
OP12_SQL = rf"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
crc AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS h FROM raw),
shape AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM crc),
step AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM shape),
doc AS (SELECT r, doc_id, n, CASE WHEN doc_id IS NOT NULL AND h % 10 = 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w,
  doc_id IS NULL OR h % 10 <> 0 AS plain FROM step),
word AS (SELECT r, unnest(range(0, n)) AS i, unnest(w) AS word FROM doc),
gram AS (SELECT r, i, word, hash(word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS gram,
  [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS words, lead(i, 4) OVER o IS NOT NULL AS whole FROM word WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, gram FROM gram WHERE whole GROUP BY r, gram HAVING count(*) > 1),
again AS (SELECT gram.* FROM gram JOIN twice USING (r, gram) WHERE whole),
pair AS (SELECT x.r, x.i, y.i - x.i AS q FROM again x JOIN again y ON x.r = y.r AND x.gram = y.gram AND x.words = y.words AND y.i > x.i),
island AS (SELECT r, q, min(i) AS start, count(*) + {overlap() - 1} + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pair) GROUP BY r, q, k),
run AS (SELECT r, start, length, min(q) AS period FROM island WHERE length >= greatest({LEAST_WORDS}, {TIMES} * q) GROUP BY r, start, length),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT word.r, string_agg(word.word, ' ' ORDER BY word.i) AS collapsed FROM word ANTI JOIN gone ON gone.r = word.r AND gone.i = word.i GROUP BY word.r),
found AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
  first(struct_pack(s := start, l := length, p := period) ORDER BY length DESC, start, period) AS top FROM run GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(top.l AS BIGINT) AS length, CAST(top.p AS BIGINT) AS period, CAST(1000 * top.l // top.p AS BIGINT) AS exponent_milli,
 sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM doc LEFT JOIN found USING (r) LEFT JOIN kept USING (r)
"""
