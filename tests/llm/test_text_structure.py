"""Byte-level BPE, periodic runs and the divergence audit: brute force, nulls, empties, long
texts, ties, repeated rows, clashing columns and empty tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lexbolt.llm import bpe, divergence, periods
from lexbolt.llm.common import materialize

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, ids string, runs int, n long, term string, p double, words long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(60)]
    out = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 90))), rng.choice(["en", "fr"]), f"s{rng.randint(0, 6)}") for i in range(150)]
    out += [(200, None, "en", "s1"), (201, "", "fr", None), (202, " \t\n ", None, "s1"), (203, "ONE One one", "en", "s1"), (203, "ONE One one", "en", "s1")]
    out += [(None, "no id no id no id no id no id here", "en", "s2"), (204, "word " * 30000, "en", "s2"), (205, "x" * 40000, "en", "s8"), (206, "12 34", "en", "empty"), (207, "!", "xx", "a"), (208, "?", "xx", "b")]
    out += [(300 + i, "x é漢字😀 'tis we'll  double space \r\n end<|endoftext|> " * (i + 1), "fr", "s3") for i in range(6)]
    out += [(400 + i, ("a b c " * i + "d e " * i) * 3, "en", "loops") for i in range(12)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return materialize(spark.createDataFrame([(*r, "x", 1, 2, "y", 0.5, 3) for r in rows], SCHEMA).repartition(3), "docs")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- byte-level BPE


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_gives_the_librarys_ids(docs, rows, none, library):
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want[doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    got = bpe.coded(docs, RANKS, PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, got.collect())) == want
    assert bpe.coded(none, RANKS, PATTERN).collect() == []


def test_bpe_of_random_and_long_pieces(library):
    rng, codec = random.Random(5), bpe.codec(RANKS, PATTERN)
    letters = "abcdefghiABC'stve\n\t 12 é漢字😀!?  "
    texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 2, 7, 40, 400]))) for _ in range(1500)]
    texts += ["".join(rng.choices("etaoinsh", k=n)) for n in (bpe.LONG_BYTES - 1, bpe.LONG_BYTES, bpe.LONG_BYTES + 1, 30000)]
    texts += ["a" * n for n in (2, 3, 1023, 1025, 20000)] + [" " * 9000, "x y " * 90000]
    got = list(codec.encode(texts))
    assert len(got) == len(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_matrix_and_heap_agree():
    rng, codec = random.Random(6), bpe.codec(RANKS, PATTERN)
    pieces = [bytes(rng.choices(range(97, 110), k=rng.randint(2, 200))) for _ in range(300)]
    pieces = [p for p in pieces if p not in codec.ranks]
    assert codec.merged(pieces) == [codec._heap(p) for p in pieces]


# ---- periodic runs


def slow_runs(words, least=6, times=4):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(i + 1, j + 1)
    return sorted((i, n, q) for (i, n), q in found.items())


def slow_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    # one word over and over would take the square of its length: known
    runs = [(0, n, 1)] if n > 1000 and len(set(words)) == 1 else slow_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *head, digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs(docs, rows, none):
    got = periods.digests(periods.collapse(periods.with_loops(docs)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(slow_row(*r[:2]) for r in rows)
    assert periods.digests(periods.collapse(periods.with_loops(none))).collect() == []
    texts = {r.doc_id: r for r in periods.collapse(docs).collect()}
    assert texts[411].collapsed.split() == ["a", "b", "c", "d", "e"] * 3 and texts[200].collapsed == ""
    assert [tuple(x) for x in texts[204].runs] == [(0, 30000, 1)]


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (4, 2), (6, 3), (10, 5)])
def test_runs_of_random_words(least, times):
    rng = random.Random(least * 10 + times)
    texts = []
    for _ in range(300):
        n, kinds = rng.choice([0, 1, 5, 12, 40, 120]), rng.choice([1, 2, 3, 9, 50])
        words = [rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.6:
            at, p = rng.randrange(n), rng.randint(1, max(1, n // times))
            words = [w if i < at else words[at + (i - at) % p] for i, w in enumerate(words)] + [rng.randrange(kinds) for _ in range(rng.randint(0, 9))]
        texts.append(words)
    sizes = np.array([len(t) for t in texts])
    doc, start, length, period = periods.runs_of_documents(np.array([w for t in texts for w in t]), sizes, least, times)
    first = np.cumsum(sizes) - sizes
    got = defaultdict(list)
    for d, s, n, q in zip(doc.tolist(), (start - first[doc]).tolist(), length.tolist(), period.tolist()):
        got[d].append((s, n, q))
    for d, words in enumerate(texts):
        assert got[d] == slow_runs(words, least, times)


def test_masking_keeps_every_run_and_masks_the_rest():
    rng = random.Random(2)
    words = [*range(5000), *(7000 + i % 9 for i in range(60)), *range(8000, 9000)]
    rng.shuffle(words[:5000])
    on = periods.surviving(np.array(words), np.zeros(len(words), np.int64), periods.overlap())
    assert on[5000:5060].all() and on.sum() == 60


# ---- divergence


def same_as_sql(spark, frame, folder):
    frame.write.parquet(str(folder))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    return Counter(con.sql(f"SELECT lang, source, part, item, value, rank FROM ({divergence.OP13_SQL})").fetchall())


@pytest.mark.parametrize("share, groups, block, tile", [(0.25, 64, 128, 4096), (0.5, 3, 2, 5), (2.0, 1000, 3, 7), (0.0, 0, 4, 50)])
def test_divergence(spark, docs, none, tmp_path, monkeypatch, share, groups, block, tile):
    """By both ways alone and together; small blocks make several tiles of a language."""
    for name, value in (("HEAVY_SHARE", share), ("LIGHT_GROUPS", groups), ("TILE_TERMS", tile)):
        monkeypatch.setattr(divergence, name, value)
    got = divergence.audit(docs, block=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == same_as_sql(spark, docs, tmp_path / "d")
    assert divergence.audit(none, block=block).collect() == []


def test_counts_of_terms_are_passed_on_in_parts(docs, monkeypatch):
    import pyarrow as pa

    rows = docs.select("lang", "source", "text").fillna("").toArrow().combine_chunks().to_batches()

    def total():
        out = Counter()
        for b in divergence._count(iter(rows)):
            for r in pa.Table.from_batches([b]).to_pylist():
                out[r["lang"], r["source"], r["term"], "n"] += r["n"]
                out[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return out

    whole = total()
    monkeypatch.setattr(divergence, "HELD_TERMS", 10)
    assert total() == whole and whole["en", "s2", "word", "n"] == 30000


def test_shares_are_exact_beyond_longs(spark):
    from pyspark.sql import functions as F

    big = 10**13
    row = spark.range(1).select(divergence._share(F.lit(big).cast("long"), F.lit(3 * big).cast("long")).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 1) // (3 * big)
