"""Operator 1, quality classifier: interpolated modified Kneser-Ney over characters.

Trusted text (every document labelled good, but for a fifth that is held out by a hash of
its id) trains a trigram model of characters for each language and one for all together.
The language's model weighs n / (n + OWN_SYMBOLS), where n counts the symbols that trained
it, and the model of all the rest; so a language with little text leans on all, and no size
switches anything. A symbol is a code point, so no character is left out, and one that
trusted text lacks has the probability of what is unseen. A word that repeats the one
before it is one symbol of its own.

Documents are counted once, map-side, in blocks: a block holds some megabytes of text of
one language, lists its distinct trigrams, and codes each document as places in that list
with counts, which takes less than the text. All else are joins of such tables:

- which documents of which blocks are trusted: ids meet labels; their counts are summed
  over blocks, then over shards, by n-gram;
- continuation counts, totals of histories, discounts and interpolated probabilities:
  count tables meet on history and on suffix;
- the blocks' distinct trigrams meet the model's tables, sharded by n-gram, and the
  logarithms found (as whole numbers of 1 / LOG_UNIT, so that sums don't hang on their
  order) meet the coded documents by block: perplexities.

No text is shuffled, and nothing of the model or the documents is sent to the driver.

Two perplexities are compared with a language's quantiles over the trusted documents held
out: that a symbol, which junk raises, must not be above the upper one, and that a word,
which loops of a word lower, must not be below the lower one. Short documents are drawn to
the language's means by PRIOR words and symbols, as their perplexity says less; limits of a
language with few held-out documents are drawn to those of all by PRIOR_DOCS documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbolt.llm.common import KEY, OWN, id_key, keyed, materialize, table, text_of

FOLDS = 5
#: A code point has 21 bits, so three fit a long; START is none.
BITS = 21
START = (1 << BITS) - 1
QUANTILE, MARGIN, PRIOR, PRIOR_WORDS, PRIOR_DOCS = 0.998, 1.15, 200, 40, 200
OWN_SYMBOLS = 20_000
LOG_UNIT = 1 << 16
#: Ranks of a quantile are off by at most this part of the rows.
RANKS = 1_000_000
#: Characters and documents at which a block of one language ends, and of all open blocks.
BLOCK_CHARS, BLOCK_DOCS, OPEN_CHARS = 3 << 20, 4096, 5 << 20
#: The model of all languages; no language's name.
ALL = "\0"


def marked(text: str) -> str:
    """White space as single spaces, a word that repeats the one before it as \\x01."""
    words = text.split()
    return " ".join([b if a != b else "\x01" for a, b in zip(["", *words], words)])


def codes(text: str) -> np.ndarray:
    return np.frombuffer(marked(text).encode("utf-32-le", "replace"), "<u4")


def trigrams(text: str) -> np.ndarray:
    """A number of 3 * BITS bits for each character: itself and the two before it."""
    s = np.concatenate(([START, START], codes(text))).astype(np.int64)
    return (s[:-2] << 2 * BITS) | (s[1:-1] << BITS) | s[2:]


# ---- blocks of coded documents


def pack(places: list[np.ndarray], counts: list[np.ndarray]) -> tuple[bytes, list[int]]:
    """Ascending places and their counts of each document, as bytes, and where documents end.
    Places are coded by their differences in four planes, counts in one; larger ones repeat."""
    gaps, ns, ends = [], [], []
    for p, n in zip(places, counts):
        times = (n + 254) // 255
        gap = np.diff(p, prepend=0)
        at = np.cumsum(times) - times
        g = np.zeros(int(times.sum()), "<u4")
        g[at] = gap
        c = np.full(len(g), 255, np.uint8)
        c[at + times - 1] = n - 255 * (times - 1)
        gaps.append(g)
        ns.append(c)
        ends.append(len(g))
    g = np.concatenate(gaps) if gaps else np.zeros(0, "<u4")
    planes = np.ascontiguousarray(g.view(np.uint8).reshape(-1, 4).T)
    return zlib.compress(planes.tobytes() + b"".join(c.tobytes() for c in ns), 1), np.cumsum(ends).tolist()


def unpack(data: bytes, ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, count, document) of each entry."""
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(5, -1)
    gaps = np.ascontiguousarray(raw[:4].T).view("<u4").ravel().astype(np.int64)
    ends = np.asarray(ends, np.int64)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    run = np.cumsum(gaps)
    before = np.concatenate(([0], run))[starts]
    owner = np.repeat(np.arange(len(ends)), ends - starts)
    return run - before[owner], raw[4].astype(np.int64), owner


_CODED = "block long, lang string, doc_id array<long>, mark array<long>, words array<int>, keys array<long>, ends array<long>, data binary"


def coded(docs: DataFrame) -> DataFrame:
    """Blocks of documents of one language, stored: ids, hashes of texts, numbers of words,
    distinct trigrams (keys) and the documents coded by them (see pack)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, open_, held = TaskContext.get().partitionId(), 0, {}, 0

        def close(lang) -> pa.RecordBatch:
            nonlocal number
            ids, marks, words, keys, counts, _ = open_.pop(lang)
            every, place = np.unique(np.concatenate(keys), return_inverse=True)
            cuts = np.cumsum([len(k) for k in keys])[:-1]
            data, ends = pack(np.split(place, cuts), counts)
            row = [(task << 32) + number, lang, ids, marks, words, every, ends, data]
            number += 1
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [c.split()[0] for c in _CODED.split(", ")])

        for b in batches:
            for doc_id, mark, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                own = open_.setdefault(lang, [[], [], [], [], [], 0])
                k, n = np.unique(trigrams(text), return_counts=True)
                for into, x in zip(own, (doc_id, mark, len(text.split()), k, n.astype(np.int32))):
                    into.append(x)
                own[5] += len(text)
                held += len(text)
                if own[5] >= BLOCK_CHARS or len(own[0]) >= BLOCK_DOCS:
                    held -= own[5]
                    yield close(lang)
                elif held >= OPEN_CHARS or len(open_) > 1000:
                    for x in [*open_]:
                        yield close(x)
                    held = 0
        for lang in [*open_]:
            yield close(lang)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()), "lang", text_of())
    return materialize(rows.mapInArrow(run, _CODED), "coded")


def trusted_members(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """block, at (place in it), doc_id and held (out of the counts) of every document
    labelled good."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    members = blocks.select("block", F.posexplode("doc_id").alias("at", "doc_id"))
    held = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(FOLDS)) == 0
    return members.join(good, "doc_id", "left_semi").withColumn("held", held)


def counted(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """lang, k, c: trigram counts over the members that aren't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, keys, ends, data, ats in zip(*(c.to_pylist() for c in b.columns)):
                place, n, owner = unpack(data, ends)
                use = np.zeros(len(ends), bool)
                use[ats] = True
                c = np.bincount(place, n * use[owner], len(keys)).astype(np.int64)
                seen = c > 0
                columns = [pa.array([lang] * int(seen.sum()), pa.string()), pa.array(np.array(keys, np.int64)[seen]), pa.array(c[seen])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "k", "c"])

    chosen = members.where(~F.col("held")).groupBy("block").agg(F.collect_list("at").alias("ats"))  # BLOCK_DOCS at most
    rows = blocks.join(materialize(chosen, "trusted-blocks"), "block").select("lang", "keys", "ends", "data", "ats")
    return rows.mapInArrow(run, "lang string, k long, c long").groupBy("lang", "k").agg(F.sum("c").alias("c"))


# ---- the model


def _discounted(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From lang, k, c of one order: (lang, k, own) with the discounted relative count, and
    (lang, h, g) with the weight that history h leaves to the lower order."""
    n = [F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    d = counts.groupBy("lang").agg(*n)
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    for i in (1, 2, 3):  # where a count of counts is zero, the usual discounts of half a count a step
        off = F.lit(float(i)) - (i + 1) * F.try_divide(y * F.col(f"n{i + 1}"), F.col(f"n{i}"))
        d = d.withColumn(f"d{i}", F.when(off.isNull(), 0.5 * i).otherwise(F.greatest(F.lit(0.05), off)))
    used = counts.join(d.select("lang", "d1", "d2", "d3"), "lang").withColumn("h", F.shiftright("k", BITS))
    used = used.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
    used = used.withColumn("d", F.least("d", F.col("c") * 0.95))
    totals = used.groupBy("lang", "h").agg(F.sum("c").alias("all"), F.sum("d").alias("off"))
    own = used.join(totals, ["lang", "h"]).select("lang", "k", ((F.col("c") - F.col("d")) / F.col("all")).alias("own"))
    return own, totals.select("lang", "h", (F.col("off") / F.col("all")).alias("g"))


def train(counts: DataFrame) -> dict[str, DataFrame]:
    """From lang, k, c (trigram counts by language, null too): stored tables p3, p2, p1 (lang,
    k, p), p0 (lang, k, p, with k 0) and g3, g2 (lang, h, g): a seen n-gram's interpolated
    probability, that of any unseen character, and the weight of the lower order otherwise,
    for each language and for ALL; and share (lang, share): the weight of the language's own
    model beside that of all, which grows with the symbols that it has seen."""
    counts = materialize(counts, "counts")
    c3 = counts.groupBy("k").agg(F.sum("c").alias("c")).withColumn("lang", F.lit(ALL))
    c3 = materialize(counts.where((F.col("lang") != ALL)).unionByName(c3), "trigrams")
    suffix = lambda k, order: F.expr(f"{k} & {(1 << BITS * order) - 1}")
    c2 = c3.groupBy("lang", suffix("k", 2).alias("k")).agg(F.count("*").alias("c"))  # histories that it follows
    c1 = c2.groupBy("lang", suffix("k", 1).alias("k")).agg(F.count("*").alias("c"))
    own1, g1 = _discounted(c1)
    kinds = c1.groupBy("lang").agg((F.count("*") + 1).alias("kinds"))  # the characters, and all unseen ones as one
    p0 = materialize(g1.join(kinds, "lang").select("lang", F.lit(0).cast("long").alias("k"), (F.col("g") / F.col("kinds")).alias("p")), "p0")
    floor = p0.select("lang", F.col("p").alias("q"))
    p1 = materialize(own1.join(floor, "lang").select("lang", "k", (F.col("own") + F.col("q")).alias("p")), "p1")

    def higher(counts: DataFrame, lower: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
        own, g = _discounted(counts)
        below = lower.select("lang", F.col("k").alias("s"), F.col("p").alias("q"))
        p = own.withColumn("h", F.shiftright("k", BITS)).withColumn("s", suffix("k", order - 1))
        p = p.join(g, ["lang", "h"]).join(below, ["lang", "s"])
        return materialize(p.select("lang", "k", (F.col("own") + F.col("g") * F.col("q")).alias("p")), f"p{order}"), materialize(g, f"g{order}")

    p2, g2 = higher(c2, p1, 2)
    p3, g3 = higher(c3, p2, 3)
    seen = c3.where(F.col("lang") != ALL).groupBy("lang").agg(F.sum("c").alias("n"))
    share = materialize(seen.select("lang", (F.col("n") / (F.col("n") + OWN_SYMBOLS)).alias("share")), "share")
    return {"p0": p0, "p1": p1, "p2": p2, "p3": p3, "g2": g2, "g3": g3, "share": share}


def log_probabilities(keys: DataFrame, model: dict[str, DataFrame]) -> DataFrame:
    """lang, k, lp for distinct lang, k: log-probabilities in LOG_UNIT, by joins on n-gram,
    history and suffix. Null languages and those without a model take the model of all. Null
    without any trusted text."""
    every = keys.select("k").distinct().withColumn("lang", F.lit(ALL))
    g = keys.where(F.col("lang") != ALL).select("k", "lang").unionByName(every)
    suffix = lambda order: F.expr(f"k & {(1 << BITS * order) - 1}")
    g = g.withColumns({"h3": F.shiftright("k", BITS), "k2": suffix(2), "k1": suffix(1)})
    g = g.withColumn("h2", F.shiftright("k2", BITS))
    for name, key, on in (("p3", "k", "k"), ("g3", "h", "h3"), ("p2", "k", "k2"), ("g2", "h", "h2"), ("p1", "k", "k1")):
        g = g.join(model[name].select("lang", F.col(key).alias(on), F.col(name[0]).alias(name)), ["lang", on], "left")
    g = g.join(model["p0"].select("lang", F.col("p").alias("p0")), "lang", "left")
    one = F.lit(1.0)
    p = F.coalesce("p3", F.coalesce("g3", one) * F.coalesce("p2", F.coalesce("g2", one) * F.coalesce("p1", "p0")))
    g = materialize(g.select("lang", "k", p.alias("p")), "probabilities")
    own = g.where(F.col("lang") != ALL).join(model["share"], "lang").select(F.col("lang").alias("of"), "k", F.col("p").alias("own"), "share")
    out = keys.join(g.where(F.col("lang") == ALL).select("k", "p"), "k").withColumn("of", F.col("lang"))
    out = out.join(own, ["of", "k"], "left")
    mixed = F.when(F.col("own").isNull(), F.col("p")).otherwise(F.col("share") * F.col("own") + (1 - F.col("share")) * F.col("p"))
    return out.select("lang", "k", F.round(F.log(mixed) * LOG_UNIT).cast("int").alias("lp"))


def score(blocks: DataFrame, model: dict[str, DataFrame]) -> DataFrame:
    """doc_id, mark, lang, words, chars (symbols) and log_p of every document in the blocks;
    log_p is null without a model."""
    name = F.coalesce("lang", F.lit(ALL))
    listed = blocks.select("block", name.alias("lang"), F.posexplode("keys").alias("at", "k"))
    found = log_probabilities(listed.select("lang", "k").distinct(), model)
    found = listed.join(materialize(found, "log-probabilities"), ["lang", "k"])
    found = found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "lp"))).alias("lps"))  # the block's distinct trigrams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                lang, ids, marks, words, ends, data, lps = (c[i].as_py() for c in b.columns)
                place, n, owner = unpack(data, ends)
                known = len(lps) > 0 and lps[0] is not None
                logs = np.array(lps if known else [0] * len(lps), np.int64)
                total = np.bincount(owner, logs[place] * n, len(ends))  # whole numbers, exact
                chars = np.bincount(owner, n, len(ends)).astype(np.int64)
                log_p = pa.array(total / LOG_UNIT) if known else pa.nulls(len(ends), pa.float64())
                columns = [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array([lang] * len(ids), pa.string()), pa.array(words, pa.int64()), pa.array(chars), log_p]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "lang", "words", "chars", "log_p"])

    # Texts without symbols alone make a block without trigrams, hence the outer join.
    both = blocks.join(found.hint("merge"), "block", "left")
    both = both.select("lang", "doc_id", "mark", "words", "ends", "data", F.coalesce(F.col("lps.lp"), F.array().cast("array<int>")).alias("lp"))
    return both.mapInArrow(run, "doc_id long, mark long, lang string, words long, chars long, log_p double")


def _nats() -> tuple:
    """Mean negative log-probability a symbol and a word, drawn to the language's."""
    symbol = -(F.col("log_p") + PRIOR * F.col("mean")) / (F.col("chars") + PRIOR)
    word = -(F.col("log_p") + PRIOR_WORDS * F.col("word_mean")) / (F.col("words") + PRIOR_WORDS)
    return symbol, word


def thresholds(held: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """lang, mean and word_mean (log-probability a symbol and a word), most and least (limits
    of the two perplexities' logarithms) from the stored scores of the documents held out: a
    row a language and one for ALL, which serves those that aren't there."""
    rows = held.where("words > 0 AND log_p IS NOT NULL").withColumn("lang", F.explode(F.array_distinct(F.array(F.lit(ALL), F.coalesce("lang", F.lit(ALL))))))
    mean = rows.groupBy("lang").agg((F.sum("log_p") / F.sum("chars")).alias("mean"), (F.sum("log_p") / F.sum("words")).alias("word_mean"), F.count("*").alias("n"))
    mean = materialize(mean, "means")
    symbol, word = _nats()
    # In the row of all, a document is measured by how far it is from its own language's mean.
    own = F.broadcast(mean.select(F.col("lang").alias("of"), "mean", "word_mean"))  # a row a language
    far = held.where("words > 0 AND log_p IS NOT NULL").join(own, F.coalesce("lang", F.lit(ALL)) == F.col("of"))
    far = far.select("of", (symbol + F.col("mean")).alias("symbol"), (word + F.col("word_mean")).alias("word"))
    upper, lower = F.percentile_approx("symbol", quantile, RANKS), F.percentile_approx("word", 1 - quantile, RANKS)
    each = far.groupBy("of").agg(upper.alias("upper"), lower.alias("lower"))
    whole = far.agg(upper, lower).first()
    share = F.when(F.col("lang") == ALL, 0.0).otherwise(F.col("n") / (F.col("n") + PRIOR_DOCS))
    drawn = lambda a, b: F.when(F.col(a).isNull(), F.lit(b)).otherwise(share * F.col(a) + (1 - share) * F.lit(b))
    out = mean.join(each, F.col("lang") == F.col("of"), "left")
    most = drawn("upper", whole[0]) - F.col("mean") + float(np.log(margin))
    least = (drawn("lower", whole[1]) - F.col("word_mean")) / margin
    return out.select("lang", "mean", "word_mean", most.alias("most"), least.alias("least"))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), lang, perplexity (a symbol), word_perplexity,
    threshold, word_threshold and kept: a row for each row of `docs`.

    Texts without words (null, empty, white space) have no perplexity and aren't kept. Null
    languages and those without trusted text are held against the model and the limits of
    all. Labels may repeat, be null or name no document. Without trusted documents to train
    on there is no perplexity, without any held out no threshold; then nothing can be judged
    and whatever has words is kept. Rows are judged one by one, so ties and repeated rows
    need no rule. Other columns aren't looked at.
    """
    blocks = coded(docs)
    members = materialize(trusted_members(blocks, labels), "trusted")
    model = train(counted(blocks, members))
    scored = materialize(score(blocks, model), "scores")
    held = members.where("held").select("doc_id").distinct()
    limits = materialize(thresholds(materialize(scored.join(held, "doc_id", "left_semi"), "held-scores")), "thresholds")
    own = F.broadcast(limits.select(F.col("lang").alias("of"), *[F.col(c) for c in ("mean", "word_mean", "most", "least")]))  # a row a language
    rest = limits.where(F.col("lang") == ALL).first()
    rows = scored.join(own, F.col("lang") == F.col("of"), "left")
    for c in ("mean", "word_mean", "most", "least"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(rest[c] if rest else None).cast("double")))
    judged = (F.col("words") > 0) & F.col("most").isNotNull()
    symbol, word = _nats()
    fair = (symbol <= F.col("most")) & (word >= F.col("least"))
    kept = (F.col("words") > 0) & (F.col("most").isNull() | F.col("log_p").isNull() | F.coalesce(fair, F.lit(False)))
    perplexity = [F.exp(F.when(F.col("words") > 0, F.coalesce(x, y))) for x, y in ((symbol, -F.col("log_p") / F.col("chars")), (word, -F.col("log_p") / F.col("words")))]
    return rows.select(
        "doc_id", "mark", "lang", perplexity[0].alias("perplexity"), perplexity[1].alias("word_perplexity"),
        F.exp("most").alias("threshold"), F.exp("least").alias("word_threshold"), kept.alias("kept"),
    )


def _rows(docs: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`docs` and a row a verdict, both with KEY: id, text and language."""
    mark = F.struct(F.xxhash64(text_of()).alias("mark"), F.col("lang").isNull().alias("none"), F.coalesce("lang", F.lit("")).alias("lang"))
    found = F.struct("mark", F.col("lang").isNull().alias("none"), F.coalesce("lang", F.lit("")).alias("lang"))
    return keyed(docs, mark), judged.select("*", *id_key(), found.alias("__mark"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, as they are; columns of any name pass through."""
    rows, judged = _rows(docs, verdicts(docs, labels))
    return rows.join(judged.where("kept").select(*KEY), KEY, "left_semi").select(f"{OWN}.*")


NEW = ("perplexity", "word_perplexity", "threshold", "word_threshold", "kept")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the columns NEW (see verdicts) to those of `docs`; columns of these names are replaced."""
    rows, judged = _rows(docs, verdicts(docs, labels))
    names = [F.col(f"{OWN}.`{c}`") for c in docs.columns if c not in NEW]
    return rows.join(judged.select(*KEY, *NEW).dropDuplicates(KEY), KEY).select(*names, *NEW)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("mark")
