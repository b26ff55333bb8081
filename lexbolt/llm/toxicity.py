"""Operator 8, toxicity: cumulative-link ordinal regression over sparse word features.

Grades run from 0 (not toxic) to GRADES: labels say only whether a document is toxic, so
toxic documents are graded by how dense toxic features are in them, in equal shares; which
features are toxic is taken from the other half of the documents, so that no document has a
part in its own grade. One weight a feature is shared by all ordered thresholds,

    P(grade >= k | x) = 1 / (1 + exp(theta_k - w.x)),  theta_1 < theta_2 < ...,

and the severity is the expected grade, the sum of these over k.

Features are words (runs of letters, lower-cased) and their first 4 and 5 letters, hashed
into 2 ** FEATURE_BITS places; none is left out. x has the log-ratio of a feature's
frequency in toxic and in clean documents for each distinct word that has it, over the root
of the number of entries. So w.x is a sum over distinct words, and scoring is one look-up a
word. The classifier is fitted on at most MAX_TOXIC toxic and MAX_CLEAN clean labelled
documents, chosen by a hash of the id; a fifth of them is held out and sets the limit from
which a document counts as toxic, clean ones weighing as many as there are labelled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbolt.llm.common import OWN, keyed, materialize, table, text_of

MAX_TOXIC, MAX_CLEAN, FOLDS, GRADES, FEATURE_BITS = 1_250, 3_750, 5, 3, 20
STEPS, RATE, PENALTY, SMOOTHING, TOXIC_RATIO = 100, 0.05, 1.0, 1.0, 2.0
_words = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> set[str]:
    return set(_words(text.lower()))


def features_of(word: str) -> list[int]:
    """Places of the word and of its beginnings if they are shorter (marked by their length)."""
    names = [word, *(f"{n}:{word[:n]}" for n in (4, 5) if len(word) > n)]
    return [xxhash.xxh3_64_intdigest(x) & ((1 << FEATURE_BITS) - 1) for x in names]


def labelled(documents: DataFrame, labels: DataFrame, toxic: int = MAX_TOXIC, clean: int = MAX_CLEAN) -> tuple[DataFrame, float]:
    """text, toxic, held of at most so many labelled documents of either kind, stored; and
    how many clean labels there are for each one taken. A document whose labels differ
    counts as toxic."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg((F.max("toxic") > 0).alias("__toxic"))
    known = materialize(known, "toxic-labels")
    n = known.where(~F.col("__toxic")).count()
    some = lambda rows, most: rows.orderBy(F.xxhash64("__id"), "__id").limit(most)
    known = some(known.where("__toxic"), toxic).unionByName(some(known.where(~F.col("__toxic")), clean))
    held = F.pmod(F.xxhash64(F.lit(8), "__id"), F.lit(FOLDS)) == 0
    rows = documents.select(F.col("doc_id").cast("long").alias("__id"), text_of().alias("text"))
    rows = rows.join(F.broadcast(known), "__id")  # MAX_TOXIC + MAX_CLEAN rows
    rows = rows.select("text", F.col("__toxic").alias("toxic"), held.alias("held"), (F.pmod(F.xxhash64(F.lit(9), "__id"), F.lit(2)) == 0).alias("half"))
    return materialize(rows, "labelled"), max(1.0, n / max(1, min(n, clean)))


def log_ratios(owner: np.ndarray, column: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Of every feature's frequency in toxic and in clean documents; 0 where it isn't met."""
    width = 1 << FEATURE_BITS
    t, c = np.bincount(column, toxic[owner], width), np.bincount(column, ~toxic[owner], width)
    r = np.log((t + SMOOTHING) / (toxic.sum() + 2 * SMOOTHING)) - np.log((c + SMOOTHING) / ((~toxic).sum() + 2 * SMOOTHING))
    return np.where(t + c > 0, r, 0.0)


def thetas_of(param: np.ndarray, width: int) -> np.ndarray:
    """Ascending thetas from the first and the logarithms of the steps to the next ones."""
    return param[width] + np.concatenate(([0.0], np.cumsum(np.exp(param[width + 1 :]))))


def loss_and_gradient(param: np.ndarray, owner: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, width: int, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the grades y plus the penalty, and its gradient."""
    n, w, theta = len(y), param[:width], thetas_of(param, width)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    z = np.bincount(owner, w[column] * value, n) if len(owner) else np.zeros(n)
    above = np.hstack([np.ones((n, 1)), sigmoid(z[:, None] - theta[None, :]), np.zeros((n, 1))])  # P(grade >= k)
    rows = np.arange(n)
    p = np.maximum(above[rows, y] - above[rows, y + 1], 1e-12)
    slope = above * (1 - above)  # zero at both ends
    d_own, d_next = slope[rows, y] / p, slope[rows, y + 1] / p
    dz = -(d_own - d_next) / n
    d_theta = np.array([(d_own[y == k].sum() - d_next[y == k - 1].sum()) / n for k in range(1, len(theta) + 1)])
    g_w = (np.bincount(column, dz[owner] * value, width) if len(owner) else 0) + l2 * w / n
    tail = np.cumsum(d_theta[::-1])[::-1]
    grad = np.concatenate([g_w, [tail[0]], tail[1:] * np.exp(param[width + 1 :])])
    return float(-np.log(p).mean() + l2 * (w @ w) / (2 * n)), grad


def fit_ordinal(owner: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, width: int, grades: int = GRADES, steps: int = STEPS, l2: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """w and ascending thetas, by Adam over all rows; entry i is `value` of `column` in row `owner`."""
    param = np.concatenate([np.zeros(width), [1.0], np.zeros(grades - 1)])
    m, v = np.zeros_like(param), np.zeros_like(param)
    for t in range(1, steps + 1):
        _, grad = loss_and_gradient(param, owner, column, value, y, width, l2)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        param = param - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return param[:width], thetas_of(param, width)


def expected_grade(z: np.ndarray, thetas: np.ndarray) -> np.ndarray:
    return (1 / (1 + np.exp(np.clip(thetas[None, :] - np.asarray(z, float)[:, None], -700, 700)))).sum(1)


def grades_of(owner: np.ndarray, column: np.ndarray, toxic: np.ndarray, half: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """0 for clean documents; for toxic ones 1 to `grades` by the share of their entries
    whose log-ratio over the other half of the documents is TOXIC_RATIO or more."""
    density = np.zeros(len(toxic))
    for side in (True, False):
        other = half != side
        if not (other & toxic).any() or not (other & ~toxic).any():
            other = np.ones(len(toxic), bool)
        use, place = other[owner], np.cumsum(other) - 1
        r = log_ratios(place[owner[use]], column[use], toxic[other])
        n = np.maximum(np.bincount(owner, minlength=len(toxic)), 1)
        own = np.bincount(owner, r[column] >= TOXIC_RATIO, len(toxic)) / n
        density[half == side] = own[half == side]
    cuts = np.quantile(density[toxic], [k / grades for k in range(1, grades)])
    return np.where(toxic, 1 + np.searchsorted(cuts, density, side="left"), 0)


def train(documents: DataFrame, labels: DataFrame) -> dict | None:
    """Weights (log-ratio times w), thetas and the limit; None without toxic or without clean examples."""
    rows, weight = labelled(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.array(sorted(f for w in words_of(t) for f in features_of(w)), "<i4").tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), *b.columns[1:]], ["x", "toxic", "held", "half"])

    found = rows.mapInArrow(run, "x binary, toxic boolean, held boolean, half boolean").toArrow()  # MAX_TOXIC + MAX_CLEAN rows
    found = found.take(np.argsort([xxhash.xxh3_64_intdigest(x.as_py()) for x in found["x"]], kind="stable")) if len(found) else found
    x = [np.frombuffer(b, "<i4") for b in found["x"].to_pylist()]
    toxic, held, half = (np.array(found[c].to_pylist(), bool) for c in ("toxic", "held", "half"))
    if not toxic.any() or toxic.all():
        return None
    if not (toxic & ~held).any() or not (~toxic & ~held).any():
        held = np.zeros(len(x), bool)

    def entries(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [x[i] for i in np.nonzero(use)[0]]
        return np.repeat(np.arange(len(own)), [len(r) for r in own]), np.concatenate(own).astype(np.int64)

    owner, column = entries(~held)
    fit = ~held
    ratio = log_ratios(owner, column, toxic[fit])
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=int(fit.sum())), 1))
    grade = grades_of(owner, column, toxic[fit], half[fit])
    w, thetas = fit_ordinal(owner, column, ratio[column] * scale[owner], grade, 1 << FEATURE_BITS)
    weights = (w * ratio).astype(np.float32)
    severity = expected_grade(np.array([weights[r].sum(dtype=np.float64) / np.sqrt(max(1, len(r))) for r in x]), thetas)
    test = held if (held & toxic).any() and (held & ~toxic).any() else ~held
    # The limit with the best F1 on held-out documents; the middle between neighbours.
    s, t = severity[test], toxic[test]
    order = np.argsort(-s, kind="stable")
    ss, hit, false = s[order], np.cumsum(t[order]), weight * np.cumsum(~t[order])
    last = np.append(ss[1:] != ss[:-1], True)
    f1 = np.where(last, 2 * hit / (hit + false + t.sum()), -1)
    k = int(np.argmax(f1))
    limit = (ss[k] + (ss[k + 1] if k + 1 < len(ss) else 0.0)) / 2
    return {"weights": weights, "thetas": thetas, "limit": float(limit), "f1": float(f1[k])}


NEW = ("severity", "grade", "toxic")


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """Adds severity (0 to GRADES), grade (the nearest) and toxic to the columns of `docs`;
    columns of these names are replaced, others of any name pass through.

    Texts without letters (null, empty) score as text without features. Rows are scored one
    by one, so ties and repeated rows need no rule. Without examples of both kinds to learn
    from, the new columns are null. No rows give no rows.
    """
    rows = keyed(docs, F.lit(0)).select(OWN, F.coalesce(F.col(f"{OWN}.text"), F.lit("")).alias("text"))
    names = [F.col(f"{OWN}.`{c}`") for c in docs.columns if c not in NEW]
    if model is None:
        return rows.select(*names, F.lit(None).cast("double").alias("severity"), F.lit(None).cast("int").alias("grade"), F.lit(None).cast("boolean").alias("toxic"))
    sent = docs.sparkSession.sparkContext.broadcast(model["weights"])  # 4 MB
    thetas, cache = model["thetas"], {}

    @F.pandas_udf("double")
    def severity(text):
        import pandas as pd

        weights, z = sent.value, []
        for t in text:
            total, entries = 0.0, 0
            if len(cache) > 300_000:
                cache.clear()
            for w in words_of(t):
                own = cache.get(w)
                if own is None:
                    places = features_of(w)
                    own = float(weights[places].sum(dtype=np.float64)), len(places)
                    if len(w) <= 64:
                        cache[w] = own
                total += own[0]
                entries += own[1]
            z.append(round(total / max(1, entries) ** 0.5, 6))  # the order of a set's words must not show
        return pd.Series(expected_grade(np.array(z), thetas)) if z else pd.Series([], dtype=float)

    out = rows.select(OWN, severity("text").alias("severity"))
    return out.select(*names, "severity", F.round("severity").cast("int").alias("grade"), (F.col("severity") >= model["limit"]).alias("toxic"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, train(documents, table(spark, sf_dir, "labels"))).select("doc_id", *NEW)
