"""Operator 13, how the sources of a language differ in their terms (heavy-light split).

Terms of documents are counted in the tasks that read them (numbers of a bounded number of
terms at a time), and only these partial counts are shuffled, by language and term: then a
term's documents, its total and its groups (a group is a language's source) are known where
its counts are. With p of every cell (group, term) the divergence of all pairs of groups
is a sum over all kept terms, split by in how many groups a term occurs:

- A term that is absent has one and the same p in a group (p0), so all terms are first
  counted as absent in both groups.
- Heavy terms, those in over HEAVY_SHARE of the language's groups or in over LIGHT_GROUPS,
  fill dense tiles: TILE_TERMS terms by two blocks of BLOCK groups, cells of no occurrence
  included, summed over the terms in numpy for all pairs of the two blocks in place of
  what the terms counted for as absent.
- Light terms are absent nearly everywhere. What each group's own ones change is added as
  if absent in the other; that depends on the group's p alone, so a histogram of p by
  group does. Then, term by term, each pair of postings (LIGHT_GROUPS at most) is corrected
  for being in both groups; the corrections are summed by pair of groups in the tasks.

All is done in 64-bit integers; the partial sums are added as decimals. No table is
broadcast by command: the groups' table is stored, so Spark knows its size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexbolt.llm.common import materialize, table

LEAST_DOCS, TOP_TERMS = 3, 200
SCALE = 1_000_000_000
HEAVY_SHARE, LIGHT_GROUPS = 0.25, 64
BLOCK, TILE_TERMS = 128, 512
#: Terms that a counting task holds before it passes their counts on; pairs that are corrected at a time.
HELD_TERMS, PAIRS = 300_000, 1 << 20

#: Bytes of no term become spaces, A-Z become a-z, all others stay, so terms are what split() gives.
_TERMS = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TERMS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), docs (documents): partial counts of rows of lang, source, text."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
            names = [pa.repeat(x, len(terms)) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*names, terms, pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64())], ["lang", "source", "term", "n", "docs"])

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            terms = terms_of(text.as_py())
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(terms)
            docs.update(set(terms))
            size += len(n) - before
            if size >= HELD_TERMS:
                yield from flush()
                held.clear()
                size = 0
    yield from flush()


def _share(n: Column, of: Column) -> Column:
    """1 + floor(SCALE (n + 1) / of), exactly; n may be beyond what times SCALE is a long."""
    return F.lit(1).cast("long") + F.call_function("div", (n + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), of.cast("decimal(19,0)"))


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Two stored tables. Counts: lang, source, term, n, total (in the language), groups (that
    have the term), first (one row a language and term is). Groups: lang, source, gid (place
    in the language), size, groups, all_size, all_terms, heavy, p0."""
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = own.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", "term")
    counts = counts.select("lang", "source", "term", "n", *[f.over(of_term).alias(c) for c, f in (("total", F.sum("n")), ("groups", F.count("*")), ("seen", F.sum("docs")))], F.row_number().over(of_term.orderBy("source")).alias("nth"))
    counts = materialize(counts.where(F.col("seen") >= least_docs).select("lang", "source", "term", "n", "total", "groups", (F.col("nth") == 1).alias("first")), "term-counts")

    groups = own.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left").fillna(0, ["size"])
    of_lang = W.partitionBy("lang")
    groups = groups.select("*", (F.row_number().over(of_lang.orderBy("source")) - 1).alias("gid"), F.count("*").over(of_lang).alias("all_groups"), F.sum("size").over(of_lang).alias("all_size"))
    groups = materialize(groups, "term-groups")
    by_spread = counts.where("first").groupBy("lang", "groups").agg(F.count("*").alias("terms"))
    spread = groups.select("lang", "all_groups").distinct().join(by_spread, "lang")
    terms = spread.groupBy("lang").agg(F.sum("terms").alias("all_terms"), F.sum(F.when(_heavy(), F.col("terms")).otherwise(0)).alias("heavy"))
    groups = groups.join(terms, "lang", "left").fillna(0, ["all_terms", "heavy"])
    return counts, materialize(groups.withColumn("p0", F.when(F.col("all_terms") > 0, _share(F.lit(0), F.col("size") + F.col("all_terms")))), "term-groups")


def _heavy() -> Column:
    return (F.col("groups") > F.col("all_groups") * HEAVY_SHARE) | (F.col("groups") > LIGHT_GROUPS)


# ---- dense tiles, and light terms but for their pairs


def _floor_gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _tile(key: tuple, cells: pa.Table, groups: pa.Table) -> pa.Table:
    """lang, g, h, value: what the cells of one tile add to the pairs of its two blocks."""
    lang, a, b, bucket = (x.as_py() for x in key)
    own_block = dict(zip(groups["gid"].to_pylist(), groups["block"].to_pylist()))
    gid, p0 = groups["gid"].to_numpy(), groups["p0"].to_numpy()
    terms = groups["all_terms"][0].as_py() if bucket == 0 else 0
    order = np.argsort(gid)
    gid, p0 = gid[order], p0[order]
    of = np.searchsorted(gid, cells["gid"].to_numpy())
    p, weight = cells["p"].to_numpy(), cells["weight"].to_numpy()
    dense = np.asarray(cells["term"].is_valid())
    names = cells["term"].filter(pa.array(dense)).combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    grid = np.repeat(p0[:, None], len(names.dictionary), 1) if len(names) else np.zeros((len(gid), 0), np.int64)
    grid[of[dense], names.indices.to_numpy() if len(names) else []] = p[dense]
    absent = terms - grid.shape[1]  # all terms count as absent once, those of the grid no longer
    alone = [(p[~dense & (of == i)], weight[~dense & (of == i)]) for i in range(len(gid))] if (~dense).any() else None
    block = np.array([own_block[g] for g in gid.tolist()])
    out = []
    for one, other in {(a, b), (b, a)}:
        hs = np.flatnonzero(block == other)
        for g in np.flatnonzero(block == one).tolist():
            value = _floor_gap(grid[g], grid[hs]).sum(1)
            both_absent = _floor_gap(p0[g], p0[hs])
            value += absent * both_absent
            if alone:
                own, n = alone[g]
                value += ((_floor_gap(own, p0[hs][:, None]) - both_absent[:, None]) * n).sum(1)
                value += np.array([((_floor_gap(p0[g], alone[h][0]) - x) * alone[h][1]).sum() for h, x in zip(hs.tolist(), both_absent.tolist())], np.int64)
            on = hs != g
            out.append((np.full(on.sum(), gid[g]), gid[hs[on]], value[on]))
    g, h, value = (np.concatenate(x) for x in zip(*out))
    return pa.table({"lang": pa.repeat(lang, len(g)), "g": g.astype(np.int64), "h": h.astype(np.int64), "value": value.astype(np.int64)})


def _tiled(rows: DataFrame, buckets: Column, block: int) -> DataFrame:
    """Rows of groups, once for each tile that their block is part of."""
    last, own = F.floor((F.col("all_groups") - 1) / block).cast("int"), F.floor(F.col("gid") / block).cast("int")
    rows = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("*", F.least("other", own).alias("a"), F.greatest("other", own).alias("b"), F.explode(buckets).alias("bucket"))


def _tiles(cells: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    heavy = cells.where("is_heavy").select("lang", "gid", "all_groups", "heavy", "term", "p", F.lit(1).cast("long").alias("weight"))
    light = cells.where("NOT is_heavy").groupBy("lang", "gid", "all_groups", "heavy", F.lit(None).cast("string").alias("term"), "p").agg(F.count("*").alias("weight"))
    n = F.greatest(F.lit(1), F.ceil(F.col("heavy") / TILE_TERMS)).cast("int")
    # What histograms add is a sum over their rows, so these are spread over the tiles like terms.
    one = F.array(F.pmod(F.when(F.col("term").isNull(), F.xxhash64("gid", "p")).otherwise(F.xxhash64("term")), n).cast("int"))
    key = ["lang", "a", "b", "bucket"]
    left = _tiled(heavy.unionByName(light), one, block).select(*key, "gid", "term", "p", "weight").groupBy(*key)
    right = _tiled(groups.select("lang", "gid", "all_groups", "heavy", "all_terms", F.coalesce("p0", F.lit(1)).alias("p0")), F.sequence(F.lit(0), n - 1), block)
    right = right.select(*key, "gid", "block", "p0", "all_terms").groupBy(*key)
    return left.cogroup(right).applyInArrow(_tile, "lang string, g long, h long, value long")


# ---- light terms' pairs


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, g, h, value of rows of lang and postings, summed by pair of groups."""
    for b in batches:
        langs, postings = b.column(0).dictionary_encode(), b.column(1)
        sizes = np.diff(postings.offsets.to_numpy())
        flat = postings.flatten()
        gid, p, p0 = (flat.field(k).to_numpy() for k in range(3))
        row = np.repeat(np.arange(len(sizes)), sizes)
        begins, lang = np.cumsum(sizes) - sizes, langs.indices.to_numpy()[row]
        upto = np.cumsum(sizes[row])
        at = 0
        while at < len(row):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            n = sizes[row[at:end]]
            i = np.repeat(np.arange(at, end), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + begins[row[i]]
            i, j = i[gid[i] != gid[j]], j[gid[i] != gid[j]]
            value = _floor_gap(p[i], p[j]) - _floor_gap(p[i], p0[j]) - _floor_gap(p0[i], p[j]) + _floor_gap(p0[i], p0[j])
            order = np.lexsort((gid[j], gid[i], lang[i]))
            i, j, value = i[order], j[order], value[order]
            if len(i):
                new = np.flatnonzero(np.append(True, (lang[i][1:] != lang[i][:-1]) | (gid[i][1:] != gid[i][:-1]) | (gid[j][1:] != gid[j][:-1])))
                columns = [langs.dictionary.take(pa.array(lang[i[new]])), pa.array(gid[i[new]]), pa.array(gid[j[new]]), pa.array(np.add.reduceat(value, new))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "g", "h", "value"])
            at = end


def _in_both(cells: DataFrame) -> DataFrame:
    shared = cells.where("NOT is_heavy AND groups > 1").groupBy("lang", "term").agg(F.collect_list(F.struct(F.col("gid").cast("long").alias("gid"), "p", "p0")).alias("postings"))
    return shared.select("lang", "postings").mapInArrow(_corrections, "lang string, g long, h long, value long")


# ---- both parts


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: how far the source is from each
    other source of its language, over all terms in at least `least_docs` documents of the
    language. Part `term`: the `top` kept terms by which a source stands out of its language.

    Null lang, source and text count as empty; documents without terms make their group
    known; null ids, repeated ids and repeated rows are documents of their own; other columns, whatever
    their names, aren't looked at. Where a language keeps no term all its pairs are 0. Ties are
    ordered by the item's bytes. No rows give no rows.
    """
    counts, groups = kept_counts(docs, least_docs)
    known = groups.select("lang", "source", F.col("gid").cast("long").alias("gid"), "size", "all_groups", "all_size", "all_terms", "heavy", "p0")
    p = _share(F.col("n"), F.col("size") + F.col("all_terms"))
    q = _share(F.col("total"), F.col("all_size") + F.col("all_terms"))
    cells = counts.join(known, ["lang", "source"]).select("lang", "source", "term", "gid", "groups", "all_groups", "heavy", p.alias("p"), q.alias("q"), "p0", _heavy().alias("is_heavy"))
    cells = materialize(cells, "term-cells")

    order = lambda *by: W.partitionBy("lang", "source").orderBy(F.desc("value"), *by)
    terms = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order("item"))).where(F.col("rank") <= top)

    pairs = _tiles(cells, known, block).unionByName(_in_both(cells)).groupBy("lang", "g", "h").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    names = known.select("lang", F.col("gid").alias("g"), "source")
    pairs = pairs.join(names, ["lang", "g"]).join(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    pairs = pairs.select("lang", "source", "item", "value", F.row_number().over(order("item")).alias("rank"))
    parts = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, rows in (("pair", pairs), ("term", terms))]
    return parts[0].unionByName(parts[1])


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(s), 0) AS size FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS s FROM c GROUP BY lang, source) USING (lang, source) GROUP BY lang, source),
cell AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, 1 + CAST({SCALE} AS HUGEINT) * (coalesce(n, 0) + 1) // CAST(size + v AS HUGEINT) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
whole AS (SELECT lang, sum(n) AS size FROM c GROUP BY lang),
q AS (SELECT lang, term, 1 + CAST({SCALE} AS HUGEINT) * (sum(n) + 1) // CAST(any_value(whole.size) + any_value(v) AS HUGEINT) AS q FROM c JOIN whole USING (lang) JOIN v USING (lang) GROUP BY lang, term),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM cell JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM
  (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term))
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
