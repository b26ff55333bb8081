"""The read model: point lookups, indexes with defaults, adjacency and grouped lists.

Every function takes and returns DataFrames, for one key or for all keys at once; no key is
looked up by a loop. Missing keys give no row or the stated default, null keys never match,
and of duplicate keys the first in the given order counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexbolt.functions.text import number_key, roman_key
from lexbolt.operators.postings import BOUND, chunked


def lookup(rows: DataFrame, key: str, value: str, order: list, fold: bool = False) -> DataFrame:
    """The first row whose key is `value`; with `fold`, upper-cased (roman numerals). No row
    for a key that isn't there."""
    wanted = F.lit(value.upper() if fold and value is not None else value)
    return rows.where(F.col(key) == wanted).orderBy(*order).limit(1)


def of(rows: DataFrame, **keys) -> DataFrame:
    """The rows that have all of these values; a null value matches nothing."""
    for column, value in keys.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows


def listed(rows: DataFrame, by: list[str], order: list[Column], fields: list[str], name: str = "listed") -> DataFrame:
    """A row a group: its rows as an array of `fields`, in the given order. Ties beyond the
    order are broken by the fields themselves."""
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*fields).alias("row"))
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(key)), lambda s: s["row"]).alias(name))


def with_default(rows: DataFrame, index: DataFrame, key: list[str], column: str) -> DataFrame:
    """Every row with the index's array for its key, empty where it has none. An index in
    chunks gives a row a chunk."""
    found = rows.join(index.select(*key, *[c for c in ("chunk", "first") if c in index.columns], column), key, "left")
    return found.withColumn(column, F.coalesce(column, F.array().cast(index.schema[column].dataType)))


def with_title(rows: DataFrame, titles: DataFrame, key: str, column: str, default: str = "") -> DataFrame:
    """Every row with the title of its key; the default where there is none. Titles with
    one key: the smallest."""
    one = titles.groupBy(key).agg(F.min(column).alias(column))
    return rows.join(one, key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def exploded(rows: DataFrame, column: str, name: str) -> DataFrame:
    """A row for each element of an array, with the other columns of its parent; parents of
    empty or null arrays drop out."""
    return rows.select(*[c for c in rows.columns if c != column], F.explode(column).alias(name))


def literal_adjacency(spark: SparkSession, mapping: dict, key: str, ids: str, kind: str = "int") -> DataFrame:
    """key and ids of a fixed mapping (a literal of the program, so it is small); empty and null
    lists keep their key."""
    return spark.createDataFrame([(k, None if v is None else list(v)) for k, v in mapping.items()], f"{key} {kind}, {ids} array<{kind}>")


def edges_of(adjacency: DataFrame, key: str, ids: str, name: str) -> DataFrame:
    """A row for each id that a key lists; a key that lists none has one with null."""
    return adjacency.select(key, F.explode_outer(ids).alias(name))


def related(adjacency: DataFrame, key: str, ids: str, entities: DataFrame, number: str) -> DataFrame:
    """key and the columns of `entities` for each of the array `ids` whose number (as text)
    an entity has; others drop out. An id that is listed twice comes twice."""
    edges = exploded(adjacency.select(key, ids), ids, "__id").withColumn("__id", F.col("__id").cast("string"))
    return edges.join(entities, F.col("__id") == F.col(number)).drop("__id")


def inverted(adjacency: DataFrame, key: str, ids: str, name: str = "keys", bound: int = BOUND) -> DataFrame:
    """id, chunk, first, and the keys that list it, sorted by leading number, then as text,
    without repeats, in chunks of at most `bound`."""
    edges = exploded(adjacency.select(key, ids), ids, "id").withColumn("id", F.col("id").cast("string")).distinct()
    chunks = chunked(edges, ["id"], [number_key(F.col(key).cast("string")), F.col(key).cast("string")], [key], name, bound)
    return chunks.select("id", "chunk", "first", F.col(f"{name}.{key}").alias(name))


def joined_lists(rows: DataFrame, docs: DataFrame, key: str, by: list[str], order: list[Column], fields: list[str], name: str, bound: int = BOUND) -> DataFrame:
    """Rows whose key a document has, ordered lists by group in chunks of at most `bound`;
    dangling ones drop."""
    return chunked(rows.join(docs.select(key).distinct(), key, "left_semi"), by, order, fields, name, bound)


def sorted_sets(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """The distinct values of a group, by leading number, then as text."""
    text = F.col(column).cast("string")
    return listed(rows.select(*by, column).distinct().where(F.col(column).isNotNull()), by, [number_key(text), text], [column], column).select(*by, F.col(f"{column}.{column}").alias(column))


def presence(rows: DataFrame, by: list[str], **tests: Column) -> DataFrame:
    """For each group and test whether some row passes it."""
    return rows.groupBy(*by).agg(*[F.coalesce(F.bool_or(t), F.lit(False)).alias(n) for n, t in tests.items()])


def states(wanted: DataFrame, snapshots: DataFrame, gaps: DataFrame, key: list[str]) -> DataFrame:
    """Every key with its state: snapshot where there is one, else gap where that is known,
    else neither."""
    have = snapshots.select(*key).distinct().withColumn("__s", F.lit(True))
    lack = gaps.select(*key).distinct().withColumn("__g", F.lit(True))
    state = F.when(F.col("__s").isNotNull(), "snapshot").when(F.col("__g").isNotNull(), "gap").otherwise("neither")
    return wanted.join(have, key, "left").join(lack, key, "left").withColumn("state", state).drop("__s", "__g")


def chapters(articles: DataFrame, number: str, chapter: str, fields: list[str]) -> DataFrame:
    """A row a chapter: the fields of its first article by number, its numbers in order, how
    many they are and their range as a label."""
    first = F.struct(number_key(F.col(number)).alias("n"), F.col(number).alias("t"))
    out = articles.groupBy(chapter).agg(
        *[F.min_by(f, first).alias(f) for f in fields], F.transform(F.array_sort(F.collect_list(first)), lambda s: s["t"]).alias("numbers"), F.count("*").alias("n"),
        F.min_by(number, first).alias("__low"), F.max_by(number, first).alias("__high"),
    )
    label = F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(F.concat("__low", F.lit("–"), "__high"))
    return out.withColumn("label", label).drop("__low", "__high")


def other_versions(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """For each key and version the other versions that have the key: one shuffle on the
    key, in place of a self-join."""
    have = rows.groupBy(*key).agg(F.array_sort(F.collect_set(version)).alias("__all"))
    return have.select(*key, F.explode("__all").alias(version), "__all").withColumn("others", F.array_remove("__all", F.col(version))).drop("__all")


def shared_keys(rows: DataFrame, key: str) -> DataFrame:
    """key, n: how many rows have it, for keys of more than one."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def siblings(rows: DataFrame, key: str, own: str, order: list[Column], bound: int = BOUND) -> DataFrame:
    """key, own, chunk, siblings: each row with the other rows that have its key, by `own`
    (which tells rows of a key apart), in the given order and in chunks of at most `bound`.
    Rows alone with their key, and null keys, have no rows here."""
    kept = rows.where(F.col(key).isNotNull()).select(key, own, *[o.alias(f"__by{i}") for i, o in enumerate(order)])
    chunks = chunked(kept, [key], [F.col(f"__by{i}") for i in range(len(order))], [own], "siblings", bound)
    others = kept.select(key, own).join(chunks.select(key, "chunk", F.col(f"siblings.{own}").alias("siblings")), key)
    others = others.withColumn("siblings", F.filter("siblings", lambda x: x != F.col(own)))
    return others.where(F.size("siblings") > 0)


def without_reverse(edges: DataFrame, s: str, t: str) -> DataFrame:
    """s, t of distinct edges whose reverse isn't one."""
    pairs = edges.select(F.col(s).alias("s"), F.col(t).alias("t")).distinct()
    return pairs.join(pairs.select(F.col("s").alias("t"), F.col("t").alias("s")), ["s", "t"], "left_anti")


def divergence(left: DataFrame, right: DataFrame, key: str, column: str, most: int | None = None) -> DataFrame:
    """key, left, right: sizes that differ between two sides, the largest difference first."""
    both = left.select(key, F.col(column).alias("left")).join(right.select(key, F.col(column).alias("right")), key).where(F.col("left") != F.col("right"))
    both = both.orderBy(F.abs(F.col("left") - F.col("right")).desc(), key)
    return both if most is None else both.limit(most)


def differing(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field, left, right: fields of matched keys that differ as text, null being one
    value."""
    text = lambda side: F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{side}.{c}").cast("string").alias("value")) for c in columns])
    both = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"))
    pairs = both.select(F.col(f"l.{key}").alias(key), F.explode(F.arrays_zip(text("l").alias("l"), text("r").alias("r"))).alias("p"))
    out = pairs.select(key, F.col("p.l.field").alias("field"), F.col("p.l.value").alias("left"), F.col("p.r.value").alias("right"))
    return out.where(~F.col("left").eqNullSafe(F.col("right")))


def newest_first(date: Column, key: Column) -> list[Column]:
    """ISO dates without hyphens, descending; no date comes last; then by key."""
    return [F.replace(F.coalesce(date, F.lit("")), F.lit("-"), F.lit("")).desc(), key.asc()]


def stage_order(stage: Column, order: dict[str, int], kind: Column, kinds: list[str], number: Column) -> list[Column]:
    """Stages in their order, kinds in theirs, numbers by value (roman for annexes), then as text."""
    place = lambda c, known, rest: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), c), F.lit(rest))
    value = F.when(kind == "annexes", roman_key(number)).otherwise(number_key(number))
    return [place(stage, order, 99), place(kind, {k: i for i, k in enumerate(kinds)}, 99), value, number]


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same at every run: by a digest of key and seed."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def heads(rows: DataFrame, by: list[str], order: list[Column], fields: list[str], n: int, name: str = "head") -> DataFrame:
    """The first n rows of each group as an array. A limit by group stands before the shuffle,
    so a group never meets in a task but for n rows of each task. Ties beyond the order are
    broken by the fields."""
    w = W.partitionBy(*by).orderBy(*order, F.struct(*fields))
    first = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    return listed(first, by, [F.col("__n")], fields, name)


def line_spans(docs: DataFrame, key: str, text: str, marker: str) -> DataFrame:
    """key, n, start, end: from each marker (a regular expression) to the next, in
    characters from 0; the last reaches to the end of the text. What stands before the first
    marker is no span."""
    parts = F.filter(F.split(text, rf"(?={marker})"), lambda p: p != "")
    pieces = docs.select(key, F.posexplode(parts).alias("i", "p")).withColumn("length", F.length("p"))
    w = W.partitionBy(key).orderBy("i")
    pieces = pieces.withColumn("end", F.sum("length").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("long"))
    spans = pieces.where(F.col("p").rlike(f"^(?:{marker})")).withColumn("start", F.col("end") - F.col("length"))
    return spans.select(key, (F.row_number().over(w) - 1).alias("n"), "start", "end")


def token_index(docs: DataFrame, key: str, text: str, separator: str = r"[\s\-]+") -> DataFrame:
    """token, n_docs, n: a full-text index's terms: lower-cased, split at the separator."""
    tokens = docs.select(key, F.explode(F.split(F.lower(text), separator)).alias("token")).where("token <> ''")
    pairs = tokens.groupBy("token", key).agg(F.count("*").alias("n"))
    return pairs.groupBy("token").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))


def search(docs: DataFrame, key: str, text: str, words: list[str], separator: str = r"[\s\-]+") -> DataFrame:
    """key, hits: documents that have all the words, with how often they have them. `words`
    are a fixed, short list."""
    wanted = sorted({w.lower() for w in words})
    tokens = docs.select(key, F.explode(F.split(F.lower(text), separator)).alias("token")).where(F.col("token").isin(wanted))
    return tokens.groupBy(key).agg(F.count("*").alias("hits"), F.countDistinct("token").alias("n")).where(F.col("n") == len(wanted)).drop("n")
