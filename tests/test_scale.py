"""Operators that bound what a task holds: held against plain forms of the same, with bounds so
small that they act."""

import glob
import math
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexbolt.operators import crawl, guidance, integrity, lookups, postings, relations, search, sections, segments, tags
from lexbolt.sources import readers, stores, writers


@pytest.fixture(scope="module")
def hot(spark):
    """A key with half of the rows, a null key, ties and repeated rows."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 3 + ["a", "b", None]), rng.randint(0, 400), rng.choice("xyz")) for _ in range(3000)]
    return rows, spark.createDataFrame(rows + rows[:50], "k string, n int, v string").repartition(5)


def test_chunks_hold_all_in_order(spark, hot):
    rows, frame = hot
    want = defaultdict(list)
    for k, n, v in rows + rows[:50]:
        want[k].append((n, v))
    got = defaultdict(list)
    for r in postings.chunked(frame, ["k"], [F.col("n")], ["n", "v"], bound=64).orderBy("k", "chunk").collect():
        assert len(r.entries) <= 64 and r["first"] == len(got[r.k])
        got[r.k] += [tuple(e) for e in r.entries]
    assert {k: sorted(v) for k, v in want.items()} == got
    chunks = postings.chunked(frame, ["k"], [F.col("n")], ["n", "v"], bound=64)
    assert {r.k: r.n for r in postings.extent(chunks, ["k"]).collect()} == {k: len(v) for k, v in want.items()}
    wanted = spark.createDataFrame([("hot", 0), ("hot", 700), ("a", 10**6)], "k string, at long")
    assert {r.at: tuple(r.entry) for r in postings.entries_at(chunks, wanted, ["k"]).collect()} == {i: sorted(want["hot"])[i] for i in (0, 700)}
    assert postings.chunked(frame.limit(0), ["k"], [F.col("n")], ["n"]).collect() == []


def test_chunks_are_cut_where_rows_are_sorted(hot):
    _, frame = hot
    plan = lambda rows, keep: postings.chunked(rows, ["k"], [F.col("n")], ["n"], bound=8, keep=keep)._jdf.queryExecution().toString()
    assert "collect_list" not in plan(frame, False)  # rows aren't grouped, so not shuffled again
    made = frame.withColumn("made", F.sha2("v", 256)).drop("v")
    assert "sha2" in plan(made, False) and "sha2" not in plan(made, True)  # what made the rows isn't done again for ranges


def test_bitmaps_are_sets(spark, hot):
    rows, frame = hot
    big = frame.withColumn("n", F.col("n").cast("long") * 1000 - 5)
    want = defaultdict(set)
    for k, n, _ in rows:
        if n:
            want[k].add(n * 1000 - 5)
    sets = postings.bitmaps(big, ["k"], "n")
    got = defaultdict(list)
    for r in postings.members(sets, ["k"], "ns").orderBy("k", "bucket").collect():
        got[r.k] += r.ns
    assert got == {k: sorted(v) for k, v in want.items()}
    assert {r.k: r.n for r in postings.sizes(sets, ["k"]).collect()} == {k: len(v) for k, v in want.items()}
    whole = postings.members(postings.union_of(sets, []), [], "ns").orderBy("bucket").collect()
    assert [n for r in whole for n in r.ns] == sorted(set().union(*want.values()))


def test_segmented_state_is_that_of_one_window(hot):
    _, frame = hot
    rows = frame.select("k", F.monotonically_increasing_id().alias("at"), "v", "n")
    marks = {"x": (F.col("v") == "x", F.col("n")), "odd": (F.col("n") % 2 == 1, F.col("at"))}
    plain = segments.last_markers(rows, ["k"], ["at"], marks)
    cut = segments.last_markers(rows, ["k"], ["at"], marks, bound=100, segment=16)
    assert Counter(map(tuple, plain.collect())) == Counter(map(tuple, cut.select(plain.columns).collect())) and cut.count() == 3050
    probe = lambda bound: relations.asof_backward(rows, F.col("v") == "x", F.col("v") == "y", "k", ["at"], "n", bound)
    assert Counter(map(tuple, probe(10**9).collect())) == Counter(map(tuple, probe(10).collect()))
    nested = lambda bound: relations.nested_context(rows, ["k"], ["at"], F.col("v") == "x", F.col("v") == "y", F.col("n"), bound)
    assert Counter(map(tuple, nested(10**9).collect())) == Counter(map(tuple, nested(10).collect()))
    assert segments.is_hot(rows, ["k"], 1000) and not segments.is_hot(rows.limit(0), ["k"], 0)


def test_heads_are_limited_before_the_shuffle(hot):
    rows, frame = hot
    out = lookups.heads(frame, ["k"], [F.desc("n")], ["n", "v"], 3)
    want = defaultdict(list)
    for k, n, v in rows + rows[:50]:
        want[k].append((-n, v))
    assert {r.k: [(-e.n, e.v) for e in r["head"]] for r in out.collect()} == {k: sorted(v)[:3] for k, v in want.items()}
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()


def test_siblings_come_in_chunks(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), (None, 5), (None, 6)] + [("c", i) for i in range(10, 40)], "k string, i int")
    got = defaultdict(list)
    for r in lookups.siblings(rows, "k", "i", [F.col("i")], bound=7).orderBy("k", "i", "chunk").collect():
        assert len(r.siblings) <= 7
        got[r.k, r.i] += r.siblings
    assert got["a", 2] == [1, 3] and got["c", 12] == [i for i in range(10, 40) if i != 12] and {k for k, _ in got} == {"a", "c"}


# ---- search


@pytest.mark.parametrize("block, first", [(4, 1), (7, 3), (256, 4)])
def test_ranked_search_is_that_of_all_documents(spark, tmp_path, block, first):
    rng = random.Random(block)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(40)], k=rng.randint(0, 60))) for _ in range(200)] + [None, "", "W1-w2  w3", "w39 " * 50]
    docs = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts)], "id int, text string")
    search.write_index(docs, "id", "text", str(tmp_path / "i"), block_docs=block, shards=5)
    queries = {"one": ["w0"], "two": ["W1", "w30", "w30"], "rare": ["w38", "w39"], "none": ["zzz"]}
    got = search.ranked(spark, str(tmp_path / "i"), queries, k=10, first_blocks=first).collect()

    counts = [Counter(w for w in (t or "").lower().replace("-", " ").split()) for t in texts]
    mean = sum(c.total() for c in counts) / len(counts)
    for q, asked in queries.items():
        scores = []
        for i, c in enumerate(counts):
            s = 0.0
            for w in {w.lower() for w in asked} & c.keys():
                have = sum(w in o for o in counts)
                s += math.log(1 + (len(counts) - have + 0.5) / (have + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean))
            if s:
                scores.append(round(s, 6))
        mine = sorted((r["rank"], r.score) for r in got if r["query"] == q)
        assert [r for r, _ in mine] == list(range(1, len(mine) + 1))
        assert [s for _, s in mine] == pytest.approx(sorted(scores, reverse=True)[:10], abs=2e-6)


def test_index_tasks_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "TASK_WORDS", 100)
    docs = spark.range(300).selectExpr("id", "concat('a b t', id) AS text")
    search.write_index(docs, "id", "text", str(tmp_path / "i"), shards=2)
    files = glob.glob(str(tmp_path / "i/postings/*/part-*"))
    assert len({f.split("part-")[1][:5] for f in files}) > 4  # more tasks than the session has partitions
    assert [r.key for r in search.ranked(spark, str(tmp_path / "i"), {"q": ["t7"]}).collect()] == [7]


def test_words_are_not_shuffled(spark, tmp_path):
    docs = spark.range(2000).selectExpr("'k' || id AS id", "repeat('some words that come again and again ', 40) || id AS text").coalesce(2)
    search.write_index(docs, "id", "text", str(tmp_path / "i"), shards=2)
    lists = spark.read.parquet(str(tmp_path / "i/postings")).where(F.col("shard") == search.LISTS)
    assert lists.selectExpr("sum(n)", "sum(size(keys))", "max(n)").first() == (2000, 2000, 256)
    postings = spark.read.parquet(str(tmp_path / "i/postings")).where("term = 'again'")
    assert postings.count() == lists.count() and postings.selectExpr("sum(n)", "max(most)").first() == (2000, 80)
    sizes = sum(os.path.getsize(f) for f in glob.glob(str(tmp_path / "i/postings/*/*.parquet")))
    assert sizes < docs.selectExpr("sum(length(text))").first()[0] / 4


def test_search_reads_its_terms_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common t{i}") for i in range(300)], "id int, text string")
    search.write_index(docs, "id", "text", str(tmp_path / "i"), shards=16)
    out = search.ranked(spark, str(tmp_path / "i"), {"q": ["t7"]})
    assert [r.key for r in out.collect()] == [7] and out.select("score").first().score > 0
    plan = out._jdf.queryExecution().toString()
    assert any("shard" in x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:])


# ---- reachability


def test_distances_and_ends(spark):
    page = lambda i, *to: (f"http://s/p{i}", "".join(f'<a href="/p{t}">x</a>' for t in to))
    pages = spark.createDataFrame([page(0, 1, 2), page(1, 0, 3), page(2, 3, 77), page(3, 1, 3), page(4, 0), ("http://s/null", None)], "url string, html string")
    got = {r.url: (r.distance, r.state) for r in crawl.crawled(pages, ["/p0"]).collect()}
    assert got == {"http://s/p0": (0, "reached"), "http://s/p1": (1, "reached"), "http://s/p2": (1, "reached"), "http://s/p3": (2, "reached"), "http://s/p4": (None, "unreachable"), "http://s/null": (None, "unreachable"), "/p77": (2, "missing")}
    assert {r.url for r in crawl.crawled(pages, ["/p0"], most=1).collect() if r.state == "reached"} == {"http://s/p0", "http://s/p1", "http://s/p2"}
    assert {r.state for r in crawl.crawled(pages, ["/elsewhere"]).collect()} == {"unreachable"}
    assert crawl.crawled(pages.limit(0), ["/p0"]).collect() == []


# ---- markers, tags, suites


def test_markers_by_automaton(spark):
    rng = random.Random(1)
    text = "".join(rng.choices("abc", k=3000))
    markers = sorted({"".join(rng.choices("abcd", k=rng.randint(1, 6))) for _ in range(300)})
    assert integrity.contained(markers, text) == [m for m in markers if m in text]
    assert integrity.contained(["", *markers], "") == [""]
    pages = spark.createDataFrame([(1, text), (1, "zz"), (2, None)], "page int, body string")
    index = spark.createDataFrame([(1, m) for m in markers] + [(1, "zz"), (2, "a"), (3, "a"), (1, None), (None, "a"), (2, "a")], "page int, marker string")
    lost = Counter((r.page, r.marker) for r in integrity.without_marker(index, pages, "page", "marker", "body").collect())
    assert lost == Counter([(1, m) for m in markers if m not in text] + [(2, "a"), (2, "a"), (3, "a"), (1, None), (None, "a")])
    twice = integrity.without_marker(index, pages, "page", "marker", "body")._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in twice


def test_tags_in_order(spark):
    docs = spark.createDataFrame([(1, "<h1>A</h1>x<p>one</p><p>two</p><h1>B</h1><li>i<h1>C</h1><p></p>"), (2, None), (3, "plain")], "d int, html string")
    rows = tags.tag_rows(docs, "d", "html")
    assert [(r.heading, r.after, r["items"]) for r in tags.next_after(rows, "d", "h1", "p", "li").orderBy("heading").collect()] == [("A", "one", 1), ("B", None, 1), ("C", None, 1)]
    deep = spark.createDataFrame([(1, "<ul><ul></ul><ul>")], "d int, html string")
    assert [r.depth for r in tags.depths(tags.tag_rows(deep, "d", "html"), "d", ["ul"]).orderBy("pos").collect()] == [1, 2, 1, 2]


def test_counts_by_shared_key(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (None, "x")], "i int, v string")
    b = spark.createDataFrame([(1,), (3,), (None,)], "j int")
    row = relations.key_counts({"a": (a, "i"), "b": (b, "j")}, {"xs": ("a", F.col("v") == "x")}).first()
    assert (row.n_a, row.n_b, row.dup_a, row.dup_b, row.lost_a, row.lost_b, row.xs) == (4, 3, 1, 0, 2, 2, 3)
    out = relations.measured(spark.range(1).selectExpr("2 AS p", "0 AS q", "cast(null AS int) AS r"), {"one": "p", "two": "q", "three": "r"}, soft=("one",))
    assert [tuple(r) for r in out.collect()] == [("one", "SOFT", 2), ("two", "PASS", 0), ("three", "PASS", 0)]


# ---- stores and readers


def test_a_failed_refresh_leaves_the_old_version(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        stores.published(spark, folder)
    stores.publish(spark.range(5), folder)
    bad = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("no")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="no"):
        stores.publish(bad, folder)
    assert stores.published(spark, folder).count() == 5
    reader = stores.published(spark, folder)
    stores.publish(spark.range(7), folder)
    assert reader.count() == 5 and stores.published(spark, folder).count() == 7  # who began before sees the old one whole
    assert len(stores.forget_old(spark, folder)) == 2 and stores.published(spark, folder).count() == 7


def test_unchanged_buckets_keep_their_files(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    names = lambda: {p for p in (tmp_path / "t").rglob("*.parquet")}
    rows = spark.range(500).select(F.col("id"), F.concat(F.lit("t"), "id").alias("text"))
    assert stores.publish_changed(rows, folder, "id", 8) == list(range(8))
    before = names()
    assert stores.publish_changed(rows.repartition(3), folder, "id", 8) == [] and names() == before
    later = rows.withColumn("text", F.when(F.col("id") == 9, None).otherwise(F.col("text")))
    assert len(stores.publish_changed(later, folder, "id", 8)) == 1 and len(names() - before) == 1
    assert stores.published(spark, folder).where("text IS NULL").count() == 1 and stores.published(spark, folder).count() == 500
    changes = spark.createDataFrame([(9, "nine"), (1000, "new")], "id long, text string")
    assert len(stores.patch(spark, folder, "id", changes)) in (1, 2)
    before = names()
    assert stores.patch(spark, folder, "id", changes) == [] and names() == before
    assert {r.text for r in stores.published(spark, folder).where("id IN (9, 1000)").collect()} == {"nine", "new"}
    with pytest.raises(Exception):
        stores.patch(spark, folder, "id", changes.withColumn("text", F.raise_error(F.lit("no"))))
    assert stores.published(spark, folder).count() == 501
    assert stores.publish_changed(rows.limit(0), folder, "id", 8) and stores.published(spark, folder).count() == 0


def test_bad_files_are_rejects(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"number": "1", "m": {"a": "b"}}')
    (tmp_path / "2.json").write_text('{"number": ')
    (tmp_path / "3.json").write_text('{"number": "3", "m": [1]}')
    shape = "number string, m map<string,string>"
    assert [r.number for r in readers.json_entities(spark, str(tmp_path / "*.json"), shape).collect()] == ["1"]
    bad = readers.json_rejects(spark, str(tmp_path / "*.json"), shape)
    assert {(r.file[-6:], r.text) for r in bad.collect()} == {("2.json", '{"number": '), ("3.json", '{"number": "3", "m": [1]}')} and bad.count() == 2


def test_small_sources_are_spread(spark):
    assert readers.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_small_files_are_written_by_all_cores(spark, tmp_path):
    rows = spark.range(40).coalesce(1).selectExpr("string(id) AS number", "'t' || id AS value")
    writers.many_files(rows.select("value"), str(tmp_path / "flat"))
    writers.many_files(rows, str(tmp_path / "folders"), "number")
    for at in ("flat/part-*", "folders/number=*/part-*"):
        files = glob.glob(str(tmp_path / at))
        assert len(files) == 40 and len({f.split("part-")[1][:5] for f in files}) == 4
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    read = readers.whole_texts(spark, str(tmp_path / "folders"), "*.txt").collect()
    assert sorted(r.text.rstrip("\u0003") for r in read) == sorted(f"t{i}" for i in range(40)) and spark.conf.get(name) == before
    entities = readers.json_entities(spark, f"{tmp_path}/flat/*.txt", "a int")
    assert entities.collect() == [] and len(entities._jdf.inputFiles()) == 40


def test_partitions_grow_in_number(spark):
    dealt = readers.by_keys(spark.range(5000).selectExpr("id % 700 AS doc", "id"), "doc", task_rows=500)
    assert dealt.rdd.getNumPartitions() == 10 and max(dealt.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 1500
    assert dealt.groupBy("doc").count().count() == 700


def test_lines_of_guides_are_dealt_once_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(sections, "by_keys", lambda rows, *keys: readers.by_keys(rows, *keys, task_rows=50))
    lines = spark.range(1200).selectExpr("string(id % 60) AS doc", "1 AS page", "id AS line_no", "'Text ' || id AS line")
    found = sections.sections(lines)
    assert found.rdd.getNumPartitions() == 24 and found.count() == 60


def test_guides_are_dealt_and_sorted_once(spark):
    texts = ["Step 1. Is it in", "scope?", "A text.", "1.1. Systems on page 3", "1 A note", " goes on ", "1.2. Real heading", "Body", "Apples a day is text", "2 Next", "1 First again", "301 none", "Guide | Step 1  1", ""]
    rng = random.Random(5)
    rows = [(f"d{d}", page, at, rng.choice(texts)) for d in range(150) for page in (1, 2) for at in range(rng.randint(0, 9))]
    lines = spark.createDataFrame(rows, "doc string, page int, line_no int, line string")
    both = sections.guide_markdown(sections.sections(lines), sections.footnotes(lines))
    once = sections.guides(lines)
    assert Counter(map(tuple, once.collect())) == Counter(map(tuple, both.collect())) and once.count() > 100
    plan = once._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("LocalTableScan") + plan.count("Scan ExistingRDD") == 1 and "Join" not in plan
    assert "try_cast" not in plan  # a failed cast is an exception a line


def test_candidates_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(guidance, "by_keys", lambda rows, *keys: readers.by_keys(rows, *keys, task_rows=20))
    chunks = spark.range(100).selectExpr("id", "'nl' AS lang", "'Articles 5, 6 and 7' AS text")
    found = guidance.cited(chunks, ["id"])
    assert found.rdd.getNumPartitions() > 4 and found.count() == 300
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
