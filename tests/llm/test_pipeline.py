"""Columns of any name pass through operators and pipeline; the pipeline on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexbolt.llm import exact_dedup, licenses, mixing, packing, quality, simhash, sketches, tokens, toxicity, warc
from lexbolt.llm.common import materialize

EXTRA = ["words", "of", "chars", "mean", "most", "least", "kept", "toxic", "severity", "held", "threshold", "row", "node", "size", "block", "key", "sid", "draws", "perplexity"]


def extended(df):
    return df.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col(df.columns[0]).cast("string"), F.lit("none"))).alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(31)
    vocab = ["".join(rng.choices("aeioutnsr", k=rng.randint(2, 6))) for _ in range(300)]
    text = lambda k: " ".join(rng.choices(vocab, k=k))
    rows = [(i, text(rng.randint(30, 120)), "en", f"s{i % 3}") for i in range(240)]
    rows += [(300 + i, rows[i][1], "en", "s1") for i in range(10)]  # copies
    rows += [(400 + i, rows[20 + i][1] + " end", "en", "s2") for i in range(10)]  # near copies
    rows += [(500, None, None, None), (501, "", "en", "s1"), (502, " \n", None, "s1"), (None, text(50), "en", None), (503, text(20000), "en", "s0"), (504, "%% ## " * 400, "en", "s0")]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_extra_columns_stay(spark, tables):
    docs, labels = tables
    more = materialize(extended(docs).repartition(3), "more")
    whole = {tuple(r) for r in more.collect()}
    for out in (quality.keep(more, labels), exact_dedup.drop_copies(more), simhash.drop_near_copies(more), mixing.mix(more)):
        assert out.columns == more.columns and {tuple(r) for r in out.collect()} <= whole and out.count()
    for out, new in ((quality.classify(more, labels), quality.NEW), (toxicity.score(more, toxicity.train(more, labels)), toxicity.NEW)):
        own = [c for c in more.columns if c not in new]
        assert out.columns == own + list(new) and out.count() == more.count()
        assert {tuple(r) for r in out.select(*own).collect()} == {tuple(r) for r in more.select(*own).collect()}
    plain = lambda f: sorted(map(str, f(docs).drop("sequence", "shards", "shard", "segment", "place", "offset", "capacity").collect()))
    same = lambda f: sorted(map(str, f(more).drop("sequence", "shards", "shard", "segment", "place", "offset", "capacity").collect()))
    for f in (exact_dedup.exact_groups, simhash.near_groups, mixing.mix_plan, sketches.edited_pairs, tokens.token_index, licenses.scan, packing.pack_documents):
        assert plain(f) == same(f)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert sorted(map(str, warc.archive(pages).collect())) == sorted(map(str, warc.archive(extended(pages)).collect()))


def run(spark, folder, docs, labels):
    docs.repartition(2).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_pipeline_end_to_end(spark, tables, tmp_path):
    docs, labels = tables
    stages, seen = [n for n, _ in corpus_pipeline.STAGES], {}
    packed = run(spark, tmp_path, extended(docs), labels).collect()
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        frame = materialize(stage(spark, frame, str(tmp_path)), "stage")
        assert frame.columns == [*docs.columns, *EXTRA]
        seen[name] = [r.doc_id for r in frame.select("doc_id").collect()]
    assert not {500, 501, 502, 504} & {*seen[stages[0]]} and {*range(200)} <= {*seen[stages[0]]}
    assert len(seen[stages[1]]) == len({*seen[stages[0]]}) - 10 and not {*range(300, 310)} & {*seen[stages[1]]}
    assert not {*range(400, 410)} & {*seen[stages[2]]} and {*range(240)} <= {*seen[stages[2]]}
    assert max(map(seen[stages[3]].count, {*seen[stages[3]]})) <= 2
    assert sorted(str(r.doc_id) for r in packed if r.piece == 0) == sorted(map(str, seen[stages[3]]))


def test_pipeline_of_nothing(spark, tables, tmp_path):
    docs, labels = tables
    assert run(spark, tmp_path / "a", docs.limit(0), labels).count() == 0
    assert run(spark, tmp_path / "b", docs, labels.limit(0)).count() > 0


def test_near_dedup_asks_for_one_python_worker_a_task(spark, tables, monkeypatch):
    """Workers stay with an executor, each with what it remembers, so a second Python step in
    a task costs memory in every later stage."""
    plans, store = {}, simhash.materialize

    def recorded(df, name):
        plans[name] = df._jdf.queryExecution().toString()
        return store(df, name)

    monkeypatch.setattr(simhash, "materialize", recorded)
    out = simhash.drop_near_copies(tables[0])
    assert "MapInArrow" in plans["shingle-sets"] and not [n for n, p in plans.items() if "EvalPython" in p]
    assert "EvalPython" not in out._jdf.queryExecution().toString()
