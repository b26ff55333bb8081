"""Every query against its SQL; grammars, templates, readers and writers on small fixtures."""

import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lexbolt.functions import structure as T
from lexbolt.functions import text as X
from lexbolt.operators import citations as C
from lexbolt.operators import guidance as G
from lexbolt.operators import integrity as I
from lexbolt.operators import linker as L
from lexbolt.operators import lookups as U
from lexbolt.operators import relations as R
from lexbolt.operators import sections as S
from lexbolt.plans.registry import QUERIES, SQL
from lexbolt.sources import history as H
from lexbolt.sources import markup as M
from lexbolt.sources import readers, writers

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    df = QUERIES[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert sorted(df.columns) == sorted(names) and got == want and want


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


# ---- references


def found(text, *fields):
    return [tuple(r.get(f) for f in fields) for r in C.references_in(text)]


def test_pin_cites_and_lists():
    pin = lambda t: found(t, "target", "paragraph", "letter", "subparagraph")
    assert pin("Article 6(a)") == [("6", None, None, None)]  # a letter needs its paragraph
    assert pin("Article 5 (1) (a)(ii)") == [("5", "1", "a", "ii")]
    assert [x[0] for x in pin("Articles 5, 7, and 9")] == ["5", "7"]  # one separator a step
    assert pin("Article 3(5), (6)") == [("3", "5", None, None)]
    assert [x[0] for x in pin("Articles 3 TO 5")] == ["3", "4", "5"]
    assert pin("Articles 3(1) to 5(2)") == [("3", "1", None, None), ("4", None, None, None), ("5", None, None, None)]
    assert [x[0] for x in pin("Articles 1 to 51")] == [str(n) for n in range(1, 52)]
    assert [x[0] for x in pin("Articles 1 to 80")] == ["1"] and [x[0] for x in pin("Articles 9–8")] == ["9", "8"]
    assert [x[0] for x in pin("Annexes I to III and V(2)(a)")] == ["I", "III", "V"]
    assert C.references_in(None) == [] and C.references_in("Article on law") == []


def test_qualifiers():
    kind = lambda t: found(t, "kind", "target_kind", "target", "celex", "short_name")
    assert kind("Article 5 of Regulation (EU) 2024/1689") == [("internal", "article", "5", None, None)]
    assert kind("Article 5 OF THIS REGULATION") == [("internal", "article", "5", None, None)]
    assert kind("Article 22 of the GDPR") == kind("Article 22 under gdpr") == [("external_gdpr", "article", "22", "32016R0679", "GDPR")]
    assert kind("Article 6 GDPR") == [("external_gdpr", "article", "6", "32016R0679", "GDPR")]
    assert kind("Article 6 gdpr")[0] == ("internal", "article", "6", None, None)  # bare names only as they are spelled
    assert kind("Article 2 of Directive (EU) 2019/790") == [("external_other", "article", "2", "32019L0790", None)]
    assert kind("Article 9 of Regulation(EU) 2016/679")[0][:4] == ("external_gdpr", "article", "9", "32016R0679")
    assert found("Article 5 of Regulation (EU) No. 1025 / 2012", "official_name", "raw") == [("Regulation (EU) No 1025/2012", "Article 5 of Regulation (EU) No. 1025 / 2012")]
    assert kind("the NIS2 Directive and Regulation (EU) 2024/1689") == [("external_other", "instrument", None, "32022L2555", "NIS2 Directive")]
    assert [k[1] for k in kind("Article 6 of the GDPR; the GDPR")] == ["article", "instrument"]
    # A name that encloses what is known isn't hidden by it.
    assert C._touches((0, 10), [(2, 5)]) is False and C._touches((2, 5), [(0, 10)]) and C._touches((4, 12), [(0, 5)])


def test_parts_of_texts_that_recur_are_read_once():
    C._remembered.cache_clear()
    said = [C.found_references(f"In case {i}: Article 5 of the GDPR, Annex II and Articles 1 to 3 DSA") for i in range(50)]
    assert all(r == said[0] for r in said) and len(said[0]) == 5
    assert C._remembered.cache_info().misses == 53
    # In parts as in one piece: heads inside words, names and ranks over several parts.
    assert [r[0] for r in C.found_references("DSA, Article 5 and xArticle 6; the  GDPR, Annex I of DORA. Directive 2014/5/EU")] == ["Article 5", "Annex I", "Directive 2014/5/EU", "the  GDPR", "DORA", "DSA"]


def test_reference_rows(spark):
    chunks = spark.createDataFrame([("5", "Article 5 and Article 6 of this Regulation"), ("4a", "Article 5"), ("III", None), ("7", "no law")], "source string, text string")
    refs = C.references(chunks).collect()
    assert sorted((r.source, r.target) for r in refs) == [("4a", "5"), ("5", "6")]
    index = {r.target: [x.source for x in r.refs] for r in C.reverse_index(C.references(chunks)).collect() if r.chunk == r["first"] == 0}
    assert index == {"5": ["4a"], "6": ["5"]}
    broken = C.found_in(chunks, lambda t: 1 / 0, ["raw"], "Article").collect()
    assert len(broken) == 2 and all("ZeroDivision" in r.error for r in broken)
    assert C.references(chunks.limit(0)).count() == 0 and C.counters(C.references(chunks.limit(0))).count() == 0


def test_texts_are_read_once_for_all_counts(spark):
    chunks = spark.createDataFrame([("5", "Article 5 and Article 6 of this Regulation; the GDPR"), ("4a", "Article 5 DSA"), ("7", None)], "source string, text string")
    tallies = C.tallied(C.references(chunks))
    counted, covered = C.counters_of(tallies), C.coverage_of(tallies)
    assert not any("MapInArrow" in x._jdf.queryExecution().toString() for x in (counted, covered, C.counters(C.references(chunks)), C.coverage(C.references(chunks))))
    assert {r.measure: r.n for r in covered.collect()} == {"internal": 1, "external": 2, "sources_internal": 1, "sources_external": 2, "articles_cited": 1, "failed": 0}
    assert {(r.counter, r.value): r.n for r in counted.collect()}["source", "5"] == 2


def test_guidance_grammar(spark):
    cases = {
        "Article 5(a)": [(5, None, "a")], "Article 6(1), point (b)": [(6, "1", "b")], "Articles 26, 27 and 28": [(26, None, None), (27, None, None), (28, None, None)],
        "Article 3(5), (6) and (7)": [(3, "5", None), (3, "6", None), (3, "7", None)], "artikel 5, lid 1, onder c": [(5, None, None), (5, "1", "c")], "artikel 5 en artikel 5": [(5, None, None), (5, None, None)],
        "Artikelen 4 en 9, lid 2; artikel 9": [(4, None, None), (9, None, None), (9, None, None)], "artikel 7, lid 3 en artikel 7": [(7, None, None), (7, None, None), (7, "3", None)],
    }
    texts = spark.createDataFrame([(i, "nl", t) for i, t in enumerate(cases)], "i int, lang string, text string")
    found = {}
    for r in G.cited(texts, ["i"]).orderBy("i", "place").collect():
        found.setdefault(r.i, []).append((r.article, r.paragraph, r.letter))
    assert list(cases.values()) == [found[i] for i in range(len(cases))]
    dutch = G.cited(texts.withColumn("lang", F.lit("en")), ["i"]).where("i = 4").collect()
    assert [(r.article, r.paragraph) for r in dutch] == [(5, None)]
    page = spark.createDataFrame([("d", "en", 1, "AI Act, Article 500. The AI Act, Article 4."), ("d", "en", 2, None)], "doc string, lang string, page int, text string")
    notes = spark.createDataFrame([], "doc string, lang string, page int, number int, text string")
    sections = spark.createDataFrame([], "doc string, number string, page int")
    rows = G.guidance_citations(page, notes, sections).collect()
    assert [(r.article, r.section) for r in rows] == [(4, None)]


def test_links_in_text():
    ref = lambda raw, target, href, external=False: {"raw": raw, "target": target, "href": href, "external": external, "class": None}
    assert L.linked("Articles 5 and 15(5)", [ref("Articles 5 and 15(5)", "5", "/5"), ref("Articles 5 and 15(5)", "15", "/15")]) == 'Articles <a href="/5">5</a> and <a href="/15">15</a>(5)'
    assert L.linked("Annex I and Annex II", [ref("Annex I", "I", "/1"), ref("Annex II", "II", "/2")]) == '<a href="/1">Annex I</a> and <a href="/2">Annex II</a>'
    assert L.linked("", [ref("x", "1", "/")]) == "" and L.linked(None, []) is None and L.linked("a & b", []) == "a & b"


def test_amendment_and_paragraph_edges(spark):
    row = spark.createDataFrame([("Article 5", None, "de", "III", "**1.** x")], "a string, b string, lang string, entity string, body string")
    one = row.select(X.amendment_target(F.col("a"), F.col("lang")).alias("t"), X.amendment_target(F.col("b"), F.lit("en")).alias("u"), T.numbered_paragraphs(F.col("body"), F.col("entity")).alias("p")).first()
    assert one.t is None and one.u.kind == "structural" and one.p[0].id is None and one.p[0].number == "1"
    blanks = spark.createDataFrame([("\u2003x\u00a0 y\u2003",)], "t string").select(X.clean(F.col("t")).alias("c"), T.stripped(F.col("t")).alias("s")).first()
    assert blanks.c == "x y" and blanks.s == "x\u00a0 y"


def test_sections_render(spark):
    lines = spark.createDataFrame([("d", 1, i, x) for i, x in enumerate(["Step 1. Begin", "Text", "1 A note"])], "doc string, page int, line_no int, line string")
    assert S.guide_markdown(S.sections(lines), S.footnotes(lines)).first().markdown == "## Step 1. Begin\n\nText\n\n## Notes\n\n1. A note"


# ---- templates


def test_journal_template(spark):
    html = """<p class="oj-ti-section-1">HOOFDSTUK I</p><p class="oj-ti-section-2">Alg</p><p class="oj-ti-section-1">AFDELING 2</p><p class="oj-ti-section-2">Deel</p>
    <div class="eli-subdivision" id="art_2"><p class="oj-ti-art">Artikel 2</p><p class="oj-sti-art">Titel</p><p>1.  Een&nbsp;&nbsp;twee</p><div><p>in</p></div><span><p>not</p></span></div>
    <p class="oj-ti-section-1">HOOFDSTUK II</p><div class="eli-subdivision" id="art_1"><p>x<br>y</p><p></div><div id="art_9">no</div>"""
    annexes = """<div><p class="oj-doc-ti">BIJLAGE I</p><p class="oj-doc-ti">Naam</p><div><p>1. a</p><table><tr><td>(a)</td><td>b</td></tr></table></div><p class="oj-doc-ti" id="two">BIJLAGE II</p><p>c</p><p class="oj-final">d</p><p>e</p></div>
    <div class="eli-subdivision" id="rct_3"><table><tr><td>(3)</td><td>Overwegende</td></tr></table></div><div class="eli-subdivision" id="rct_4">plain</div>"""
    files = spark.createDataFrame([("a", html), ("b", annexes), ("c", None), ("d", "")], "file string, html string")
    rows = {(r.file, r.kind, r.number): r for r in M.journal_entities(files).collect()}
    assert sorted(rows) == [("a", "article", "1"), ("a", "article", "2"), ("b", "annex", "I"), ("b", "annex", "II"), ("b", "recital", "3"), ("b", "recital", "4")]
    one, two = rows["a", "article", "1"], rows["a", "article", "2"]
    assert (one.chapter, one.chapter_title, one.section, one.title, one.body_md) == ("II", "", None, "", "x y\n")
    assert two.body_md == "**1.** Een twee\n\nin\n" and (two.chapter, two.chapter_title, two.section, two.section_title, two.title) == ("I", "Alg", "2", "Deel", "Titel")
    first, second = rows["b", "annex", "I"], rows["b", "annex", "II"]
    assert (first.title, first.body_md, first.anchor) == ("Naam", "## Naam\n\n**1.** a\n\n- (a) b\n", "bijlage_I") and (second.body_md, second.body_text, second.anchor) == ("c\n", "c", "two")
    assert rows["b", "recital", "3"].body_md == "Overwegende\n" and rows["b", "recital", "4"].body_text == "plain"


def test_journal_spans_are_marks_on_rows(spark):
    files = spark.createDataFrame([("a", "<div><p class=oj-doc-ti>ANNEX I</p><div><p class=oj-doc-ti>ANNEX V</p><p>x</p></div><p>y</p></div>")], "file string, html string")
    found = M.journal_entities(files, "en")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # nothing is joined back to the elements
    assert sorted((r.number, r.body_md) for r in found.collect()) == [("I", "## ANNEX V\n\ny\n"), ("V", "x\n")]  # the inner annex alone has the inner blocks, its heading is in both


def test_proposal_template(spark):
    html = """<p class="SectionTitle">TITEL I</p><p class="SectionTitle">Over</p><p class="SectionTitle">Hoofdstuk 2</p><p class="li ManualConsidrant">(3) Ja</p><p class="Titrearticle">Artikel 1 Naam</p><p>een</p><p class="SectionTitle">Regels</p>
    <p class="Titrearticle">Artikel 2</p><p class="li NumPar1">1. x</p><table><tr><td><p>no</p></td></tr></table><p class="Titrearticle">Anders</p><p>lost</p><p class="Annexetitre">BIJLAGE II Van</p><p class="SectionTitle">Kop</p><table><tr><td>a</td><td></td><td>b</td></tr></table>"""
    rows = {(r.kind, r.number): r for r in M.proposal_entities(spark.createDataFrame([("a", html), ("b", "<p>")], "file string, html string")).collect()}
    assert sorted(rows) == [("annex", "II"), ("article", "1"), ("article", "2"), ("recital", "3")]
    one, two, annex = rows["article", "1"], rows["article", "2"], rows["annex", "II"]
    assert (one.title, one.chapter, one.chapter_title, one.section, one.section_title, one.body_md) == ("Naam", "I", "Over", "2", None, "een\n")
    assert (two.title, two.section_title, two.body_md, two.body_text) == ("", "Regels", "**1.** x\n", "1. x")
    assert (annex.title, annex.chapter, annex.body_md) == ("Van", None, "### Kop\n\na | b\n") and rows["recital", "3"].body_md == "Ja\n"


def test_amendment_template(spark):
    html = """<p class="oj-ti-grseq-1">Amendment 2</p><p class="oj-ti-grseq-1">A</p><p class="oj-ti-grseq-1"></p><p class="oj-ti-grseq-1">B</p><table><tr><td>Text proposed by the Commission</td><td>Amendment</td></tr><tr><td>old</td><td>new</td></tr><tr><td>1</td><td>2</td><td>3</td></tr><tr><td>both</td></tr></table><table><tr><td>late</td></tr></table>
    <p class="oj-ti-grseq-1">Amendment 1</p>"""
    rows = M.amendment_rows(spark.createDataFrame([("a", html), ("b", "no markup")], "file string, html string"), "en").collect()
    assert sorted((r.number, r.target, r.old_text, r.new_text, r.char_count) for r in rows) == [(1, "", "", "", 0), (2, "A — B", "old\n\nboth", "new\n\nboth", 9)]
    assert {r.number: r.body_md for r in rows}[1] == "## 1\n\n*(—)*\n\n## 2\n\n*(—)*\n"


def test_tables_become_lists():
    table = M.tree("<table><tr><td></td><td>(b)</td><td>two<table><tr><td>(i)</td><td>deep</td></tr></table></td></tr><tr><td>x</td></tr><tr><td>(c)</td><td></td></tr></table>").all("table")[0]
    assert M.list_lines(table) == ["- (b) two", "  - (i) deep", "- (c)"]


def test_templates_as_rows(spark):
    files = spark.createDataFrame([("a", "<p class='Titrearticle'>Artikel 3 Naam</p><p class='li Point1'>(a) x</p>"), ("b", None)], "file string, html string")
    assert [(r.file, r.kind, r.number, r.title, r.body_md) for r in M.proposal_entities(files).collect()] == [("a", "article", "3", "Naam", "- (a) x\n")]
    dutch = "<p class='oj-ti-grseq-1'>Amendement 4</p><table><tr><td>Door de Commissie voorgestelde tekst</td><td>Amendement</td></tr><tr><td></td><td>nieuw</td></tr></table>"
    row = M.amendment_rows(spark.createDataFrame([("a", dutch)], "file string, html string")).first()
    assert (row.number, row.old_text, row.new_text, row.char_count) == (4, "", "nieuw", 5)


# ---- readers, writers, history


def test_readers(spark, tmp_path):
    for n in ("3", "4a"):
        (tmp_path / f"article-{n}.json").write_text(json.dumps({"number": n, "m": {"x": "1"}}, indent=2))
        (tmp_path / f"article-{n}.md").write_text(f"line\n{n}")
    rows = readers.json_entities(spark, str(tmp_path / "*.json"), "number string, m map<string,string>")
    assert {r.number for r in rows.collect()} == {"3", "4a"} and all(r.file.endswith(".json") for r in rows.collect())
    assert readers.map_entries(rows.select("number", "m"), "m", "k", "v").where("k = 'x' AND v = '1'").count() == 2
    assert {(r.number, r.text) for r in readers.whole_texts(spark, str(tmp_path)).collect()} == {("3", "line\n3"), ("4a", "line\n4a")}
    (tmp_path / "index.xml").write_text("<sitemapindex><sitemap><loc>http://s/one.xml</loc></sitemap></sitemapindex>")
    (tmp_path / "one.xml").write_text("<urlset><url><loc>http://s/a</loc></url><url><loc>http://s/b</loc></url></urlset>")
    assert [r.loc for r in readers.site_map(spark, str(tmp_path / "index.xml"), "sitemap").collect()] == ["http://s/one.xml"]
    assert {r.loc for r in readers.site_maps(spark, str(tmp_path / "index.xml"), lambda loc: loc.replace("http://s", str(tmp_path))).collect()} == {"http://s/a", "http://s/b"}


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, "é"), ("a", 1, "x"), ("c", 3, None)], "k string, n int, text string")
    writers.ordered_json(rows, str(tmp_path / "o"), ["k"], one_file=True)
    files = [f for f in (tmp_path / "o").iterdir() if f.suffix == ".json"]
    assert len(files) == 1 and files[0].read_text().startswith('{"k":"a","n":1,"text":"x"}\n{"k":"b"')
    writers.ordered_json(rows, str(tmp_path / "o"), ["k"])  # overwrites
    parts = sorted(f for f in (tmp_path / "o").iterdir() if f.suffix == ".json")
    assert [json.loads(x)["k"] for f in parts for x in f.read_text().splitlines()] == ["a", "b", "c"]
    writers.pretty_json(rows, str(tmp_path / "p.json"), ["k"])
    assert json.loads((tmp_path / "p.json").read_text())[1] == {"k": "b", "n": 2, "text": "é"}
    with pytest.raises(ValueError):
        writers.pretty_json(rows, str(tmp_path / "p.json"), ["k"], most=2)
    stored = writers.manifest(rows, "k", "text")
    later = rows.withColumn("text", F.when(F.col("k") == "a", "y").otherwise(F.col("text")))
    assert [r.k for r in writers.changed(later.where("text IS NOT NULL"), stored, "k", "text").collect()] == ["a"]
    new = spark.createDataFrame([("a", 9)], "k string, n int")
    assert {(r.k, r.n) for r in writers.merged(rows, new, ["k"]).collect()} == {("a", 9), ("b", 2), ("c", 3)}
    assert [r.n for r in writers.counts(rows=rows, new=new).orderBy("kind").collect()] == [1, 3]
    assert {r.k for r in writers.missing(spark.createDataFrame([("a",), ("z",)], "k string"), rows, "k", F.lit("t")).collect()} == {"z"}
    done = rows.select(writers.patched(F.col("text"), "[m]", " [m]").alias("t"))
    assert {r.t for r in done.select(writers.patched(F.col("t"), "[m]", " [m]").alias("t")).collect()} == {"x [m]", "é [m]", None}
    writers.with_tables(str(tmp_path / "t"), one=rows)
    writers.with_tables(str(tmp_path / "t"), two=new)
    assert spark.read.parquet(str(tmp_path / "t/one")).count() == 3 and spark.read.parquet(str(tmp_path / "t/two")).count() == 1


def test_map_merge(spark):
    shape = "k string, m map<string,string>"
    old = spark.createDataFrame([("a", {"en": "1", "nl": "2"}), ("b", {"en": "3"}), ("d", None)], shape)
    new = spark.createDataFrame([("a", {"nl": "9"}), ("c", {"en": "4"}), ("d", {"x": "5"})], shape)
    assert {r.k: r.m for r in writers.merged_maps(old, new, "k", "m").collect()} == {"a": {"en": "1", "nl": "9"}, "b": {"en": "3"}, "c": {"en": "4"}, "d": {"x": "5"}}


def test_entity_documents(spark, tmp_path):
    rows = spark.createDataFrame([("4a", 2, 'The "x"', "Body")], "number string, chapter int, title string, body string")
    docs = writers.entity_documents(rows, X.article_path(F.col("chapter"), F.col("number")), {"title": F.col("title"), "none": F.lit(None).cast("string")}, {"chapter": F.col("chapter")}, F.col("body"))
    writers.write_entities(docs, str(tmp_path / "e"))
    got = spark.read.parquet(str(tmp_path / "e")).first()
    assert got.path == "chapter-02/article-04a" and got.folder == "chapter-02"
    assert got.markdown == '---\ntitle: "The \\"x\\""\nnone: null\nchapter: 2\n---\n\nBody' and json.loads(got.json) == {"title": 'The "x"', "none": None, "chapter": 2, "body_md": "Body"}


def test_link_report(spark, tmp_path):
    pages = spark.createDataFrame([("http://s/a/", '<a href="../b.html">x</a> <a class="y" href="c">z</a>'), ("http://s/b", "")], "url string, html string")
    broken = I.dangling_links(pages)
    assert [(r.href, r["class"]) for r in broken.collect()] == [("c", "unexpected")]
    writers.link_report(broken, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().href == "c"


def test_asserts_end_the_job(spark):
    rows = spark.createDataFrame([("s", "letters", "1", "t", "x", "id")], "stage string, content_type string, number string, title string, text string, snapshot_id string")
    with pytest.raises(Exception, match="isn't known"):
        H.snapshots(rows).collect()
    assert I.asserted(spark.range(3), F.col("id") < 3, "no").count() == 3


def test_read_model_edges(spark):
    rows = spark.createDataFrame([("4a", 1), ("4", 2), (None, 3), ("4", 0)], "number string, n int")
    assert [r.n for r in U.lookup(rows, "number", "4", ["n"]).collect()] == [0]
    assert U.lookup(rows, "number", "x", ["n"]).count() == 0 and U.lookup(rows, "number", None, ["n"]).count() == 0 and U.of(rows, number=None).count() == 0
    index = U.listed(rows.where("number IS NOT NULL"), ["number"], [F.col("n")], ["n"], "l")
    got = {(r.number, len(r.l)) for r in U.with_default(rows.select("number").distinct(), index, ["number"], "l").collect()}
    assert got == {("4a", 1), ("4", 2), (None, 0)}
    empty = rows.limit(0)
    for out in (U.shared_keys(empty, "number"), U.siblings(empty, "number", "n", [F.col("n")]), U.sorted_sets(empty, ["number"], "n"), U.chapters(empty, "number", "n", []), U.other_versions(empty, ["number"], "n"), U.heads(empty, ["number"], [F.col("n")], ["n"], 2)):
        assert out.count() == 0
    adjacency = spark.createDataFrame([("a", [1, 2, 9]), ("b", []), ("c", None)], "k string, ids array<int>")
    entities = spark.createDataFrame([("1", "one"), ("2", "two")], "number string, t string")
    assert sorted((r.k, r.t) for r in U.related(adjacency, "k", "ids", entities, "number").collect()) == [("a", "one"), ("a", "two")]
    assert {r.id: r["keys"] for r in U.inverted(adjacency, "k", "ids").collect()} == {"1": ["a"], "2": ["a"], "9": ["a"]}


def test_paths(spark):
    cases = {("../b/?x#y", "http://s/a/c/d.html"): "/a/b/", ("", "http://s/a/"): "/a/", ("#t", "http://s/a/b.html"): "/a/b.html", ("/x/./y/..", "/"): "/x/", ("tel:1", "/a"): None, ("../../../z", "http://s/a/b"): "/z"}
    rows = spark.createDataFrame([(h, p, w) for (h, p), w in cases.items()], "href string, page string, want string")
    assert rows.where(~X.resolved_path(F.col("href"), F.col("page")).eqNullSafe(F.col("want"))).collect() == []
    same = spark.createDataFrame([("http://s/a/index.html",), ("/a.html",), ("/a/",), ("https://t/a?x",)], "u string")
    assert [r.k for r in same.select(X.page_key(F.col("u")).alias("k")).distinct().collect()] == ["/a"]


def test_sample_is_the_same_at_every_run(spark):
    rows = spark.range(500)
    one = [r.id for r in U.sampled(rows, "id", 10, 7).collect()]
    assert one == [r.id for r in U.sampled(rows.repartition(7), "id", 10, 7).collect()] and one != [r.id for r in U.sampled(rows, "id", 10, 8).collect()]
    assert R.neighbours(rows, [], ["id"], "id").where("prev_key IS NULL").count() == 1
