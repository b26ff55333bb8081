"""Citations and amendments over texts that are written from columns: plain SQL says from the
columns alone what the grammars must find."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexbolt.functions import text as X
from lexbolt.operators import citations as C
from lexbolt.operators import guidance as G
from lexbolt.operators import linker as L
from lexbolt.plans.base import SQL, made, query
from lexbolt.sources import history as H
from lexbolt.sources import writers as K

c = F.col

#: a, b: article numbers; the qualifier goes by the order's status.
_A, _B = "(o_custkey % 97 + 1)", "(o_orderkey % 40 + 100)"
_TAIL = "CASE o_orderstatus WHEN 'O' THEN ' of this Regulation' WHEN 'F' THEN ' of Regulation (EU) 2016/679' ELSE ' under the Digital Services Act' END"
_TEXT = f"'As in Articles ' || {_A} || ' (2)(b), 98 and ' || {_B} || ' to ' || ({_B} + 2) || '(1)' || {_TAIL} || '; Annexes II and IV(' || (o_custkey % 9) || ') and Directive 2014/' || (o_custkey % 90 + 1) || '/EU apply to Article 99a, 99 GDPR.'"


def _chunks(spark, sf_dir):
    return made(spark, sf_dir, "orders", source=f"string({_B} + 1)", o_orderkey="o_orderkey", text=_TEXT)


_OUT = "CASE o_orderstatus WHEN 'O' THEN 'internal' WHEN 'F' THEN 'external_gdpr' ELSE 'external_other' END"
_ID = "CASE o_orderstatus WHEN 'F' THEN '32016R0679' WHEN 'P' THEN '32022R2065' END"
_NAME = "CASE o_orderstatus WHEN 'F' THEN 'Regulation (EU) 2016/679' WHEN 'P' THEN 'DSA' END"
_LIST = f"'Articles ' || {_A} || ' (2)(b), 98 and ' || {_B} || ' to ' || ({_B} + 2) || '(1)' || {_TAIL}"
_ANNEX = "'Annexes II and IV(' || (o_custkey % 9) || ')'"
_FOUND = " UNION ALL ".join(
    f"SELECT ({_B} + 1)::VARCHAR AS source, o_orderkey, {raw} AS raw, {kind} AS kind, '{target_kind}' AS target_kind, ({target})::VARCHAR AS target, {paragraph}::VARCHAR AS paragraph, {letter}::VARCHAR AS letter, {celex} AS celex, {short} AS short_name, {name} AS official_name FROM orders"
    for raw, kind, target_kind, target, paragraph, letter, celex, short, name in [
        *[(_LIST, _OUT, "article", t, p, l, _ID, "CASE o_orderstatus WHEN 'P' THEN 'DSA' END", _NAME) for t, p, l in ((_A, "'2'", "'b'"), ("98", "NULL", "NULL"), (_B, "NULL", "NULL"), (f"{_B} + 1", "NULL", "NULL"), (f"{_B} + 2", "NULL", "NULL"))],
        *[(_ANNEX, "'internal'", "annex", t, p, "NULL", "NULL", "NULL", "NULL") for t, p in (("'II'", "NULL"), ("'IV'", "(o_custkey % 9)"))],
        *[("'Article 99a, 99 GDPR'", "'external_gdpr'", "article", t, "NULL", "NULL", "'32016R0679'", "'GDPR'", "'GDPR'") for t in ("'99a'", "99")],
        ("'Directive 2014/' || (o_custkey % 90 + 1) || '/EU'", "'external_other'", "instrument", "NULL", "NULL", "NULL", "'32014L' || lpad((o_custkey % 90 + 1)::VARCHAR, 4, '0')", "NULL", "'Directive 2014/' || (o_custkey % 90 + 1) || '/EU'"),
    ]
)
_REFS = f"SELECT * FROM ({_FOUND}) WHERE NOT (kind = 'internal' AND target_kind = 'article' AND target = source)"


def _refs(spark, sf_dir):
    return C.references(_chunks(spark, sf_dir))


@query(_REFS)
def citations_extract(spark, sf_dir):
    return _refs(spark, sf_dir).drop("place", "subparagraph", "error")


@query(f"SELECT target AS article, row_number() OVER (PARTITION BY target ORDER BY source::INTEGER) - 1 AS place, source FROM ({_REFS}) WHERE kind = 'internal' AND target_kind = 'article'")
def citations_reverse(spark, sf_dir):
    index = C.reverse_index(_refs(spark, sf_dir))
    return index.select(c("target").alias("article"), "first", F.posexplode("refs").alias("i", "ref")).select("article", (c("first") + c("i")).alias("place"), c("ref.source").alias("source"))


@query(f"SELECT source, row_number() OVER (PARTITION BY source ORDER BY coalesce(try_cast(regexp_extract(target, '^\\d+') AS INTEGER), 0), coalesce(target, ''), raw) - 1 AS place, coalesce(target, '-') AS target FROM ({_REFS}) WHERE kind <> 'internal'")
def citations_forward(spark, sf_dir):
    index = C.forward_index(_refs(spark, sf_dir), external=True)
    return index.select("source", "first", F.posexplode("refs").alias("i", "ref")).select("source", (c("first") + c("i")).alias("place"), F.coalesce("ref.target", F.lit("-")).alias("target"))


_COUNTERS = " UNION ALL ".join(f"SELECT '{name}' AS counter, {value} AS value, count(*) AS n FROM r WHERE {value} IS NOT NULL GROUP BY 2" for name, value in (("kind", "kind"), ("target_kind", "CASE WHEN kind = 'internal' THEN target_kind END"), ("celex", "CASE WHEN kind <> 'internal' THEN coalesce(celex, '(none)') END"), ("source", "source"), ("short_name", "short_name")))


@query(f"WITH r AS ({_REFS}) {_COUNTERS}")
def citation_counters(spark, sf_dir):
    return C.counters(_refs(spark, sf_dir))


_MEASURES = {
    "internal": "count(*) FILTER (kind = 'internal')", "external": "count(*) FILTER (kind <> 'internal')", "sources_internal": "count(DISTINCT source) FILTER (kind = 'internal')", "sources_external": "count(DISTINCT source) FILTER (kind <> 'internal')",
    "articles_cited": "count(DISTINCT target) FILTER (kind = 'internal' AND target_kind = 'article')", "failed": "count(*) FILTER (false)",
}


@query(f"WITH r AS ({_REFS}) " + " UNION ALL ".join(f"SELECT '{k}' AS measure, {v} AS n FROM r" for k, v in _MEASURES.items()))
def citation_coverage(spark, sf_dir):
    return C.coverage(_refs(spark, sf_dir))


@query(f"""WITH r AS ({_REFS}), m AS ({" UNION ALL ".join(f"SELECT '{k}' AS measure, {v} AS n FROM r" for k, v in _MEASURES.items())}), k AS ({_COUNTERS}),
 k2 AS (SELECT *, row_number() OVER (PARTITION BY counter ORDER BY n DESC, value) AS place FROM k QUALIFY counter <> 'source' OR place <= 20),
 t AS (SELECT counter, string_agg('| `' || value || '` | ' || n || ' |', chr(10) ORDER BY place) AS t FROM k2 GROUP BY counter)
 SELECT '# Coverage' || chr(10) || chr(10) || (SELECT string_agg('- ' || replace(measure, '_', ' ') || ': **' || n || '**' || CASE WHEN measure LIKE 'sources%' OR measure LIKE 'articles%' THEN ' / 113' ELSE '' END, chr(10) ORDER BY measure) FROM m) || chr(10) || chr(10)
 || (SELECT string_agg('## ' || counter || chr(10) || chr(10) || '| value | n |' || chr(10) || '|-|-|' || chr(10) || t, chr(10) || chr(10) ORDER BY counter) FROM t) || chr(10) AS markdown""")
def coverage_report(spark, sf_dir):
    tallies = C.tallied(_refs(spark, sf_dir))
    return K.coverage_report(C.coverage_of(tallies), C.counters_of(tallies), "Coverage", 113)


#: Forms of references, one an order by its key: the text, and what is in it as (raw, kind,
#: target kind, target, paragraph, letter, subparagraph, instrument). {a} is a number of the order.
_GDPR, _LED, _DSA, _DMA = "32016R0679", "32016L0680", "32022R2065", "32022R1925"
_FORMS = [
    ("Article {a}", [("Article {a}", "internal", "article", "{a}")]),
    ("see Article {a}(2).", [("Article {a}(2)", "internal", "article", "{a}", "2")]),
    ("Article {a} (2)(b)(iv)", [("Article {a} (2)(b)(iv)", "internal", "article", "{a}", "2", "b", "iv")]),
    ("Article {a}(b)", [("Article {a}", "internal", "article", "{a}")]),
    ("Articles {a}, 98 and 99(3)", [("Articles {a}, 98 and 99(3)", "internal", "article", t, p) for t, p in (("{a}", None), ("98", None), ("99", "3"))]),
    ("Articles 3 TO 5", [("Articles 3 TO 5", "internal", "article", t) for t in "345"]),
    ("Articles 3(1) to 5(2)", [("Articles 3(1) to 5(2)", "internal", "article", t, p) for t, p in (("3", "1"), ("4", None), ("5", None))]),
    ("Articles 1 to 80", [("Articles 1", "internal", "article", "1")]),
    ("Articles 9–8, but not {a}", [("Articles 9–8", "internal", "article", t) for t in "98"]),
    ("Articles {a},, 9", [("Articles {a}", "internal", "article", "{a}")]),
    ("Article {a}a and no other", [("Article {a}a", "internal", "article", "{a}a")]),
    ("Article {a} OF THIS REGULATION", [("Article {a} OF THIS REGULATION", "internal", "article", "{a}")]),
    ("Article {a} of Regulation (EU) 2016/679", [("Article {a} of Regulation (EU) 2016/679", "external_gdpr", "article", "{a}", None, None, None, _GDPR)]),
    ("Article {a} of Directive (EU) 2019/790", [("Article {a} of Directive (EU) 2019/790", "external_other", "article", "{a}", None, None, None, "32019L0790")]),
    ("Article {a} under Regulation (EU) No. 1025 / 2012", [("Article {a} under Regulation (EU) No. 1025 / 2012", "external_other", "article", "{a}", None, None, None, "32012R1025")]),
    ("Article {a}(1) GDPR", [("Article {a}(1) GDPR", "external_gdpr", "article", "{a}", "1", None, None, _GDPR)]),
    ("Article {a} gdpr", [("Article {a}", "internal", "article", "{a}"), ("gdpr", "external_gdpr", "instrument", None, None, None, None, _GDPR)]),
    ("Annex III", [("Annex III", "internal", "annex", "III")]),
    ("Annexes I to III and V(2)(a)", [("Annexes I to III and V(2)(a)", "internal", "annex", t, p, x) for t, p, x in (("I", None, None), ("III", None, None), ("V", "2", "a"))]),
    ("under the NIS2 Directive of {a}", [("the NIS2 Directive", "external_other", "instrument", None, None, None, None, "32022L2555")]),
    ("Decision (EU) 2021/914", [("Decision (EU) 2021/914", "external_other", "instrument", None, None, None, None, "32021D0914")]),
    ("no article {a} of law", []),
    ("Article 5, Article {a} and Annex IV", [("Article 5", "internal", "article", "5"), ("Article {a}", "internal", "article", "{a}"), ("Annex IV", "internal", "annex", "IV")]),
    ("Articles 10, 11 to 13 and 20 of the Digital Services Act", [("Articles 10, 11 to 13 and 20 of the Digital Services Act", "external_other", "article", t, None, None, None, _DSA) for t in ("10", "11", "12", "13", "20")]),
    ("Article {a} of the Law Enforcement Directive; Article 4 DMA", [("Article {a} of the Law Enforcement Directive", "external_other", "article", "{a}", None, None, None, _LED), ("Article 4 DMA", "external_other", "article", "4", None, None, None, _DMA)]),
    ("Regulation (EU) 2024/1689 and Directive 2014/{a}/EU", [("Directive 2014/{a}/EU", "external_other", "instrument", None, None, None, None, "2014")]),
]
_ITEM = ["raw", "kind", "target_kind", "target", "paragraph", "letter", "subparagraph", "celex"]


def _text_sql(text):
    """SQL of a text in which {a} is a number of the order."""
    return "NULL" if text is None else "'" + text.replace("'", "''").replace("{a}", f"' || {_A} || '") + "'"


def _form(forms, place="o_orderkey"):
    return "CASE " + " ".join(f"WHEN {place} % {len(forms)} = {i} THEN {_text_sql(text)}" for i, (text, _) in enumerate(forms)) + " END"


def _forms_sql(forms, names):
    """SQL of all that the forms of all orders hold."""
    rows = [(i, [*row, *[None] * (len(names) - len(row))]) for i, (_, found) in enumerate(forms) for row in found]
    last = lambda x: f"'32014L' || lpad(({_A})::VARCHAR, 4, '0')" if x == "2014" else _text_sql(x)
    one = lambda row: ", ".join(f"{last(x) if n == 'celex' else _text_sql(x)} AS {n}" for n, x in zip(names, row))
    return " UNION ALL ".join(f"SELECT o_orderkey, {one(row)} FROM orders WHERE o_orderkey % {len(forms)} = {i}" for i, row in rows)


@query(_forms_sql(_FORMS, _ITEM))
def citation_forms(spark, sf_dir):
    rows = made(spark, sf_dir, "orders", source="'0'", o_orderkey="o_orderkey", text=_form(_FORMS))
    return C.references(rows).select("o_orderkey", *_ITEM)


_STAND_ALONE = "'Under the GDPR, Directive (EU) 2016/' || (o_custkey % 900 + 1) || ' (the LED), Regulation(EC) 300/2008 and Regulation (EU) 2024/1689'"


@query("SELECT o_orderkey, unnest(['the GDPR', 'Directive (EU) 2016/' || (o_custkey % 900 + 1), 'the LED', 'Regulation(EC) 300/2008']) AS raw, unnest(['32016R0679', '32016L' || lpad((o_custkey % 900 + 1)::VARCHAR, 4, '0'), '32016L0680', '32008R0300']) AS celex, unnest(['GDPR', 'Directive (EU) 2016/' || (o_custkey % 900 + 1), 'LED', 'Regulation (EC) No 300/2008']) AS official_name FROM orders")
def instruments_extract(spark, sf_dir):
    rows = made(spark, sf_dir, "orders", source="'1'", o_orderkey="o_orderkey", text=_STAND_ALONE)
    return C.references(rows).where("target_kind = 'instrument'").select("o_orderkey", "raw", "celex", "official_name")


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '32016R' || lpad(o_custkey::VARCHAR, greatest(4, length(o_custkey::VARCHAR))::INTEGER, '0') WHEN 1 THEN '32012R' || lpad(o_custkey::VARCHAR, greatest(4, length(o_custkey::VARCHAR))::INTEGER, '0') WHEN 2 THEN '32008R' || lpad(o_custkey::VARCHAR, greatest(4, length(o_custkey::VARCHAR))::INTEGER, '0') WHEN 3 THEN '32014L' || lpad(o_custkey::VARCHAR, greatest(4, length(o_custkey::VARCHAR))::INTEGER, '0') WHEN 4 THEN '32021D' || lpad(o_custkey::VARCHAR, greatest(4, length(o_custkey::VARCHAR))::INTEGER, '0') END AS id FROM orders")
def instrument_ids(spark, sf_dir):
    texts = "array('Regulation(EU) 2016/' || o_custkey, 'Regulation (EU) No. ' || o_custkey || '/2012', 'Regulation (EC) ' || o_custkey || ' / 2008', 'Directive 2014/' || o_custkey || '/EU', 'Decision (EU) 2021/' || o_custkey, 'none')"
    return made(spark, sf_dir, "orders", o_orderkey="o_orderkey", text=f"element_at({texts}, int(o_orderkey % 6) + 1)").select("o_orderkey", X.instrument_id(c("text")).alias("id"))


_AIM = "array('Article ' || o_custkey || ' - paragraph 1 a', 'Recital ' || o_custkey || ' b (new)', 'annex iii - point 1', 'Title VIIIA', 'Artikel ' || o_custkey || ' bis (nieuw)', 'Overweging ' || o_custkey || ' Quater', 'Artikel ' || o_custkey || ' – lid 2 ter')"
_AIMED = "SELECT o_orderkey, o_orderkey % 7 AS k, ['article', 'recital', 'annex', 'structural', 'article', 'recital', 'article'][o_orderkey % 7 + 1] AS kind, CASE WHEN o_orderkey % 7 IN (0, 1, 4, 5, 6) THEN o_custkey::VARCHAR WHEN o_orderkey % 7 = 2 THEN 'III' END AS number, [NULL, 'b', NULL, NULL, 'bis', 'quater', NULL][o_orderkey % 7 + 1] AS suffix, ['1', NULL, NULL, NULL, NULL, NULL, '2'][o_orderkey % 7 + 1] AS paragraph, ['a', NULL, NULL, NULL, NULL, NULL, 'ter'][o_orderkey % 7 + 1] AS paragraph_suffix FROM orders"


@query(f"SELECT o_orderkey, kind, number, suffix, paragraph, paragraph_suffix FROM ({_AIMED})")
def amend_target_classify(spark, sf_dir):
    rows = made(spark, sf_dir, "orders", o_orderkey="o_orderkey", text=f"element_at({_AIM}, int(o_orderkey % 7) + 1)", lang="if(o_orderkey % 7 > 3, 'nl', 'en')")
    return rows.select("o_orderkey", X.amendment_target(c("text"), c("lang")).alias("t")).select("o_orderkey", "t.*")


_TITLES = "CASE WHEN o_orderkey % 2 = 0 THEN 'Body' ELSE 'Markdown' END"


@query(f"""SELECT 'snap_first_article_' || o_orderkey AS snapshot_id, 'first' AS stage, 'articles' AS content_type, o_orderkey::VARCHAR AS number, {_TITLES} AS text, NULL AS amends_kind FROM orders WHERE o_orderstatus = 'O'
 UNION ALL SELECT 'snap_second_recital_' || o_orderkey, 'second', 'recitals', o_orderkey::VARCHAR, CASE WHEN o_orderkey % 2 = 0 THEN 'in "it"' ELSE 'row ' || o_custkey END, NULL FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT 'snap_second_amendment_' || a.o_orderkey, 'second', 'amendments', a.o_orderkey::VARCHAR, 'new', a.kind FROM ({_AIMED}) a JOIN orders o ON o.o_orderkey = a.o_orderkey WHERE o.o_orderstatus = 'P' AND a.k < 4""")
def drafting_snapshots(spark, sf_dir):
    return H.snapshots(*_history(spark, sf_dir), stages=["first", "second"]).select("snapshot_id", "stage", "content_type", "number", "text", "amends_kind")


def _history(spark, sf_dir):
    entities = made(spark, sf_dir, "orders", s="o_orderstatus", number="o_orderkey", title="'t'", body_text="if(o_orderkey % 2 = 0, 'Body', '')", body_md="'Markdown'").where("s = 'O'")
    blob = "map('second', map('recitals', map(string(o_orderkey), if(o_orderkey % 2 = 0, '\"in \\\\\"it\\\\\"\"', '{\"title\": \"t\", \"text\": \"row ' || o_custkey || '\"}'))))"
    versions = made(spark, sf_dir, "orders", s="o_orderstatus", by_version=blob).where("s = 'F'")
    amended = made(spark, sf_dir, "orders", s="o_orderstatus", k="o_orderkey % 7", number="o_orderkey", target=f"element_at({_AIM}, int(o_orderkey % 7) + 1)", new_text="'new'").where("s = 'P' AND k < 4")
    return H.from_entities(entities, "first", "articles"), H.from_versions(versions), H.from_amendments(amended, "second", "en")


@query(f"SELECT amends_kind, count(*) AS n FROM ({SQL['drafting_snapshots']}) WHERE content_type = 'amendments' GROUP BY amends_kind")
def amendment_kinds(spark, sf_dir):
    return H.kinds_of_amendments(H.snapshots(*_history(spark, sf_dir)))


# ---- guidance


_PAGE = "'No law here. See Articles ' || (o_custkey % 50 + 1) || ', 60 and 200 of the AI Act! Article 9 is elsewhere. The AI  Act, Article ' || (o_custkey % 100 + 1) || '(2), (3) and (4).'"
_NOTE = "if(o_orderkey % 2 = 0, 'AI-verordening, artikel ' || (o_custkey % 90 + 1) || ', lid 2, onder b', 'Another act, artikel 3')"


@query("""SELECT * FROM (SELECT o_orderkey::VARCHAR AS doc, CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE '2' END AS section, 5 AS page, NULL::INTEGER AS note, unnest([o_custkey % 50 + 1, 60, o_custkey % 100 + 1, o_custkey % 100 + 1, o_custkey % 100 + 1])::INTEGER AS article, unnest([NULL, NULL, '2', '3', '4']) AS paragraph, NULL AS letter FROM orders
 UNION SELECT o_orderkey::VARCHAR, NULL, 1, 7, (o_custkey % 90 + 1)::INTEGER, unnest([NULL, '2']), unnest([NULL, 'b']) FROM orders WHERE o_orderkey % 2 = 0)""")
def guidance_citations(spark, sf_dir):
    pages = made(spark, sf_dir, "orders", doc="string(o_orderkey)", lang="if(o_orderkey % 2 = 0, 'nl', 'en')", page="5", text=_PAGE)
    notes = made(spark, sf_dir, "orders", doc="string(o_orderkey)", lang="if(o_orderkey % 2 = 0, 'nl', 'en')", page="1", number="7", text=_NOTE)
    sections = made(spark, sf_dir, "orders", doc="string(o_orderkey)", s="explode(array(struct('1' AS number, 2 AS page), struct('2' AS number, if(o_orderkey % 3 = 0, 6, 5) AS page)))").select("doc", "s.*")
    return G.guidance_citations(pages, notes, sections).drop("lang", "raw", "context")


#: Forms of guidance citations: the text, and what is in it as (article, paragraph, letter, raw).
_GUIDE_FORMS = [
    ("Article {a}(a)", [("{a}", None, "a", "Article {a}(a)")]),
    ("Article {a}(1), point (b)", [("{a}", "1", "b", "Article {a}(1), point (b)")]),
    ("Articles 26, {a} and 28", [(t, None, None, "Articles 26, {a} and 28") for t in ("26", "{a}", "28")]),
    ("Article {a}(5), (6) and (7)", [("{a}", "5", None, "Article {a}(5)"), ("{a}", "6", None, "Article {a}(6)"), ("{a}", "7", None, "Article {a}(7)")]),
    ("artikel {a}, lid 1, onder c", [("{a}", None, None, "artikel {a}"), ("{a}", "1", "c", "artikel {a}, lid 1, onder c")]),
    ("Artikelen 101 en 104; artikel 102", [("101", None, None, "Artikelen 101 en 104"), ("104", None, None, "Artikelen 101 en 104"), ("102", None, None, "artikel 102")]),
    ("artikel {a}, lid 3 en artikel {a}", [("{a}", None, None, "artikel {a}"), ("{a}", "3", None, "artikel {a}, lid 3"), ("{a}", None, None, "artikel {a}")]),
    ("no citation of {a}", []),
    ("Articles 5 to {a}", [("5", None, None, "Articles 5")]),
    ("Article {a}. " + "x" * 130 + " (4)", [("{a}", None, None, "Article {a}")]),
]


@query(_forms_sql(_GUIDE_FORMS, ["article", "paragraph", "letter", "raw"]))
def guidance_forms(spark, sf_dir):
    rows = made(spark, sf_dir, "orders", o_orderkey="o_orderkey", lang="'nl'", text=_form(_GUIDE_FORMS))
    return G.cited(rows, ["o_orderkey"]).select("o_orderkey", c("article").cast("string").alias("article"), "paragraph", "letter", "raw")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'external_gdpr' ELSE 'external_other' END AS kind, CASE o_orderkey % 5 WHEN 0 THEN '32016L0680' ELSE '32016R0679' END AS celex FROM orders WHERE o_orderkey % 5 IN (0, 1)
 UNION ALL SELECT o_orderkey, 'external_gdpr', NULL FROM orders WHERE o_orderkey % 5 = 4""")
def mistagged_references(spark, sf_dir):
    kind = "CASE WHEN o_orderkey % 5 IN (0, 2, 4) THEN 'external_gdpr' WHEN o_orderkey % 5 = 1 THEN 'external_other' ELSE 'internal' END"
    celex = "CASE o_orderkey % 5 WHEN 0 THEN '32016L0680' WHEN 1 THEN '32016R0679' WHEN 2 THEN '32016R0679' END"
    return C.mistagged(made(spark, sf_dir, "orders", o_orderkey="o_orderkey", kind=kind, celex=celex))


@query(f"SELECT article, row_number() OVER (PARTITION BY article ORDER BY doc) - 1 AS place, doc FROM ({SQL['guidance_citations']})")
def guidance_by_article(spark, sf_dir):
    rows = G.by_article(guidance_citations(spark, sf_dir).withColumn("lang", F.lit("nl")).withColumn("raw", F.lit("r")))
    return rows.select("article", "first", F.posexplode("citations").alias("i", "r")).select("article", (c("first") + c("i")).alias("place"), c("r.doc").alias("doc"))


# ---- inline links


@query("""SELECT o_orderkey, 'See <b> Articles <a class="in" href="/a/' || (o_custkey % 97 + 1) || '">' || (o_custkey % 97 + 1) || '</a>(2) &amp; <a class="in" href="/a/98">98</a> and <a class="out" href="/x?a&amp;b" target="_blank" rel="noopener">the &#39;GDPR&#39;<span class="ref-external-mark" aria-hidden="true"> ↗</span></a>.' AS html FROM orders""")
def reference_links(spark, sf_dir):
    raw = f"'Articles ' || {_A} || '(2) & 98'"
    ref = lambda raw, target, href, external, kind: f"named_struct('raw', {raw}, 'target', string({target}), 'href', {href}, 'external', {external}, 'class', '{kind}')"
    name = "'the ' || chr(39) || 'GDPR' || chr(39)"
    refs = f"array({ref(raw, _A, f"'/a/' || {_A}", 'false', 'in')}, {ref(raw, 98, "'/a/98'", 'false', 'in')}, {ref(name, 'null', "'/x?a&b'", 'true', 'out')}, {ref(name, "'g'", "'/in'", 'false', 'in')})"
    rows = made(spark, sf_dir, "orders", o_orderkey="o_orderkey", text=f"'See <b> ' || {raw} || ' and the ' || chr(39) || 'GDPR' || chr(39) || '.'", refs=refs)
    return rows.select("o_orderkey", L.link_references(c("text"), c("refs")).alias("html"))
