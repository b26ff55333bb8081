"""Text functions and structure, over whole texts or over texts written from columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexbolt.functions import structure as T
from lexbolt.functions import text as X
from lexbolt.operators import sections as S
from lexbolt.plans.base import SQL, made, query
from lexbolt.sources import markup as M
from lexbolt.sources import writers as K
from lexbolt.sources.readers import table

c = F.col


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS sha FROM documents""")
def text_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.clean(c("text")), 256).alias("sha"))


@query("SELECT doc_id, sha256(text) AS sha256, length(text) AS char_count FROM documents")
def content_sha256(spark, sf_dir):
    return K.manifest(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(r"SELECT doc_id, substring(lower(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 80) AS slug FROM documents")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.slugify(c("text")).alias("slug"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '…' ELSE text END AS preview FROM documents")
def truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate(c("text"), 300).alias("preview"))


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN regexp_replace(substring(text, 1, 400), ' [^ ]*$', '') || '…' ELSE text END AS context FROM documents")
def context_cut(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.cut_at_word(c("text")).alias("context"))


@query("SELECT doc_id, substring(array_to_string(string_split(text, chr(10))[2:3], ' '), 1, 200) AS preview FROM documents")
def line_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.lines_of(c("text"), 2, 2).alias("preview"))


@query(r"SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS n_sentences FROM documents")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.sentences(c("text"))).alias("n_sentences"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda b: trim(b) <> '' AND NOT regexp_matches(regexp_replace(b, '^\s+', ''), '^(?:#|<!--|---)'))) AS n_blocks FROM documents")
def doc_block_counts(spark, sf_dir):
    doubled = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", X.block_count(doubled).alias("n_blocks"))


@query(r"SELECT doc_id, regexp_replace(CASE WHEN doc_id % 2 = 0 THEN doc_id || '.  ' || text ELSE text END, '^(\d+)\.\s+', '**\1.** ') AS md FROM documents")
def bold_leads(spark, sf_dir):
    rows = made(spark, sf_dir, "documents", doc_id="doc_id", text="if(doc_id % 2 = 0, doc_id || '.  ' || text, text)")
    return rows.select("doc_id", X.bold_lead(c("text")).alias("md"))


@query("SELECT p_partkey, 'The EU'||chr(39)||'S AI Act: ' || upper(p_type[1]) || lower(p_type[2:]) || ' And GPAI-' || p_partkey AS title FROM part")
def title_cases(spark, sf_dir):
    rows = made(spark, sf_dir, "part", p_partkey="p_partkey", t="concat('the eu', chr(39), 's ai act: ', p_type, ' and GPAI-', p_partkey)")
    return rows.select("p_partkey", T.title_case(c("t")).alias("title"))


@query("SELECT doc_id, sha256(regexp_replace(replace(replace(replace(replace(replace(translate(nfc_normalize(text), chr(160) || chr(8201) || chr(8239) || '–‘’“”' || chr(173) || chr(8203) || chr(8204) || chr(8205) || chr(65279), '   -' || chr(39) || chr(39) || '\"\"'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '[ \\t]+', ' ', 'g')) AS sha FROM documents")
def text_normalised(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalised(c("text")), 256).alias("sha"))


@query(r"SELECT doc_id, greatest(len(regexp_extract_all(text, '\n\d+\.\s')), 1) AS n FROM documents")
def paragraph_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.paragraph_estimate(c("text")).alias("n"))


# ---- markup and routes


def _markdown_sql() -> str:
    out = "html"
    for pattern, new in T.MARKDOWN_RULES:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    for name, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{plain}')"
    return f"SELECT page_id, {out} AS markdown FROM pages"


@query(_markdown_sql())
def page_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_markdown(c("html")).alias("markdown"))


@query(r"""SELECT page_id, '/nl' || regexp_replace(p, '^/(en|nl)(/|$)', '\2') AS other, CASE WHEN p LIKE '/recitals%' THEN 'recitals' WHEN p LIKE '/annexes%' THEN 'annexes' WHEN p LIKE '/history%' THEN 'history' WHEN p LIKE '/guidance%' THEN 'guidance' WHEN p LIKE '/about%' THEN 'about' ELSE 'articles' END AS section
 FROM (SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS p FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[#?].*$', ''), '^[a-z]+://[^/]*', ''), '/index\.html$', '/') AS p FROM pages))""")
def page_routes(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", X.url_path(c("url")).alias("p"))
    return p.select("page_id", T.swap_language(c("p"), "nl").alias("other"), T.nav_section(c("p")).alias("section"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN '/a/p' || l_partkey || '.html' WHEN 1 THEN '/en/p' || l_partkey || '/' WHEN 2 THEN '/en/x/' || l_partkey WHEN 3 THEN NULL END AS path FROM lineitem")
def resolved_paths(spark, sf_dir):
    page = F.lit("http://h.example/en/x/index.html?q=1")
    rows = made(spark, sf_dir, "lineitem", l_orderkey="l_orderkey", l_linenumber="l_linenumber", l_partkey="l_partkey", href="element_at(array('/a/b/../p' || l_partkey || '.html#t', '../p' || l_partkey || '/', './' || l_partkey || '?x', 'mailto:p' || l_partkey), l_linenumber % 4 + 1)")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", X.resolved_path(c("href"), page).alias("path"))


@query("SELECT p_partkey, 'chapter-' || CASE WHEN p_size < 10 THEN '0' ELSE '' END || p_size || '/article-' || CASE WHEN p_partkey < 10 THEN '0' ELSE '' END || p_partkey || CASE WHEN p_size % 2 = 0 THEN 'a' ELSE '' END AS path, '---' || chr(10) || 'title: \"' || p_name || ' \\\"q\\\"\"' || chr(10) || 'brand: null' || chr(10) || 'size: ' || p_size || chr(10) || '---' || chr(10) || chr(10) || p_type AS markdown FROM part")
def entity_files(spark, sf_dir):
    rows = made(spark, sf_dir, "part", p_partkey="p_partkey", number="p_partkey || if(p_size % 2 = 0, 'a', '')", title="p_name || ' \"q\"'", p_size="p_size", p_type="p_type")
    path = X.article_path(c("p_size"), c("number")).alias("path")
    docs = K.entity_documents(rows.withColumn("path", path), c("path"), {"title": c("title"), "brand": F.lit(None).cast("string")}, {"size": c("p_size")}, c("p_type"))
    return docs.join(rows.select("p_partkey", path), "path").select("p_partkey", "path", "markdown")


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN '  - (a) ' || l_partkey WHEN 1 THEN '**' || l_partkey || '.** text' WHEN 2 THEN '### ' || l_partkey ELSE CAST(l_partkey AS VARCHAR) END AS md FROM lineitem")
def styled_blocks(spark, sf_dir):
    rows = made(spark, sf_dir, "lineitem", l_orderkey="l_orderkey", l_linenumber="l_linenumber", style="element_at(array('li Point2', 'li NumPar1', 'SectionTitle', 'Normal'), l_linenumber % 4 + 1)", text="element_at(array('(a) ' || l_partkey, l_partkey || '.   text', string(l_partkey), string(l_partkey)), l_linenumber % 4 + 1)")
    return rows.select("l_orderkey", "l_linenumber", X.styled_block(c("style"), c("text")).alias("md"))


# ---- numbers, dates and forms

_DIGITS = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


@query("SELECT p_partkey, p_partkey AS num_key, CASE WHEN p_partkey % 3 = 0 THEN 9999 ELSE p_size END AS late_key, CASE WHEN p_size <= 3 THEN p_size ELSE 999 END AS roman_key FROM part")
def number_keys(spark, sf_dir):
    rows = made(spark, sf_dir, "part", p_partkey="p_partkey", number="p_partkey || 'a'", late="if(p_partkey % 3 = 0, 'x', string(p_size))", r="if(p_size <= 3, lower(repeat('I', p_size)), 'Q')")
    return rows.select("p_partkey", X.number_key(c("number")).alias("num_key"), X.number_key(c("late"), 9999).alias("late_key"), X.roman_key(c("r")).alias("roman_key"))


_NL = "['januari','februari','maart','april','mei','juni','juli','augustus','september','oktober','november','december']"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'soon' WHEN o_orderkey % 2 = 0 THEN day(o_orderdate) || ' ' || {_NL}[month(o_orderdate)] || ' ' || year(o_orderdate) ELSE day(o_orderdate) || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate) END AS spelled FROM orders")
def long_dates(spark, sf_dir):
    rows = made(spark, sf_dir, "orders", o_orderkey="o_orderkey", day="if(o_orderkey % 5 = 0, 'soon', date_format(o_orderdate, 'yyyy-MM-dd'))", lang="if(o_orderkey % 2 = 0, 'nl', 'en')")
    return rows.select("o_orderkey", X.long_date(c("day"), c("lang")).alias("spelled"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '(' || l_linenumber || ')' END || CASE WHEN l_returnflag = 'A' THEN '(a)' ELSE '' END AS pin, CASE WHEN l_linestatus = 'O' THEN '§1.' || l_linenumber || ', ' ELSE '' END || 'p. ' || l_suppkey || CASE WHEN l_returnflag = 'R' THEN ', vn. ' || l_linenumber ELSE '' END AS place FROM lineitem")
def pin_cites(spark, sf_dir):
    rows = made(spark, sf_dir, "lineitem", l_orderkey="l_orderkey", l_linenumber="l_linenumber", p="if(l_linenumber % 3 = 0, '', string(l_linenumber))", l="if(l_returnflag = 'A', 'a', null)", s="if(l_linestatus = 'O', '1.' || l_linenumber, '')", page="l_suppkey", n="if(l_returnflag = 'R', l_linenumber, null)")
    return rows.select("l_orderkey", "l_linenumber", T.pin_cite(c("p"), c("l")).alias("pin"), T.location(c("s"), c("page"), c("n"), F.lit("nl")).alias("place"))


@query("SELECT o_orderkey, o_orderstatus = 'P' AND length(CAST(o_custkey AS VARCHAR)) = 3 AS celex, o_orderstatus <> 'F' AS site, o_orderstatus = 'O' AS law FROM orders")
def form_checks(spark, sf_dir):
    rows = made(spark, sf_dir, "orders", o_orderkey="o_orderkey", celex="if(o_orderstatus = 'P', '32016R0' || o_custkey, 'x')", site="if(o_orderstatus = 'F', 'https://own.example/fr/', 'https://own.example/en/article/' || o_custkey || '/')", law="if(o_orderstatus = 'O', 'https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:32016R0679', 'https://eur-lex.europa.eu/')")
    return rows.select("o_orderkey", T.valid_celex(c("celex")).alias("celex"), T.valid_site_url(c("site"), F.lit("en"), "https://own.example").alias("site"), T.valid_registry_url(c("law"), F.lit("en")).alias("law"))


@query("SELECT s_suppkey, '[x](../recitals/index.md) [y](n-' || CASE WHEN s_suppkey < 0 THEN '' ELSE 'b' END || '.md) (articles/chapter-' || s_nationkey || '/index.md)' AS links FROM supplier")
def index_links(spark, sf_dir):
    rows = made(spark, sf_dir, "supplier", s_suppkey="s_suppkey", md="'[x](../recitals/) [y](../n-b.md) (articles/chapter-' || s_nationkey || '/)'")
    return rows.select("s_suppkey", T.index_links(c("md")).alias("links"))


# ---- paragraphs, parts and tables


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE lpad(o_custkey::VARCHAR, greatest(3, length(o_custkey::VARCHAR))::INTEGER, '0') || '.00' || k END AS id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE k::VARCHAR END AS number,
 CASE WHEN o_orderstatus = 'P' THEN 'Plain ' || o_orderkey WHEN k = 1 THEN '1.   First ' || o_orderkey || chr(10) || chr(10) || '(a)' || chr(10) || 'one' ELSE '2.   Second.' END AS text
 FROM orders, (VALUES (1), (2)) AS v(k) WHERE o_orderstatus <> 'P' OR k = 1""")
def body_paragraphs(spark, sf_dir):
    body = r"if(o_orderstatus = 'P', ' Plain ' || o_orderkey || ' \n', 'lost\n\n**1.** First ' || o_orderkey || '\n\n- a) one\n\n**2.**  Second.\n')"
    rows = made(spark, sf_dir, "orders", o_orderkey="o_orderkey", entity="string(o_custkey)", body=body)
    return rows.select("o_orderkey", F.inline(T.numbered_paragraphs(c("body"), c("entity"))))


_POINTS = r"'Intro ' || o_custkey || ':\n(a)\none ' || o_orderkey || '\n(b) two\nmore\n(c)\n(aa) no part'"


@query("SELECT o_orderkey, marker, text FROM (SELECT o_orderkey, unnest([NULL, '(a)', '(b)', '(c)']) AS marker, unnest(['Intro ' || o_custkey || ':', 'one ' || o_orderkey, 'two' || chr(10) || 'more', '(aa) no part']) AS text FROM orders)")
def sub_point_parts(spark, sf_dir):
    return made(spark, sf_dir, "orders", o_orderkey="o_orderkey", text=_POINTS).select("o_orderkey", F.inline(T.sub_points(c("text"))))


@query("SELECT o_orderkey, unnest(CASE WHEN o_orderstatus = 'P' THEN [NULL] ELSE ['(a)', '(b)', '(c)'] END) AS marker, unnest(CASE WHEN o_orderstatus = 'P' THEN ['Whole.'] ELSE ['one ' || o_orderkey, 'two' || chr(10) || 'more', '(aa) no part'] END) AS text FROM orders")
def text_chunk_rows(spark, sf_dir):
    rows = made(spark, sf_dir, "orders", o_orderkey="o_orderkey", text=f"if(o_orderstatus = 'P', 'Whole.', {_POINTS})")
    return rows.select("o_orderkey", F.inline(T.text_chunks(c("text"))))


@query("SELECT o_orderkey, 'Old & ' || o_custkey || chr(10) || chr(10) || chr(10) || chr(10) || 'Both' AS old_text, 'New' || chr(10) || chr(10) || 'Added ' || o_orderkey || chr(10) || chr(10) || 'Both' AS new_text FROM orders")
def amendment_columns(spark, sf_dir):
    html = "'<table><tr><th>Text proposed by the Commission</th><th>Amendment</th></tr><tr><td>Old &amp; <b>' || o_custkey || '</b></td><td>New</td></tr><tr><td></td><td>Added ' || o_orderkey || '</td></tr><tr><td> </td><td></td></tr><tr><td colspan=2>Both</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>'"
    both = made(spark, sf_dir, "orders", o_orderkey="o_orderkey", html=html).select("o_orderkey", T.two_columns(T.table_cells(c("html"))).alias("s"))
    return both.select("o_orderkey", c("s.left").alias("old_text"), c("s.right").alias("new_text"))


@query("SELECT o_orderkey, '- (a) first ' || o_custkey || chr(10) || '- (b) second' || chr(10) || 'bare' AS lines FROM orders")
def marker_table_lines(spark, sf_dir):
    html = "'<table><tr><td>(a)</td><td>first ' || o_custkey || '</td></tr><tr><td></td><td>(b)</td><td>second</td></tr><tr><td></td><td>bare</td></tr><tr><td>x</td></tr></table>'"
    return made(spark, sf_dir, "orders", o_orderkey="o_orderkey", html=html).select("o_orderkey", T.marker_lines(T.table_cells(c("html"))).alias("lines"))


# ---- documents in the three templates of markup, and paged guides

_JOURNAL = (
    "'<p class=\"oj-ti-section-1\">CHAPTER II</p><p class=\"oj-ti-section-2\">On ' || p_name || '</p><p class=\"oj-ti-section-1\">SECTION 1</p><p class=\"oj-ti-section-2\">Part</p>"
    "<div class=\"eli-subdivision\" id=\"art_' || p_partkey || '\"><p class=\"oj-ti-art\">Article</p><div class=\"eli-title\"><p class=\"oj-sti-art\">' || p_type || '</p></div><p>1. First ' || p_size || '</p><table><tr><td>(a)</td><td><p>one</p><table><tr><td>(i)</td><td>deep</td></tr></table></td></tr></table></div>"
    "<p class=\"oj-ti-section-1\">CHAPTER III</p><p class=\"oj-ti-section-2\">Last</p><div class=\"eli-subdivision\" id=\"art_9999999\"><p>End</p></div>"
    "<div class=\"eli-subdivision\" id=\"rct_7\"><table><tr><td>(7)</td><td>Whereas ' || p_brand || '</td></tr></table></div>"
    "<p class=\"oj-doc-ti\" id=\"x\">ANNEX IV</p><p class=\"oj-doc-ti\">Of ' || p_name || '</p><p>2. Two</p><div class=\"oj-final\">gone</div>'"
)


@query("""SELECT p_partkey::VARCHAR AS file, k AS kind, CASE k WHEN 'article' THEN p_partkey::VARCHAR WHEN 'last' THEN '9999999' WHEN 'recital' THEN '7' ELSE 'IV' END AS number,
 CASE k WHEN 'article' THEN p_type WHEN 'last' THEN '' WHEN 'annex' THEN 'Of ' || p_name END AS title, CASE k WHEN 'article' THEN 'II' WHEN 'last' THEN 'III' END AS chapter, CASE k WHEN 'article' THEN 'On ' || p_name WHEN 'last' THEN 'Last' END AS chapter_title,
 CASE k WHEN 'article' THEN '1' END AS section, CASE k WHEN 'article' THEN 'Part' END AS section_title,
 CASE k WHEN 'article' THEN '**1.** First ' || p_size || chr(10) || chr(10) || '- (a) one' || chr(10) || chr(10) || '  - (i) deep' WHEN 'last' THEN 'End' WHEN 'recital' THEN 'Whereas ' || p_brand ELSE '## Of ' || p_name || chr(10) || chr(10) || '**2.** Two' END || chr(10) AS body_md
 FROM part, (VALUES ('article'), ('last'), ('recital'), ('annex')) AS v(k)""".replace("k AS kind", "CASE k WHEN 'last' THEN 'article' ELSE k END AS kind"))
def journal_documents(spark, sf_dir):
    files = made(spark, sf_dir, "part", file="string(p_partkey)", html=_JOURNAL)
    return M.journal_entities(files, "en").drop("body_text", "char_count", "anchor")


_PROPOSAL = (
    "'<p class=\"SectionTitle\">TITLE I</p><p class=\"SectionTitle\">On ' || p_name || '</p><p class=\"SectionTitle\">Chapter 2</p><p class=\"SectionTitle\">Rules</p><p class=\"li ManualConsidrant\">(3) Whereas ' || p_size || '</p>"
    "<p class=\"Titrearticle\">Article ' || p_partkey || ' ' || p_type || '</p><p class=\"li NumPar1\">1. First</p><p class=\"li Point1\">(a) one</p><p class=\"li Point2\">(i) two</p><p class=\"Normal\">Plain</p>"
    "<p class=\"Annexetitre\">ANNEX II Of ' || p_brand || '</p><p class=\"Normal\">Text</p><table><tr><td>a</td><td>b</td></tr></table>'"
)


@query("""SELECT p_partkey::VARCHAR AS file, k AS kind, CASE k WHEN 'article' THEN p_partkey::VARCHAR WHEN 'recital' THEN '3' ELSE 'II' END AS number, CASE k WHEN 'article' THEN p_type WHEN 'annex' THEN 'Of ' || p_brand END AS title,
 CASE k WHEN 'article' THEN 'I' END AS chapter, CASE k WHEN 'article' THEN 'On ' || p_name END AS chapter_title, CASE k WHEN 'article' THEN '2' END AS section, CASE k WHEN 'article' THEN 'Rules' END AS section_title,
 CASE k WHEN 'article' THEN '**1.** First' || chr(10) || chr(10) || '- (a) one' || chr(10) || chr(10) || '  - (i) two' || chr(10) || chr(10) || 'Plain' WHEN 'recital' THEN 'Whereas ' || p_size ELSE 'Text' || chr(10) || chr(10) || 'a | b' END || chr(10) AS body_md
 FROM part, (VALUES ('article'), ('recital'), ('annex')) AS v(k)""")
def proposal_documents(spark, sf_dir):
    files = made(spark, sf_dir, "part", file="string(p_partkey)", html=_PROPOSAL)
    return M.proposal_entities(files, "en").drop("body_text", "char_count", "anchor")


_COMPARED = (
    "'<p class=\"oj-ti-grseq-1\">Amendment 1</p><p class=\"oj-ti-grseq-1\">Proposal</p><p class=\"oj-ti-grseq-1\">Recital ' || p_size || '</p><table><tr><td>Text proposed by the Commission</td><td>Amendment</td></tr><tr><td>Old ' || p_name || '</td><td>New</td></tr></table><table><tr><td>late</td></tr></table>"
    "<p class=\"oj-ti-grseq-1\">Amendment 2</p><p class=\"oj-ti-grseq-1\">Article ' || p_partkey || ' a (new)</p>'"
)


@query("SELECT p_partkey::VARCHAR AS file, k AS number, CASE k WHEN 1 THEN 'Proposal — Recital ' || p_size ELSE 'Article ' || p_partkey || ' a (new)' END AS target, CASE k WHEN 1 THEN 'Old ' || p_name ELSE '' END AS old_text, CASE k WHEN 1 THEN 'New' ELSE '' END AS new_text, CASE k WHEN 1 THEN 3 ELSE 0 END AS char_count FROM part, (VALUES (1), (2)) AS v(k)")
def amendment_documents(spark, sf_dir):
    files = made(spark, sf_dir, "part", file="string(p_partkey)", html=_COMPARED)
    return M.amendment_rows(files, "en").drop("body_md")


def _guide(spark, sf_dir):
    """A guide of two pages for each order."""
    lines = "array('Guide | Step 1  1', 'A title', 'Step 1. Is it in', 'scope?', 'Text ' || o_custkey || '.', '1.1. Systems on page 3', '1 A note', 'that goes on', '4 Ending', '1.2. Real heading', 'Body of it that is a sentence', 'Apples a day is body text', '2 Next note', '3 Last')"
    rows = made(spark, sf_dir, "orders", doc="string(o_orderkey)", lines=lines).select("doc", F.posexplode("lines").alias("line_no", "line"))
    return rows.select("doc", F.when(c("line_no") < 9, 1).otherwise(2).alias("page"), "line_no", "line")


_SECTIONS = """SELECT o_orderkey::VARCHAR AS doc, k AS ordinal, CASE k WHEN 0 THEN 'frontmatter' WHEN 1 THEN 'step-1-is-it-in-scope' ELSE 'sec-1-2-real-heading' END AS id, CASE k WHEN 2 THEN 2 ELSE 1 END AS level, CASE k WHEN 1 THEN '1' WHEN 2 THEN '1.2' END AS number,
 CASE k WHEN 0 THEN 'Frontmatter' WHEN 1 THEN 'Step 1. Is it in scope?' ELSE '1.2. Real heading' END AS title, CASE k WHEN 2 THEN 2 ELSE 1 END AS page,
 CASE k WHEN 0 THEN 'A title' WHEN 1 THEN 'Text ' || o_custkey || '.|1.1. Systems on page 3' ELSE 'Body of it that is a sentence|Apples a day is body text' END AS body FROM orders, (VALUES (0), (1), (2)) AS v(k)"""


@query(_SECTIONS)
def guide_sections(spark, sf_dir):
    return S.sections(_guide(spark, sf_dir)).withColumn("body", F.array_join("body", "|"))


@query("SELECT o_orderkey::VARCHAR AS doc, k AS number, CASE WHEN k IN (1, 4) THEN 1 ELSE 2 END AS page, CASE k WHEN 1 THEN 'A note that goes on' WHEN 2 THEN 'Next note' WHEN 3 THEN 'Last' ELSE 'Ending' END AS text FROM orders, (VALUES (1), (2), (3), (4)) AS v(k)")
def guide_footnotes(spark, sf_dir):
    return S.footnotes(_guide(spark, sf_dir))


@query(f"SELECT doc, string_agg(repeat('#', level + 1) || ' ' || title || chr(10) || chr(10) || replace(body, '|', chr(10)), chr(10) || chr(10) ORDER BY ordinal) || chr(10) || chr(10) || '## Notes' || chr(10) || chr(10) || '1. A note that goes on' || chr(10) || '2. Next note' || chr(10) || '3. Last' || chr(10) || '4. Ending' AS markdown FROM ({SQL['guide_sections']}) GROUP BY doc")
def guide_markdown(spark, sf_dir):
    return S.guides(_guide(spark, sf_dir))
