"""HTML documents as rows: elements in document order, and three templates over them.

Catalyst has no document tree, so Python reads a document once (Arrow batches) and gives a
row an element: its place, where it ends, its parent, tags above it, classes, text, and of a
table its cells and its lines as a list. All else is DataFrames over these rows: headings
are carried on as running state, an element belongs to the last entity that hasn't ended,
and bodies are its blocks in order. Windows are by file: a file's elements came out of one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexbolt.functions.text import roman
from lexbolt.operators.segments import last_markers
from lexbolt.sources.readers import by_keys, spread
from lexbolt.sources.stores import stored

#: Words that head the parts of a document, and its marks of style.
HEADINGS = {
    "nl": {"chapter": "HOOFDSTUK", "section": "AFDELING", "annex": "BIJLAGE", "title": "TITEL", "article": "Artikel", "amendment": "Amendement", "header": "door de commissie voorgestelde tekst"},
    "en": {"chapter": "CHAPTER", "section": "SECTION", "annex": "ANNEX", "title": "TITLE", "article": "Article", "amendment": "Amendment", "header": "text proposed by the commission"},
}
POINTS = {"li Point0": "", "li Point1": "", "li Point1letter": "  ", "li Point2": "  ", "li ManualPointlet": "  ", "li Point3": "    "}
NUMBERED = {"li NumPar1", "li ManualNumPar1", "li NumPar2", "li ManualNumPar2"}
ENDS = {"oj-final", "oj-doc-end", "oj-signatory"}
HIDDEN = {"oj-ti-art", "oj-sti-art", "oj-ti-section-1", "oj-ti-section-2", "oj-doc-ti"}
VOID = {"area", "base", "br", "col", "hr", "img", "input", "link", "meta", "source", "wbr"}
ROMAN = {roman(n): n for n in range(1, 100)}

ELEMENT = "file string, pos int, last int, parent int, tag string, classes array<string>, id string, text string, path string, cells array<array<string>>, lines string"


_NONE: set[str] = set()


class Node:
    """An element: tag, attributes, classes, children (elements and texts). `said` has the
    document's texts in order, those in scripts left out; the element's are from start to end."""

    __slots__ = ("tag", "attrs", "children", "parent", "said", "start", "end")

    def __init__(self, tag: str, attrs: dict, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self.said: list[str] = [] if parent is None else parent.said
        self.start = self.end = len(self.said)

    @property
    def classes(self) -> set[str]:
        style = self.attrs.get("class")
        return set(style.split()) if style else _NONE

    @property
    def style(self) -> str:
        return " ".join((self.attrs.get("class") or "").split())

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n is not self and n.tag in tags]

    def text(self) -> str:
        return tidy(" ".join(self.said[self.start : self.end]))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def leave(self, until: Node | None) -> None:
        """Ends the open elements below `until`."""
        while self.at is not until:
            self.at.end = len(self.root.said)
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "tr", "td", "li") and self.at.tag == tag:  # left open
            self.leave(self.at.parent)
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:  # an end without a start is left out
            self.leave(node.parent)

    def handle_data(self, data):
        self.at.children.append(data)
        if self.at.tag not in ("script", "style") and (text := data.strip()):
            self.root.said.append(text)

    def close(self):
        super().close()
        self.leave(None)


def tree(html: str) -> Node:
    reader = _Tree()
    reader.feed(html or "")
    reader.close()
    return reader.root


def tidy(text: str) -> str:
    text = text.replace("\u00a0", " ")
    return (re.sub(r"[ \t]{2,}", " ", text) if "  " in text or "\t" in text else text).strip()


def rows_of(table: Node) -> list[list[Node]]:
    """Cells by row, of the table itself and not of those inside its cells."""
    out, stack = [], list(reversed(table.children))
    while stack:
        node = stack.pop()
        if isinstance(node, Node) and node.tag == "tr":
            out.append([c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th")])
        elif isinstance(node, Node) and node.tag in ("tbody", "thead", "tfoot"):
            stack += reversed(node.children)
    return out


def cell_lines(cell: Node) -> list[str]:
    """What a cell holds, line by line; tables inside it become lists of their own."""
    out = []
    for child in cell.children:
        if isinstance(child, str):
            out.append(tidy(child))
        elif child.tag == "table":
            out += list_lines(child)
        elif child.tag == "div":
            out += cell_lines(child)
        else:
            out.append(child.text())
    return [x for x in out if x]


def list_lines(table: Node) -> list[str]:
    """A table of marker and body as list items. Of three cells an empty first one is only
    padding; rows of other sizes go; further lines of a body are indented."""
    out = []
    for cells in rows_of(table):
        if len(cells) == 3 and not cells[0].text():
            cells = cells[1:]
        if len(cells) not in (2, 3):
            continue
        marker, lines = cells[0].text(), cell_lines(cells[1])
        if not marker:
            out += ["\n".join(lines)] if lines else []
            continue
        out.append(f"- {marker} {lines[0] if lines else ''}".rstrip())
        out += [f"  {x}" for line in lines[1:] for x in line.split("\n")]
    return out


# ---- elements as rows


def elements(html: str) -> list[tuple]:
    """Elements in document order as (pos, last, parent, tag, classes, id, text, path, cells,
    lines): last is the place of the last element inside, path the tags above it, each behind a
    slash. Elements without class or id inside a paragraph or a cell have no row."""
    root, out = tree(html), []
    stack: list[tuple[Node, int, str, bool]] = [(c, -1, "", False) for c in reversed(root.children) if isinstance(c, Node)]
    pos = 0
    while stack:
        node, parent, path, inner = stack.pop()
        if node.tag in ("p", "div", "table") or node.attrs.get("class") or node.attrs.get("id") or not inner:
            is_table = node.tag == "table"
            cells = [[c.text() for c in row] for row in rows_of(node)] if is_table else None
            out.append([pos, pos, parent, node.tag, (node.attrs.get("class") or "").split(), node.attrs.get("id"), node.text(), path, cells, "\n\n".join(list_lines(node)) if is_table else None])
        own, inside = pos, inner or node.tag in ("p", "td", "th")
        pos += 1
        stack += [(c, own, f"{path}/{node.tag}", inside) for c in reversed(node.children) if isinstance(c, Node)]
    last: dict[int, int] = {}
    for row in reversed(out):  # children come after their parents
        row[1] = max(row[0], last.get(row[0], row[0]))
        last[row[2]] = max(last.get(row[2], -1), row[1])
    return [tuple(r) for r in out]


def element_rows(files: DataFrame) -> DataFrame:
    """ELEMENT rows of `files` (file, html), stored, since templates look at them more than
    once. Null html has no elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string())), pa.string()]
        names = [c.split()[0] for c in ELEMENT.split(", ")]
        for b in batches:
            owner, found = [], []
            for i, html in enumerate(b.column(1)):
                rows = elements(html.as_py() or "")
                owner += [i] * len(rows)
                found += rows
            columns = list(zip(*found)) or [[]] * len(kinds)
            own = b.column(0).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

    return stored(spread(files.select(F.col("file").cast("string"), "html")).mapInArrow(run, ELEMENT), "elements")


def _has(name: str) -> Column:
    return F.array_contains("classes", name)


def _any(names: set[str]) -> Column:
    return F.arrays_overlap("classes", F.array(*map(F.lit, sorted(names))))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _bold(text: Column) -> Column:
    return F.regexp_replace(text, r"^(\d+)\.\s+", r"**$1.** ")


def _is_roman(number: Column) -> Column:
    return F.coalesce(number.isin(list(ROMAN)), F.lit(False))


def _joined(value: Column, between: str = "\n\n") -> Column:
    """Of a group, the values that aren't null or empty, by place."""
    found = F.filter(F.collect_list(F.struct("pos", value.alias("x"))), lambda r: r["x"] != "")
    return F.array_join(F.transform(F.array_sort(found), lambda r: r["x"]), between)


def _first(value: str, test: Column) -> Column:
    return F.min_by(value, F.when(test, F.col("pos")))


def _place(heads: DataFrame, entities: DataFrame) -> DataFrame:
    """`entities` (file, pos, ...) with chapter, chapter_title, section, section_title. `heads`:
    file, pos, head (chapter, section or title), number, text. The first title after a head is
    its title; a section without a number takes none; a section ends with its chapter."""
    before = F.lag(F.struct("head", "number")).over(W.partitionBy("file").orderBy("pos"))
    heads = heads.withColumn("before", before)
    titled = (F.col("head") == "title") & ((F.col("before.head") == "chapter") | ((F.col("before.head") == "section") & F.col("before.number").isNotNull()))
    both = entities.unionByName(heads, allowMissingColumns=True)
    at = lambda value: F.struct("pos", F.col(value).alias("v"))
    marks = {k: (F.coalesce(F.col("head") == k, F.lit(False)), at("number")) for k in ("chapter", "section")}
    marks |= {f"{k}_title": (F.coalesce(titled & (F.col("before.head") == k), F.lit(False)), at("text")) for k in ("chapter", "section")}
    rows = last_markers(both, ["file"], ["pos"], marks, None).where("head IS NULL")
    here = F.col("section.pos") > F.coalesce(F.col("chapter.pos"), F.lit(-1))
    title = lambda k: F.when(F.col(f"{k}_title.pos") > F.col(f"{k}.pos"), F.col(f"{k}_title.v"))
    return rows.select(
        *entities.columns, F.coalesce("chapter.v", F.lit("")).alias("chapter"), F.coalesce(title("chapter"), F.lit("")).alias("chapter_title"),
        F.when(here, F.col("section.v")).alias("section"), F.when(here, title("section")).alias("section_title"),
    )


def _inside(rows: DataFrame, name: str, begins: Column, span: Column, **more: tuple[Column, Column]) -> DataFrame:
    """The rows with `name`: the `span` (a struct with pos and last) of the last row at or before
    them where one `begins`, if it hasn't ended; rows in none go. `more` carries other marks along.
    Spans are rows themselves, so nothing is joined to them."""
    return last_markers(rows, ["file"], ["pos"], {name: (begins, span)} | more, None).where(F.col("pos") <= F.col(f"{name}.last"))


def _below(span: str) -> Column:
    """Whether only divs are between the span's element and this one."""
    return F.regexp_like(F.expr(f"substring(path, length({span}.path) + 1)"), F.lit("^(/div)*$"))


def _block(heads: bool = False) -> Column:
    """A paragraph, heading or list of the journal's template in Markdown; null if it is none."""
    text = F.when(_has("oj-ti-grseq-1"), F.concat(F.lit("### "), "text"))
    if heads:
        text = text.when(_has("oj-doc-ti"), F.concat(F.lit("## "), "text")).when(_any({"oj-ti-section-1", "oj-ti-section-2"}), F.concat(F.lit("### "), "text"))
    text = text.when(~_any(HIDDEN), _bold(F.col("text")))
    return F.when((F.col("tag") == "p") & (F.col("text") != ""), text).when(F.col("tag") == "table", F.col("lines"))


def _entity(rows: DataFrame) -> DataFrame:
    """The columns of an entity, those that a kind doesn't have being null."""
    names = ["title", "chapter", "chapter_title", "section", "section_title"]
    missing = {n: F.lit(None).cast("string") for n in names if n not in rows.columns}
    rows = rows.withColumns(missing | {"char_count": F.length("body_text").cast("long")})
    return rows.select("file", "kind", "number", *names, "body_md", "body_text", "char_count", "anchor")


def journal_entities(files: DataFrame, lang: str = "nl") -> DataFrame:
    """Articles, recitals and annexes of documents in the journal's template."""
    words, rows = HEADINGS[lang], element_rows(files)
    kind, number = F.split_part("text", F.lit(" "), F.lit(1)), F.regexp_extract("text", "(?s)^[^ ]* (.*)$", 1)
    heading = F.when(_has("oj-ti-section-1"), F.when(kind == words["chapter"], "chapter").when(kind == words["section"], "section")).when(_has("oj-ti-section-2"), "title")
    value = F.when(heading == "chapter", F.when(_is_roman(number), number).otherwise("")).when(heading == "section", F.when(number.rlike(r"^\d+$"), number))
    heads = rows.where(heading.isNotNull()).select("file", "pos", heading.alias("head"), value.alias("number"), "text")

    is_entity = (F.col("tag") == "div") & _has("eli-subdivision") & F.coalesce(F.col("id").rlike(r"^(art|rct)_\d+$"), F.lit(False))
    is_title = F.coalesce((F.col("tag") == "div") & _has("eli-title"), F.lit(False))
    content = _inside(by_keys(rows, "file"), "own", is_entity, F.struct("pos", "last", "path"), head=(is_title, F.struct("pos", "last", "parent")))
    itself, below = F.col("pos") == F.col("own.pos"), F.col("pos") > F.col("own.pos")
    hidden = F.coalesce((F.col("head.parent") == F.col("own.pos")) & (F.col("pos") <= F.col("head.last")), F.lit(False))
    body = F.when(below & _below("own") & ~hidden, _block())
    found = content.groupBy("file", F.col("own.pos").alias("pos")).agg(
        _first("id", itself).alias("anchor"), _first("text", itself).alias("body_text"), _joined(body).alias("body"),
        _first("text", below & _has("oj-sti-art")).alias("title"), _first("cells", below & (F.col("tag") == "table")).alias("cells"),
    )
    found = found.withColumn("number", F.regexp_extract("anchor", r"_(\d+)$", 1))
    articles = _place(heads, found.where(F.col("anchor").startswith("art")).drop("cells"))
    articles = articles.select("*", F.lit("article").alias("kind"), F.concat(_strip(F.coalesce("body", F.lit(""))), F.lit("\n")).alias("body_md")).withColumn("title", F.coalesce("title", F.lit("")))
    whole = F.coalesce(F.nullif(F.get(F.get("cells", F.lit(0)), F.lit(1)), F.lit("")), F.col("body_text"))
    recitals = found.where(F.col("anchor").startswith("rct")).withColumn("body_text", whole).select("file", F.lit("recital").alias("kind"), "number", "body_text", F.concat("body_text", F.lit("\n")).alias("body_md"), "anchor")
    return _entity(articles).unionByName(_entity(recitals)).unionByName(_annexes(rows, words["annex"]))


def _annexes(rows: DataFrame, word: str) -> DataFrame:
    """What stands between the heading of an annex and the next, or the end of the document:
    elements beside the heading, with all that is in them."""
    number = F.regexp_extract("text", rf"^{word}\s+([IVX]+)$", 1)
    is_head = (F.col("tag") == "p") & _has("oj-doc-ti") & _is_roman(number)
    stops = _any(ENDS) | (_has("oj-doc-ti") & F.col("text").startswith(word)) | is_head
    head = F.struct("pos", number.alias("number"), F.coalesce("id", F.concat(F.lit(f"{word.lower()}_"), number)).alias("anchor"))
    rows = last_markers(by_keys(rows, "file"), ["file", "parent"], ["pos"], {"head": (is_head, head), "stop": (stops, F.col("pos"))}, None)
    is_child = F.coalesce((F.col("head.pos") < F.col("pos")) & (F.col("stop") == F.col("head.pos")), F.lit(False))
    rows = last_markers(rows, ["file"], ["pos"], {"child": (is_child, F.struct("pos", "last", "path", F.col("head.pos").alias("head_pos")))}, None)
    # A row may be a heading and in another's annex too: then it counts for both.
    own = F.when(F.col("head.pos") == F.col("pos"), F.struct(F.col("pos").alias("of"), F.lit(True).alias("heads")))
    inner = F.when(F.col("pos") <= F.col("child.last"), F.struct(F.col("child.head_pos").alias("of"), F.lit(False).alias("heads")))
    content, heads = rows.withColumn("in", F.explode(F.array_compact(F.array(own, inner)))), F.col("in.heads")
    found = content.groupBy("file", F.col("in.of").alias("head_pos")).agg(
        _first("head.number", heads).alias("number"), _first("head.anchor", heads).alias("anchor"),
        _joined(F.when(~heads & _below("child"), _block(heads=True))).alias("body"), _joined(F.when(~heads & (F.col("child.pos") == F.col("pos")), F.col("text"))).alias("body_text"),
        _first("text", ~heads & (F.col("tag") == "p") & _has("oj-doc-ti")).alias("title"),
    ).fillna("", ["title"])
    return _entity(found.select("file", F.lit("annex").alias("kind"), "number", "title", "anchor", F.concat(_strip(F.col("body")), F.lit("\n")).alias("body_md"), _strip(F.col("body_text")).alias("body_text")))


def _styled() -> Column:
    """A paragraph of the word processor's template, by its style."""
    style = F.array_join("classes", " ")
    out = F.when(F.col("text") == "", F.lit(None).cast("string"))
    for name, indent in POINTS.items():
        out = out.when(style == name, F.concat(F.lit(f"{indent}- "), "text"))
    return out.when(style.isin(sorted(NUMBERED)), _bold(F.col("text"))).when(style.contains("SectionTitle"), F.concat(F.lit("### "), "text")).otherwise(F.col("text"))


def proposal_entities(files: DataFrame, lang: str = "nl") -> DataFrame:
    """Articles, recitals and annexes of documents in the word processor's template, which is
    flat: an entity ends where the next heading of one begins."""
    words, rows = HEADINGS[lang], element_rows(files)
    is_article, is_annex = _has("Titrearticle"), ~_has("Titrearticle") & _has("Annexetitre")
    rule = F.when(is_article, F.regexp_extract("text", rf"^{words['article']}\s+(\d+)(?:\s+(?s:.+))?$", 1)).when(is_annex, F.regexp_extract("text", rf"^{words['annex']}\s+([IVX]+)(?s:\s*.*)$", 1))
    title = F.when(is_article, F.regexp_extract("text", rf"^{words['article']}\s+\d+(?:\s+((?s:.+)))?$", 1)).when(is_annex, F.regexp_extract("text", rf"^{words['annex']}\s+[IVX]+\s*((?s:.*))$", 1))
    recital = F.regexp_extract("text", r"^\((\d+)\)\s*(?s:.*)$", 1)
    is_recital = ~is_article & ~is_annex & _has("ManualConsidrant") & (recital != "") & F.col("tag").isin("p", "div", "table")
    is_section = ~is_article & ~is_annex & ~is_recital & _has("SectionTitle")
    role = F.when(is_article, "article").when(is_annex, "annex").when(is_recital, "recital").when(is_section, "section")
    rows = rows.withColumn("role", role).withColumn("text", F.when(F.col("tag").isin("p", "div", "table"), F.col("text")).otherwise(""))

    kind, number = F.upper(F.split_part("text", F.lit(" "), F.lit(1))), F.regexp_extract("text", "(?s)^[^ ]* (.*)$", 1)
    heading = F.when((kind == words["title"]) & _is_roman(F.upper(number)), "chapter").when((kind == words["chapter"]) & number.rlike(r"^\d+$"), "section").otherwise("title")
    heads = rows.where("role = 'section'").select("file", "pos", heading.alias("head"), F.when(heading == "chapter", F.upper(number)).otherwise(number).alias("number"), "text")

    spans = rows.where(F.col("role").isin("article", "annex")).select("file", "pos", F.col("role").alias("kind"), rule.alias("number"), F.trim(F.coalesce(title, F.lit(""))).alias("title"))
    own = F.struct("pos", F.col("role").alias("kind"), rule.alias("number"), F.lit(2**31 - 1).alias("last"))
    content = _inside(rows, "own", F.col("role").isin("article", "annex"), own).where((F.col("own.number") != "") & ~F.coalesce(F.col("role").isin("article", "annex", "recital"), F.lit(False)) & ~F.contains("path", F.lit("/table")))
    in_annex = F.col("own.kind") == "annex"
    lines = F.transform("cells", lambda row: F.array_join(F.filter(row, lambda x: x != ""), " | "))
    flat = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    md = F.when(F.col("role") == "section", F.when(in_annex, _styled())).when(F.col("tag") == "p", _styled()).when((F.col("tag") == "table") & in_annex, flat)
    plain = F.when(F.col("role") == "section", F.when(in_annex, F.col("text"))).when(F.col("tag") == "p", F.col("text")).when((F.col("tag") == "table") & in_annex, flat)
    found = content.groupBy("file", F.col("own.pos").alias("pos")).agg(_joined(md).alias("body"), _joined(plain).alias("body_text"))
    found = spans.where("number <> ''").join(found, ["file", "pos"], "left").fillna("", ["body", "body_text"])
    found = found.withColumn("body_md", F.concat(_strip(F.col("body")), F.lit("\n"))).withColumn("body_text", _strip(F.col("body_text"))).drop("body").withColumn("anchor", F.lit(None).cast("string"))
    articles = _place(heads, found.where("kind = 'article'"))
    recitals = rows.where("role = 'recital'").select("file", F.lit("recital").alias("kind"), recital.alias("number"), _strip(F.regexp_extract("text", r"^\(\d+\)\s*((?s:.*))$", 1)).alias("body_text"), F.lit(None).cast("string").alias("anchor"))
    recitals = recitals.withColumn("body_md", F.concat("body_text", F.lit("\n")))
    return _entity(articles).unionByName(_entity(found.where("kind = 'annex'"))).unionByName(_entity(recitals))


def amendment_rows(files: DataFrame, lang: str = "nl") -> DataFrame:
    """file, number, target, old_text, new_text, body_md, char_count of the amendments of
    comparisons: target is up to four headings after the amendment's own, joined; the columns
    are those of the first table before the next one, with the tables inside it. char_count is
    of the right column alone in English, else of both."""
    words, rows = HEADINGS[lang], element_rows(files)
    number = F.regexp_extract("text", rf"^{words['amendment']}\s+(\d+)$", 1)
    is_head = _has("oj-ti-grseq-1")
    spans = rows.where(is_head & (number != "")).select("file", "pos", number.cast("int").alias("number"))
    content = _inside(rows, "own", is_head & (number != ""), F.struct("pos", F.lit(2**31 - 1).alias("last")))
    content = content.where((is_head | (F.col("tag") == "table")) & (F.col("pos") > F.col("own.pos"))).withColumn("of", F.col("own.pos"))
    in_order = W.partitionBy("file", "of").orderBy("pos")
    heads = content.where(is_head).withColumn("nth", F.row_number().over(in_order)).where("nth <= 4")
    heads = heads.groupBy("file", "of").agg(_joined(F.col("text"), " — ").alias("target"))
    tables = content.where((F.col("tag") == "table") & ~is_head).withColumn("end", F.first("last").over(in_order)).where(F.col("pos") <= F.col("end"))
    cells = tables.select("file", "of", "pos", F.posexplode("cells").alias("row", "texts"))
    joined = F.trim(F.lower(F.array_join("texts", " | ")))
    header = joined.contains(words["header"]) | joined.isin([x.format(w) for w in ("amendment", "amendement") for x in ("{}", "| {}", "{} |")])
    kept = cells.where(~header & F.exists("texts", lambda t: t != "") & (F.size("texts") <= 2))
    sides = F.array_sort(F.collect_list(F.struct("pos", "row", F.get("texts", F.lit(0)).alias("left"), F.element_at("texts", -1).alias("right"))))
    sides = kept.groupBy("file", "of").agg(sides.alias("s")).select("file", "of", F.array_join("s.left", "\n\n").alias("old_text"), F.array_join("s.right", "\n\n").alias("new_text"))
    found = spans.select("file", F.col("pos").alias("of"), "number").join(heads, ["file", "of"], "left").join(sides, ["file", "of"], "left").fillna("", ["target", "old_text", "new_text"])
    column = lambda c: F.when(F.col(c) == "", "*(—)*").otherwise(F.col(c))
    md = F.concat(F.when(F.col("target") != "", F.concat(F.lit("**"), "target", F.lit("**\n\n"))).otherwise(""), F.lit("## 1\n\n"), column("old_text"), F.lit("\n\n## 2\n\n"), column("new_text"), F.lit("\n"))
    n = F.length("new_text") if lang == "en" else F.length("old_text") + F.length("new_text")
    return found.select("file", "number", "target", "old_text", "new_text", md.alias("body_md"), n.cast("long").alias("char_count"))
