"""Inline links: each known reference in a text becomes an anchor."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

REFS = "array<struct<raw:string,target:string,href:string,external:boolean,class:string>>"
#: What is escaped, and the marks of an anchor that leaves the site.
ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"})
LEAVES, MARK = ' target="_blank" rel="noopener"', '<span class="ref-external-mark" aria-hidden="true"> ↗</span>'


def anchor(ref: dict, shown: str) -> str:
    kind = f'class="{ref["class"]}" ' if ref.get("class") else ""
    href = (ref["href"] or "").replace("&", "&amp;").replace('"', "&quot;")
    leaves, mark = (LEAVES, MARK) if ref["external"] else ("", "")
    return f'<a {kind}href="{href}"{leaves}>{shown.translate(ESCAPES)}{mark}</a>'


@lru_cache(maxsize=512)
def _any_of(words: tuple[str, ...], apart: bool) -> re.Pattern:
    """Finds one of the words, the longest first; apart: not inside a word or brackets."""
    found = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    return re.compile(rf"(?<![\w(])({found})(?![\w)])" if apart else f"({found})")


def shown_as(raw: str, refs: list[dict]) -> str:
    """A reference that is found in a text, as markup: one anchor for a single target; for
    several, an anchor on the name of each."""
    by_target = {r["target"]: r for r in refs}
    if len(by_target) == 1:
        return anchor(refs[-1], raw)
    names = tuple(sorted(t for t in by_target if t))
    between_and_names = _any_of(names, True).split(raw) if names else [raw]
    return "".join(anchor(by_target[x], x) if i % 2 else x.translate(ESCAPES) for i, x in enumerate(between_and_names))


def linked(text: str | None, refs: list[dict]) -> str | None:
    """The text with anchors. Longer references are tried first; for equal ones external
    beats internal; one that stands for several targets gets an anchor for each. Only what
    is matched is escaped. Null and empty texts stay."""
    refs = [r for r in refs if r["raw"]]
    if not text or not refs:
        return text
    leaving = {r["raw"] for r in refs if r["external"]}
    markup = {raw: shown_as(raw, [r for r in refs if r["raw"] == raw and bool(r["external"]) == (raw in leaving)]) for raw in {r["raw"] for r in refs}}
    pieces = _any_of(tuple(sorted(markup)), False).split(text)
    return "".join(markup[x] if i % 2 else x for i, x in enumerate(pieces))


@F.pandas_udf(StringType())
def _linked(text: pd.Series, refs: pd.Series) -> pd.Series:
    return pd.Series([linked(t, [] if r is None else list(r)) for t, r in zip(text, refs)])


def link_references(text: Column, refs: Column) -> Column:
    """`refs` is an array as in REFS; the references of a text travel with it, so nothing
    is broadcast. Matching an alternation needs Python; texts without references pass by."""
    some = F.coalesce(F.size(refs), F.lit(0)) > 0
    return F.when(some, _linked(F.when(some, text), F.when(some, refs.cast(REFS)))).otherwise(text)
