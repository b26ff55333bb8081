"""Operator 3, licence scans: word bigrams of normalised text against licence templates.

A text is normalised to lower-case words without punctuation, so line ends and the marks of
comments don't matter. A notice may stand anywhere in it and may be cut or added to, so a
template is held against every stretch of words (window). With n and m bigrams, repeats
included, of which s are shared, Dice's coefficient is 2 s / (n + m); a window and a template
match from LEAST_DICE on. The best window begins and ends with a shared bigram (to leave out
what isn't shared at its ends only raises the coefficient), and it can't have more than (2 -
LEAST_DICE) / LEAST_DICE m bigrams; so from each shared bigram one pass over those that follow
within that reach finds the best window that begins there. None is missed.

Of a template's windows that overlap, the one of the largest coefficient is kept. Licences
share most of their words, so these words may match several: of windows of different
templates that overlap, the one that shares most bigrams is kept (then the one of the larger
coefficient, then of the longer template), so that a notice of one licence isn't reported as
its neighbours', nor a whole text as another licence's first sentence.

Size bounds prune the templates. As s is at most n, a match needs s >= low m with low =
LEAST_DICE / (2 - LEAST_DICE); so a text of fewer bigrams than low m, or that shares fewer
with the template in all, can't match it, and no window of it is looked at. ANCHORS are
words such that each template keeps fewer bigrams than that without them: a text with no
anchor can't match, and most texts end there.

The rest is an inverted index: a text's bigrams meet the templates' in a join with a fixed
table, and the shared ones are gathered by text and template in pre-aggregated shuffles.
Everything runs in built-in functions; no pair of text and template is formed that shares no
bigram.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbolt.llm.common import table, text_of

LEAST_DICE = 0.8

_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_NO_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
_APACHE_COPY = "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_NO_WARRANTY = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
_APACHE_SEE = "See the License for the specific language governing permissions and limitations under the License."
_GPL_3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_GPL_2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
_UNLICENSE = "This is free and unencumbered software released into the public domain."

#: Licences and notices in the words that projects use for them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE_NO_WARRANTY),
    ("Apache-2.0", f"{_APACHE} {_APACHE_COPY} {_APACHE_NO_WARRANTY} {_APACHE_SEE}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_NO_WARRANTY}"),
    ("BSD-3-Clause", _BSD),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_3} {_BSD_NO_WARRANTY}"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL_3),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GPL_2),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_MIT_NOTICE} {_NO_WARRANTY}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", _ISC),
    ("ISC", f"{_ISC} {_ISC_NO_WARRANTY}"),
    ("Unlicense", _UNLICENSE),
    ("Proprietary", "Copyright, all rights reserved worldwide."),
]

_COMMON = {"a", "all", "and", "any", "are", "as", "at", "be", "by", "can", "either", "for", "in", "is", "it", "may", "no", "not", "of", "on", "or", "that", "the", "this", "to", "under", "use", "used", "v", "with", "without", "you", "0", "2", "3", "4"}


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams_of(text: str) -> Counter:
    w = words_of(text)
    return Counter(f"{a} {b}" for a, b in zip(w, w[1:]))


def anchors(templates: list[tuple[str, str]], least: float = LEAST_DICE) -> list[str]:
    """Words without which every template has too few bigrams left to be matched; chosen
    greedily, those first that are in most templates still open."""
    open_, chosen = [bigrams_of(t) for _, t in templates], []
    while True:
        left = [{b: n for b, n in grams.items() if not set(b.split()) & set(chosen)} for grams in open_]
        short = [x for x, grams in zip(left, open_) if sum(x.values()) >= least * grams.total() / (2 - least)]
        if not short:
            return chosen
        votes: dict[str, int] = {}
        for grams in short:
            for w in sorted({w for b in grams for w in b.split()}):
                votes[w] = votes.get(w, 0) + 1
        chosen.append(max(votes, key=lambda w: (w not in _COMMON, votes[w], w.startswith("licen"), len(w), w)))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _windows(least: float) -> Column:
    """Of `hits`, by place (p, and the place `prev` of the one that it is a repeat too many
    of, once that is in the window): from each the best window that begins with it, as
    (shared, dice, first_word, n_words)."""
    reach = (2 - least) / least

    def best(hit: Column, i: Column) -> Column:
        ahead = F.slice("hits", i + 1, F.ceil(reach * (F.col("length") - 1)).cast("int"))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("shared"), F.lit(0.0).cast("double").alias("dice"), F.lit(0).alias("bigrams"))

        def step(s: Column, h: Column) -> Column:
            n, bigrams = s["n"] + F.when(h["prev"] < hit["p"], 1).otherwise(0), h["p"] - hit["p"] + 1
            dice = 2.0 * n / (bigrams + F.col("length") - 1)
            better = dice > s["dice"]
            keep = lambda new, old: F.when(better, new).otherwise(s[old]).alias(old)
            return F.struct(n.alias("n"), keep(n, "shared"), keep(dice, "dice"), keep(bigrams, "bigrams"))

        found = F.aggregate(ahead, start, step)
        return F.struct(hit["p"].alias("first_word"), found.alias("w"))

    found = F.filter(F.transform("hits", best), lambda x: x["w"]["dice"] >= least)
    return F.transform(found, lambda x: F.struct(x["w"]["shared"].alias("shared"), x["w"]["dice"].alias("dice"), x["first_word"].alias("first_word"), (x["w"]["bigrams"] + 1).alias("n_words")))


def _apart(windows: Column) -> Column:
    """Of windows in their order of preference each that overlaps none kept before it."""
    def step(kept: Column, w: Column) -> Column:
        touched = F.exists(kept, lambda k: (k["first_word"] < w["first_word"] + w["n_words"]) & (w["first_word"] < k["first_word"] + k["n_words"]))
        return F.when(touched, kept).otherwise(F.concat(kept, F.array(w)))

    return F.aggregate(windows, F.slice(windows, 1, 0), step)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """doc_id, license, dice, first_word, n_words: a row for each licence found, for each row
    of `docs`: of its windows that are kept the one of the largest coefficient (of equal ones
    the first), by the place of its first word (from 0) and its length.

    Null and empty texts, and those of one word, match nothing, and no rows give no rows.
    Repeated rows repeat their matches, null ids stay null. Columns other than doc_id and text
    aren't looked at. A text may be of any length; what it shares with one template is held
    together, and so are its windows that match.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    low = least / (2 - least)
    grams = [(name, k, len(words_of(t)), b, n) for k, (name, t) in enumerate(templates) for b, n in sorted(bigrams_of(t).items())]
    known = spark.createDataFrame(grams, "license string, template int, length int, bigram string, times int")  # a fixed table
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("doc_id"), text_of().alias("text"))
    alone = r"(?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, anchors(templates, least))) + r")(?![\p{L}\p{N}])"
    rows = rows.where(F.lower("text").rlike(alone)).select("row", "doc_id", _words(F.col("text")).alias("words"))
    pairs = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    at = rows.select("row", "doc_id", F.size("words").alias("total"), F.posexplode(pairs).alias("p", "bigram")).where("bigram IS NOT NULL")
    met = at.join(F.broadcast(known), "bigram").where(F.col("total") - 1 >= low * (F.col("length") - 1) - 1e-9)

    # Whole texts: what is shared with a template at all; then the hits in order.
    text = ["row", "doc_id", "license", "template", "length"]
    met = met.groupBy(*text, "bigram", "times").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    hits = F.transform("ps", lambda p, i: F.struct(p.alias("p"), F.coalesce(F.get("ps", i - F.col("times")), F.lit(-1)).alias("prev")))
    met = met.groupBy(*text).agg(F.sum(F.least(F.size("ps"), "times")).alias("most"), F.array_sort(F.flatten(F.collect_list(hits))).alias("hits"))
    met = met.where(F.col("most") >= low * (F.col("length") - 1) - 1e-9)

    best = F.transform(_windows(least), lambda w: F.struct((-w["dice"]).alias("worse"), w["first_word"].alias("first_word"), w["n_words"].alias("n_words"), w["shared"].alias("shared")))
    met = met.select("row", "doc_id", "license", "length", F.array_sort(best).alias("windows"))
    met = met.select("row", "doc_id", "license", "length", F.inline(_apart(F.col("windows"))))
    preferred = F.struct((-F.col("shared")).alias("less"), "worse", (-F.col("length")).alias("shorter"), "license", "first_word", "n_words")
    of_text = met.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(preferred)).alias("windows"))
    kept = of_text.select("row", "doc_id", F.inline(_apart(F.col("windows"))))
    best = kept.groupBy("row", "doc_id", "license").agg(F.min(F.struct("worse", "first_word", "n_words")).alias("best"))
    return best.select("doc_id", "license", (-F.col("best.worse")).alias("dice"), "best.first_word", "best.n_words")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_VALUES = ", ".join(f"('{name}', {k}, '" + t.replace("'", "''") + "')" for k, (name, t) in enumerate(TEMPLATES))

OP3_SQL = rf"""
WITH RECURSIVE templates(license, template, t) AS (VALUES {_VALUES}),
tw AS (SELECT license, template, list_filter(string_split(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM templates),
tb AS (SELECT license, template, len(w) AS length, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM tw),
known AS (SELECT license, template, length, bigram, count(*) AS times FROM tb GROUP BY ALL),
doc AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents),
pos AS (SELECT r, doc_id, len(w) AS total, unnest(range(0, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM doc),
met AS (SELECT pos.*, license, template, length, lag(p, CAST(times AS INTEGER), -1) OVER (PARTITION BY r, template, pos.bigram ORDER BY p) AS prev FROM pos JOIN known USING (bigram)),
win AS (SELECT a.r, a.doc_id, a.license, a.template, a.length, a.p AS first, b.p AS last, sum(CASE WHEN b.prev < a.p THEN 1 ELSE 0 END) OVER (PARTITION BY a.r, a.template, a.p ORDER BY b.p) AS shared
  FROM met a JOIN met b ON a.r = b.r AND a.template = b.template AND b.p >= a.p AND b.p <= a.p + ceil({(2 - LEAST_DICE) / LEAST_DICE} * (a.length - 1))),
dice AS (SELECT *, 2.0 * shared / (last - first + 1 + length - 1) AS dice FROM win),
start AS (SELECT * FROM dice WHERE dice >= {LEAST_DICE} QUALIFY row_number() OVER (PARTITION BY r, template, first ORDER BY dice DESC, last) = 1),
own AS (SELECT *, last - first + 2 AS n_words, row_number() OVER (PARTITION BY r, template ORDER BY dice DESC, first, last) AS k FROM start),
own_picked AS (SELECT r, template, k, [{{'f': first, 'n': n_words}}] AS kept, true AS ok FROM own WHERE k = 1
  UNION ALL SELECT x.r, x.template, x.k, CASE WHEN x.ok THEN list_append(x.kept, {{'f': x.first, 'n': x.n_words}}) ELSE x.kept END, x.ok FROM
  (SELECT c.r, c.template, c.k, c.first, c.n_words, p.kept, len(list_filter(p.kept, lambda w: w.f < c.first + c.n_words AND c.first < w.f + w.n)) = 0 AS ok FROM own_picked p JOIN own c ON c.r = p.r AND c.template = p.template AND c.k = p.k + 1) x),
ranked AS (SELECT own.r, doc_id, license, first, n_words, dice, row_number() OVER (PARTITION BY own.r ORDER BY shared DESC, dice DESC, length DESC, license, first, last) AS k FROM own JOIN own_picked o ON o.r = own.r AND o.template = own.template AND o.k = own.k AND ok),
picked AS (SELECT r, k, [{{'f': first, 'n': n_words}}] AS kept, true AS ok FROM ranked WHERE k = 1
  UNION ALL SELECT x.r, x.k, CASE WHEN x.ok THEN list_append(x.kept, {{'f': x.first, 'n': x.n_words}}) ELSE x.kept END, x.ok FROM
  (SELECT c.r, c.k, c.first, c.n_words, p.kept, len(list_filter(p.kept, lambda w: w.f < c.first + c.n_words AND c.first < w.f + w.n)) = 0 AS ok FROM picked p JOIN ranked c ON c.r = p.r AND c.k = p.k + 1) x),
best AS (SELECT ranked.*, row_number() OVER (PARTITION BY ranked.r, license ORDER BY dice DESC, ranked.first, ranked.n_words) AS place FROM ranked JOIN picked ON picked.r = ranked.r AND picked.k = ranked.k AND ok)
SELECT doc_id, license, CAST(dice AS DOUBLE) AS dice, CAST(first AS INTEGER) AS first_word, CAST(n_words AS INTEGER) AS n_words FROM best WHERE place = 1
"""
