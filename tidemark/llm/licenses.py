"""Operator 6 [native]: licence scans by Dice coefficient over word bigrams.

Text is normalised (lower case, runs of anything but letters and digits become one space) and compared
with licence templates by the Dice coefficient of the sets of word bigrams. Units are every line, every
paragraph of several lines (lines up to one without a letter or digit, so comment marks and CRLF end
one too), and windows: where a template's telling bigram stands, as many words as the template has, so
placed that the bigram has the same place in both. Windows find whole licences over many paragraphs,
and notices inside longer lines or wrapped comment blocks.

Two bounds prune templates before any sets are intersected: with coefficient t at least, the sizes of
the sets lie within a factor (2 - t) / t of each other, and the sets share t / (2 - t) of the
template's bigrams, so that a text without any of the template's chosen few bigrams cannot reach it;
that one pattern over each whole text is all that most documents cost. DataFrame operations only;
templates are a short fixed list, so units meet them where they lie and nothing is shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

THRESHOLD = 0.8
#: Fixed values: (licence, text of a notice or of a licence's main paragraph).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("proprietary", "All rights reserved."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
)
_OTHER = r"[^\p{L}\p{N}]+"
#: A word with what stands before it, and what ends a paragraph: a line without a letter or digit.
_SEGMENT, _BLANK = r"[^\p{L}\p{N}]*[\p{L}\p{N}]+", r"(?<=\n)[^\p{L}\p{N}\n]*\n"


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def _least(n: int, threshold: float) -> int:
    """Bigrams of a template of n that a unit must share."""
    return math.ceil(threshold / (2 - threshold) * n - 1e-9)


def _telling(bigrams: list[str], threshold: float) -> list[str]:
    """Bigrams of a template of which every unit that reaches it has one.

    A unit shares ``_least`` of a template's bigrams, so it has one of any n - least + 1 of them; the
    longest are taken, since they are rare.
    """
    return sorted(bigrams, key=lambda x: (-len(x), x))[: len(bigrams) - _least(len(bigrams), threshold) + 1]


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, common beginnings written once, so that few branches are tried at each place."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(h).replace("\\ ", " ") + (tails[0] and re.escape(tails[0]).replace("\\ ", " ") if len(tails) == 1 else f"(?:{_any_of(tails)})") for h, tails in heads.items()]
    return "|".join(parts)


class _Set:
    """Templates prepared for one threshold."""

    def __init__(self, templates, threshold: float):
        self.rows = []  # (number, name, words, bigrams)
        places: dict[str, list] = {}
        for i, (name, text) in enumerate(templates):
            words, bigrams = words_of(text), bigrams_of(text)
            if not bigrams:
                continue
            self.rows.append((i, name, len(words), bigrams))
            at = {}
            for k, b in enumerate(f"{x} {y}" for x, y in zip(words, words[1:])):
                at.setdefault(b, k)
            for b in _telling(bigrams, threshold):
                places.setdefault(b, []).append((len(self.rows), at[b]))
        self.places = dict(sorted(places.items()))  # telling bigram: [(place in rows from 1, place in the template)]
        # the same pattern for texts as they are but for case, and for normal forms
        self.raw = f"(?<![\\p{{L}}\\p{{N}}])(?:{_any_of(list(self.places))})(?![\\p{{L}}\\p{{N}}])".replace(" ", _OTHER)
        self.pattern = f"(?:^| )(?:{_any_of(list(self.places))})(?: |$)"

    def listed(self):
        return F.array(*[F.struct(F.lit(i).alias("no"), F.lit(name).alias("license"), F.lit(w).alias("w"), F.lit(len(b)).alias("n"), F.array(*map(F.lit, b)).alias("b")) for i, name, w, b in self.rows])


def _bigrams(words):
    last = F.size(words) - 1
    return F.when(last > 0, F.zip_with(F.slice(words, F.lit(1), F.greatest(last, F.lit(0))), F.slice(words, F.lit(2), F.greatest(last, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, unit, unit_no, start, end, license, template_no, dice)``: every template that a unit reaches.

    ``unit`` is ``line``, ``paragraph`` (if more than one line) or ``window``; ``unit_no`` counts from 0
    in the document (for a window, its first word's number), ``start`` and ``end`` are character
    offsets in the text. Of windows of one template that overlap only the best stays (of equals the
    first). Documents that match nothing, null and empty texts give no row; repeated rows match
    repeatedly; a null id stays null; other columns are ignored; an empty table gives an empty result.
    Templates of less than two words cannot match.
    """
    known = _Set(templates, threshold)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    norm = lambda x: F.trim(F.regexp_replace(F.lower(x), _OTHER, " "))
    tells = lambda x: F.coalesce(F.regexp_like(x, F.lit(known.pattern)), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # what most documents cost: one search; the few that have a telling bigram are written down for both kinds of unit
    rows = durable(rows.where(F.coalesce(F.regexp_like(F.lower("text"), F.lit(known.raw)), F.lit(False))))
    listed = known.listed()

    def unit(parts, name: str):
        """Parts that are no separators, with their place; ``parts`` hold the whole text."""
        structs = F.transform(parts, lambda x, i: F.struct(F.lit(name).alias("unit"), i.alias("i"), norm(x).alias("s")))
        wanted = (lambda u, x: tells(u["s"])) if name == "line" else (lambda u, x: F.contains(F.rtrim(x), F.lit("\n")) & tells(u["s"]))
        return F.filter(structs, lambda u: wanted(u, F.get(parts, u["i"])))

    # a paragraph keeps its last line break; one mark stands where paragraphs part
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.col("text"), F.lit("\n")), _BLANK, "$0\0")
    rows = _held(rows, lines=F.split("text", "\n"), paragraphs=F.split(marked, "\0"))
    units = rows.select("doc_id", "lines", "paragraphs", F.explode(F.concat(unit(F.col("lines"), "line"), unit(F.col("paragraphs"), "paragraph"))).alias("u"))
    units = _held(units, words=F.split("u.s", " "))
    units = _held(units, pairs=F.array_distinct(_bigrams(F.col("words")))).withColumn("n", F.size("pairs"))
    # the size bounds come first: only templates of fitting size are intersected
    fitting = F.filter(listed, lambda t: (F.col("n") >= t["n"] * low - 1e-9) & (F.col("n") <= t["n"] * high + 1e-9))
    units = units.withColumn("t", F.explode(fitting))
    units = units.withColumn("dice", 2.0 * F.size(F.array_intersect("pairs", "t.b")) / (F.col("n") + F.col("t.n"))).where(F.col("dice") >= threshold)
    is_line = F.col("u.unit") == "line"
    part = F.get(F.when(is_line, F.col("lines")).otherwise(F.col("paragraphs")), F.col("u.i"))
    lengths = F.aggregate(F.slice(F.when(is_line, F.col("lines")).otherwise(F.col("paragraphs")), F.lit(1), F.col("u.i")), F.lit(0), lambda n, x: n + F.length(x))
    # lines are parted by a break each; the paragraphs' text has one break put before it
    start = F.when(is_line, lengths + F.col("u.i")).otherwise(F.greatest(lengths - 1, F.lit(0)))
    body = F.when(is_line | (F.col("u.i") > 0), part).otherwise(F.substr(part, F.lit(2)))
    end = start + F.length(F.when(is_line, body).otherwise(F.rtrim(body, F.lit("\n"))))
    found = units.select("doc_id", "u.unit", F.col("u.i").alias("unit_no"), start.cast("long").alias("start"), end.cast("long").alias("end"), "t.license", F.col("t.no").alias("template_no"), F.round("dice", 9).alias("dice"))
    return found.unionByName(_windows(rows.select("doc_id", "text"), known, listed, threshold, low, high))


def _held(rows: DataFrame, **columns) -> DataFrame:
    """``rows`` with more columns, each computed once a row: the optimizer would else put them into every lambda that reads them."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return rows.select("*", one.alias("held")).select(*rows.columns, *[F.col("held")[n].alias(n) for n in columns])


def _windows(rows: DataFrame, known: _Set, listed, threshold: float, low: float, high: float) -> DataFrame:
    rows = _held(rows, segments=F.regexp_extract_all("text", F.lit(_SEGMENT), F.lit(0))).drop("text")
    rows = _held(rows, words=F.transform("segments", lambda x: F.lower(F.regexp_replace(x, "^" + _OTHER, ""))))
    rows = _held(rows, hits=F.filter(F.transform(_bigrams(F.col("words")), lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lambda h: h["b"].isin(*known.places)))
    where = F.create_map(*[x for b, at in known.places.items() for x in (F.lit(b), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(o).alias("o")) for t, o in at]))])
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(where, h["b"]), lambda x: F.struct(x["t"].alias("t"), F.greatest(h["i"] - x["o"], F.lit(0)).alias("at"))))))
    rows = _held(rows.where(F.size("hits") > 0), starts=starts, known=listed).drop("hits")

    def rated(x):
        t = F.element_at("known", x["t"])
        pairs = F.array_distinct(_bigrams(F.slice("words", x["at"] + 1, t["w"])))
        fits = (F.size(pairs) >= t["n"] * low - 1e-9) & (F.size(pairs) <= t["n"] * high + 1e-9)
        dice = F.when(fits, 2.0 * F.size(F.array_intersect(pairs, t["b"])) / (F.size(pairs) + t["n"])).otherwise(0.0)
        return F.struct(x["t"].alias("t"), x["at"].alias("at"), t["w"].alias("w"), dice.alias("dice"))

    rows = _held(rows, all=F.transform("starts", rated)).drop("starts", "words")
    rows = _held(rows, rated=F.filter("all", lambda x: x["dice"] >= threshold)).drop("all")
    better = lambda v, x: (v["t"] == x["t"]) & (F.abs(v["at"] - x["at"]) < x["w"]) & ((v["dice"] > x["dice"]) | ((v["dice"] == x["dice"]) & (v["at"] < x["at"])))
    best = F.filter("rated", lambda x: ~F.exists("rated", lambda v: better(v, x)))
    rows = rows.where(F.size("rated") > 0).select("doc_id", "segments", F.explode(best).alias("x"), "known")
    length = lambda n: F.aggregate(F.slice("segments", F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    lead = F.length(F.regexp_extract(F.get("segments", F.col("x.at")), "^[^\\p{L}\\p{N}]*", 0))
    last = F.least(F.col("x.at") + F.col("x.w"), F.size("segments"))
    t = F.element_at("known", F.col("x.t"))
    return rows.select("doc_id", F.lit("window").alias("unit"), F.col("x.at").alias("unit_no"), (length(F.col("x.at")) + lead).cast("long").alias("start"), length(last).cast("long").alias("end"), t["license"].alias("license"), t["no"].alias("template_no"), F.round("x.dice", 9).alias("dice"))


def sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same over ``documents`` in DuckDB: every line and paragraph against every template, and every telling bigram's window."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = _Set(templates, threshold)
    rows = ", ".join(f"({i}, {quoted(n)}, {w}, [{', '.join(map(quoted, b))}])" for i, n, w, b in known.rows)
    places = ", ".join(f"({quoted(b)}, {known.rows[t - 1][0]}, {o})" for b, at in known.places.items() for t, o in at)
    return rf"""
WITH t(no, license, w, b) AS (VALUES {rows}), place(g, no, o) AS (VALUES {places}),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents WHERE text IS NOT NULL),
parts AS (
  SELECT doc_id, 'line' AS unit, 1 AS sep, 0 AS shift, string_split(text, chr(10)) AS p FROM d
  UNION ALL SELECT doc_id, 'paragraph', 0, 1, string_split(regexp_replace(replace(chr(10) || text || chr(10), chr(10), chr(10) || chr(1)), '([^\p{{L}}\p{{N}}
]*
)', '' || chr(2), 'g'), chr(2)) FROM d
), units AS (
  SELECT doc_id, unit, sep, shift, list_transform(p, lambda x: replace(x, chr(1), '')) AS p, unnest(range(len(p))) AS i FROM parts
), normal AS (
  SELECT doc_id, unit, i, greatest(coalesce(list_sum(list_transform(p[1:i], lambda x: len(x))), 0) + i * sep - shift, 0) AS start,
         len(CASE WHEN unit = 'line' THEN p[i + 1] WHEN i > 0 THEN rtrim(p[i + 1], chr(10)) ELSE rtrim(substr(p[1], 2), chr(10)) END) AS n_chars,
         string_split(trim(regexp_replace(lower(p[i + 1]), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w
  FROM units WHERE unit = 'line' OR contains(rtrim(p[i + 1]), chr(10))
), grams AS (
  SELECT doc_id, unit, i, start, n_chars, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS g FROM normal WHERE len(w) >= 2
), scored AS (
  SELECT doc_id, unit, i, start, n_chars, license, no, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM grams, t
), seg AS (
  SELECT rid, doc_id, regexp_extract_all(text, '[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]+') AS s FROM d
), word AS (
  SELECT rid, doc_id, s, list_transform(s, lambda x: lower(regexp_replace(x, '^[^\p{{L}}\p{{N}}]+', ''))) AS w FROM seg
), gram AS (
  SELECT rid, unnest(range(len(w) - 1)) AS i, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS g FROM word WHERE len(w) >= 2
), spot AS (
  SELECT DISTINCT rid, no, greatest(i - o, 0) AS pos FROM gram JOIN place USING (g)
), cand AS (
  SELECT rid, no, pos, t.w AS size, license, list_distinct(list_transform(range(pos + 1, least(pos + t.w, len(word.w))), lambda k: word.w[k] || ' ' || word.w[k + 1])) AS g, b FROM spot JOIN t USING (no) JOIN word USING (rid)
), rated AS (
  SELECT rid, no, pos, size, license, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM cand
), good AS (SELECT * FROM rated WHERE dice >= {threshold}), best AS (
  SELECT * FROM good x WHERE NOT EXISTS (SELECT 1 FROM good v WHERE v.rid = x.rid AND v.no = x.no AND abs(v.pos - x.pos) < x.size AND (v.dice > x.dice OR v.dice = x.dice AND v.pos < x.pos))
)
SELECT doc_id, unit, i::INTEGER AS unit_no, start::BIGINT AS start, (start + n_chars)::BIGINT AS "end", license, no::INTEGER AS template_no, round(dice, 9) AS dice
FROM scored WHERE dice >= {threshold}
UNION ALL
SELECT doc_id, 'window', pos::INTEGER, (coalesce(list_sum(list_transform(s[1:pos], lambda x: len(x))), 0) + len(regexp_extract(s[pos + 1], '^[^\p{{L}}\p{{N}}]*')))::BIGINT,
       list_sum(list_transform(s[1:pos + size], lambda x: len(x)))::BIGINT, license, no::INTEGER, round(dice, 9) FROM best JOIN word USING (rid)
"""
