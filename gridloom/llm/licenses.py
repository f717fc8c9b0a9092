"""Licence scan with a positional index of rare licence words.

Short notices are looked for as one run of words. Longer ones are cut into parts of about PART words, which are looked for each by
itself; a notice is there where enough of its parts stand in their places, give or take DRIFT words, so words may be added or left out.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words_of


#: Notices of over 1.5 * PART words are cut into parts of about PART words, of which PART_SHARE must stand at their places.
PART, PART_SHARE = 12, 0.7
#: How many words the parts of one notice may be away from their places, against the one that begins earliest.
DRIFT = 16


@dataclass(frozen=True)
class Part:
    """A run of words of the template `t`, from its word `offset` on; `share` of them must stand at their places."""

    t: int
    offset: int
    words: tuple[str, ...]
    share: float

    @property
    def spare(self) -> int:
        """How many of the words may differ."""
        n = len(self.words)
        return max((k for k in range(n) if (n - k) / n >= self.share), default=0)


@dataclass(frozen=True)
class Template:
    """A licence text. `share` of its words (of its parts, if it is long) must stand at their places, and every key phrase must occur in the document."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    share: float = 1.0
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(r"[a-z0-9]+", self.text.lower())

    @property
    def spare(self) -> int:
        """How many of the words may differ in a notice that is not cut."""
        return Part(0, 0, tuple(self.words), self.share).spare

    @property
    def is_long(self) -> bool:
        return len(self.words) > 1.5 * PART

    @property
    def needed(self) -> int:
        """How many parts must be there."""
        return ceil(self.share * len(self.parts(0)) - 1e-9) if self.is_long else 1

    def parts(self, t: int) -> list[Part]:
        words = self.words
        if not self.is_long:
            return [Part(t, 0, tuple(words), self.share)]
        n = round(len(words) / PART)
        cuts = [k * len(words) // n for k in range(n + 1)]
        return [Part(t, x, tuple(words[x:y]), PART_SHARE) for x, y in zip(cuts, cuts[1:], strict=False)]


# Base phrases and the notices the scan knows beyond them.
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("mit-notice", "released under the mit license", ("mit license",), 0.8),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted",), 0.8),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",), 0.8),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",), 0.6),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license version 2",), 0.6),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",), 0.8),
    Template("agpl", "gnu affero general public license", ("affero general public license",), 0.8),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",), 0.8),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",), 0.6),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",), 0.8),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",), 0.8),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",), 0.8),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("public domain dedication",), 0.8),
    # whole texts and standard file headers
    Template("mit-full", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
        OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ("permission is hereby granted",), 0.75),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
        FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        ("with or without fee",), 0.75),
    Template("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
        PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        ("source and binary forms", "reproduce the above copyright notice"), 0.7),
    Template("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
        from this software without specific prior written permission.""", ("endorse or promote products", "prior written permission"), 0.6),
    Template("apache-2.0-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
        or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ("apache license version 2 0",), 0.7),
    Template("gpl-2.0-header", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed
        in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details.""", ("gnu general public license", "version 2 of the license"), 0.7),
    Template("gpl-3.0-header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed
        in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details.""", ("gnu general public license", "version 3 of the license"), 0.7),
    Template("lgpl-header", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""", ("gnu lesser general public license",), 0.7),
    Template("agpl-3.0-header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""", ("gnu affero general public license",), 0.7),
    Template("mpl-2.0-header", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", ("mozilla public license v 2 0",), 0.6),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
        or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means.""", ("unencumbered software",), 0.7),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
        and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented;
        you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
        would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""", ("plainly marked as such",), 0.7),
    Template("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
        prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.""",
        ("obtaining a copy of the software and accompanying",), 0.7),
)
#: Places of a part that the index holds at least: those of its words that the fewest documents have.
RARE_PLACES = 4
_FIELD = 1 << 40  # part (or template) and start in one number, so that candidates sort as plain numbers


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the vocabulary occurs. Counted over all documents; at most one row a word reaches the driver."""
    known = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    rows = words.select(F.explode_outer(known).alias("word")).where("word IS NOT NULL").groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in rows}


def rare_index(parts: list[Part], frequency: dict[str, int]) -> tuple[list[tuple[str, int, int]], list[int]]:
    """Postings (word, part, place) of each part's rarest places, and how many must agree. Ties go to the earlier place.

    Where `spare` words may differ, at most so many of the indexed places disagree, so all the others must agree, at least two if the
    part has them: no start that verification would accept is lost.
    The order is that of the inverse document frequency, which falls as the frequency grows.
    """
    postings, needed = [], []
    for q, part in enumerate(parts):
        places = sorted(range(len(part.words)), key=lambda j: (frequency.get(part.words[j], 0), j))[: max(RARE_PLACES, part.spare + 2)]
        postings += [(part.words[j], q, j) for j in places]
        needed.append(len(places) - part.spare)
    return postings, needed


def _constant(values: list, kind: str) -> Column:
    """A (nested) array as one literal: the optimiser reads the text once, where an expression for each element would have to be analysed."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _longs(values: list[int]) -> Column:
    return _constant(values, "array<bigint>")


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row for each row of docs (doc_id, text): its words, the places of base phrases, the labels found and a score.

    Each document's words that are in the index are looked up; every posting gives a part and a start (place in the document less
    place in the part). Starts on which enough postings agree are verified against all the part's words. A notice is found where enough of
    its verified parts have it begin within DRIFT words, and where its key phrases occur in the document.
    A base phrase counts at each start where all its words stand. score is the largest share of a notice that was found (of its words, or of
    its parts if it is long), 0.0 without one. Null and empty texts have no words, no labels ('') and null places. Everything happens
    within the row, over whole texts: no shuffle, no limit on matches. Repeated rows have equal results; an empty table gives an empty one.
    """
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    parts = [p for t, template in enumerate(templates) for p in template.parts(t)]
    vocabulary = sorted({w for p in parts for w in p.words})
    postings, needed = rare_index(parts, document_frequencies(words, vocabulary))
    indexed = sorted({w for w, _, _ in postings})
    by_word = {w: [q * _FIELD + _FIELD // 2 - j for x, q, j in postings if x == w] for w in indexed}
    lists = _constant([by_word[w] for w in indexed], "array<array<bigint>>")
    number = _constant(indexed, "array<string>")
    texts = _constant([p.words for p in parts], "array<array<string>>")

    at = lambda array, i: F.get(array, i.cast("int"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(indexed), F.struct(i.cast("bigint").alias("i"), w.alias("w")))), lambda h: h.isNotNull())
    out = words.select("doc_id", "words", F.size("words").cast("bigint").alias("n_words"), hits.alias("hits"))

    codes = F.flatten(F.transform("hits", lambda h: F.transform(at(lists, F.array_position(number, h["w"]) - 1), lambda c: c + h["i"])))
    out = out.select("doc_id", "words", "n_words", F.when(F.size("hits") > 0, F.sort_array(codes)).alias("codes"), F.size("hits").alias("n_hits"))

    id_of = lambda c: F.shiftright(c, 40)
    start_of = lambda c: c.bitwiseAND(_FIELD - 1) - _FIELD // 2
    agree = lambda c, i: ((i == 0) | (F.get("codes", i - 1) != c)) & (at(F.col("codes"), i + at(_longs(needed), id_of(c)) - 1) == c)
    found = F.transform(F.filter("codes", agree), lambda c: F.struct(id_of(c).alias("q"), start_of(c).alias("start")))
    out = out.select("doc_id", "words", "n_words", F.when(F.col("codes").isNotNull(), found).alias("found"), F.size("codes").alias("n_codes"))

    def same(f: Column) -> Column:
        mine = at(texts, f["q"])
        return F.size(F.filter(F.transform(mine, lambda w, j: at(F.col("words"), f["start"] + j) == w), lambda x: x)) / F.size(mine)

    shares = F.transform("found", lambda f: F.struct(f["q"].alias("q"), f["start"].alias("start"), same(f).alias("share")))
    text = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    out = out.select("doc_id", "n_words", F.when(F.size("found") > 0, shares).alias("found"), F.when(F.size("found") > 0, text).alias("joined"))

    has_keys = F.array(*(F.lit(True) if not t.keys else F.forall(F.array(*(F.lit(f" {k} ") for k in t.keys)), lambda k: F.col("joined").contains(k)) for t in templates))
    out = out.select("doc_id", "n_words", "found", F.when(F.col("joined").isNotNull(), has_keys).alias("keys"), F.size("found").alias("n_found"))
    minimum, owner, offset = _constant([p.share for p in parts], "array<double>"), _longs([p.t for p in parts]), _longs([p.offset for p in parts])
    long = F.array(*(F.lit(t.is_long) for t in templates))
    verified = F.filter("found", lambda f: (f["share"] >= at(minimum, f["q"])) & at(F.col("keys"), at(owner, f["q"])))
    v = F.transform(verified, lambda f: F.struct(at(owner, f["q"]).alias("t"), (f["start"] - at(offset, f["q"])).alias("start"), f["share"].alias("share")))
    # a second use of `keys` keeps Spark from folding its projection into this one, where it would be computed for each element
    out = out.select("doc_id", "n_words", F.when((F.col("n_found") > 0) & (F.size("keys") > 0), v).alias("v"), (F.col("n_found") > 0).alias("any"))

    # parts of long notices, by where they have the notice begin: enough of them from one on within DRIFT words
    begins = F.sort_array(F.transform(F.filter("v", lambda f: at(long, f["t"])), lambda f: f["t"] * _FIELD + _FIELD // 2 + f["start"]))
    out = out.select("doc_id", "n_words", F.filter("v", lambda f: ~at(long, f["t"])).alias("short"), F.when(F.exists("v", lambda f: at(long, f["t"])), begins).alias("begins"), F.size("v").alias("n_v"))
    sizes, wanted = _longs([len(t.parts(0)) for t in templates]), _longs([t.needed for t in templates])
    near = lambda c, i, k: F.coalesce(at(F.col("begins"), i + k - 1) <= c + DRIFT, F.lit(False))
    many = lambda c, i: F.array_max(F.filter(F.sequence(at(wanted, id_of(c)), at(sizes, id_of(c))), lambda k: near(c, i, k))) / at(sizes, id_of(c))
    whole = F.transform("begins", lambda c, i: F.when(near(c, i, at(wanted, id_of(c))), F.struct(id_of(c).alias("t"), start_of(c).alias("start"), many(c, i).alias("share"))))
    out = out.select("doc_id", "n_words", F.concat("short", F.coalesce(F.array_compact(whole), F.filter("short", lambda f: F.lit(False)))).alias("v"), F.size("begins").alias("n_begins"))

    n_base = sum(t.base for t in templates)
    if any(t.base for t in templates[n_base:]):
        raise ValueError("base templates come first")
    base = F.filter("v", lambda f: f["t"] < n_base)
    labels = F.array(*(F.lit(t.label) for t in templates))
    joined = lambda rows: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda f: at(labels, f["t"])))), ","), F.lit(""))
    places = F.array_distinct(F.transform(base, lambda f: f["start"]))
    return out.select(
        "doc_id", "n_words", F.greatest(F.size(F.coalesce(base, F.array())), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("v")).alias("labels"),
        F.coalesce(F.array_max(F.transform("v", lambda f: f["share"])), F.lit(0.0)).alias("score"),
    )


def op1_rare_token_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence scan over every whole text of `documents`."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def oracle_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The scan in SQL, by its rule alone: every start at which any word of a template stands, without an index."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [p for t, x in enumerate(templates) for p in x.parts(t)]
    rows = ", ".join(f"({q}, {j}, {quote(w)}, {len(p.words)})" for q, p in enumerate(parts) for j, w in enumerate(p.words))
    owners = ", ".join(f"({q}, {p.t}, {p.offset}, {p.share})" for q, p in enumerate(parts))
    keys = lambda x: f"[{', '.join(quote(f' {k} ') for k in x.keys)}]::VARCHAR[]"
    meta = ", ".join(f"({t}, {quote(x.label)}, {str(x.base).lower()}, {str(x.is_long).lower()}, {len(x.parts(t))}, {x.needed}, {keys(x)})" for t, x in enumerate(templates))
    return rf"""
WITH places(q, j, w, n) AS (VALUES {rows}),
parts(q, t, first, share) AS (VALUES {owners}),
meta(t, label, base, is_long, n_parts, needed, keys) AS (VALUES {meta}),
lists AS (
  SELECT doc_id, row_number() OVER () AS r,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
tokens AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM lists),
shares AS (SELECT r, q, i - j AS start, count(*) / any_value(n) AS share FROM tokens JOIN places USING (w) GROUP BY r, q, i - j),
verified AS (
  SELECT r, t, start - first AS start, s.share, label, base, is_long, n_parts, needed
  FROM shares s JOIN parts p USING (q) JOIN meta USING (t) JOIN lists USING (r)
  WHERE s.share >= p.share AND len(list_filter(keys, lambda k: NOT contains(' ' || array_to_string(ws, ' ') || ' ', k))) = 0),
near AS (
  SELECT *, count(*) OVER (PARTITION BY r, t ORDER BY start RANGE BETWEEN CURRENT ROW AND {DRIFT} FOLLOWING) AS many FROM verified WHERE is_long),
found AS (
  SELECT r, start, share, label, base FROM verified WHERE NOT is_long
  UNION ALL SELECT r, start, least(many, n_parts) / n_parts, label, base FROM near WHERE many >= needed),
summed AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM found GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM lists LEFT JOIN summed USING (r)
"""
