"""Licence scan: lines, whole texts and windows of words compared to licence templates by the Dice coefficient over word bigrams.

DataFrame functions only.
"""

from __future__ import annotations

from collections import Counter
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (licence, template), as the public notices and texts read. Fixed values.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("proprietary", "All rights reserved."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY
THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the
copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS
PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY
OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
the original software. 3. This notice may not be removed or altered from any source distribution."""),
)
LEAST = 0.8
#: A word that no template holds, and the fields of a window: its first and last word, and its coefficient and length with a minus, to sort by.
WALL, SPAN = "\u00b6", "o:double,k:int,i:int,j:int,license:string"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


ANY_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def let(value: Column, body) -> Column:
    """The body's value for a value that is computed once; a plain expression would be computed anew wherever it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits and of characters beyond ASCII."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def plain(text: str) -> list[str]:
    return "".join(c if c.isalnum() and c.isascii() else " " for c in text.lower()).split()


def shapes(templates) -> list[tuple[str, list[str], int, list[tuple[str, int]]]]:
    """(licence, distinct bigrams, number of bigrams, bigrams that occur several times with how often) of each template."""
    out = []
    for name, text in templates:
        w = plain(text)
        pairs = Counter([f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] or w)
        out.append((name, sorted(pairs), pairs.total(), sorted((g, c) for g, c in pairs.items() if c > 1)))
    return out


def bounds(m: int, least: float) -> tuple[int, int]:
    """Numbers of bigrams that can reach the coefficient with a template of m: n >= m*t/(2-t) and n <= m*(2-t)/t."""
    return max(1, ceil(m * least / (2 - least) - 1e-9)), floor(m * (2 - least) / least + 1e-9)


def key_words(templates, least: float) -> list[str]:
    """Words of which a text must hold one, or no window of it reaches the least coefficient with any template."""
    keys: set[str] = set()
    for _, grams, m, again in shapes(templates):
        times = dict.fromkeys(grams, 1) | dict(again)
        while True:
            left = {g: c for g, c in times.items() if not keys & set(g.split())}
            n = sum(left.values())
            if 2 * n < least * (max(bounds(m, least)[0], n) + m) - 1e-9:
                break
            keys.add(max({w for g in left for w in g.split()}, key=lambda w: (len(w), w)))
    return sorted(keys)


def more_shared(again: Column, grams: Column) -> Column:
    """What bigrams that a template holds several times add to the number of distinct shared bigrams, for a list of all of a segment's bigrams."""
    extra = lambda r: F.greatest(F.least(F.size(F.filter(grams, lambda g: g == r["g"])), r["c"]) - 1, F.lit(0))
    return F.when(F.size(again) > 0, F.aggregate(again, F.lit(0), lambda acc, r: acc + extra(r))).otherwise(F.lit(0))


def spans(g: Column, fixed: Column, vocabulary: Column, least: float) -> Column:
    """Windows over a list of bigrams that reach the least coefficient and share no word: (o, i, j, license), with o the negative coefficient.

    A window that begins or ends with a bigram the template lacks is worse than the one without it, so windows run from one shared bigram
    to another. Of those that overlap the best stays, then the longest, then the first; equal ones of several licences stay together.
    """

    def of(x, hits):
        at = lambda a, k: F.slice(hits, k + 1, x["hi"])  # noqa: E731  no window holds more shared bigrams than that

        def starting(a, k):
            def ending(b, e):
                n = b["i"] - a["i"] + 1
                own = F.transform(F.slice(hits, k + 1, e + 1), lambda c: c["g"])
                shared = let(own, lambda held: F.size(F.array_distinct(held)) + more_shared(x["r"], held))
                likely = n.between(x["lo"], x["hi"]) & ((e + 1) * F.lit(2.0) >= (n + x["m"]) * F.lit(least) - 1e-9)
                score = F.when(likely, shared * F.lit(-2.0) / (n + x["m"])).otherwise(F.lit(0.0))
                return F.struct(score.alias("o"), (-n).alias("k"), a["i"].alias("i"), (b["i"] + 1).alias("j"), x["license"].alias("license"))

            return F.filter(F.transform(at(a, k), ending), lambda y: y["o"] <= -least)

        enough = F.size(hits) * 2 >= (x["m"] + x["lo"]) * F.lit(least) - 1e-9
        return F.when(enough, F.flatten(F.transform(hits, starting))).otherwise(F.array().cast(f"array<struct<{SPAN}>>"))

    def apart(found):
        clash = lambda taken, y: F.exists(taken, lambda z: (z["i"] <= y["j"]) & (y["i"] <= z["j"]) & ~((z["i"] == y["i"]) & (z["j"] == y["j"]) & (z["o"] == y["o"]) & (z["license"] != y["license"])))
        bare = F.transform(F.array_sort(found), lambda y: F.struct(y["o"], y["k"], y["i"], y["j"], y["license"]).cast(f"struct<{SPAN}>"))
        return F.aggregate(bare, F.array().cast(f"array<struct<{SPAN}>>"), lambda taken, y: F.when(clash(taken, y), taken).otherwise(F.concat(taken, F.array(y))))

    def hit(present):
        placed = F.filter(F.transform(g, lambda x, i: F.struct(i.alias("i"), x.alias("g"))), lambda h: F.array_contains(present, h["g"]))
        return let(placed, lambda hits: apart(F.flatten(F.transform(fixed, lambda x: let(F.filter(hits, lambda h: F.array_contains(x["t"], h["g"])), lambda own: of(x, own))))))

    return let(F.array_intersect(g, vocabulary), hit)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, least: float = LEAST, windows: bool = False) -> DataFrame:
    """(doc_id, license, segments, dice): licences found in each document, with the number of matching segments and the best coefficient.

    Segments are the lines of a text, and the whole text where it has several lines. The coefficient is twice the number of shared
    bigrams by the numbers of bigrams of both, with bigrams that occur several times counted as often; so a segment is compared only to
    templates within its size bounds, and a segment that no template's bounds hold is passed over before its bigrams are made. Texts
    without any of the words that every match must hold some of are passed over whole. A segment counts for the licence of the largest
    coefficient, with ties for each such licence. A null or empty text has no segment; a text of any length is read whole; repeated rows
    of a doc_id add up; rows with a null doc_id are reported under null; an empty table gives no rows; other columns are ignored.

    With ``windows``, every window of words that a template's bounds hold is a segment too, across line breaks and inside longer lines,
    unless it shares words with a segment that counts or with a better window.
    """
    known = [(name, grams, m, again, *bounds(m, least)) for name, grams, m, again in shapes(templates)]
    low, high = min(x[4] for x in known), max(x[5] for x in known)
    several = lambda again: F.array(*[F.struct(F.lit(g).alias("g"), F.lit(c).alias("c")) for g, c in again]) if again else F.array().cast("array<struct<g:string,c:int>>")
    shape = lambda a, g, m, again, lo, hi: {"license": F.lit(a), "t": F.array(*map(F.lit, g)), "m": F.lit(m), "r": several(again), "lo": F.lit(lo), "hi": F.lit(hi)}
    fixed = F.array(*[F.struct(*[v.alias(k) for k, v in shape(*x).items()]) for x in known])
    t = F.col(f"`{text}`")
    # lower() folds more than A-Z, but no word of ASCII letters that stands there is lost by that
    docs = docs.where(F.arrays_overlap(F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0)), F.array(*map(F.lit, key_words(templates, least)))))
    whole = lambda lines: (F.size(lines) > 1) & (F.regexp_count(t, F.lit(ANY_WORD)) <= high + 1)  # noqa: E731  the whole text only where it has few enough words
    pieces = let(F.split(t, "\n", -1), lambda lines: F.when(whole(lines), F.concat(lines, F.array(t))).otherwise(lines))
    segments = docs.where(t.isNotNull()).select(F.col(f"`{doc_id}`").alias("doc_id"), F.explode(pieces).alias("segment"))
    none = F.array().cast("array<struct<license:string,dice:double>>")

    def best(g, n, every):
        """The licences of the largest coefficient, if it reaches the least."""
        candidates = F.filter(fixed, lambda x: n.between(x["lo"], x["hi"]))
        scored = F.transform(candidates, lambda x: F.named_struct(F.lit("license"), x["license"], F.lit("dice"), (F.size(F.array_intersect(g, x["t"])) + more_shared(x["r"], every)) * F.lit(2.0) / (n + x["m"])))
        top = lambda s: F.array_max(F.transform(s, lambda x: x["dice"]))
        return let(F.filter(scored, lambda x: x["dice"] >= least), lambda s: let(top(s), lambda m: F.array_distinct(F.filter(s, lambda x: x["dice"] == m))))

    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))

    def compared(w):
        n = F.greatest(F.size(w) - 1, F.lit(1))
        grams = lambda w: F.when(F.size(w) == 1, w).otherwise(pairs(w))
        return F.when((F.size(w) > 0) & n.between(low, high), let(grams(w), lambda every: let(F.array_distinct(every), lambda g: best(g, n, every)))).otherwise(none)

    found = segments.select("doc_id", F.explode(let(words(F.col("segment")), compared)).alias("x"))
    if windows:
        wall = F.lit(f" {WALL}" * (high + 2))  # no window reaches across a line that counts
        matched = lambda piece: F.size(let(words(piece), compared)) > 0
        open_ = let(F.split(t, "\n", -1), lambda lines: F.when(whole(lines) & matched(t), F.lit("")).otherwise(F.array_join(F.transform(lines, lambda x: F.when(matched(x), wall).otherwise(x)), "\n")))
        vocabulary = F.array(*map(F.lit, sorted({g for _, grams, *_ in known for g in grams})))
        inside = let(let(words(open_), pairs), lambda g: spans(g, fixed, vocabulary, least))
        more = docs.where(t.isNotNull()).select(F.col(f"`{doc_id}`").alias("doc_id"), F.explode(inside).alias("x"))
        found = found.unionAll(more.select("doc_id", F.struct(F.col("x.license").alias("license"), (-F.col("x.o")).alias("dice")).alias("x")))
    return found.groupBy("doc_id", F.col("x.license").alias("license")).agg(F.count("*").alias("segments"), F.round(F.max("x.dice"), 6).alias("dice"))


def sql(templates=TEMPLATES, least: float = LEAST) -> str:
    """The same in DuckDB SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = [(name, g, m, again, *bounds(m, least)) for name, g, m, again in shapes(templates)]
    several = lambda again: "[" + ", ".join(f"{{'g': {quote(g)}, 'c': {c}}}" for g, c in again) + "]::STRUCT(g VARCHAR, c INTEGER)[]"
    rows = ", ".join(f"({quote(n)}, [{', '.join(map(quote, g))}], {m}, {several(again)}, {lo}, {hi})" for n, g, m, again, lo, hi in known)
    high = max(x[5] for x in known)
    word = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    norm = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    return f"""
WITH t(license, t, m, r, lo, hi) AS (VALUES {rows}),
l AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
s AS (SELECT rid, doc_id, unnest(CASE WHEN len(lines) > 1 AND len(regexp_extract_all({norm.format("text")}, {word})) <= {high + 1}
      THEN list_append(lines, text) ELSE lines END) AS segment FROM l),
w AS (SELECT row_number() OVER () AS sid, doc_id, regexp_extract_all({norm.format("segment")}, {word}) AS w FROM s),
g AS (SELECT sid, doc_id, greatest(len(w) - 1, 1) AS n, CASE WHEN len(w) = 1 THEN w
      ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END AS g FROM w WHERE len(w) > 0 AND len(w) <= {high + 1}),
h AS (SELECT sid, doc_id, license, 2.0::DOUBLE * (len(list_intersect(list_distinct(g), t))
      + coalesce(list_sum([greatest(least(len(list_filter(g, lambda q: q = y.g)), y.c) - 1, 0) FOR y IN r]), 0)) / (n + m) AS dice FROM g JOIN t ON n BETWEEN lo AND hi),
b AS (SELECT sid, max(dice) AS top FROM h WHERE dice >= {least} GROUP BY sid),
x AS (SELECT DISTINCT h.sid, doc_id, license, top FROM h JOIN b ON h.sid = b.sid AND h.dice = b.top)
SELECT doc_id, license, count(*) AS segments, round(max(top), 6) AS dice FROM x GROUP BY doc_id, license"""
