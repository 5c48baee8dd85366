"""Licence scan by Dice coefficient over word bigrams, in DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Public licence texts and the notices that name them.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
_ISC_WHOLE = _ISC + " IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT), ("ISC", _ISC), ("Apache-2.0", _APACHE), ("GPL-3.0", _GPL),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
]

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Texts that the scan knows besides those of the SQL.
WHOLE: list[tuple[str, str]] = [("ISC", _ISC_WHOLE), ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL)]


def normalised(text: Column) -> Column:
    """Small letters, digits and inner dots and hyphens; all else is one space."""
    kept = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}.-]+", " ")
    return F.trim(F.regexp_replace(kept, "(?:^| )[.-]+|[.-]+(?= |$)", " "))


def bigrams(text: Column) -> Column:
    """Distinct word bigrams of a normalised text, as 64-bit hashes; none for fewer than two words."""
    return F.get(F.transform(F.array(_words(text)), lambda w: F.when(F.size(w) > 1, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1))))).otherwise(F.array().cast("array<bigint>"))), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " +"), lambda w: w != "")


def _templates(spark: SparkSession, templates: list[tuple[str, str]], num: int, den: int) -> tuple[Column, int, int]:
    """The templates as one constant array, and the least and most bigrams of a segment that can match any.

    Of each: name, own (bigrams), least and most (bigrams of a text that can
    reach the coefficient num/den), pairs (most word pairs of a run of lines).
    """
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)], "i int, name string, text string").select("i", "name", bigrams(normalised(F.col("text"))).alias("b"), F.size(_words(normalised(F.col("text")))).alias("n")).orderBy("i").collect()
    rows = [r for r in rows if r["b"]]
    least = [-(-len(r["b"]) * num // (2 * den - num)) for r in rows]
    most = [len(r["b"]) * (2 * den - num) // num for r in rows]
    each = [F.struct(F.lit(r["name"]).alias("name"), F.lit(sorted(r["b"])).alias("own"), F.lit(x).alias("least"), F.lit(y).alias("most"), F.lit((r["n"] - 1) * (2 * den - num) // num).alias("pairs")) for r, x, y in zip(rows, least, most, strict=True)]
    return F.array(*each).cast("array<struct<name:string,own:array<bigint>,least:int,most:int,pairs:int>>"), min(least, default=1), max(most, default=0)


def _nearest_run(t: Column, num: int, den: int) -> Column:
    """Of the runs of two or more lines that match a template, the nearest, and of equal ones the first; null if none does.

    Over __words (line, place in its line, size of its line) and __pairs (line, place
    of its first word, bigram). A first line without a bigram of the template
    can go without loss, so runs begin only at lines that have one; they end
    at ends of lines within the size bounds, and hold no line of __alone.
    """
    shared = F.filter(F.transform("__pairs", lambda p, i: F.struct((i - p["place"]).alias("at"), p["h"].alias("h"))), lambda p: F.array_contains(t["own"], p["h"]))
    starts = F.array_distinct(F.transform(shared, lambda p: p["at"]))
    last = F.size("__words") - 1

    def run(s: Column, e: Column) -> Column:
        b = F.array_distinct(F.transform(F.slice("__pairs", s + 1, e - s), lambda p: p["h"]))
        both, of = F.size(F.array_intersect(b, t["own"])), F.size(b) + F.size(t["own"])
        first, end = F.get("__words", s)["line"], F.get("__words", e)["line"]
        return F.struct((both * 2 / of).alias("near"), (-first).alias("before"), end.alias("to"), both.alias("both"), of.alias("of"))

    def ending(s: Column) -> Column:
        ends = F.when(s + t["least"] <= last, F.sequence(s + t["least"], F.least(s + t["pairs"], last))).otherwise(F.array().cast("array<int>"))
        whole = F.filter(ends, lambda e: (F.get("__words", e)["place"] == F.get("__words", e)["size"] - 1) & (F.get("__words", e)["line"] > F.get("__words", s)["line"]))
        clear = F.filter(whole, lambda e: ~F.exists("__alone", lambda k: (k >= F.get("__words", s)["line"]) & (k <= F.get("__words", e)["line"])))
        return F.array_max(F.filter(F.transform(clear, lambda e: run(s, e)), lambda r: r["both"] * 2 * den >= r["of"] * num))

    best = F.array_max(F.filter(F.transform(starts, ending), lambda r: r.isNotNull()))
    return F.when(best.isNotNull(), F.struct(t["name"].alias("name"), best["near"].alias("near"), (-best["before"]).alias("from"), best["to"].alias("to")))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, coefficient: tuple[int, int] = (8, 10)) -> DataFrame:
    """docs with the licences that a text, one of its lines, or a run of its lines matches.

    The whole text and each of its lines are normalised and compared with
    every template (of several matches, the nearest counts, all if alike) by the Dice coefficient 2|A and B| / (|A| + |B|) of their
    distinct word bigrams. A template whose size alone keeps the coefficient
    under the limit is not compared, and a segment that no template's size
    allows is left at its count.

    Where the whole text does not match, runs of two or more consecutive lines
    are compared too, joined by a blank: a licence wrapped over lines with other
    text around it. A template takes part if the text has as many of its
    bigrams as a match needs and neither the text nor a line matched its name. A
    run has at least that many word pairs and at most (2 - c) / c times those of
    the template, c being the limit, and holds no line that matches by itself.
    Of a template's matching runs the nearest counts, once a text, and of
    overlapping runs of several templates the nearest (all if alike).

    Adds n_bigrams (long, of the whole text), licenses (array of distinct
    names, sorted), n_matches (matching pairs of segment and template; of runs,
    names) and best (double, the largest coefficient among the matches, else 0);
    columns of these names in docs are replaced, all others stay. A null
    text is empty; texts of under two words match nothing; a very long text
    costs in proportion to its length. Rows are judged one by one, so ties and
    repeated rows change nothing, and an empty table gives an empty one.
    """
    num, den = coefficient
    made = ["n_bigrams", "licenses", "n_matches", "best"]
    docs = docs.drop(*made)
    names = [F.col(c) for c in docs.columns]
    known, lo, hi = _templates(docs.sparkSession, [*TEMPLATES, *WHOLE] if templates is None else templates, num, den)
    every = F.array_distinct(F.flatten(F.transform(known, lambda t: t["own"])))
    text = F.coalesce("text", F.lit(""))
    split = docs.select("*", normalised(F.regexp_replace(text, "\n", " ")).alias("__whole"), F.when(F.contains(text, F.lit("\n")), F.transform(F.split(text, "\n"), normalised)).otherwise(F.array().cast("array<string>")).alias("__lines"))
    counted = split.select(*names, bigrams(F.col("__whole")).alias("__whole"), F.transform("__lines", bigrams).alias("__lines"), F.col("__lines").alias("__texts"))
    segments = F.transform(F.concat(F.array("__whole"), F.col("__lines")), lambda b, k: F.struct(k.alias("k"), b.alias("b")))
    fits = F.filter(segments, lambda s: (F.size(s["b"]) >= lo) & (F.size(s["b"]) <= hi))
    some = F.when(F.size("__lines") > 1, F.array_intersect("__whole", every)).otherwise(F.array().cast("array<bigint>"))
    counted = counted.select(*names, F.size("__whole").cast("long").alias("n_bigrams"), fits.alias("__fits"), some.alias("__some"), "__texts")

    def hits(t: Column) -> Column:
        near = F.filter("__fits", lambda s: (F.size(s["b"]) >= t["least"]) & (F.size(s["b"]) <= t["most"]))
        shared = F.transform(near, lambda s: F.struct(t["name"].alias("name"), s["k"].alias("k"), F.size(F.array_intersect(s["b"], t["own"])).alias("both"), (F.size(s["b"]) + F.size(t["own"])).alias("of")))
        return F.filter(shared, lambda s: s["both"] * 2 * den >= s["of"] * num)

    empty = F.array().cast("array<struct<name:string,k:int,both:int,of:int>>")
    found = counted.select(*names, "n_bigrams", "__some", "__texts", F.when(F.size("__fits") == 0, empty).otherwise(F.flatten(F.transform(known, hits))).alias("__hits"))
    # of a segment's templates, the nearest
    nearest = F.filter("__hits", lambda h: ~F.exists("__hits", lambda g: (g["k"] == h["k"]) & (g["both"] * h["of"] > h["both"] * g["of"])))
    found = found.select(*names, "n_bigrams", "__some", "__texts", nearest.alias("__hits"))

    # templates whose bigrams the text has, and that neither it nor a line matched
    seen = F.transform("__hits", lambda h: h["name"])
    sought = F.filter(known, lambda t: (F.size("__some") >= t["least"]) & ~F.array_contains(seen, t["name"]) & (F.size(F.array_intersect("__some", t["own"])) >= t["least"]))
    seek = F.when((F.size("__some") >= lo) & ~F.exists("__hits", lambda h: h["k"] == 0), sought).otherwise(F.slice(known, 1, 0))
    found = found.select(*names, "n_bigrams", "__hits", seek.alias("__seek"), "__texts")
    placed = F.flatten(F.transform(F.transform("__texts", _words), lambda ws, line: F.transform(ws, lambda w, i: F.struct(w.alias("w"), line.alias("line"), i.alias("place"), F.size(ws).alias("size")))))
    alone = F.transform("__hits", lambda h: h["k"] - 1)
    found = found.select(*names, "n_bigrams", "__hits", "__seek", F.when(F.size("__seek") > 0, placed).alias("__words"), F.when(F.size("__seek") > 0, alone).alias("__alone"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("__words") - 2), lambda i: F.struct(F.xxhash64(F.get("__words", i)["w"], F.get("__words", i + 1)["w"]).alias("h"), F.get("__words", i)["place"].alias("place")))
    found = found.select(*names, "n_bigrams", "__hits", "__seek", "__words", "__alone", F.when(F.size("__seek") > 0, pairs).alias("__pairs"))
    no_runs = F.array().cast("array<struct<name:string,near:double,from:int,to:int>>")
    runs = F.filter(F.transform("__seek", lambda t: _nearest_run(t, num, den)), lambda r: r.isNotNull())
    runs = F.when(F.size("__seek") == 0, no_runs).otherwise(runs)
    found = found.select(*names, "n_bigrams", "__hits", runs.alias("__runs"))
    clear = F.filter("__runs", lambda r: ~F.exists("__runs", lambda q: (q["from"] <= r["to"]) & (r["from"] <= q["to"]) & (q["near"] > r["near"])))
    found = found.select(*names, "n_bigrams", "__hits", clear.alias("__runs"))

    best = F.coalesce(F.array_max(F.concat(F.transform("__hits", lambda s: s["both"] * 2 / s["of"]), F.transform("__runs", lambda r: r["near"]))), F.lit(0.0))
    run_names = F.array_distinct(F.transform("__runs", lambda r: r["name"]))
    licenses = F.array_sort(F.array_distinct(F.concat(F.transform("__hits", lambda s: s["name"]), run_names)))
    made_of = F.struct("n_bigrams", licenses.alias("licenses"), (F.size("__hits") + F.size(run_names)).cast("long").alias("n_matches"), best.alias("best"))
    # a generator keeps filters on the results from being pushed into the expressions above
    return found.select(*names, F.explode(F.array(made_of)).alias("__made")).select(*names, "__made.*")


def oracle(coefficient: str = "0.8") -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
    def norm(x: str) -> str:
        return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}.-]+', ' ', 'g'), '(^| )[.-]+|[.-]+( |$)', ' ', 'g'))"
    def grams(x: str) -> str:
        return f"(SELECT list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM (SELECT list_filter(string_split({norm(x)}, ' '), lambda y: y <> '') AS w))"
    return f"""
WITH t(i, name, body) AS (VALUES {rows}), tg AS (SELECT name, i, {grams("body")} AS g FROM t),
d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
s AS (SELECT doc_id, 0 AS k, replace(x, chr(10), ' ') AS seg FROM d UNION ALL
      SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS seg FROM (SELECT doc_id, string_split(x, chr(10)) AS l FROM d WHERE contains(x, chr(10)))),
sg AS (SELECT doc_id, k, {grams("seg")} AS g FROM s),
p AS (SELECT doc_id, k, name, len(list_intersect(sg.g, tg.g)) * 2.0 / (len(sg.g) + len(tg.g)) AS dice FROM sg JOIN tg
      ON len(sg.g) * 1.5 >= len(tg.g) - 1 AND len(sg.g) <= len(tg.g) * 1.5 + 1 WHERE len(sg.g) > 0),
m AS (SELECT * FROM (SELECT *, max(dice) OVER (PARTITION BY doc_id, k) AS top FROM p) WHERE dice = top)
SELECT sg.doc_id, CAST(any_value(len(sg.g)) AS BIGINT) AS n_bigrams,
  coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT DISTINCT name FROM m WHERE m.doc_id = sg.doc_id AND dice >= {coefficient})), '') AS licenses,
  CAST((SELECT count(*) FROM m WHERE m.doc_id = sg.doc_id AND dice >= {coefficient}) AS BIGINT) AS n_matches,
  round(coalesce((SELECT max(dice) FROM m WHERE m.doc_id = sg.doc_id AND dice >= {coefficient}), 0), 6)::DOUBLE AS best
FROM sg WHERE k = 0 GROUP BY sg.doc_id
"""
