"""License scans with DataFrame functions only: passages of a text compared to templates by Dice over word bigrams.

A text is lower-cased and all but letters and digits becomes space. Passages are its lines, the whole text, and windows of a
template's size: wherever a bigram of the text is one of the template, the window in which it has the same place, so that
a notice is found that is wrapped over lines or stands inside a line. Dice counts repeated bigrams on both sides.

Sizes prune: a passage reaches the threshold t only if its number of bigrams is within t / (2 - t) and (2 - t) / t of the
template's own, and then it shares t / (2 - t) of the template's bigrams at least. So a text that has none of a few words
which most of those bigrams contain is never split, and one that holds too few of a template's bigrams is never compared
with it. Templates are a constant of the plan: nothing is joined or shuffled.
"""

from __future__ import annotations

import json
from collections import Counter
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import prepare

THRESHOLD = 0.8
NOISE = r"[^\p{L}\p{N}\n]+"
#: Words that texts without a notice are full of.
COMMON = frozenset("a above all and any are as at be by copy following for from have in is it may mit must not of on or other that the these this to use used with you".split())
#: Notices and the texts of short licences, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}


def normalised(text: Column) -> Column:
    """Lower case, with single spaces between runs of letters and digits; line ends stay."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOISE, " ")


def _words(passage: Column) -> Column:
    return F.filter(F.split(passage, "[ \n]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def _prepared(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, list[str]]]:
    """Templates in words. The driver's rule is the same as normalised()."""
    out = []
    for licence, texts in sorted(templates.items()):
        for text in texts:
            found = "".join(c.lower() if c.isalnum() else " " for c in text).split()
            if len(found) < 2:
                raise ValueError(f"a template of {licence} has fewer than two words")
            out.append((licence, found))
    return out


def telling_words(prepared: list[tuple[str, list[str]]], share: float) -> list[str]:
    """Words of which every text has one that holds at least ``share`` of a template's bigrams: the bigrams without any
    of them are fewer than that. The word goes first that gets all templates nearest to it; common words go last."""
    chosen: list[str] = []
    grams = [list(zip(words, words[1:])) for _, words in prepared]
    while True:
        gain: Counter = Counter()
        for each in grams:
            left = [g for g in each if not set(g) & set(chosen)]
            missing = floor(len(left) - share * len(each) + 1e-9) + 1
            for w, n in Counter(w for g in left for w in set(g)).items() if missing > 0 else ():
                gain[w] += min(n, missing) / len(each)
        if not gain:
            return sorted(chosen)
        chosen.append(max(gain, key=lambda w: (w not in COMMON, gain[w], w)))


def _templates(prepared: list[tuple[str, list[str]]]) -> Column:
    """An array of (licence, n, bigrams, counts): bigrams in order, and different ones with their numbers. One literal,
    which Spark folds; thousands of literals take it seconds to analyse."""
    rows = []
    for licence, words in prepared:
        grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
        rows.append({"licence": licence, "n": len(grams), "grams": grams, "counts": [{"gram": g, "times": c} for g, c in Counter(grams).items()]})
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<licence:string,n:int,grams:array<string>,counts:array<struct<gram:string,times:int>>>>")


def _dice(grams: Column, template: Column) -> Column:
    common = F.aggregate(template["counts"], F.lit(0), lambda s, c: s + F.least(c["times"], F.size(F.filter(grams, lambda g: g == c["gram"]))))
    return F.lit(2.0) * common / (F.size(grams) + template["n"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_matches, licences, best and dice for every document.

    A template matches if 2 * common / (the bigrams of a passage + its own) reaches the threshold for a line, for the
    whole text, or for a window of its size (cut at the ends of the text) in which a bigram has its place; common counts
    a bigram as often as both have it. n_matches counts templates, licences joins their names, each once and in order, by
    commas (empty if none), best and dice are those of the best match (on equal scores the last by name), or null. A null
    or empty text matches nothing. Repeated rows give a row each; an empty table gives none. Other columns of ``docs``,
    whatever their names, are not read.
    """
    prepare(docs.sparkSession)
    prepared = _prepared(templates)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    telling = telling_words(prepared, low)
    every = F.from_json(F.lit(json.dumps(sorted({f"{a} {b}" for _, w in prepared for a, b in zip(w, w[1:])}))), "array<string>")
    nothing = F.array().cast("array<struct<dice:double,licence:string>>")

    def windows(grams: Column, t: Column) -> Column:
        spots = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda i: F.array_contains(t["grams"], F.get(grams, i)))
        places = lambda i: F.filter(F.sequence(F.lit(0), t["n"] - 1), lambda j: F.get(t["grams"], j) == F.get(grams, i))
        starts = F.array_distinct(F.flatten(F.transform(spots, lambda i: F.transform(places(i), lambda j: i - j))))
        return F.transform(starts, lambda s: F.slice(grams, F.greatest(s, F.lit(0)) + 1, t["n"] + F.least(s, F.lit(0))))

    def best(grams: Column, lines: Column, t: Column) -> Column:
        fits = lambda g: (F.size(g) >= low * t["n"] - 1e-9) & (F.size(g) <= high * t["n"] + 1e-9)
        passages = F.filter(F.concat(F.array(grams), lines, windows(grams, t)), fits)
        return F.struct(F.coalesce(F.array_max(F.transform(passages, lambda g: _dice(g, t))), F.lit(0.0)).alias("dice"), t["licence"].alias("licence"))

    held = lambda shared, t: F.size(F.filter(t["grams"], lambda g: F.array_contains(shared, g)))
    told = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("plain"))
    padded = F.concat(F.lit(" "), F.translate("plain", "\n", " "), F.lit(" "))
    told = told.withColumn("some", F.exists(F.array(padded), lambda p: _any([p.contains(f" {w} ") for w in telling])))
    told = told.withColumn("grams", F.when(F.col("some"), _bigrams(_words(F.col("plain")))).otherwise(F.array().cast("array<string>")))
    told = told.withColumn("shared", F.array_intersect(F.col("grams"), every))
    told = told.withColumn("near", F.filter(_templates(prepared), lambda t: (F.size("shared") > 0) & (held(F.col("shared"), t) >= low * t["n"] - 1e-9)))
    lines = F.when(F.size("near") > 0, F.transform(F.split("plain", "\n"), lambda x: _bigrams(_words(x))))
    told = told.withColumn("lines", lines)
    scored = F.transform("near", lambda t: best(F.col("grams"), F.col("lines"), t))
    found = told.select("doc_id", F.when(F.size("near") > 0, F.filter(scored, lambda m: m["dice"] >= threshold)).otherwise(nothing).alias("found"))
    top = F.array_max("found")
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda m: m["licence"]))), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_matches"), names.alias("licences"), top["licence"].alias("best"), top["dice"].alias("dice"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def sql(templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan of ``documents`` as DuckDB SQL, from the templates as they are written."""
    rows = ", ".join("('{}', '{}')".format(licence, text.replace("'", "''")) for licence, texts in templates.items() for text in texts)
    plain = lambda c: rf"regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    grams = lambda w: f"list_transform(range(1, greatest(1, len({w}))), lambda i: {w}[i] || ' ' || {w}[i + 1])"
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    return rf"""
WITH notices AS (SELECT row_number() OVER () AS t, licence, list_filter(str_split({plain("body")}, ' '), lambda w: w <> '') AS w FROM (VALUES {rows}) v(licence, body)),
templates AS (SELECT t, licence, {grams("w")} AS g, len(w) - 1 AS tn FROM notices),
own AS (SELECT t, tn, licence, unnest(g) AS gram, generate_subscripts(g, 1) AS j FROM templates),
docs AS (SELECT row_number() OVER () AS r, doc_id, str_split({plain("text")}, chr(10)) AS lines FROM documents),
texts AS (SELECT r, list_filter(str_split(array_to_string(lines, ' '), ' '), lambda w: w <> '') AS w FROM docs),
whole AS (SELECT r, {grams("w")} AS g FROM texts),
spots AS (SELECT r, t, tn, j, i FROM (SELECT r, unnest(g) AS gram, generate_subscripts(g, 1) AS i FROM whole) JOIN own USING (gram)),
near AS (SELECT r, t FROM (SELECT DISTINCT r, t, tn, j FROM spots) GROUP BY r, t, tn HAVING count(*) >= {low} * tn - 1e-9),
windows AS (SELECT DISTINCT r, t, tn, i - j AS s FROM spots JOIN near USING (r, t)),
lines AS (SELECT r, {grams("w")} AS g FROM (SELECT r, list_filter(str_split(p, ' '), lambda w: w <> '') AS w FROM (SELECT r, unnest(lines) AS p FROM docs))),
passages AS (SELECT row_number() OVER () AS k, r, t, g FROM (
  SELECT r, t, g FROM whole JOIN near USING (r) UNION ALL SELECT r, t, g FROM lines JOIN near USING (r)
  UNION ALL SELECT r, t, list_slice(g, greatest(s, 0) + 1, s + tn) FROM windows JOIN whole USING (r))),
sized AS (SELECT k, r, t, licence, len(p.g) AS n, tn, p.g FROM passages p JOIN templates USING (t) WHERE len(p.g) BETWEEN {low} * tn - 1e-9 AND {high} * tn + 1e-9),
theirs AS (SELECT k, r, t, licence, n, tn, gram, count(*) AS c FROM (SELECT k, r, t, licence, n, tn, unnest(g) AS gram FROM sized) GROUP BY ALL),
ours AS (SELECT t, gram, count(*) AS c FROM own GROUP BY ALL),
scored AS (SELECT r, t, licence, 2.0::DOUBLE * sum(least(a.c, b.c))::BIGINT / (n + tn) AS dice FROM theirs a JOIN ours b USING (t, gram) GROUP BY k, r, t, licence, n, tn),
best AS (SELECT r, t, licence, max(dice) AS dice FROM scored GROUP BY ALL HAVING max(dice) >= {threshold}),
matched AS (SELECT r, count(*) AS n, array_to_string(list_sort(list_distinct(list(licence))), ',') AS licences, max(struct_pack(dice := dice, licence := licence)) AS m FROM best GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(licences, '') AS licences, m.licence AS best, m.dice AS dice FROM docs LEFT JOIN matched USING (r)
"""
