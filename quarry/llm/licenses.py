"""License scan by diagonal voting (built-in functions only).

Words are the runs of digits, letters and all non-ASCII characters of the text with A-Z lowered. Every rolling
K-gram of words is hashed and joined to the positions of the same K words in license templates (a fixed list, so it is
broadcast); the words themselves are compared too. Hits are aggregated by document, template and diagonal (document
position minus template position), with a partial aggregation before the shuffle. Inserted or missing words shift what
follows them, so a copy with edits lies on neighbouring diagonals: from each diagonal, those up to STRETCH - 1 of the
template's words beyond it are merged, and the band is verified: its hits must cover COVER of the template's K-grams, each
counted once. A band spans at most STRETCH times the template, whatever else stands before or behind, so copies that
follow each other are found one by one. Of verified bands that overlap, the one that covers most is the span.

Base phrases are counted beside it, as places where their words stand consecutively.

Defined results: a null text counts as empty and has no words; a text with fewer than K words has no K-grams; score is the
best coverage, at least PHRASE_SCORE where a base phrase stands, else 0; rows that repeat a doc_id with the same text
share one result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same class character by character: Java looks these up in one table, where it tests ranges one by one (about six times slower on check_s).
BY_CHAR = "[^" + "".join(rf"\x{c:02X}" for c in range(128) if not re.match(WORD, chr(c))) + "]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
PHRASE_SCORE = 0.5
K, COVER, STRETCH = 3, 0.6, 1.5
SCALE = 1 << 20  # what a template's widest band is scaled to, so that one range holds for all templates

# Public license notices, their opening words and whole.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]


def words(text: Column) -> Column:
    """Words of a text as an array. lower() also lowers letters beyond A-Z; these stay letters beyond ASCII (but for the
    Kelvin sign, which becomes a k), so neither the number of words nor the places of base phrases change."""
    return F.regexp_extract_all(F.lower(text), F.lit(BY_CHAR), F.lit(0))


def grams(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, position and words w0.. of each rolling K-gram of the column `words`, with its hash; one generated loop, nothing is copied."""
    # an inner explode would make the optimizer test the array's size in a filter below, and so extract all words twice
    at = rows.select(*keep, "words", F.posexplode_outer("words").alias("pos", "w0"))
    parts = [F.col("w0"), *[F.get("words", F.col("pos") + i) for i in range(1, K)]]
    return at.filter(F.col("pos") + K <= F.size("words")).select(*keep, "pos", F.xxhash64(*parts).alias("gram"), *[p.alias(f"w{i}") for i, p in enumerate(parts)])


def template_grams(docs: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """Template positions by gram: template, label, size (grams in the template), tpos, gram and words; a list in the plan, so of bounded size."""
    told = json.dumps([{"template": i, "label": label, "text": text} for i, (label, text) in enumerate(templates)])
    one = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(told), "array<struct<template int, label string, text string>>")))
    split = one.withColumn("words", words(F.col("text"))).withColumn("size", F.size("words") - (K - 1))
    return grams(split, ["template", "label", "size"]).select("template", "label", "size", F.col("pos").alias("tpos"), F.col("gram").alias("tgram"), *[F.col(f"w{i}").alias(f"t{i}") for i in range(K)])


def spans(rows: DataFrame, keep: list[str], templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Verified spans: keep, template, label, first and last word, coverage. rows: keep (null-safe keys) and words; templates: (label, text)."""
    hits = grams(rows, keep)
    marks = template_grams(rows, templates or TEMPLATES)
    words_equal = F.lit(True)
    for i in range(K):
        words_equal &= hits[f"w{i}"] == marks[f"t{i}"]
    # in a WHEN, so that the join's key is the one long and not the words too
    same = (hits["gram"] == marks["tgram"]) & F.when(words_equal, True).otherwise(False)
    met = hits.join(F.broadcast(marks), same).select(*keep, "template", "label", "size", "pos", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    by = [*keep, "template", "label", "size"]
    voted = met.groupBy(*by, "diagonal").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("tpos").alias("votes"))
    # diagonals as whole numbers from 1, scaled so that a band's width is SCALE: exact where they differ by just the width
    width = F.greatest(F.lit(1), F.floor((STRETCH - 1) * (F.col("size") + K - 1)).cast("int"))
    lined = voted.withColumn("place", F.floor((F.col("diagonal") + F.col("size")).cast("long") * SCALE / width).cast("long")).withColumn("n", F.size("votes"))
    line = Window.partitionBy(*by).orderBy("place")
    ahead, back, near, before = line.rangeBetween(0, SCALE), line.rangeBetween(-SCALE, 0), line.rangeBetween(-SCALE, SCALE), line.rangeBetween(-SCALE, -1)
    # bands whose hits can't suffice go by sums, before sets are built
    least = COVER * F.col("size")
    hopeful = lined.withColumn("enough", F.sum("n").over(ahead) >= least).withColumn("wanted", F.max("enough").over(back)).filter("wanted")
    banded = hopeful.select(
        *by,
        "place",
        F.min("first").over(ahead).alias("first"),
        (F.max("last").over(ahead) + K - 1).alias("last"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("votes").over(ahead)))) / F.col("size")).alias("coverage"),
    )
    verified = banded.filter(F.col("coverage") >= COVER)
    best = verified.withColumn("most", F.max("coverage").over(near)).withColumn("earlier", F.coalesce(F.max("coverage").over(before), F.lit(0.0)))
    return best.filter("coverage = most AND coverage > earlier").select(*keep, "template", "label", "first", "last", "coverage")


def phrase_places(phrase: str) -> tuple[Column, Column, Column]:
    """How often a phrase stands in `line` (words between single spaces; null: none), and the first and last word's number."""
    n = phrase.count(" ") + 1
    here = F.col("line").contains(f" {phrase} ")
    spaces = lambda s: (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")
    count = F.when(here, F.size(F.split("line", f" {phrase}(?= )", -1)) - 1).otherwise(0).cast("long")
    first = F.when(here, spaces(F.substring_index("line", f" {phrase} ", 1)))
    last = F.when(here, F.col("n_words") - n - spaces(F.substring_index("line", f" {phrase} ", -1)))
    return count, first, last


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", F.xxhash64(text).alias("text_key"), words(text).alias("words"), F.lower(text).alias("lower"))
    # only a text that holds a phrase's last word can hold the phrase; the others need no line
    likely = reduce(or_, [F.col("lower").contains(w) for w in sorted({p.split()[-1] for p in PHRASES})])
    line = F.when(likely, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    lined = split.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), line.alias("line"))
    found = {p: phrase_places(p) for p in PHRASES}
    based = lined.select(
        "doc_id",
        "text_key",
        "n_words",
        *[c.alias(f"{name}{i}") for i, p in enumerate(PHRASES) for name, c in zip(("count", "first", "last"), found[p])],
    )
    every = range(len(PHRASES))
    base = F.array_compact(F.array(*[F.when(F.col(f"count{i}") > 0, label) for i, label in enumerate(PHRASES.values())]))
    based = based.select(
        "doc_id",
        "text_key",
        "n_words",
        sum((F.col(f"count{i}") for i in every), F.lit(0).cast("long")).alias("n_base"),
        F.least(*[F.col(f"first{i}") for i in every]).alias("first_word"),
        F.greatest(*[F.col(f"last{i}") for i in every]).alias("last_word"),
        base.alias("base"),
    )
    told = spans(split, ["doc_id", "text_key"]).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("found"), F.max("coverage").alias("best"))
    told = told.select(F.col("doc_id").alias("told_id"), F.col("text_key").alias("told_key"), "found", "best")
    both = based.join(told, based["doc_id"].eqNullSafe(told["told_id"]) & (based["text_key"] == told["told_key"]), "left")
    every_label = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, PHRASE_SCORE).otherwise(0.0))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(every_label, ",").alias("labels"), score.alias("score"))
