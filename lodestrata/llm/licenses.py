"""Licence notices: normalised text compared to templates by the Dice coefficient over word bigrams.

DataFrame functions only. Three kinds of pieces of a text are compared: its lines, its paragraphs, and runs of as many words as a
template has, wherever one of a few words that licences use (ANCHORS) stands where it stands in the template; so a notice is
found within a longer line, and wrapped over several. A line or paragraph is compared with the templates whose size can
reach the coefficient with its own; a run, with the template that it was cut for. Texts without any word that all this needs
are passed over after one search."""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICE = 0.8

#: Words of licences at which runs of words are cut.
ANCHORS = ("apache", "commons", "licence", "license", "licensed", "merchantability", "mozilla", "noninfringement", "redistributions", "spdx", "sublicense", "warranties")

#: Short words that other texts hold often.
COMMON = frozenset("a an and any as by for in is it may not of on or that the this to with work you".split())

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
    "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
    "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_BSD_NAME = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
    "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
    'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
    "the specific language governing permissions and limitations under the License."
)


def _gpl(version: int) -> str:
    return (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        f"Free Software Foundation; either version {version} of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    )


#: Notices of public licences, and headers and bodies that stand for them.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Released under the Apache License 2.0.",
        _APACHE,
    ),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", _MIT),
    "ISC": (_ISC,),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "Released under the GNU General Public License, version 3 or later.",
        _gpl(3),
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0.", _gpl(2)),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Released under the 3-Clause BSD License.", f"{_BSD} {_BSD_NAME}"),
    "BSD-2-Clause": (_BSD,),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
}

TEMPLATES = {name: (*bodies, f"SPDX-License-Identifier: {name}") for name, bodies in TEMPLATES.items()}


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(n: int, dice: float) -> tuple[int, int]:
    """The sizes of sets that can reach the coefficient with a set of n: 2 min / (a + b) >= dice."""
    t = Fraction(str(dice))
    low, high = t * n / (2 - t), (2 - t) * n / t
    return -(-low.numerator // low.denominator), high.numerator // high.denominator


def covering_words(templates: dict, dice: float) -> list[str]:
    """Words of which every text that reaches the coefficient with a template holds one.

    Such a text holds at least low bigrams of the template, so it misses fewer than n - low + 1. Words are added, those
    that cover the most bigrams still in want first, until as many bigrams of each template are covered."""
    wants = []
    for bodies in templates.values():
        for body in bodies:
            grams = bigrams(body)
            wants.append([set(grams), len(grams) - size_bounds(len(grams), dice)[0] + 1, len(grams)])
    chosen: list[str] = []
    while any(need > 0 for _, need, _ in wants):
        gain: dict[str, int] = {}
        for grams, need, total in wants:
            if need > 0:
                # Long templates have enough long words, which other texts hold seldom.
                for w in {w for g in grams for w in g.split() if len(w) > (3 if total < 25 else 5) or len(grams) < 6 and w not in COMMON}:
                    gain[w] = gain.get(w, 0) + min(need, sum(w in g.split() for g in grams)) * len(w) ** 3
        best = max(sorted(gain), key=gain.__getitem__)
        chosen.append(best)
        for want in wants:
            hit = {g for g in want[0] if best in g.split()}
            want[0] -= hit
            want[1] -= len(hit)
    return chosen


def _any_word(words) -> str:
    return f"(?i)(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])"


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def _grams(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))


def _dice(grams: Column, wanted: Column) -> Column:
    return F.lit(2.0) * F.size(F.array_intersect(grams, wanted)) / (F.size(grams) + F.size(wanted))


def pieces(docs: DataFrame, templates: dict = TEMPLATES, dice: float = DICE) -> DataFrame:
    """doc_id, unit, license, dice: each different line or paragraph of docs(doc_id, text) that reaches the coefficient with a
    template, with the best one, ties by name."""
    spark = docs.sparkSession
    rows = [(name, grams, n) for name, bodies in sorted(templates.items()) for body in bodies for grams in [bigrams(body)] for n in range(size_bounds(len(grams), dice)[0], size_bounds(len(grams), dice)[1] + 1)]
    sized = spark.createDataFrame(rows, "license string, wanted array<string>, n_grams int")
    found = docs.select("doc_id", "text").filter(F.rlike("text", F.lit(_any_word(covering_words(templates, dice)))))
    units = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", r"\n[\x20\t\r]*\n")))
    found = found.select("doc_id", F.explode(units).alias("unit"))
    found = found.withColumn("grams", _grams(_words(F.col("unit")))).withColumn("n_grams", F.size("grams"))
    # As many rows as the templates have admissible sizes: fixed, whatever the data.
    found = found.join(F.broadcast(sized), "n_grams").withColumn("dice", _dice(F.col("grams"), F.col("wanted"))).filter(F.col("dice") >= dice)
    best = F.min(F.struct((-F.col("dice")).alias("d"), "license"))
    return found.groupBy("doc_id", "unit").agg(best.alias("b")).select("doc_id", "unit", F.col("b.license").alias("license"), (-F.col("b.d")).alias("dice"))


def runs(docs: DataFrame, templates: dict = TEMPLATES, dice: float = DICE) -> DataFrame:
    """doc_id, license, dice: the licences that runs of words of docs(doc_id, text) reach the coefficient with, each with its best.

    Of a text, what leaves the array of its words is for each anchor word the words around it, as far as templates reach."""
    spark = docs.sparkSession
    cut_at = [(w, len(words) - at, at, len(words), name, bigrams(body)) for name, bodies in sorted(templates.items()) for body in bodies for words in [words_of(body)] for at, w in enumerate(words) if w in ANCHORS]
    before, after = max(x[2] for x in cut_at), max(x[1] for x in cut_at)
    wanted = spark.createDataFrame([(w, at, n, name, grams) for w, _, at, n, name, grams in cut_at], "word string, place int, n_words int, license string, wanted array<string>")
    found = docs.select("doc_id", "text").filter(F.rlike("text", F.lit(_any_word(ANCHORS)))).select("doc_id", _words(F.col("text")).alias("p"))
    is_anchor = lambda i: F.array_contains(F.array(*map(F.lit, ANCHORS)), F.get("p", i))
    places = F.filter(F.sequence(F.lit(0), F.size("p") - 1), is_anchor)
    near = F.transform(places, lambda i: F.struct(F.get("p", i).alias("word"), F.least(i, F.lit(before)).alias("at"), F.slice("p", F.greatest(i - before, F.lit(0)) + 1, F.lit(before + after)).alias("near")))
    found = found.select("doc_id", F.explode(near).alias("x")).select("doc_id", "x.*")
    # As many rows as templates have anchor words: fixed, whatever the data.
    found = found.join(F.broadcast(wanted), "word").withColumn("first", F.col("at") - F.col("place"))
    run = F.slice("near", F.greatest("first", F.lit(0)) + 1, F.col("n_words") + F.least("first", F.lit(0)))
    found = found.withColumn("dice", _dice(_grams(run), F.col("wanted"))).filter(F.col("dice") >= dice)
    return found.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"))


def licensed(docs: DataFrame, templates: dict = TEMPLATES, dice: float = DICE) -> DataFrame:
    """doc_id, n_notices, license, dice, licenses: a row per row of docs(doc_id, text, ...).

    n_notices: different lines and paragraphs that reach the coefficient, and each licence that none of them but a run of words
    reaches; license and dice: of the best of all, ties by name, null if there is none; licenses: all names found, sorted, joined by
    commas, empty if there are none. Null and empty texts have none. Rows that repeat a doc_id share the notices of all of them; a
    null doc_id is an id of its own. An empty table gives no rows; other columns are ignored."""
    whole = pieces(docs, templates, dice).select("doc_id", "license", "dice", F.lit(1).alias("unit"))
    every = whole.unionByName(runs(docs, templates, dice).withColumn("unit", F.lit(0)))
    per = every.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.sum("unit").alias("units"))
    best = F.min(F.struct((-F.col("dice")).alias("d"), "license"))
    found = per.groupBy("doc_id").agg(F.sum(F.greatest("units", F.lit(1))).alias("n"), best.alias("b"), F.array_join(F.sort_array(F.collect_list("license")), ",").alias("names"))  # a row for each licence
    found = found.select(F.col("doc_id").alias("_id"), "n", "b", "names")
    out = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), F.col("b.license").alias("license"), (-F.col("b.d")).alias("dice"), F.coalesce("names", F.lit("")).alias("licenses"))
