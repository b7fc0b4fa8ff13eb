"""License scans: texts, blocks, lines and runs of lines against licence templates by the Dice coefficient over word bigrams.

A unit with a distinct bigrams and a template with b share at most min(a, b), so a pair can
only reach the threshold t when a lies between t b / (2 - t) and b (2 - t) / t. Units out of
all templates' bounds go before their bigrams are made: a unit of n words, d of them
distinct, has between d - 1 and n - 1 bigrams. Units that reach the threshold share at least
t b / (2 - t) bigrams with a template; so few of its bigrams are free of its anchor words that
one of these must stand in the unit, and texts without any anchor are skipped at once.
A licence inside a longer text is a run of lines: from each line with an anchor to each later one,
up to the words the longest template allows. Lines are taken in small groups, and a group goes on only
where it shares enough bigrams with some template. Nothing is shuffled.
"""

import re
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from shelfrank.llm.common import pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_END = r"\n[ \t\r]*\n"

# Texts of public licences and of notices that refer to them.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0 notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0 notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "MIT line": "Released under the MIT License.",
    "MIT licensed line": "This project is licensed under the MIT License.",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Rights reserved line": "Copyright. All rights reserved.",
}
THRESHOLD = 0.8
# First lines looked at together; only the size of a row depends on it, not the result.
LINES_TOGETHER = 16


def words_of(text: str) -> list[str]:
    """Words of a template: runs of a-z and 0-9 after lower-casing A-Z."""
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds_of(bigrams: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams a unit can have to reach the threshold with a template of ``bigrams``."""
    return ceil(threshold * bigrams / (2 - threshold) - 1e-9), int(bigrams * (2 - threshold) / threshold + 1e-9)


def anchors_of(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which one stands in every unit that reaches the threshold with some template.

    Of each template words are taken until fewer bigrams are free of them than a unit has to share; words that
    many bigrams of all templates hold come first, short ones last.
    """
    use: dict[str, int] = {}
    for text in templates.values():
        for pair in bigrams_of(text):
            for word in pair.split(" "):
                use[word] = use.get(word, 0) + 1
    rank = sorted(use, key=lambda w: (len(w) < 5, -use[w], w))
    taken: set[str] = set()
    for text in templates.values():
        pairs = [set(p.split(" ")) for p in bigrams_of(text)]
        least = bounds_of(len(pairs), threshold)[0]
        for word in rank:
            if sum(not p & taken for p in pairs) < least:
                break
            if any(word in p for p in pairs):
                taken.add(word)
    return sorted(taken)


def _units(text: Column) -> Column:
    """Lines, blocks of several lines, and the text where it has several blocks."""
    unit = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), (i + 1).cast("int").alias("number"), x.alias("body"))
    lines, blocks = F.split(text, "\n", -1), F.split(text, BLOCK_END, -1)
    several = F.filter(F.transform(blocks, unit("block")), lambda u: F.contains(u["body"], F.lit("\n")))
    whole = F.transform(F.array(text), unit("text"))
    return F.concat(F.transform(lines, unit("line")), several, F.when(F.size(blocks) > 1, whole).otherwise(F.slice(whole, 1, 0)))


def longest_run(templates: dict[str, str], threshold: float) -> int:
    """Most words of a run of lines: those of the longest template, times the ratio of sizes the threshold allows."""
    return int(max(len(words_of(t)) for t in templates.values()) * (2 - threshold) / threshold + 1e-9) + 1


def _once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pairs(words: Column) -> Column:
    """Distinct bigrams of an array of words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


class _Templates:
    """Bigrams and bounds of the templates as literals."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold, self.names = threshold, sorted(templates)
        self.bigrams = [bigrams_of(templates[n]) for n in self.names]
        if not 0 < threshold <= 1 or not all(self.bigrams):
            raise ValueError("the threshold lies above 0 and up to 1, and each template has two words at least")
        self.bounds = [bounds_of(len(b), threshold) for b in self.bigrams]

    def shared(self, pairs: Column):
        return [F.size(F.array_intersect(pairs, F.array(*[F.lit(x) for x in theirs]))) for theirs in self.bigrams]

    def may_hold(self, pairs: Column) -> Column:
        """Whether some part of a text with these bigrams can reach the threshold."""
        enough = F.lit(False)
        for shared, (low, _) in zip(self.shared(pairs), self.bounds):
            enough = enough | (shared >= low)
        return enough

    def best(self, pairs: Column) -> Column:
        """struct(dice, license, b, a) of the best template, the first by name of equal ones; null below the threshold."""
        a, scores = F.size(pairs), []
        for name, shared, theirs, (low, high) in zip(self.names, self.shared(pairs), self.bigrams, self.bounds):
            dice = F.when(a.between(low, high), 2 * shared / (a + len(theirs)))
            scores.append(F.struct(dice.alias("dice"), F.lit(name).alias("license"), F.lit(len(theirs)).alias("b"), a.alias("a")))
        order = lambda x, y: F.when(x["dice"] > y["dice"], -1).when(x["dice"] < y["dice"], 1).when(x["license"] < y["license"], -1).otherwise(1)
        return F.get(F.array_sort(F.filter(F.array(*scores), lambda s: s["dice"] >= self.threshold), order), F.lit(0))


def _line_groups(texts: DataFrame, anchors: list[str], longest: int) -> DataFrame:
    """(id, words, lines, first, count): for each group of first lines the words and lines its runs and its neighbours' runs can reach.

    ``lines`` are those with an anchor: number, and begin and end among ``words``. First lines are ``lines`` from
    ``first`` on, ``count`` of them; the one before and the one behind them are there too.
    """
    low = F.regexp_replace(F.regexp_replace(F.translate("text", UPPER, LOWER), "[^a-z0-9\n]+", " "), "\n", " \n ")
    tokens = F.split(F.trim(F.regexp_replace(low, " +", " ")), " ")

    def lines_of(tokens):
        places = F.filter(F.transform(tokens, lambda x, i: F.when(x == "\n", i)), lambda i: i.isNotNull())
        return F.struct(F.filter(tokens, lambda x: x != "\n").alias("words"), F.concat(places, F.array(F.size(tokens))).alias("ends"))

    def anchored(parts):
        words, ends = parts["words"], parts["ends"]
        begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) - k + 1)
        lines = F.transform(ends, lambda p, k: F.struct((k + 1).cast("int").alias("line"), begin(k).cast("int").alias("begin"), (p - k).cast("int").alias("end")))
        marks = F.array(*[F.lit(a) for a in anchors])
        held = F.filter(lines, lambda l: (l["end"] > l["begin"]) & F.arrays_overlap(F.slice(words, l["begin"] + 1, l["end"] - l["begin"]), marks))
        return F.struct(words.alias("words"), held.alias("lines"))

    def groups(parts):
        words, lines = parts["words"], parts["lines"]

        def group(at):
            first = F.greatest(at - 1, F.lit(0))
            near = F.slice(lines, first + 1, at - first + LINES_TOGETHER + 1 + longest)
            start = F.get(lines, first)["begin"]
            last = F.get(lines, F.least(at + LINES_TOGETHER, F.size(lines) - 1))["begin"]
            shifted = F.transform(near, lambda l: F.struct(l["line"].alias("line"), (l["begin"] - start).alias("begin"), (l["end"] - start).alias("end")))
            count = F.least(F.lit(LINES_TOGETHER), F.size(lines) - at)
            return F.struct(F.slice(words, start + 1, last - start + longest).alias("words"), shifted.alias("lines"), (at - first).cast("int").alias("first"), count.cast("int").alias("count"))

        return F.when(F.size(lines) > 1, F.transform(F.sequence(F.lit(0), F.size(lines) - 1, F.lit(LINES_TOGETHER)), group))

    found = _once(tokens, lambda t: _once(lines_of(t), lambda p: _once(anchored(p), groups)))
    return texts.select("id", F.explode(found).alias("group")).select("id", "group.*")


def _runs(texts: DataFrame, known: _Templates, anchors: list[str], longest: int) -> DataFrame:
    """(id, number, last, best) of the runs of lines that reach the threshold."""
    likely = _line_groups(texts, anchors, longest).filter(_once(_pairs(F.col("words")), known.may_hold))
    words, lines = F.col("words"), F.col("lines")

    def best_from(s, i):
        """The best run that begins with line ``s``, the shortest of equal ones."""
        ends = F.filter(F.slice(lines, i + 2, F.lit(longest)), lambda e: e["end"] - s["begin"] <= longest)
        body = lambda e: F.slice(words, s["begin"] + 1, e["end"] - s["begin"])
        made = lambda e: _once(_pairs(body(e)), known.best)
        runs = F.transform(ends, lambda e: F.struct(s["line"].alias("number"), e["line"].alias("last"), made(e).alias("best")))
        order = lambda x, y: F.when(x["best"]["dice"] > y["best"]["dice"], -1).when(x["best"]["dice"] < y["best"]["dice"], 1).otherwise(x["last"] - y["last"])
        reached = F.get(F.array_sort(F.filter(runs, lambda r: r["best"].isNotNull()), order), F.lit(0))
        return F.when(_once(_pairs(F.slice(words, s["begin"] + 1, F.lit(longest))), known.may_hold), reached)

    def kept(bests):
        dice = lambda r: r["best"]["dice"]
        beaten = lambda r, other, tie: F.coalesce((other["last"] == r["last"]) & ((dice(other) > dice(r)) | (F.lit(tie) & (dice(other) == dice(r)))), F.lit(False))
        # The neighbours of a group are there for comparison only.
        numbers = F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)
        stays = lambda i: F.get(bests, i).isNotNull() & ~beaten(F.get(bests, i), F.get(bests, i - 1), True) & ~beaten(F.get(bests, i), F.get(bests, i + 1), False)
        return F.transform(F.filter(numbers, stays), lambda i: F.get(bests, i))

    firsts = F.slice(lines, F.lit(1), F.col("first") + F.col("count") + 1)
    found = _once(F.transform(firsts, best_from), kept)
    return likely.select("id", F.explode(found).alias("run")).select("id", "run.number", "run.last", "run.best")


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, kind, number, last, license, shared, unit_bigrams, dice) of every unit whose best template reaches ``threshold``.

    Units are a text's lines, its blocks between blank lines where they have several lines,
    the whole text where it has several blocks, each numbered from 1, and runs of lines, from line ``number`` to line ``last``
    (null for the other kinds), whose first and last line hold an anchor word. A run has at most ``longest_run`` words; blank lines may lie
    in it. Of the runs that begin with a line the best counts, the shortest of equal ones; it goes where the best run of the anchored line
    before or behind ends with the same line and is better, or as good and longer. Of equally good
    templates the first by name wins. Null and empty texts have no unit that matches; repeated rows
    are scanned each; an empty table gives no rows. ``templates`` travel inside the plan: some hundred at most.
    """
    known = _Templates(templates, threshold)
    marks = anchors_of(templates, threshold)
    anchors = "|".join(marks)
    texts = pick(df, id=id_col, text=text_col).filter(F.rlike("text", F.lit(f"(?i)(?<![a-z0-9])(?:{anchors})(?![a-z0-9])")))
    units = texts.select("id", F.explode(_units(F.col("text"))).alias("unit")).select("id", "unit.kind", "unit.number", F.trim(F.regexp_replace(F.translate("unit.body", UPPER, LOWER), "[^a-z0-9]+", " ")).alias("plain"))
    held = units.filter(F.rlike("plain", F.lit(rf"\b(?:{anchors})\b"))).withColumn("words", F.split("plain", " "))
    sized = held.filter((F.size("words") > min(low for low, _ in known.bounds)) & (F.size(F.array_distinct("words")) - 1 <= max(high for _, high in known.bounds)))
    paired = sized.select("id", "kind", "number", F.lit(None).cast("int").alias("last"), _pairs(F.col("words")).alias("pairs"))
    single = paired.withColumn("best", known.best(F.col("pairs"))).drop("pairs")
    runs = _runs(texts, known, marks, longest_run(templates, threshold)).select("id", F.lit("run").alias("kind"), "number", "last", "best")
    found = single.unionByName(runs).filter(F.col("best").isNotNull())
    shared = F.round(F.col("best.dice") * (F.col("best.a") + F.col("best.b")) / 2).cast("int")
    return found.select("id", "kind", "number", "last", "best.license", shared.alias("shared"), F.col("best.a").alias("unit_bigrams"), F.round("best.dice", 6).alias("dice"))
