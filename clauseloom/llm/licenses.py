"""License scans by word-bigram Dice coefficients (3), DataFrame functions only.

Units of a text are normalised (lower case, letters and digits, single blanks) and compared with license templates by
2 * common / (unit + template), all counted with repeats, so that a template scores 1 against itself. With a least
coefficient d, a unit of n bigrams can match a template of m only if d / (2 - d) <= n / m <= (2 - d) / d; a unit outside
the bounds of every template is dropped by its word count, before any bigram is made, and each template is compared only
with units within its own bounds.

Units are the whole text, its paragraphs between blank lines, its lines, the sentences of its lines, and the islands of
license words: stretches in which words of any template's bigrams stand no more than ``GAP`` words apart, whatever the
lines, so that a notice is found inside a paragraph or a comment.

A text without any of the words that every match must hold has no units at all: a match lacks at most a third of its
template's bigrams, so some words that stand in more than a third of them are chosen of each template.

Units are rows for as long as they are compared; what leaves the task is one partial maximum for each document.

Null or empty text, or one without a match: ``license`` null and ``dice`` 0. Of equal coefficients the longer
template wins, then the first by name, then the earliest unit. Repeated rows each get a row. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import bind, documents, whole_text

LEAST_DICE = 0.8
BLANK_LINE = r"\n[\x20\t\r]*\n"
SENTENCE_END = r"(?<=[.!?;:])\s+"
#: Words between license words of one island at most.
GAP = 6
# Words that stand in any prose, by which no text is chosen.
COMMON_WORDS = "a an and any are as at be by for from in including is no not of on or other shall such that the this to under with without".split()

# Texts by which works are put under well-known licenses.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc0-line": "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-line": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "0bsd-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "unlicense-full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def template_bigrams(text: str) -> list[str]:
    """All bigrams in order, with repeats."""
    w = re.sub(r"[\W_]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def bounds(m: int, least: float) -> tuple[float, float]:
    """Least and greatest number of bigrams of a unit that can reach the coefficient with a template of m."""
    return m * least / (2 - least), m * (2 - least) / least


def needed_words(grams: list[str], least: float) -> list[str]:
    """Words of which a match holds one at least: they stand in more bigrams than a match may lack."""
    lacking = len(grams) - bounds(len(grams), least)[0]
    left, chosen = Counter(grams), []
    while sum(left.values()) >= len(grams) - lacking:
        by = Counter()
        for g, n in left.items():
            for w in set(g.split(" ")):
                by[w] += n * (w not in COMMON_WORDS)
        if not by or max(by.values()) == 0:
            return []
        best = max(sorted(by), key=lambda w: (by[w], len(w)))
        chosen.append(best)
        left = Counter({g: n for g, n in left.items() if best not in g.split(" ")})
    return chosen


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bigrams(w: Column) -> Column:
    return F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda x, y: F.concat_ws(" ", x, y))


def islands(text: Column, vocabulary: list[str], gap: int = GAP) -> Column:
    """Stretches of the normalised text whose bigrams of the vocabulary stand no more than ``gap`` words apart."""

    def cut(w: Column) -> Column:
        found = F.filter(F.transform(_bigrams(w), lambda x, i: F.when(x.isin(vocabulary), i)), lambda i: i.isNotNull())

        def stretches(h: Column) -> Column:
            first = F.filter(h, lambda i, k: (k == 0) | (i - F.get(h, k - 1) > gap))
            last = F.filter(h, lambda i, k: (k == F.size(h) - 1) | (F.get(h, k + 1) - i > gap))
            return F.zip_with(first, last, lambda a, b: F.array_join(F.slice(w, a + 1, b - a + 2), " "))

        return bind(found, stretches)

    return bind(F.split(normalised(text), " "), lambda w: F.when(F.size(w) > 1, cut(w)).otherwise(F.array().cast("array<string>")))


def license_scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_DICE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, dice, unit, n_compared) for each of df's rows: the best match of any unit."""
    grams = {name: template_bigrams(t) for name, t in sorted(templates.items())}
    low, high = min(bounds(len(g), least)[0] for g in grams.values()), max(bounds(len(g), least)[1] for g in grams.values())
    needed = [needed_words(g, least) for g in grams.values()]
    vocabulary = sorted({g for own in grams.values() for g in own})
    base = df.select(F.monotonically_increasing_id().alias("_uid"), F.col(doc_id).alias("doc_id"), whole_text(text).alias("_t"))
    none = F.array().cast("array<string>")
    lines = F.split("_t", "\n")
    units = F.concat(
        F.array("_t"),
        F.when(F.size(lines) > 1, lines).otherwise(none),
        F.when(F.col("_t").rlike(BLANK_LINE), F.filter(F.split("_t", BLANK_LINE), lambda x: F.contains(x, F.lit("\n")))).otherwise(none),
        F.flatten(F.transform(lines, lambda x: bind(F.split(x, SENTENCE_END), lambda s: F.when(F.size(s) > 1, s).otherwise(none)))),
        islands(F.col("_t"), vocabulary),
    )
    if all(needed):
        units = F.when(F.lower("_t").rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted({w for own in needed for w in own})) + r")(?![\p{L}\p{N}])"), units).otherwise(none)
    rows = base.select("_uid", "doc_id", F.posexplode_outer(units).alias("unit", "_u"))
    # a bigram takes three characters at least
    rows = rows.select("_uid", "doc_id", "unit", F.when(F.length("_u") >= 3 * low, F.split(normalised(F.col("_u")), " ")).alias("_w"))
    rows = rows.withColumn("_m", F.coalesce(F.size("_w") - 1, F.lit(-1)))
    # whatever a unit shares with a template is among the bigrams of all templates
    shared = F.filter(_bigrams(F.col("_w")), lambda x: x.isin(vocabulary))
    rows = rows.select("_uid", "doc_id", "unit", "_m", F.when(F.col("_m").between(low, high), shared).alias("_k"))
    scores = []
    for name, g in grams.items():
        again = [(x, n) for x, n in Counter(g).items() if n > 1]
        # each bigram as often as it stands in both
        more = [F.greatest(F.least(F.size("_k") - F.size(F.array_remove("_k", x)), F.lit(n)) - 1, F.lit(0)) for x, n in again]
        common = reduce(lambda a, b: a + b, more, F.size(F.array_intersect("_k", F.lit(sorted(set(g))))))
        possible = F.col("_m").between(*bounds(len(g), least)) & (2 * F.size("_k") >= least * (F.col("_m") + len(g)))
        scores.append(F.when(possible, F.struct((-2 * common / (F.col("_m") + len(g))).alias("d"), F.lit(-len(g)).alias("s"), F.lit(name).alias("l"))))
    best = F.when(F.size("_k") > 0, F.array_min(F.filter(F.array(*scores), lambda x: x["d"] <= -least)))
    rows = rows.select("_uid", "doc_id", "unit", F.isnotnull("_k").cast("long").alias("_c"), best.alias("_b"))
    order = F.when(F.col("_b").isNotNull(), F.struct(F.col("_b.d").alias("d"), F.col("_b.s").alias("s"), F.col("_b.l").alias("l"), "unit"))
    found = rows.groupBy("_uid", "doc_id").agg(F.min(order).alias("m"), F.sum("_c").alias("n_compared"))
    return found.select("doc_id", F.col("m.l").alias("license"), F.coalesce(-F.col("m.d"), F.lit(0.0)).alias("dice"), F.col("m.unit").alias("unit"), "n_compared")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    found = license_scan(documents(spark, sf_dir))
    return found.select("doc_id", "license", F.round("dice", 6).alias("dice"), F.col("unit").cast("long").alias("unit"), "n_compared")
