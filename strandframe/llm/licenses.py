"""License scans: texts against licence templates by Dice coefficient over word bigrams.

All of it is DataFrame functions in one pass without a shuffle. Texts and templates are normalised alike: lower case,
anything but letters and digits a blank. Compared, as sets of bigrams, are the whole text, each of its lines, and each run
of neighbouring lines of which every one has half of its bigrams or more in long templates (lines without words do not
part a run): so a licence that is wrapped within a longer text is found. Two sets of sizes n and m have a Dice
coefficient of 2 min(n, m) / (n + m) at most, so only templates with m between n t / (2 - t) and n (2 - t) / t can reach a
threshold t: these bounds prune templates before any comparison.

Licences that are kin differ in a few words. So a template only matches a text that holds all of its own telling bigrams
(the version, or what kind of its family it is), and none that tells of another kind.

Defined results: null and empty texts have no licence; texts of one word have no bigrams; of equal coefficients the
last template by name is told; repeated rows are alike; an empty table gives an empty result; other columns are left
alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Texts of public licences and of the notices by which they are applied.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "lgpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0-notice": "Licensed under the Mozilla Public License, version 2.0.",
    "isc-notice": "Released under the ISC License.",
    "bsd-2-clause-notice": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause-notice": "Licensed under the BSD 3-Clause License.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-sa-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4.0-long-notice": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-long-notice": "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.",
    "cc-by-4.0-long-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-1.0-notice": "Dedicated to the public domain under CC0 1.0.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced without permission.",
    "all-rights-reserved-notice": "All rights reserved.",
}

# Bigrams that tell of a version or a number of clauses, and those that tell of a kind within a family.
VERSIONS = ["version 1", "version 2", "version 3", "version 4", "2 clause", "3 clause", "by 4"]
KINDS = ["gnu lesser", "gnu library", "gnu affero", "by nc", "by sa", "by nd", "nc sa", "nc nd", "attribution sharealike", "attribution noncommercial", "attribution noderivatives", "nor the"]
#: Templates of as many bigrams are long: their lines make runs.
LONG = 20

_OTHER = r"[^\p{L}\p{N}]+"


def _bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def normalised_words(text: Column) -> Column:
    """Words of a normalised text; one empty word where there are none."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), _OTHER, " ")), " ")


def bigram_set(words: Column) -> Column:
    first = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array_distinct(F.transform(first, lambda w, i: F.concat(w, F.lit(" "), F.element_at(words, i + 2))))


def kin(bigrams: list[str]) -> tuple[list[str], list[str]]:
    """What a text must hold to be taken for a template of these bigrams, and what it must not."""
    return [b for b in (*VERSIONS, *KINDS) if b in bigrams], [b for b in KINDS if b not in bigrams]


def long_bigrams(bigrams: dict[str, list[str]]) -> list[str]:
    return sorted({b for found in bigrams.values() if len(found) >= LONG for b in found})


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id; license and dice of the best match of the whole text, a line or a run of lines (null if none reaches the
    threshold); n_lines and n_runs that match; whole_text, whether the whole text does; licenses, all names that match,
    sorted."""
    bigrams = {name: _bigrams(text) for name, text in sorted((templates or TEMPLATES).items())}
    sizes = {name: len(b) for name, b in bigrams.items()}
    # a little wide, for a bound may be met exactly
    least, most = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    low = min(sizes.values()) * least

    def strings(values: list[str]) -> Column:
        return F.array(*map(F.lit, values)).cast("array<string>")

    known = F.array(*(
        F.struct(F.lit(name).alias("name"), F.lit(len(b)).alias("n"), strings(b).alias("bigrams"), strings(kin(b)[0]).alias("needs"), strings(kin(b)[1]).alias("bars"))
        for name, b in bigrams.items()
    ))
    familiar = long_bigrams(bigrams)

    def matches(found: Column) -> Column:
        """struct(dice, name) of the templates that a set of bigrams matches."""
        near = F.filter(known, lambda t: (t["n"] >= F.size(found) * F.lit(least)) & (t["n"] <= F.size(found) * F.lit(most)))
        scored = F.transform(near, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(found, t["bigrams"])) / (F.size(found) + t["n"])).alias("dice"), t["name"].alias("name"), t["needs"].alias("needs"), t["bars"].alias("bars")))
        fits = F.filter(scored, lambda s: (s["dice"] >= F.lit(threshold)) & (F.size(F.array_intersect(found, s["needs"])) == F.size(s["needs"])) & ~F.arrays_overlap(found, s["bars"]))
        return F.transform(fits, lambda s: F.struct(s["dice"].alias("dice"), s["name"].alias("name")))

    def in_run(line: Column) -> Column:
        """What a line gives to the text of runs: itself, nothing if it has no words, or a break."""
        ours = F.size(F.filter(line["grams"], lambda g: g.isin(*familiar)))
        return F.when((F.size(line["grams"]) > 0) & (2 * ours >= F.size(line["grams"])), F.array_join(line["words"], " ")).when(line["words"][0] == "", F.lit("")).otherwise(F.lit("\n"))

    def words_of(text: Column) -> Column:
        return F.filter(F.split(text, " "), lambda w: w != "")

    def every(units: Column) -> Column:
        """The matches of each unit, an array of bigram sets, that has any."""
        return F.filter(F.transform(F.filter(units, lambda g: F.size(g) > F.lit(low)), matches), lambda m: F.size(m) > 0)

    nothing = F.array().cast("array<struct<dice:double,name:string>>")
    lines = F.transform(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), normalised_words)
    lines = docs.select("doc_id", F.transform(lines, lambda w: F.struct(w.alias("words"), bigram_set(w).alias("grams"))).alias("lines"))
    runs = F.when(F.size("lines") > 1, F.split(F.array_join(F.transform("lines", in_run), " "), "\n")).otherwise(F.array().cast("array<string>"))
    units = lines.select(
        "doc_id", (F.size("lines") == 1).alias("one_line"), F.transform("lines", lambda x: x["grams"]).alias("each"),
        F.filter(F.flatten(F.transform("lines", lambda x: x["words"])), lambda w: w != "").alias("words"),
        F.filter(runs, lambda r: F.trim(r) != "").alias("runs"),
    )
    found = units.select(
        "doc_id", "one_line", F.when(F.col("one_line"), nothing).otherwise(F.flatten(F.transform(F.array(bigram_set(F.col("words"))), matches))).alias("whole"),
        every(F.col("each")).alias("each"), every(F.transform("runs", lambda r: bigram_set(words_of(r)))).alias("runs"),
    )
    flat = found.select(
        "doc_id", "one_line", "whole", F.size("each").cast("long").alias("n_lines"), F.size("runs").cast("long").alias("n_runs"),
        F.concat("whole", F.flatten("each"), F.flatten("runs")).alias("all"),
    )
    best = F.array_max("all")
    return flat.select(
        "doc_id", best["name"].alias("license"), F.round(best["dice"], 4).alias("dice"), "n_lines", "n_runs",
        ((F.size("whole") > 0) | (F.col("one_line") & (F.col("n_lines") > 0))).alias("whole_text"), F.array_join(F.array_sort(F.array_distinct(F.transform("all", lambda m: m["name"]))), ",").alias("licenses"),
    )
