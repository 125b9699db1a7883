"""License scans: normalised text against licence templates by Dice coefficient over word bigrams.

A text is lower-cased and cut into words of letters and digits, so line ends, paragraphs and comment marks do not matter. Where
one of a template's anchor bigrams stands, the window of as many bigrams as the template has is compared with it, placed so
that the anchors meet. Every window that can reach the threshold has such an anchor. A window is compared only with templates
whose number of bigrams can still reach the threshold with its own. Everything happens within a row: no shuffle. Native:
DataFrame functions only.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

THRESHOLD = 0.85

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT '
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_FREE = "is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, "
_HOPE = (
    "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
    "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)
#: Licence notices as published, by SPDX id. A licence may have several.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software. " + _AS_IS),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
                   'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                   "limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program " + _FREE.format(name="General Public License") + "either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program " + _FREE.format(name="General Public License") + "either version 3 of the License, or (at your option) any later version. "
                "This program " + _HOPE.format(name="General Public License")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program " + _FREE.format(name="General Public License") + "either version 2 of the License, or (at your option) any later version. "
                "This program " + _HOPE.format(name="General Public License")),
    ("LGPL-3.0", "This library " + _FREE.format(name="Lesser General Public License") + "either version 3 of the License, or (at your option) any later version. "
                 "This library " + _HOPE.format(name="Lesser General Public License")),
    ("LGPL-2.1", "This library " + _FREE.format(name="Lesser General Public License") + "either version 2.1 of the License, or (at your option) any later version. "
                 "This library " + _HOPE.format(name="Lesser General Public License")),
    ("AGPL-3.0", "This program " + _FREE.format(name="Affero General Public License") + "either version 3 of the License, or (at your option) any later version. "
                 "This program " + _HOPE.format(name="Affero General Public License")),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
             "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
             "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies "
                "this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available "
                "at https://www.eclipse.org/legal/epl-2.0/"),
)

#: Creative Commons licences by the elements of their names, and identifiers with the endings that the tag may have.
_ELEMENTS = {"by": "Attribution", "sa": "ShareAlike", "nc": "NonCommercial", "nd": "NoDerivatives"}
_COMMONS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
_ENDINGS = {"GPL-2.0": ("-only", "-or-later"), "GPL-3.0": ("-only", "-or-later"), "LGPL-2.1": ("-only", "-or-later"), "LGPL-3.0": ("-only", "-or-later"), "AGPL-3.0": ("-only", "-or-later")}


def _notices() -> list[tuple[str, str]]:
    """Notices that follow from names: how to view a Creative Commons licence, and the SPDX tag of every licence."""
    out = []
    for code in _COMMONS:
        title = "-".join(_ELEMENTS[x] for x in code.split("-"))
        out.append((f"CC-{code.upper()}-4.0", f"This work is licensed under the Creative Commons {title} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{code}/4.0/"))
    for name in dict.fromkeys([n for n, _ in TEMPLATES] + [n for n, _ in out]):
        out += [(name, f"SPDX-License-Identifier: {name}{ending}") for ending in ("", *_ENDINGS.get(name, ()))]
    return out


TEMPLATES += tuple(_notices())


def template_table(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[dict]:
    """Of each template its words, its distinct bigrams, and the numbers of bigrams that a window may have to reach the threshold with it."""
    out = []
    for license_id, text in templates:
        words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        bigrams = list(dict.fromkeys(pairs))
        n = len(bigrams)
        sizes = [k for k in range(1, 2 * n * 100) if 2 * min(k, n) >= threshold * (k + n)]
        out.append({"license": license_id, "span": len(pairs), "n": n, "lo": sizes[0], "hi": sizes[-1], "bigrams": bigrams, "pairs": pairs})
    return out


def telling_words(known: list[dict], threshold: float = THRESHOLD) -> list[str]:
    """Words of which every window that can match some template holds at least one.

    A match shares at least k = threshold / 2 * (lo + n) of a template's n bigrams, so it holds one of any n - k + 1 of them;
    words, long ones first as they are rarer, are taken greedily until each template has so many bigrams with a taken word.
    """
    need = {i: t["n"] - math.ceil(threshold / 2 * (t["lo"] + t["n"]) - 1e-9) + 1 for i, t in enumerate(known)}
    left, taken = {i: set(t["bigrams"]) for i, t in enumerate(known)}, []
    while any(n > 0 for n in need.values()):
        gain = Counter()
        for i, bigrams in left.items():
            for word, n in Counter(w for b in bigrams for w in set(b.split())).items():
                gain[word] += max(0, min(n, need[i]))
        word = min(gain, key=lambda w: (-gain[w] * len(w) ** 3, w))
        taken.append(word)
        for i, bigrams in left.items():
            hit = {b for b in bigrams if word in b.split()}
            left[i] = bigrams - hit
            need[i] -= len(hit)
    return sorted(taken)


def anchors(known: list[dict], telling: list[str]) -> dict[str, list[int]]:
    """Bigrams with a telling word, and the templates and places where they stand: template * 2 ** 16 + place."""
    out: dict[str, list[int]] = {}
    for t, template in enumerate(known):
        for at, pair in enumerate(template["pairs"]):
            if set(pair.split()) & set(telling):
                out.setdefault(pair, []).append(t << 16 | at)
    return out


#: A candidate in one number: template, then start + ``SHIFT``, so that a window that would begin before the text has one too.
PLACES, SHIFT = 1 << 36, 1 << 16


def matches(lowered: Column, templates=TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """Of a lower-case text, array of ``struct(start, rank, off, span, license)`` in order of start, for windows that reach the threshold.

    ``start`` and ``span`` count words and bigrams; ``rank`` is minus the number of shared bigrams and ``off`` minus the Dice
    coefficient. Of windows with one start the one that shares most is kept, then those that no overlapping neighbour beats.
    """
    known = template_table(templates, threshold)
    telling = telling_words(known, threshold)
    where = anchors(known, telling)
    table = F.from_json(F.lit(json.dumps([{k: t[k] for k in ("license", "span", "n", "lo", "hi", "bigrams")} for t in known])), "array<struct<license string, span int, n int, lo int, hi int, bigrams array<string>>>")
    at_anchor = F.from_json(F.lit(json.dumps(where)), "map<string, array<long>>")
    some = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in telling])
    none = F.array().cast("array<string>")
    words = F.when(some, F.split(F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " ")), " ")).otherwise(none)

    # A lambda's body is computed for each element, so what it reads is bound first, by a transform of one element.
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def found(words: Column) -> Column:
        pairs = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
        spots = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(telling), i)))
        both = once(spots, lambda s: F.array_distinct(F.concat(s, F.filter(F.transform(s, lambda i: i - 1), lambda i: i >= 0))))
        return once(both, lambda s: once(pairs, lambda p: searched(p, s)))

    def searched(pairs: Column, spots: Column) -> Column:
        starts = F.transform(spots, lambda i: F.transform(F.coalesce(at_anchor[F.get(pairs, i)], F.array().cast("array<long>")), lambda a: F.shiftright(a, 16) * PLACES + i - a.bitwiseAND(F.lit((1 << 16) - 1)) + SHIFT))
        windows = F.transform(F.array_distinct(F.flatten(starts)), lambda c: F.struct(F.greatest(c % PLACES - SHIFT, F.lit(0)).cast("int").alias("start"), F.get(table, (c / PLACES).cast("int")).alias("t")))
        ready = F.transform(windows, lambda w: F.struct(w["start"].alias("start"), w["t"].alias("t"), F.array_distinct(F.slice(pairs, w["start"] + 1, w["t"]["span"])).alias("b")))
        fit = F.filter(ready, lambda w: F.size(w["b"]).between(w["t"]["lo"], w["t"]["hi"]))
        shared = F.transform(fit, lambda w: F.struct(w["start"].alias("start"), w["t"].alias("t"), F.size(w["b"]).alias("n"), F.size(F.array_intersect(w["b"], w["t"]["bigrams"])).alias("shared")))
        dice = lambda w: F.round(F.lit(2.0) * w["shared"] / (w["n"] + w["t"]["n"]), 6)
        scored = F.transform(shared, lambda w: F.struct(w["start"].alias("start"), (-w["shared"]).alias("rank"), (-dice(w)).alias("off"), w["t"]["span"].alias("span"), w["t"]["license"].alias("license")))
        return F.array_sort(F.filter(scored, lambda m: m["off"] <= -threshold))

    first = lambda m: F.filter(m, lambda x, i: F.coalesce(F.get(m, i - 1)["start"] != x["start"], F.lit(True)))
    meets = lambda a, b: b["start"] < a["start"] + a["span"]
    worth = lambda m: F.struct(m["rank"], m["off"])
    before = lambda m, x, i: F.coalesce(meets(F.get(m, i - 1), x) & (worth(F.get(m, i - 1)) <= worth(x)), F.lit(False))
    after = lambda m, x, i: F.coalesce(meets(x, F.get(m, i + 1)) & (worth(F.get(m, i + 1)) < worth(x)), F.lit(False))
    beaten = lambda m, x, i: before(m, x, i) | after(m, x, i)
    return once(once(once(words, found), first), lambda m: F.filter(m, lambda x, i: ~beaten(m, x, i)))


def scanned(docs: DataFrame, text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``license`` (best match), ``dice``, ``licenses`` (all, sorted, comma-joined) and ``n_matches`` (places).

    Null and empty texts match nothing: null license and dice, empty licenses. Of equal scores the last licence by name
    wins. Columns that clash with the new ones are replaced; others, and repeated rows, pass through.
    """
    names = ("license", "dice", "licenses", "n_matches")
    rows = docs.select(*[c for c in docs.columns if c not in names], matches(F.lower(text_of(text)), templates, threshold).alias("__found"))
    top = F.array_max(F.transform("__found", lambda m: F.struct((-m["off"]).alias("dice"), m["license"].alias("license"))))
    every = F.array_join(F.array_sort(F.array_distinct(F.transform("__found", lambda m: m["license"]))), ",")
    return rows.withColumns({"license": top["license"], "dice": top["dice"], "licenses": every, "n_matches": F.size("__found").cast("long")}).drop("__found")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _sql() -> str:
    known = template_table()
    where = anchors(known, telling_words(known))
    lists = ", ".join("({}, '{}', {}, {}, {}, {}, [{}])".format(k, t["license"], t["span"], t["n"], t["lo"], t["hi"], ", ".join(f"'{b}'" for b in t["bigrams"])) for k, t in enumerate(known))
    spots = ", ".join(f"('{pair}', {a >> 16}, {a & 0xFFFF})" for pair, places in where.items() for a in places)
    return f"""
WITH t(t, license, span, n, lo, hi, bigrams) AS (VALUES {lists}), a(pair, t, off) AS (VALUES {spots}),
d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
p AS (SELECT rid, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS pairs FROM d),
c AS (SELECT DISTINCT rid, a.t AS t, greatest(spot - off, 0) AS start FROM (SELECT rid, unnest(pairs) AS pair, unnest(range(0, len(pairs))) AS spot FROM p) JOIN a USING (pair)),
b AS (SELECT rid, start, t.*, list_distinct(list_slice(pairs, start + 1, start + span)) AS own FROM c JOIN p USING (rid) JOIN t USING (t)),
h AS (SELECT rid, start, span, license, n + len(own) AS sizes, len(list_intersect(own, bigrams)) AS shared FROM b WHERE len(own) BETWEEN lo AND hi),
s AS (SELECT *, round(2.0 * shared / sizes, 6) AS dice FROM h),
f AS (SELECT * FROM s WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY rid, start ORDER BY shared DESC, dice DESC, span, license) = 1),
k AS (SELECT *, lag(start + span) OVER o AS before, row(lag(shared) OVER o, lag(dice) OVER o) AS before_worth, lead(start) OVER o AS after, row(lead(shared) OVER o, lead(dice) OVER o) AS after_worth FROM f WINDOW o AS (PARTITION BY rid ORDER BY start)),
m AS (SELECT rid, max(row(dice, license)) AS top, count(*) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM k
  WHERE NOT coalesce(start < before AND before_worth >= row(shared, dice), false) AND NOT coalesce(after < start + span AND after_worth > row(shared, dice), false) GROUP BY rid)
SELECT d.doc_id, m.top[2] AS license, m.top[1] AS dice, coalesce(m.licenses, '') AS licenses, coalesce(m.n_matches, 0) AS n_matches
FROM d LEFT JOIN m USING (rid)
"""


ORACLE_8 = _sql()
