"""Licence scans by canonical digests, in DataFrame functions only.

A text is brought to a canonical form once: lower case, copyright lines dropped,
equivalent spellings made one, punctuation and white space reduced to single
spaces.  The digest of the whole form, and that of each run of its lines which
begins and ends as a known text does, is hash-joined to the digests of known
licences; nothing is matched in part.  So a licence file is found, and a notice
of one line, and a header wrapped at will inside other text.

Null and empty texts, and texts whose canonical form is empty, match nothing;
repeated documents each keep a row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .bounded import broadcast_if_small
from ..storage import stored

#: Equivalent spellings of single words, and the form that stands for both.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "acknowledgements": "acknowledgments",
    "authorised": "authorized",
    "centre": "center",
    "favour": "favor",
    "https": "http",
    "licence": "license",
    "licenced": "licensed",
    "licencee": "licensee",
    "licences": "licenses",
    "merchantable": "merchantability",
    "noncommercial": "non commercial",
    "organisation": "organization",
    "organisations": "organizations",
    "owner": "holder",
    "owners": "holders",
    "percent": "per cent",
    "recognise": "recognize",
    "sublicence": "sub license",
    "sublicense": "sub license",
    "v": "version",
    "v1": "version 1",
    "v2": "version 2",
    "v3": "version 3",
    "v4": "version 4",
    "ver": "version",
}
#: Within lines, in multi-line mode; blank and comment marks before the notice go with it.
COPYRIGHT_LINE = r"^[\s#*/;-]*(?:copyright|\(c\)|©)[^\n]*(?:\(c\)|©|[0-9]{4}|all rights reserved)[^\n]*$"

#: Known licences and their usual notices. Full texts in the folder ``license_texts`` and variants are added below.
KNOWN = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ],
}


#: Titles that stand above a text that has none of its own.
TITLES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License", "MIT-0"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License"],
}
#: Names by which one-line notices call a licence.
NAMES = {
    "0BSD": ["BSD Zero Clause License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
}
NOTICES = ["Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This project is licensed under {}", "This software is licensed under {}"]
PROGRAM = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published
by the Free Software Foundation, either version {number} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details.

You should have received a copy of the GNU {kind} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_ADDRESSES = [
    "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
    "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA", "",
]


def _variants(text: str) -> list[str]:
    """Forms in which a full text is commonly shipped."""
    # Without the appendix on how to apply it, and without the line that ends the terms.
    forms, end = [text], re.search(r"END OF TERMS AND CONDITIONS", text)
    if end:
        forms += [text[: end.end()], text[: end.start()]]
    # A form to fill in becomes a copyright line, which is dropped.
    forms += [re.sub(r"(?m)^\s*Copyright \[yyyy\].*$", "", x) for x in forms]
    # The header's address of the foundation, which is its own line in some editions.
    forms += [re.sub(r"(?m)(\A.*?)^ *51 Franklin[^\n]*$", lambda m, a=a: m[1] + a, x, count=1, flags=re.S) for x in forms for a in _ADDRESSES if "51 Franklin" in x[:400]]
    return list(dict.fromkeys(forms))


def _listed() -> dict[str, list[str]]:
    """``KNOWN`` with the texts of the folder, variants, titles and one-line notices."""
    out = {name: list(texts) for name, texts in KNOWN.items()}
    for file in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda x: x.name):
        if file.name.endswith(".txt"):
            out.setdefault(file.name[:-4], []).extend(_variants(file.read_text(encoding="utf-8")))
    mit = KNOWN["MIT"][2]
    out["MIT"] += [mit.replace("permission notice shall", "permission notice (including the next paragraph) shall"), mit.replace("NONINFRINGEMENT", "NON-INFRINGEMENT")]
    out["MIT-0"] = [re.sub(r"do so, subject to.*?(?=THE SOFTWARE IS)", "do so.\n\n", mit, flags=re.S)]
    for name in ("BSD-2-Clause", "BSD-3-Clause"):
        # Clauses are bulleted as often as numbered, and the rights reserved stand on a line of their own.
        out[name] += [re.sub(r"(?m)^\s*[123]\. ", "* ", x) for x in out[name]]
        out[name] += ["All rights reserved.\n\n" + x for x in out[name]]
    for name, titles in TITLES.items():
        out[name] += [f"{title}\n\n{text}" for text in out[name] if len(text) > 300 for title in titles]
    for name, kind, number in (("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3")):
        out.setdefault(name, []).append(PROGRAM.format(kind=kind, number=number))
    for name, called in NAMES.items():
        out.setdefault(name, []).extend(notice.format(the + x) + "." for x in called for notice in NOTICES for the in ("", "the ", "a "))
    for name in out:
        out[name] += [f"SPDX-License-Identifier: {name}"]
        if "GPL" in name:
            out[name] += [f"SPDX-License-Identifier: {name}-only", f"SPDX-License-Identifier: {name}-or-later"]
    return {name: list(dict.fromkeys(texts)) for name, texts in out.items()}


KNOWN = _listed()


#: Words at both ends of a known text by which it is looked for.
ENDS = 4


def _marked(text: Column) -> Column:
    """The canonical form, each line's first word marked by a line break before it; words are parted by one space."""
    found = F.regexp_replace(F.lower(text), "(?md)" + COPYRIGHT_LINE, " ")
    found = F.regexp_replace(F.replace(found, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}\n]+", " ")
    found = F.regexp_replace(F.regexp_replace(found, r" *\n[ \n]*", " \n"), r"^[ \n]+|[ \n]+$", "")
    both = {mark + a: mark + b for a, b in SPELLINGS.items() for mark in ("", "\n")}
    forms = F.create_map(*(F.lit(x) for pair in both.items() for x in pair))
    # The set test is a hash lookup; the map, which is searched in order, is asked for the few words it has.
    words = F.transform(F.split(F.concat(F.lit("\n"), found), " "), lambda w: F.when(~w.isin(*both), w).otherwise(F.try_element_at(forms, w)))
    return F.array_join(words, " ")


def canonical(text: Column) -> Column:
    return F.translate(_marked(text), "\n", "")


@dataclass(frozen=True)
class Digests:
    """Known texts as digests: ``(digest, license)`` rows, and by the key of their first words ``(n words, key of the last)``."""

    rows: list[tuple[str, str]]
    by_start: dict[int, list[tuple[int, int]]]
    #: Lengths of starts in words, and words of which every known text holds one, as they may be written.
    starts: list[int]
    telling: list[str]


def _key(words: Column) -> Column:
    return F.xxhash64(F.translate(F.array_join(words, " "), "\n", ""))


def _telling(texts: list[str]) -> list[str]:
    """Strings of which every one of the canonical ``texts`` has one when written: the most common words, while texts are left.

    A word counts by itself and by each spelling that it may stand for, and not
    if one of these is too short to tell anything.
    """
    left = [set(text.split(" ")) for text in texts]
    out: list[str] = []
    while left:
        counts = Counter(w for words in left for w in words)
        ways = {w: [w, *(a for a, b in SPELLINGS.items() if w in b.split(" "))] for w in counts}
        # "&" is written for "and" without any letter of it.
        usable = [w for w in counts if w != "and" and min(map(len, ways[w])) >= 5] or [w for w in counts if w != "and"]
        if not usable:
            return [""]
        best = max(usable, key=lambda w: (counts[w], len(w), w))
        out += ways[best]
        left = [words for words in left if best not in words]
    return sorted(set(out))


_DEFAULT: list[Digests] = []


def known_digests(spark: SparkSession, known: dict[str, list[str]] | None = None) -> Digests:
    """Digests of the known texts, a list of constants; of one text under several names the least name holds."""
    if known is None:
        if not _DEFAULT:  # the same in every session
            _DEFAULT.append(known_digests(spark, KNOWN))
        return _DEFAULT[0]
    rows = [(name, text) for name, texts in known.items() for text in texts]
    table = spark.createDataFrame(rows, "license string, text string").select("license", canonical(F.col("text")).alias("c")).where("c <> ''")
    words = F.split("c", " ")
    n, size = F.size(words), F.least(F.size(words), F.lit(ENDS))
    first, last = _key(F.slice(words, F.lit(1), size)), _key(F.slice(words, n - size + 1, size))
    table = table.groupBy("c").agg(F.min("license").alias("license")).select("c", "license", F.sha2("c", 256).alias("digest"), n.alias("n"), size.alias("k"), first.alias("first"), last.alias("last"))
    found = sorted(table.collect())
    by_start: dict[int, list[tuple[int, int]]] = {}
    for row in found:
        if (row.n, row.last) not in by_start.setdefault(row.first, []):
            by_start[row.first].append((row.n, row.last))
    return Digests([(r.digest, r.license) for r in found], by_start, sorted({r.k for r in found}), _telling([r.c for r in found]))


def matches(docs: DataFrame, known: Digests | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, h, start, stop, whole, license``: runs of whole lines that are a known text, none inside a longer one.

    ``start`` and ``stop`` count canonical words; ``whole`` tells the entire
    text; h is the digest of the text.  Lines may be wrapped at will.  A text
    without any telling word is left at once; in others each line's first words
    are looked up, and a run that begins and ends as a known text does is
    digested and joined.
    """
    spark = docs.sparkSession
    known = known_digests(spark) if known is None else known
    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("t")).where("t is not null")
    body = body.where(F.lower("t").rlike("|".join(known.telling)) if known.telling else F.lit(False))
    if not known.rows:
        return body.select("doc_id", F.lit("").alias("h"), F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit(False).alias("whole"), F.lit("").alias("license")).limit(0)
    # Written out, as a thousand columns would take the driver seconds to make.
    ends = {key: ", ".join(f"named_struct('n', {n}, 'last', {last}L)" for n, last in ends) for key, ends in known.by_start.items()}
    lengths = F.expr("map(" + ", ".join(f"{key}L, array({text})" for key, text in ends.items()) + ")")

    def runs(w: Column) -> Column:
        """``start, stop, digest`` of runs of the words ``w`` that begin and end as a known text."""
        n = F.size(w)
        lines = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.startswith(F.get(w, i), F.lit("\n")))

        def begun(k: int) -> Column:
            return F.filter(F.transform(lines, lambda i: F.struct(i.alias("i"), _key(F.slice(w, i + 1, F.lit(k))).alias("key"), F.lit(k).alias("k"))), lambda x: x["key"].isin(*known.by_start))

        def ended(x: Column) -> Column:
            def fits(e: Column) -> Column:
                stop = x["i"] + e["n"]
                at_line = (stop == n) | F.startswith(F.get(w, stop), F.lit("\n"))
                return (stop <= n) & (F.least(e["n"], F.lit(ENDS)) == x["k"]) & at_line & (_key(F.slice(w, stop - x["k"] + 1, x["k"])) == e["last"])

            said = lambda e: F.sha2(F.translate(F.array_join(F.slice(w, x["i"] + 1, e["n"]), " "), "\n", ""), 256)
            return F.transform(F.filter(F.try_element_at(lengths, x["key"]), fits), lambda e: F.struct(x["i"].alias("start"), (x["i"] + e["n"]).alias("stop"), said(e).alias("digest"), (e["n"] == n).alias("whole")))

        return F.flatten(F.transform(F.concat(*map(begun, known.starts)), ended))

    # The words are the one element of an array, so that they are cut once and not again in each lambda.
    found = F.get(F.transform(F.array(F.split(_marked(F.col("t")), " ")), runs), F.lit(0))
    rows = body.select("doc_id", F.md5(F.col("t").cast("binary")).alias("h"), F.explode(found).alias("r")).select("doc_id", "h", "r.*")
    # Constants: as many rows as there are known texts.
    table = F.broadcast(spark.createDataFrame(known.rows, "digest string, license string"))
    rows = rows.join(table, "digest").select("doc_id", "h", "start", "stop", "whole", "license").distinct()
    # In order of starts, longer runs first, a run inside another ends no later than one before it does.
    ahead = Window.partitionBy("doc_id", "h").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("reach", F.max("stop").over(ahead)).where("reach is null or reach < stop").drop("reach")


def scan(docs: DataFrame, known: Digests | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, whole_license, n_notices, licenses``, a row for each row of ``docs``.

    ``whole_license`` is set if the entire text is a known licence or notice;
    ``n_notices`` counts the runs of lines that are; ``licenses`` are the distinct
    ones, comma-joined.
    """
    found = matches(docs, known, id_col, text)
    by_text = found.groupBy("doc_id", "h").agg(
        F.max(F.when(F.col("whole"), F.col("license"))).alias("whole"),
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("all"),
    )
    small = broadcast_if_small(stored(by_text, "licensed"), 100_000)
    rows = docs.select(F.col(id_col).alias("i"), F.md5(F.col(text).cast("string").cast("binary")).alias("d"))
    rows = rows.join(small, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("d") == F.col("h")), "left")
    return rows.select(
        F.col("i").alias("doc_id"), F.col("whole").alias("whole_license"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("all", F.lit("")).alias("licenses"),
    )
