"""Licence scans by canonical digest: whole texts, hash-joined to known licence texts.

A text is made canonical (letters A-Z in lower case, copyright lines left out, punctuation and
white space as one space, equivalent spellings as one), digested with SHA-256, and looked up in a
table of digests of known texts. Both the whole document and each of its lines are such texts, as
licence statements stand on lines of their own. Only texts whose canonical length some known text
has are digested: others can't be equal.

The table of known digests is broadcast if it has at most `broadcast_rows` rows (of two short
strings) and joined by a shuffle beyond that. Nothing here leaves DataFrame functions.

Defined results: rows without an id are left out; null text counts as empty, whose canonical text
is empty and matches nothing; rows that repeat an id and a text have the same result; other
columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

# Texts of licences and usual statements, after the published ones.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""
_ISC = _0BSD[:-1] + ", provided that the above copyright notice and this permission notice appear in all copies."
_AS_IS = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_TEXTS = (
    ("MIT", "MIT License\n" + _MIT), ("MIT", _MIT), ("0BSD", _0BSD + _AS_IS), ("ISC", _ISC + _AS_IS), ("BSD-2-Clause", _BSD_2 + _BSD_END), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END), ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_2 + _BSD_3 + _BSD_END), ("Unlicense", _UNLICENSE), ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
)
#: How statements on one line name a licence.
_NAMES = (
    ("MIT", "the MIT License"), ("0BSD", "the BSD Zero Clause License"), ("ISC", "the ISC License"), ("BSD-2-Clause", "the BSD 2-Clause License"), ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("Apache-2.0", "the Apache License, Version 2.0"), ("Apache-2.0", "the Apache License 2.0"), ("MPL-2.0", "the Mozilla Public License, version 2.0"), ("MPL-2.0", "the Mozilla Public License 2.0"),
    ("GPL-2.0-only", "the GNU General Public License, version 2"), ("GPL-3.0-only", "the GNU General Public License, version 3"), ("LGPL-2.1-only", "the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0-only", "the GNU Lesser General Public License, version 3"), ("AGPL-3.0-only", "the GNU Affero General Public License, version 3"), ("EPL-2.0", "the Eclipse Public License, version 2.0"),
    ("Unlicense", "the Unlicense"), ("Zlib", "the zlib License"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC0-1.0", "CC0 1.0"),
)
_SAID = ("Released under {}.", "Licensed under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "Distributed under {}.")
KNOWN = _TEXTS + tuple((k, said.format(name)) for k, name in _NAMES for said in _SAID)
#: Equivalent spellings, as whole words of canonical text.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sublicence", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("organisation", "organization"), ("favour", "favor"), ("fulfil", "fulfill"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT = r"^[^a-z0-9]*(copyright[^a-z0-9]*(c[^a-z0-9]|[0-9]{4}|year)|c\) *(copyright|[0-9]{4})|all rights reserved|©)"
PUNCTUATION = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def lines(text: Column) -> Column:
    """Canonical lines of a text, before spellings; copyright lines are empty."""
    low = F.translate(text, UPPER, LOWER)
    return F.transform(F.split(low, "\n", -1), lambda x: F.when(x.rlike(COPYRIGHT), F.lit("")).otherwise(F.trim(F.regexp_replace(x, PUNCTUATION, " "))))


def spelled(text: Column) -> Column:
    return F.trim(reduce(lambda t, pair: F.replace(t, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), SPELLINGS, F.concat(F.lit(" "), text, F.lit(" "))))


def whole(canonical_lines: Column) -> Column:
    return spelled(F.array_join(F.filter(canonical_lines, lambda x: x != ""), " "))


def digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """digest, length, license_id of known texts; of texts that agree the least id."""
    given = F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("text")) for k, v in known])
    rows = spark.range(1).select(F.explode(given).alias("t")).select("t.license_id", "t.text").select("license_id", whole(lines(F.col("text"))).alias("text"))
    return rows.filter("text <> ''").groupBy(F.sha2("text", 256).alias("digest"), F.length("text").alias("length")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """doc_id, text_digest (of the whole canonical text), license_id (of the whole text), line_licenses (ids of lines, sorted, comma-joined)."""
    work = Workspace(docs.sparkSession, "licenses")
    known = work.keep(known, "known")
    n, sizes = known.count(), [r.length for r in known.select("length").distinct().limit(1000).collect()]
    lookup = known.select("digest", "license_id")
    lookup = F.broadcast(lookup) if n <= broadcast_rows else lookup
    may_match = (lambda x: F.length(x).isin(sizes)) if len(sizes) < 1000 else (lambda x: x != "")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), lines(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("lines")).filter("doc_id is not null")
    rows = rows.select("doc_id", whole(F.col("lines")).alias("all"), F.transform("lines", spelled).alias("lines"))
    units = F.transform(F.array_distinct(F.filter("lines", may_match)), lambda x: F.sha2(x, 256))
    rows = work.keep(rows.select("doc_id", F.sha2("all", 256).alias("text_digest"), units.alias("units")), "digests")

    lone = rows.select("doc_id", "text_digest", F.explode("units").alias("digest")).join(lookup, "digest").groupBy("doc_id", "text_digest").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("line_licenses"))
    entire = rows.select("doc_id", "text_digest").join(lookup.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    return entire.join(lone, ["doc_id", "text_digest"], "left").select("doc_id", "text_digest", "license_id", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))


def oracle_sql(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """The same over tables `documents` and the given texts, for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    spell = lambda t: "trim(" + reduce(lambda x, p: f"replace({x}, ' {p[0]} ', ' {p[1]} ')", SPELLINGS, f"(' ' || {t} || ' ')") + ")"
    split = lambda t: f"list_transform(string_split(translate({t}, '{UPPER}', '{LOWER}'), chr(10)), lambda x: CASE WHEN regexp_matches(x, {quote(COPYRIGHT)}) THEN '' ELSE trim(regexp_replace(x, {quote(PUNCTUATION)}, ' ', 'g')) END)"
    join = lambda x: f"array_to_string(list_filter({x}, lambda x: x <> ''), ' ')"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in known)
    return f"""
WITH given AS (SELECT license_id, {spell(join(split('text')))} AS text FROM (VALUES {values}) AS t(license_id, text)),
known AS (SELECT sha256(text) AS digest, min(license_id) AS license_id FROM given WHERE text <> '' GROUP BY 1),
rows AS (SELECT doc_id, {split("coalesce(text, '')")} AS lines FROM documents WHERE doc_id IS NOT NULL),
canon AS (SELECT doc_id, sha256({spell(join('lines'))}) AS text_digest, list_distinct(list_transform(lines, lambda x: {spell("x")})) AS units FROM rows),
hits AS (SELECT DISTINCT doc_id, text_digest, license_id FROM (SELECT doc_id, text_digest, sha256(unnest(units)) AS digest FROM canon) JOIN known USING (digest)),
lone AS (SELECT doc_id, text_digest, string_agg(license_id, ',' ORDER BY license_id) AS line_licenses FROM hits GROUP BY ALL)
SELECT canon.doc_id, canon.text_digest, known.license_id, coalesce(lone.line_licenses, '') AS line_licenses
FROM canon LEFT JOIN known ON known.digest = canon.text_digest LEFT JOIN lone ON lone.doc_id = canon.doc_id AND lone.text_digest = canon.text_digest"""
