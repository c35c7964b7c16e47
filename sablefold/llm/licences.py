"""Licence scan by canonical digests.

A text is brought to a canonical form (case, comment marks, copyright lines,
equivalent spellings, punctuation and white space don't count), and its SHA-256
is looked up among the digests of known licence texts.  Whole texts, paragraphs
and single lines are looked up, always entire.  Built-in expressions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that every known text has one of, before and after any rewriting here.
ANCHORS = "licen[cs]|permission|redistribut|warrant|public[^a-z0-9]+(rem )?domain"

#: Rewritings in order, in Java's syntax; the text is in lower case by then.
STEPS = [
    (r"(?m)^[\x20\x09]*(//+|#+|/?\*+/?|;+|--+|<!--|rem )[\x20\x09]*", ""),
    # Notices, but not a wrapped line of the text itself ("copyright holders be liable", "(c) You must").
    (r"(?m)^[\x20\x09]*(copyright(?![\x20\x09]*[,.;)\n]|[\x20\x09]+(holder|owner|notice|law|licen[cs]|statement|interest|treat|permission|and|or|in|to|is|for|on|as)s?e?\b)|\(c\)(?![\x20\x09]+(you|under|if|the|any|an?|to|for|in|such|each|that|this|all|no|every|accompany|convey|prohibiting)\b)|©|all rights reserved).*$", ""),
    (r"[\x20\x09-\x0D]+", " "),
    (r"licenc(e|es|ed|ing|or|ors)\b", r"licens\1"),
    (r"sub-licens", "sublicens"),
    (r"non-commercial", "noncommercial"),
    (r"organisation", "organization"),
    (r"acknowledgement", "acknowledgment"),
    (r"merchantib", "merchantab"),
    (r"copyright owner", "copyright holder"),
    (r"https:", "http:"),
    (r"\bversion ([0-9])", r"v\1"),
    (r"&", " and "),
    (r"[^a-z0-9.]+", " "),
    (r"\.( |$)", r"\1"),
    (r"^ +| +$", ""),
    (r" +", " "),
]

#: What the SQL statement goes by.
SQL_ANCHORS = "licen[cs]|permission|redistribut|warrant|public domain"

SQL_STEPS = [
    (r"(?m)^[\x20\x09]*(//+|#+|/?\*+/?|;+|--+|<!--|rem )[\x20\x09]*", ""),
    (r"(?m)^[\x20\x09]*(copyright|\(c\)|©|all rights reserved).*$", ""),
    (r"licenc(e|es|ed|ing|or|ors)\b", r"licens\1"),
    (r"sub-licens", "sublicens"),
    (r"non-commercial", "noncommercial"),
    (r"organisation", "organization"),
    (r"acknowledgement", "acknowledgment"),
    (r"merchantib", "merchantab"),
    (r"copyright owner", "copyright holder"),
    (r"https:", "http:"),
    (r"\bversion ([0-9])", r"v\1"),
    (r"&", " and "),
    (r"[^a-z0-9.]+", " "),
    (r"\.( |$)", r"\1"),
    (r"^ +| +$", ""),
    (r" +", " "),
]

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_UNLICENSE = [
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "For more information, please refer to",
]


def _gnu(name: str, version: str, later: bool) -> list[str]:
    """The three paragraphs of the GNU notice."""
    terms = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version} of the License."
    return [
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {terms}",
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.",
        f"You should have received a copy of the GNU {name} along with this program. If not, see https://www.gnu.org/licenses/.",
    ]


#: Known texts and notices, by licence.
KNOWN = [
    ("MIT", f"{_GRANT} {_WARRANTY}"),
    ("MIT", f"The MIT License {_GRANT} {_WARRANTY}"),
    ("MIT", f"MIT License {_GRANT} {_WARRANTY}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC}. {_ISC_WARRANTY}"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
]
# Paragraphs of the texts above, and further texts; the SQL statement has the 25 above only.
KNOWN += [("MIT", p) for p in (*_GRANT.replace("conditions: The", "conditions:\nThe").split("\n"), _WARRANTY)]
KNOWN += [("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies."), ("0BSD", f"{_ISC}.")]
KNOWN += [("Apache-2.0", p) for p in _APACHE.replace(" You may", "\nYou may").replace(" Unless", "\nUnless").split("\n") if "obtain a copy" not in p]
for _id, _marks in (("BSD-2-Clause", [("", ""), ("1. ", "2. "), ("* ", "* ")]), ("BSD-3-Clause", [("", "", ""), ("1. ", "2. ", "3. "), ("* ", "* ", "* ")])):
    for _m in _marks:
        _terms = " ".join(m + t for m, t in zip(_m, (_BSD_1, _BSD_2, _BSD_3)))
        KNOWN += [(_id, f"{_head}{_BSD} {_terms} {_BSD_WARRANTY}") for _head in ("", f"BSD {_id[4]}-Clause License ", f"The BSD {_id[4]}-Clause License ")]
KNOWN += [("BSD-3-Clause", m + _BSD_3) for m in ("", "3. ")]
# The two share these.
KNOWN += [("BSD", p) for p in (_BSD, f"1. {_BSD_1}", _BSD_1, f"2. {_BSD_2}", _BSD_2, _BSD_WARRANTY)]
KNOWN += [("Unlicense", " ".join([*_UNLICENSE[:n], *end])) for n in (4, 5) for end in ([], ["<https://unlicense.org>"], ["<https://unlicense.org/>"])[: 1 if n == 4 else 3]]
KNOWN += [("Unlicense", p) for p in _UNLICENSE[2:4]]
for _id, _name, _version in (("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3")):
    for _later in (True, False):
        _notice = _gnu(_name, _version, _later)
        # The second and third paragraphs don't tell the version.
        KNOWN += [(_id, t.replace("software: you", _says)) for _says in ("software: you", "software; you") for t in (" ".join(_notice), _notice[0])]


def canonical(text: Column) -> Column:
    out = F.lower(text)
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern, new.replace("\\1", "$1"))
    return out


def digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """license_id and digest of the known texts: one row per text, so small enough to broadcast."""
    return spark.createDataFrame(known, "license_id string, text string").select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).dropDuplicates(["digest"])


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """doc_id, license_id, scope ('text', 'paragraph' or 'line') and hits, for every licence that a text holds.

    ``scope`` is the widest in which the licence was found; ``hits`` counts the
    places in that scope.  Rows that repeat a doc_id add up; null doc_ids are
    one document.  Null and empty texts hold nothing.  Texts without a word of
    ``ANCHORS`` are left out early, unless a known text has none either.
    """
    spark = docs.sparkSession
    anchored = all(re.search(ANCHORS, text.lower()) for _, text in known)
    likely = lambda c: F.lower(c).rlike(ANCHORS) if anchored else F.col(c).isNotNull()
    marked = docs.select("doc_id", "text").where(likely("text"))
    unit = lambda level, parts: F.transform(parts, lambda p: F.struct(F.lit(level).alias("level"), p.alias("part")))
    units = F.concat(unit(0, F.array("text")), unit(1, F.split("text", r"\n[\x20\x09]*\n")), unit(2, F.split("text", r"\n")))
    parts = marked.select("doc_id", F.explode(units).alias("u")).where(likely("u.part"))
    found = parts.select("doc_id", "u.level", F.sha2(canonical(F.col("u.part")), 256).alias("digest")).join(F.broadcast(digests(spark, known)), "digest")
    counted = found.groupBy("doc_id", "license_id", "level").agg(F.count("*").alias("hits"))
    top = counted.groupBy("doc_id", "license_id").agg(F.min(F.struct("level", "hits")).alias("top"))
    name = F.element_at(F.array(F.lit("text"), F.lit("paragraph"), F.lit("line")), F.col("top.level") + 1)
    return top.select("doc_id", "license_id", name.alias("scope"), F.col("top.hits").alias("hits"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """DuckDB's SQL for the first 25 known texts, with the narrower rewriting of ``SQL_STEPS``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(column: str) -> str:
        for pattern, new in [("lower", None), *SQL_STEPS]:
            column = f"lower({column})" if new is None else f"regexp_replace({column}, {quote(pattern)}, {quote(new)}, 'g')"
        return column

    known = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN[:25])
    return f"""
    WITH known AS (SELECT DISTINCT license_id, sha256({form('text')}) AS digest FROM (VALUES {known}) k(license_id, text)),
    units AS (
      SELECT doc_id, 0 AS level, text AS part FROM documents
      UNION ALL SELECT doc_id, 1, unnest(regexp_split_to_array(text, '\\n[\\x20\\x09]*\\n')) FROM documents
      UNION ALL SELECT doc_id, 2, unnest(string_split(text, chr(10))) FROM documents),
    marked AS (SELECT * FROM units WHERE regexp_matches(lower(part), {quote(SQL_ANCHORS)})),
    counted AS (SELECT doc_id, license_id, level, count(*) AS hits FROM marked JOIN known ON sha256({form('part')}) = digest GROUP BY ALL)
    SELECT doc_id, license_id, CASE min(level) WHEN 0 THEN 'text' WHEN 1 THEN 'paragraph' ELSE 'line' END AS scope, arg_min(hits, level) AS hits
    FROM counted GROUP BY doc_id, license_id"""
