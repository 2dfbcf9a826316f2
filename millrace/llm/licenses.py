"""Licence scan by canonical digest lookup, in DataFrame expressions alone.

An entire text is normalised (case, copyright lines, equivalent spellings, punctuation
and white space) and its SHA-256 hash-joined to the digests of known licence texts, which
go through the same expressions. The known texts are a few dozen rows of this module and
its folder ``texts``, or of the caller, checked to be at most ``MOST_KNOWN`` before they are broadcast; beyond
that the join is left to the planner.

Defined cases: a null or empty text has no licence, and neither has one that normalises
to nothing; repeated rows give repeated rows; two known names with one digest give the
smaller name; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_KNOWN = 10_000

#: (pattern, replacement) in order. The first takes lines that have the shape of a notice: copyright and a sign, year
#: or holder, not a licence's own sentences that a line break leaves with "copyright" in front.
STEPS = [
    (r"(^|\n)[^\na-z0-9_]*(copyright\b[^\na-z0-9(©\[<{]*(\(c\)|©|&copy;|[0-9]{4}|[\[<{])[^\n]*|\(c\)[^\n]*\b(19|20)[0-9]{2}\b[^\n]*|copyright[ \t][^\n]*\b(19|20)[0-9]{2}[ \t.]*(?=\n|$)|(\(c\)[ \t]*copyright|©)[^\n]*|copyright:[^\n]*|copyright[ \t]+[^\n.,;:]{1,60}(?=\n[ \t]*\n)|copyright[ \t]+[^\n]{1,60}\b(authors|contributors|developers|team|inc|ltd|llc|foundation|corporation|project)\.?[ \t]*(?=\n|$)|all rights reserved[^\na-z0-9]*(?=\n|$))", "\n"),
    (r"\s+", " "),
    (r"https://", "http://"),
    (r"licence", "license"),
    (r"copyright[- ]?owner", "copyright holder"),
    (r"(organ|author|recogn|util)is(e|ing|ation)", "$1iz$2"),
    (r"favour", "favor"),
    (r"(non|sub)-(commercial|licens|infring)", "$1$2"),
    (r"version[ ,]*([0-9])", "v$1"),
    (r"&", " and "),
    (r"[^a-z0-9]+", " "),
]

#: The SQL's first step and texts are as given: it knows no others, takes any line that begins with "copyright", and
#: keeps line breaks within a spelling.
SQL_STEPS = [
    (r"(^|\n)[^\na-z0-9]*(copyright|\(c\)|©|all rights reserved)[^\n]*", "\n"),
    *STEPS[2:],
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
"""
_ISC_END = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: (name, text): whole texts, and the one-line notices that stand for a licence by themselves.
KNOWN = [
    ("MIT", _MIT), ("MIT", "The MIT License\n\n" + _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "Released under the MIT License."),
    ("ISC", _ISC + _ISC_END), ("ISC", "ISC License\n\n" + _ISC + _ISC_END),
    ("BSD-2-Clause", _BSD + _BSD_END), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD + _BSD_3 + _BSD_END),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

SQL_KNOWN = list(KNOWN)

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>"""


def whole() -> list[tuple[str, str]]:
    """The texts of the folder, named by their files, each also up to the end of its terms where an appendix follows."""
    out = []
    for path in sorted((Path(__file__).parent / "texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        terms, end, more = text.partition("END OF TERMS AND CONDITIONS")
        out += [(path.stem, text)] + [(path.stem, terms), (path.stem, terms + end)] * bool(more.strip())
    return out


KNOWN += [
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB), ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BOOST), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST), *whole(),
]


def canonical(text: Column) -> Column:
    """The normalised text; null stays null."""
    out = F.lower(text)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(license, text) of a folder of whole texts, each named by its file without the ending; names before a first ``@`` are one licence."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"(@.*)?\.[A-Za-z]+$", "")
    return spark.read.text(path, wholetext=True).select(name.alias("license"), F.col("value").alias("text"))


def known(spark: SparkSession, texts: list[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """(digest, license): one row a digest. Texts that normalise to nothing are no licence."""
    rows = texts.select("license", "text") if isinstance(texts, DataFrame) else spark.createDataFrame(texts, "license string, text string")
    rows = rows.select(canonical(F.col("text")).alias("form"), "license").where("form <> ''")
    return rows.select(F.sha2("form", 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, texts: list[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """(doc_id, canonical_chars, digest, license) of every document; license is null where the entire text is none.

    texts: pairs of name and text, or a table (license, text), such as ``folder`` gives; a table is left to the planner to join.
    """
    form = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(canonical(F.col("text")), F.lit("")).alias("canonical"))
    rows = form.select("doc_id", F.length("canonical").cast("long").alias("canonical_chars"), F.sha2("canonical", 256).alias("digest"))
    table = known(docs.sparkSession, texts)
    if not isinstance(texts, DataFrame) and len(texts) <= MOST_KNOWN:
        table = F.broadcast(table)
    return rows.join(table, "digest", "left").select("doc_id", "canonical_chars", "digest", F.when(F.col("canonical_chars") > 0, F.col("license")).alias("license"))


def scan_sql(texts: list[tuple[str, str]] = SQL_KNOWN) -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    form = "lower(text)"
    for pattern, to in SQL_STEPS:
        form = f"regexp_replace({form}, {quote(pattern)}, {quote(to.replace('$', chr(92)))}, 'g')"
    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in texts)
    return f"""
WITH known AS (
  SELECT sha256(trim({form})) AS digest, min(license) AS license FROM (VALUES {values}) AS k(license, text) GROUP BY 1
), form AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(trim({form}), '') AS canonical FROM documents
)
SELECT doc_id, CAST(length(canonical) AS BIGINT) AS canonical_chars, sha256(canonical) AS digest,
       CASE WHEN length(canonical) > 0 THEN license END AS license
FROM form LEFT JOIN known ON sha256(canonical) = digest"""
