"""Licence scans by canonical digests (operator 1); DataFrame operations only.

Texts are brought to a canonical form: lower case; copyright statements, known title lines and
list marks removed; everything but letters and digits a single space; spellings that count as
equal made equal. The digest of the whole canonical text, with line breaks as spaces, is joined
with the digests of known licences; the digests of its lines are joined with those of known
one-line notices. So neither a title nor the way a text is wrapped matters.

Defined results: a null or empty text, and one that has only titles and copyright lines,
matches nothing and has a null digest. Repeated rows each get a row. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import stage

# Equal spellings, applied in this order to words that single spaces part.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
    ("per cent", "percent"), ("organisation", "organization"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("favour", "favor"), ("fulfil ", "fulfill "), ("copyright holder", "copyright owner"), ("whilst", "while"), ("http ", "https "),
]
# A line is a copyright statement where a year, a mark, a placeholder or a name follows;
# "copyright notice and this permission notice" is a wrapped line of a licence.
COPYRIGHT_LINE = (r"(?im)^[ \t/*#;-]*(?:copyright[ \t]*(?:\(c\)|©|:|by\b|[<\[{]|[^\n]*\b[12][0-9]{3}\b)|(?-i:Copyright[ \t]+[A-Z])|"
                  r"\(c\)[ \t]*(?:copyright|by\b|[<\[{]|[12][0-9]{3})|©|all rights reserved\.?[ \t]*$)[^\n]*$")
LIST_MARK = r"(?im)^[ \t/*#;]*(?:[0-9]{1,2}[.)]|\([a-z0-9]\)|[*•-])[ \t]+"
# Title lines in canonical form.
TITLES = [
    "mit license", "the mit license", "the mit license mit", "mit license mit", "mit no attribution", "mit no attribution license",
    "isc license", "the isc license", "isc license isc", "bsd zero clause license", "zero clause bsd", "0bsd license",
    "bsd 2 clause license", "the 2 clause bsd license", "bsd 2 clause simplified license", "simplified bsd license",
    "bsd 3 clause license", "the 3 clause bsd license", "bsd 3 clause new or revised license", "new bsd license", "modified bsd license",
    "apache license", "version 2 0 january 2004", "https www apache org licenses",
    "gnu general public license", "gnu lesser general public license", "version 2 june 1991", "version 3 29 june 2007",
    "version 2 1 february 1999", "mozilla public license version 2 0",
]

_PERMISSION = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
               'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
               'rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to '
               'permit persons to whom the Software is furnished to do so, subject to the following conditions:')
_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
          'WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR '
          'COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR '
          'OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.')
_ISC_GRANT = ('Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted')
_ISC_END = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
            'IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, '
            'INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN '
            'AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR '
            'PERFORMANCE OF THIS SOFTWARE.')
_BSD_HEAD = ('Redistribution and use in source and binary forms, with or without modification, are permitted provided that the '
             'following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of '
             'conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, '
             'this list of conditions and the following disclaimer in the documentation and/or other materials provided with the '
             'distribution.\n')
_BSD_NAME = ('3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products '
             'derived from this software without specific prior written permission.\n')
_BSD_END = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
            'INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE '
            'DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, '
            'SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR '
            'SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, '
            'WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE '
            'OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.')

# Public licence texts, without titles.
TEXTS = {
    "MIT": f"{_PERMISSION}\nThe above copyright notice and this permission notice shall be included in all copies or substantial "
           f"portions of the Software.\n{_AS_IS}",
    "MIT-0": f"{_PERMISSION.removesuffix(', subject to the following conditions:')}.\n{_AS_IS}",
    "ISC": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}",
    "0BSD": f"{_ISC_GRANT}.\n{_ISC_END}",
    "BSD-2-Clause": _BSD_HEAD + _BSD_END,
    "BSD-3-Clause": _BSD_HEAD + _BSD_NAME + _BSD_END,
}
# Digests of long public licences (`_digests` of the published file): whole, and where
# an appendix tells how to apply them, up to "END OF TERMS AND CONDITIONS" with and without that line.
DIGESTS = {
    "Apache-2.0": ["6fa85691b62a7258ec22815f928bca1a", "ce34f1b1f2abde7f5d99e6c1f070b5fd", "558074b5d6320d0a0e90b9ba993ef441"],
    "GPL-2.0": ["881fa96a5ab42cc5ed622d392a757c9b", "45d406a3440c42097f98c865a36993cd", "ae5e54bfa7f30c2fb520f3917ccaf389"],
    "GPL-3.0": ["d598557b196ba5905c6e6f557d13f4fc", "b7230933365e4a020ed17e5a924750f1", "bceece5c7a9ae429ef7acf4c1e4a67db"],
    "LGPL-2.1": ["42443fcd7adc79c794ec94925041f0f0", "e2883bf0d6e15df230328e2b3e2bb0c4", "faacec617e1e5e779dc843f3e4c25016"],
    "LGPL-3.0": ["448e8785d1cd0bb95741ba6b8d75e5ab"],
    "MPL-2.0": ["8ec934de409154aa5a121b2ee2053d83"],
    "CC0-1.0": ["dda622f2a6954c3bec3a251c578f8583"],
}
# Identifiers and names in one-line notices.
SPDX = {
    "MIT": ["MIT"], "MIT-0": ["MIT-0"], "ISC": ["ISC"], "0BSD": ["0BSD"], "BSD-2-Clause": ["BSD-2-Clause"], "BSD-3-Clause": ["BSD-3-Clause"],
    "Apache-2.0": ["Apache-2.0"], "MPL-2.0": ["MPL-2.0"],
    "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+"], "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+"],
    "LGPL-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1+"], "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-3.0+"],
    "CC0-1.0": ["CC0-1.0"], "CC-BY-4.0": ["CC-BY-4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"],
}
NAMES = {
    "MIT": ["the MIT License", "the MIT licence"], "ISC": ["the ISC License"], "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"], "Apache-2.0": ["the Apache License, Version 2.0"], "MPL-2.0": ["the Mozilla Public License, version 2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2"], "GPL-3.0": ["the GNU General Public License, version 3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1"], "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "CC-BY-4.0": ["CC BY 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0"], "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
}
STARTS = ["Licensed under", "Released under", "This work is licensed under", "Distributed under"]
NOTICES = {k: [f"SPDX-License-Identifier: {x}" for x in ids] + [f"{start} {name}." for name in NAMES.get(k, []) for start in STARTS]
           for k, ids in SPDX.items()}


def canonical(text: Column) -> Column:
    """Lower-case words parted by single spaces, with line ends kept."""
    c = F.regexp_replace(text, F.lit(COPYRIGHT_LINE), F.lit(""))
    c = F.lower(F.regexp_replace(c, F.lit(LIST_MARK), F.lit("")))
    return F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" and ")), F.lit(r"[^\p{L}\p{N}\n]+"), F.lit(" "))


def _spelled(words: Column) -> Column:
    for old, new in SPELLINGS:
        words = F.replace(words, F.lit(old), F.lit(new))
    return words


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), lambda x: _spelled(F.trim(x))), lambda x: (x != "") & ~x.isin(TITLES))


def _digests(rows: DataFrame, text: str) -> DataFrame:
    """All columns of `rows` but the text, `digest` and the distinct digests of its lines. Equal
    spellings count again after lines are joined: a wrapped pair of words is one as well."""
    lines = rows.withColumn("_lines", _lines(canonical(F.coalesce(F.col(text).cast("string"), F.lit("")))))
    return lines.select(*[c for c in rows.columns if c != text],
                        F.when(F.size("_lines") > 0, F.md5(_spelled(F.array_join("_lines", " ")).cast("binary"))).alias("digest"),
                        F.array_distinct(F.transform("_lines", lambda x: F.md5(x.cast("binary")))).alias("line_digests"))


def known_digests(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """`digest, licence`: of the built-in licences, or of `texts(licence, text)`."""
    found = _digests(known(spark) if texts is None else texts, "text").filter("digest IS NOT NULL").select("digest", "licence")
    if texts is None:
        long = [(d, k) for k, ds in DIGESTS.items() for d in ds]
        found = found.unionByName(spark.createDataFrame(long, "digest string, licence string"))
    return found.groupBy("digest").agg(F.min("licence").alias("licence"))


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """`licence, text` of the known licences."""
    return spark.createDataFrame(list((TEXTS if texts is None else texts).items()), "licence string, text string")


def known_notices(spark: SparkSession, notices: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(k, x) for k, xs in (NOTICES if notices is None else notices).items() for x in xs]
    return spark.createDataFrame(rows, "licence string, text string")


def scan(docs: DataFrame, licences: DataFrame | None = None, notices: DataFrame | None = None) -> DataFrame:
    """`doc_id, digest, licence, notices` for each row of `docs(doc_id, text)`: the licence
    whose whole text it is, and the licences of its notice lines ('' for none).

    Spark picks the join by the size of the licence table; the built-in one has a few rows.
    """
    spark = docs.sparkSession
    whole = known_digests(spark, licences)
    lines = (_digests(known_notices(spark) if notices is None else notices, "text").filter(F.size("line_digests") == 1)
             .select(F.explode("line_digests").alias("digest"), F.col("licence").alias("notice")).distinct())
    rows = stage(_digests(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"), "text"))
    found = (rows.select("_row", F.explode("line_digests").alias("digest")).join(lines, "digest")
             .groupBy("_row").agg(F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices")))
    return (rows.join(whole, "digest", "left").join(found, "_row", "left")
            .select("doc_id", "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices")))


def oracle() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def spelled(c: str) -> str:
        for old, new in SPELLINGS:
            c = f"replace({c}, {quoted(old)}, {quoted(new)})"
        return c

    def lines(c: str) -> str:
        c = f"regexp_replace(regexp_replace({c}, {quoted(COPYRIGHT_LINE)}, '', 'g'), {quoted(LIST_MARK)}, '', 'g')"
        c = f"regexp_replace(replace(lower({c}), '&', ' and '), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
        titles = ", ".join(map(quoted, TITLES))
        return f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: {spelled('trim(x)')}), lambda x: x <> '' AND x NOT IN ({titles}))"

    def digest(c: str) -> str:
        return f"md5({spelled(c)})"

    def values(rows: list[tuple[str, str]]) -> str:
        return ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in rows)

    joined = lambda c: f"array_to_string({c}, ' ')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {lines("coalesce(text, '')")} AS ls FROM documents),
e AS (SELECT rid, doc_id, ls, CASE WHEN len(ls) > 0 THEN {digest(joined('ls'))} END AS digest FROM d),
k(licence, text) AS (VALUES {values(list(TEXTS.items()))}),
l(licence, digest) AS (VALUES {values([(a, b) for a, xs in DIGESTS.items() for b in xs])}),
kd AS (SELECT digest, min(licence) AS licence FROM (SELECT {digest(joined(lines('text')))} AS digest, licence FROM k UNION ALL SELECT digest, licence FROM l) GROUP BY 1),
n(notice, text) AS (VALUES {values([(a, b) for a, xs in NOTICES.items() for b in xs])}),
nd AS (SELECT DISTINCT md5({lines('text')}[1]) AS line, notice FROM n),
f AS (SELECT rid, string_agg(DISTINCT notice, ',' ORDER BY notice) AS notices
      FROM (SELECT rid, md5(unnest(ls)) AS line FROM e) JOIN nd USING (line) GROUP BY rid)
SELECT doc_id, e.digest, licence, coalesce(notices, '') AS notices FROM e LEFT JOIN kd USING (digest) LEFT JOIN f USING (rid)"""
