"""Licence scan: canonical digests of whole texts, and of their paragraphs and lines, joined to known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of widely used licences and notices, as their owners publish them.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD3 = BSD2.replace(
    "THIS SOFTWARE IS PROVIDED BY",
    """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY""",
)
GNU_NOTICE = """{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN = {
    "MIT": [MIT, "MIT License\n\n" + MIT, "The MIT License (MIT)\n\n" + MIT, "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "ISC": [ISC, "ISC License\n\n" + ISC],
    "BSD-2-Clause": [BSD2, "BSD 2-Clause License\n\n" + BSD2],
    "BSD-3-Clause": [BSD3, "BSD 3-Clause License\n\n" + BSD3],
    "Unlicense": [UNLICENSE],
    "Apache-2.0": [APACHE_HEADER, "Licensed under the Apache License, Version 2.0."],
    "MPL-2.0": [MPL_NOTICE],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", *[GNU_NOTICE.format(x, "", 3) for x in ("This program", "This file")]],
    "GPL-2.0": [GNU_NOTICE.format(x, "", 2) for x in ("This program", "This file")],
    "LGPL-3.0": [GNU_NOTICE.format(x, "Lesser ", 3) for x in ("This program", "This library")],
    "LGPL-2.1": [GNU_NOTICE.format(x, "Lesser ", 2.1) for x in ("This program", "This library")],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "Proprietary": ["All rights reserved."],
}
# Characters and sha256 of the canonical form of longer licences, as their owners publish them.
LONG = {
    "GPL-1.0": (11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    "GPL-2.0": (17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    "GPL-3.0": (33406, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    "LGPL-2.0": (24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    "LGPL-2.1": (25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    "LGPL-3.0": (7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    "Apache-2.0": (9920, "1503ed7ce6c2188ed269646562607a76b5c74bff588f36b20862ee3af525f3ea"),
    "MPL-1.1": (22467, "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    "MPL-2.0": (14341, "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    "Artistic-1.0": (5833, "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    "CC0-1.0": (6691, "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    "GFDL-1.2": (19583, "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    "GFDL-1.3": (22018, "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
}
#: Words that a licence may spell either way, right-hand side canonical.
EQUIVALENT = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "favour": "favor",
    "merchantibility": "merchantability",
    "non infringement": "noninfringement",
    "organisation": "organization",
    "authorised": "authorized",
    "recognise": "recognize",
    "https": "http",
    "v2": "version 2",
    "v3": "version 3",
}

#: Known texts that a broadcast may hold.
KNOWN_SENT = 100_000
COPYRIGHT_LINE = r"^[^\p{L}\n]*(?:copyright|\(c\)|©)[^\n]*(?:\d{4}|\(c\)|©)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{Nd}\n]+"
BLANK_LINES = r"\n *\n[ \n]*"


def folded(text: Column) -> Column:
    """Lower case, no copyright lines, two blanks between words, one spelling; lines as they are.

    Two blanks, so that each word has its own on both sides.
    """
    c = F.regexp_replace(text, f"(?imd){COPYRIGHT_LINE}", "")
    c = F.regexp_replace(F.lower(c), NOT_WORD, "  ")
    c = F.concat(F.lit("  "), F.replace(c, F.lit("\n"), F.lit("  \n  ")), F.lit("  "))
    for old, new in EQUIVALENT.items():
        c = F.replace(c, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return c


def joined(c: Column) -> Column:
    """One blank between the words of a folded text, whatever its lines; a pair of words that is spelt as one may be cut by a line's end."""
    c = F.concat(F.lit("  "), F.trim(F.regexp_replace(c, "[ \n]+", "  ")), F.lit("  "))
    for old, new in EQUIVALENT.items():
        if " " in old:
            c = F.replace(c, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new} "))
    return F.trim(F.replace(c, F.lit("  "), F.lit(" ")))


def canonical(text: Column) -> Column:
    """The form in which texts are compared."""
    return joined(folded(text))


def literal_rows(spark, rows: list[tuple[str, str]], names: tuple[str, str]) -> DataFrame:
    """A small table of literals, without data from Python's side."""
    cells = [F.struct(*[F.lit(x).alias(n) for x, n in zip(r, names, strict=True)]) for r in rows]
    kind = f"array<struct<{names[0]}:string,{names[1]}:string>>"
    return spark.range(1).select(F.inline(F.array(*cells) if cells else F.array().cast(kind)))


def known_digests(spark, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(digest, license_id, size): one row for each known text, given as a table of texts by licence.

    Without a table: KNOWN, and LONG by digest.
    """
    texts = literal_rows(spark, [(k, t) for k, ts in (KNOWN if known is None else known).items() for t in ts], ("license_id", "t"))
    c = texts.select(canonical(F.col("t")).alias("c"), "license_id")
    out = c.select(F.sha2("c", 256).alias("digest"), "license_id", F.length("c").alias("size"))
    if known is None:
        long = literal_rows(spark, [(k, f"{d} {n}") for k, (n, d) in LONG.items()], ("license_id", "t"))
        out = out.unionByName(long.select(F.substring_index("t", " ", 1).alias("digest"), "license_id", F.substring_index("t", " ", -1).cast("int").alias("size")))
    return out.groupBy("digest", "size").agg(F.min("license_id").alias("license_id"))


def license_scan(df: DataFrame, known: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hash-join every whole text, and each of its lines and paragraphs, to known digests.

    Gives one row per input row: ``digest`` of the canonical text,
    ``license_id`` if the whole text is a known licence, ``notice_ids``
    the licences that stand as lines or paragraphs in it, and ``n_notices``.
    Null, empty and punctuation-only texts have the digest of the empty text
    and no licence. Texts of any length are read whole; repeated rows are each
    answered; of licences with one text the first by name holds; an empty table
    gives an empty one; other columns are not read.

    A line or paragraph is hashed only if a known text is as long, which loses
    none, so few rows but those of whole texts meet the known table. It is
    broadcast up to KNOWN_SENT texts. Answers come together by row number,
    which no text can make hot.
    """
    spark = df.sparkSession
    table = known_digests(spark, known)
    sizes = sorted(r[0] for r in table.select("size").distinct().collect())  # lengths of known texts
    n = len(LONG) + sum(map(len, KNOWN.values())) if known is None else sum(map(len, known.values()))
    folds = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), folded(F.coalesce(F.col(text_col), F.lit(""))).alias("f"))
    lines = F.transform(F.split("f", "\n", -1), lambda x: F.trim(F.replace(x, F.lit("  "), F.lit(" "))))
    parts = F.filter(F.split(F.trim("f"), BLANK_LINES, -1), lambda x: F.trim(x).contains("\n"))
    both = F.concat(lines, F.transform(parts, joined))
    asked = F.transform(F.filter(both, lambda x: F.length(x).isin(*sizes)) if sizes else F.array().cast("array<string>"), lambda x: F.sha2(x, 256))
    whole = F.sha2(joined(F.col("f")), 256)
    rows = folds.select("rid", "doc_id", F.posexplode(F.concat(F.array(whole), asked)).alias("at", "digest"))
    table = table.select("digest", "license_id")
    rows = rows.join(F.broadcast(table) if n <= KNOWN_SENT else table, "digest", "left")
    first, hit = F.col("at") == 0, F.when(F.col("at") > 0, F.col("license_id"))
    return rows.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"),
        F.max(F.when(first, F.col("digest"))).alias("digest"),
        F.max(F.when(first, F.col("license_id"))).alias("license_id"),
        F.array_join(F.sort_array(F.collect_set(hit)), ",").alias("notice_ids"),
        F.count(hit).alias("n_notices"),
    ).drop("rid")


def lines_scan(df: DataFrame, known: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license_id, n): how many lines of each document are, as whole texts, known licences."""
    lines = df.select(F.col(id_col).alias("doc_id"), F.explode(F.split(text_col, "\n", -1)).alias("text"))
    return license_scan(lines, known).where("license_id IS NOT NULL").groupBy("doc_id", "license_id").agg(F.count("*").alias("n"))


def _folded_sql(x: str) -> str:
    c = f"regexp_replace({x}, '(?im){COPYRIGHT_LINE}', '', 'g')"
    c = f"regexp_replace(lower({c}), '{NOT_WORD}', '  ', 'g')"
    c = f"('  ' || replace({c}, chr(10), '  ' || chr(10) || '  ') || '  ')"
    for old, new in EQUIVALENT.items():
        c = f"replace({c}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return c


def _joined_sql(c: str) -> str:
    c = f"('  ' || trim(regexp_replace({c}, '[ \\n]+', '  ', 'g')) || '  ')"
    for old, new in EQUIVALENT.items():
        if " " in old:
            c = f"replace({c}, ' {old.replace(' ', '  ')} ', ' {new} ')"
    return f"trim(replace({c}, '  ', ' '))"


def _known_sql() -> str:
    known = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, ts in KNOWN.items() for t in ts)
    long = ", ".join(f"('{d}', '{k}')" for k, (_, d) in LONG.items())
    return f"""k0 AS (SELECT sha256({_joined_sql(_folded_sql('t'))}) AS digest, license_id FROM (VALUES {known}) v(license_id, t)
  UNION ALL SELECT * FROM (VALUES {long}) w(digest, license_id)),
k AS (SELECT digest, min(license_id) AS license_id FROM k0 GROUP BY 1)"""


def license_sql(table: str = "documents") -> str:
    """The same rows in DuckDB's SQL."""
    return f"""
WITH {_known_sql()},
d AS (SELECT doc_id, {_folded_sql("coalesce(text, '')")} AS f FROM {table}),
x AS (SELECT doc_id, trim(replace(l, '  ', ' ')) AS x FROM (SELECT doc_id, unnest(string_split(f, chr(10))) AS l FROM d)
      UNION ALL SELECT doc_id, {_joined_sql('p')} FROM (SELECT doc_id, unnest(regexp_split_to_array(trim(f), '{BLANK_LINES}')) AS p FROM d) WHERE contains(trim(p), chr(10))),
n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids, count(*) AS n FROM x JOIN k ON k.digest = sha256(x) GROUP BY doc_id),
w AS (SELECT doc_id, sha256({_joined_sql('f')}) AS digest FROM d)
SELECT w.doc_id, w.digest, k.license_id, coalesce(n.ids, '') AS notice_ids, coalesce(n.n, 0)::BIGINT AS n_notices
FROM w LEFT JOIN k ON k.digest = w.digest LEFT JOIN n ON n.doc_id = w.doc_id
"""


def lines_sql(table: str = "documents") -> str:
    return f"""
WITH {_known_sql()},
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM {table})
SELECT doc_id, license_id, count(*) AS n FROM l JOIN k ON k.digest = sha256({_joined_sql(_folded_sql('t'))}) GROUP BY ALL
"""
