"""License scans: canonical digest lookup with DataFrame functions alone.

A text is made canonical (lower case, equivalent spellings, no copyright lines, nothing
but words) and hashed; the digests of entire texts are joined to those of the known
licenses and notices, a fixed table of some dozens of rows. The same lookup on each line
finds the notices that stand inside other text.

Defined results: null and empty texts, and texts that are empty once canonical, match
nothing and have a null digest; repeated rows are judged each on its own; texts of any
length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of public licenses and common notices, by SPDX identifier.
MIT = """MIT License

Copyright (c) <year> <holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Copyright (c) <year> <holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
ZLIB = """zlib License

Copyright (c) <year> <holders>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_2, _BSD_3 = _BSD_HEAD + _BSD_TAIL, _BSD_HEAD + _BSD_NAMES + _BSD_TAIL
#: Entire texts by identifier.
TEXTS = (
    ("MIT", MIT),
    ("MIT", MIT.removeprefix("MIT License")),
    ("MIT", "The " + MIT),
    ("MIT", MIT.replace("MIT License", "The MIT License (MIT)", 1)),
    ("ISC", ISC),
    ("ISC", ISC.removeprefix("ISC License")),
    ("ISC", "The " + ISC),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_2),
    ("BSD-2-Clause", "The BSD 2-Clause License\n\n" + _BSD_2),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_3),
    ("BSD-3-Clause", "The BSD 3-Clause License\n\n" + _BSD_3),
    ("Zlib", ZLIB),
    ("Zlib", ZLIB.removeprefix("zlib License")),
    ("Unlicense", UNLICENSE),
    ("Apache-2.0", APACHE_HEADER),
    ("BSL-1.0", BOOST),
)
#: Digests of the canonical words of longer texts, and how many characters
#: those words are, as the Debian distribution has them in /usr/share/common-licenses; the
#: second of a kind is the text up to END OF TERMS AND CONDITIONS.
DIGESTS = (
    ("Apache-2.0", 9920, "1503ed7ce6c2188ed269646562607a76b5c74bff588f36b20862ee3af525f3ea"),
    ("Apache-2.0", 8865, "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff"),
    ("Artistic-1.0", 5833, "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 19661, "009e9c9e26987137c9ea0122b94757f136a1becdb5960160762a1b39825c2233"),
    ("GFDL-1.3", 22106, "1660e5283c63da358507452d2f0ef975fafaaad4bb4c79279a7cb94aa7bbcf0d"),
    ("GPL-1.0", 11843, "d408d9dad6e4560274412e743ec3ba01007197655029f60544c308bc54f80499"),
    ("GPL-1.0", 9461, "90b42d1cf0f9ef747c945cda0a54d5bd16341c8491956c54b3f4f283efa0176a"),
    ("GPL-2.0", 17200, "0bfb659bf7eeb9921df1446a6a93beba70e0dc947eec10a42d26bb310dccd498"),
    ("GPL-2.0", 14534, "8607b1cff63e9a9dc468bf76327bdd0bb2d2abe09d6e8076427fd49236f46f29"),
    ("GPL-3.0", 33497, "0472008b2e64866eb1db6471e76fc0cc3cf742180a15ea30a01655e5d9952441"),
    ("GPL-3.0", 31027, "4daf25711475345bba3326eb65ac074ad13b96798bf4bd295a284f56837f3ac0"),
    ("LGPL-2.0", 24208, "9ccbf81e2fd78db81966e466a22ed39318d0a4b4550cd69d1144dcf09722ff10"),
    ("LGPL-2.0", 22323, "9e78fa98415a9a8c863589ab742457328d22cd2319bbf585de04b27baf33a2be"),
    ("LGPL-2.1", 25300, "a9cc8dda4023821e198a2e1bee36afc3e68fce90828780c7bac37ffe33565e15"),
    ("LGPL-2.1", 23416, "f13ce8aa4b0cc0de7c3b73a95e705f217972ef8710e7c0a463342682e2e523de"),
    ("LGPL-3.0", 7163, "ab1202917a49a52eb4671fc091c00933076c119053fff6e8b5849ca93d6b53b3"),
    ("MPL-1.1", 22467, "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", 14341, "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)
#: Full names by which notices call a license.
NAMES = (
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("CC0-1.0", "Creative Commons Zero 1.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
    ("CC0-1.0", "CC0 1.0"),
    ("Unlicense", "Unlicense"),
    ("Zlib", "zlib License"),
)
#: Ways in which a notice line names a license.
NOTICES = (
    "{}",
    "the {}",
    "Licensed under the {}",
    "Released under the {}",
    "Distributed under the {}",
    "This work is licensed under the {}",
    "This work is licensed under a {}",
    "This software is released under the {}",
    "This file is licensed under the {}",
    "This project is licensed under the {}",
    "This program is licensed under the {}",
    "Available under the {}",
)
#: Spellings that count as the same, and the one used.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("non-commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("recognise", "recognize"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("https://", "http://"),
    ("&", " and "),
)

#: A line that says whose copyright it is: it starts with the sign or the word, then a sign,
#: year or place for one. Licences have lines that start with the word alone.
COPYRIGHT = r"^[^a-z0-9\n]*((copyright[^a-z0-9\n]*(\(c\)|©|[0-9<\[])|(\(c\)|©)[^a-z0-9\n]*[0-9<\[])[^\n]*|all rights reserved[^a-z0-9\n]*)$"


def spelled(text: Column) -> Column:
    """A text in lower case, equivalent spellings replaced in turn."""
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz\n")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def canonical(text: Column, holders: bool = False) -> Column:
    """Canonical lines of a text: lower-case words with single blanks, lines kept apart; a
    copyright line becomes empty, if not ``holders``."""
    out = spelled(text)
    if not holders:
        out = F.regexp_replace(out, f"(?dm){COPYRIGHT}", "")  # d: only a line feed ends a line
    return F.trim(F.regexp_replace(out, r"[^a-z0-9\n]+", " "))


def digest(canonical_text: Column) -> Column:
    """SHA-256 of canonical words; null where there are none."""
    words = F.trim(F.regexp_replace(canonical_text, r"[ \n]+", " "))
    return F.when(words != "", F.sha2(words, 256))


def _known() -> list[tuple[str, str]]:
    lines = [(i, form.format(name)) for i, name in NAMES for form in NOTICES]
    return [*TEXTS, *lines, *((i, f"SPDX-License-Identifier: {i}") for i in sorted({i for i, *_ in (*NAMES, *TEXTS, *DIGESTS)}))]


def known(spark) -> DataFrame:
    """(digest, license, size): known texts and notices in the same canonical form, with and
    without copyright lines, and their lengths."""
    rows = spark.createDataFrame(_known(), "license string, known string")
    forms = F.explode(F.array(canonical(F.col("known")), canonical(F.col("known"), holders=True)))
    rows = rows.select("license", forms.alias("form")).select("license", F.trim(F.regexp_replace("form", r"[ \n]+", " ")).alias("words")).filter("words <> ''")
    made = rows.select("license", F.sha2("words", 256).alias("digest"), F.length("words").alias("size"))
    made = made.unionByName(spark.createDataFrame(list(DIGESTS), "license string, size int, digest string"))
    return made.groupBy("digest").agg(F.min("license").alias("license"), F.min("size").alias("size"))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, text_digest, license (of the entire text) and notices (of lines, sorted).

    The digest is that of the text without copyright lines. A license is also known by the
    digest of all its words, as some texts have such a line of their own. Where a kept column
    is called like one of the results, the result takes its place.
    """
    table = known(docs.sparkSession)
    rows = table.collect()  # fixed size: some hundred rows
    found = {r["digest"]: r["license"] for r in rows}
    lines = F.transform(F.split("__canonical", "\n"), lambda line: F.trim(line))
    # a line as long as none that is known needs no digest
    lines = F.filter(lines, lambda line: F.length(line).isin(sorted({r["size"] for r in rows})))
    lookup = F.create_map(*[F.lit(x) for pair in sorted(found.items()) for x in pair])
    notices = F.transform(lines, lambda line: F.try_element_at(lookup, F.sha2(line, 256)))
    notices = F.array_join(F.array_sort(F.array_distinct(F.filter(notices, lambda x: x.isNotNull()))), ",")
    own = [k for k in keep if k not in ("text_digest", "license", "notices")]
    lower = F.lower("text")
    named = F.contains(lower, F.lit("copyright")) | F.contains(lower, F.lit("(c)")) | F.contains(lower, F.lit("©")) | F.contains(lower, F.lit("all rights"))
    whole = F.when(named, digest(canonical(F.col("text"), holders=True)))
    rows = docs.select(F.struct(*own).alias("__kept"), canonical(F.col("text")).alias("__canonical"), whole.alias("__whole"))
    rows = rows.select("__kept", digest(F.col("__canonical")).alias("text_digest"), "__whole", F.coalesce(notices, F.lit("")).alias("notices"))
    first = table.select(F.col("digest").alias("text_digest"), F.col("license").alias("__first"))
    second = table.select(F.col("digest").alias("__whole"), F.col("license").alias("__second"))
    joined = rows.join(F.broadcast(first), "text_digest", "left").join(F.broadcast(second), "__whole", "left")
    license_ = F.coalesce("__first", "__second").alias("license")
    return joined.select(*[F.col("__kept")[k].alias(k) for k in own], "text_digest", license_, "notices")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_canonical(text: str, holders: bool = False) -> str:
    out = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(13), 'abcdefghijklmnopqrstuvwxyz' || chr(10))"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    if not holders:
        out = f"regexp_replace({out}, {_quoted('(?m)' + COPYRIGHT)}, '', 'g')"
    return f"trim(regexp_replace({out}, '[^a-z0-9\\n]+', ' ', 'g'))"


def _sql_digest(canonical_text: str) -> str:
    words = f"trim(regexp_replace({canonical_text}, '[ \\n]+', ' ', 'g'))"
    return f"CASE WHEN {words} <> '' THEN sha256({words}) END"


def sql(docs: str = "documents") -> str:
    """DuckDB SQL for the rows of :func:`scan`."""
    texts = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in _known())
    digests = ", ".join(f"({_quoted(i)}, {_quoted(d)})" for i, _, d in DIGESTS)
    return f"""
        WITH texts AS (SELECT * FROM (VALUES {texts}) AS v(license, known)),
        known AS (
            SELECT digest, min(license) AS license
            FROM (SELECT license, {_sql_digest(_sql_canonical("known"))} AS digest FROM texts
                UNION ALL SELECT license, {_sql_digest(_sql_canonical("known", True))} AS digest FROM texts
                UNION ALL SELECT * FROM (VALUES {digests}) AS v(license, digest)) AS k
            WHERE digest IS NOT NULL GROUP BY digest),
        docs AS (SELECT row_number() OVER () AS r, doc_id, {_sql_canonical("text")} AS c, {_sql_canonical("text", True)} AS h FROM {docs}),
        lines AS (SELECT r, trim(unnest(string_split(c, chr(10)))) AS line FROM docs),
        notices AS (
            SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
            FROM lines JOIN known ON sha256(line) = digest GROUP BY r)
        SELECT doc_id, {_sql_digest("c")} AS text_digest, coalesce(a.license, b.license) AS license, coalesce(notices, '') AS notices
        FROM docs LEFT JOIN notices USING (r) LEFT JOIN known AS a ON {_sql_digest("c")} = a.digest LEFT JOIN known AS b ON {_sql_digest("h")} = b.digest"""
