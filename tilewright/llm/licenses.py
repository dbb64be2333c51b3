"""Licence texts by canonical digest: whole texts, and lines that are whole notices.

A text's canonical form is lower case, without copyright lines, with every run of
characters other than letters and digits as one space, and with one spelling for words
that have two. Its SHA-256 is looked up, by an equi-join, among the digests of known
texts; so is that of each line, for one-line notices within a document. A text is put in
this form once, line by line, and its lines are joined for the whole.

Known are the full texts in ``license_texts`` (each with and without what follows its terms)
and in ``TEXTS`` (with and without a title), and one-line notices; any table (license, text) may
be passed instead, or made with ``from_folder``.

DataFrame operations only. The known table is joined as Spark finds fit: it is broadcast
only below the session's own size limit, which the built-in one keeps, a local relation of
known size. Cases: a null or empty text, or one that is all
punctuation and copyright lines, has a null digest and no licence; several known texts
with one digest give the smallest licence id; rows are told apart by an internal number,
so equal or null doc ids stay rows of their own; an empty table gives an empty table;
letters are lower-cased as Java does (a final sigma by its place); columns of any other name are
kept, while one of an output's name gives way to it.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.store import written

#: A line with who holds the copyright, in a lower-case text; group 1 is kept.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{]|by )|\(c\)[ \t]*(?:copyright|[0-9])|©|all rights reserved)[^\n]*"
#: Spellings that count as the same.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("recognised", "recognized"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("behaviour", "behavior"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("whilst", "while"),
    ("copyright owner", "copyright holder"),
]

#: Short licences in full.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}
#: The third clause that tells one licence of that family from the other.
_CLAUSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace("THIS SOFTWARE IS", _CLAUSE + "THIS SOFTWARE IS", 1)
TEXTS["Zlib"] = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
TEXTS["BSL-1.0"] = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
TEXTS["Unlicense"] = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
#: Lines after which long licences tell how to apply them; copies often end before.
ENDS = ("END OF TERMS AND CONDITIONS", 'Exhibit B - "Incompatible With Secondary Licenses" Notice', "Exhibit A - Source Code Form License Notice")
#: What a licence text may have above it.
TITLES = {"BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"], "Zlib": ["zlib License", "The zlib License"], "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"], "Unlicense": ["The Unlicense"], "MIT": ["MIT License", "The MIT License (MIT)", "The MIT License"], "ISC": ["ISC License"], "0BSD": ["Zero-Clause BSD"], "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"]}
#: Names of licences in notices.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "ISC": ["ISC License", "ISC"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
}
LEADS = ["Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This project is licensed under", "This software is licensed under"]


def in_folder(folder: Path) -> list[tuple[str, str]]:
    """(licence, text) of every .txt file, named by its licence; as a whole, and up to and without each of ``ENDS``."""
    out = []
    for path in sorted(folder.glob("*.txt")):
        text = path.read_text()
        out.append((path.stem, text))
        for end in ENDS:
            if end in text:
                out += [(path.stem, text.split(end)[0]), (path.stem, text.split(end)[0] + end)]
    return out


def known() -> list[tuple[str, str]]:
    """(licence, text): full texts in their usual forms, and the notices that leads and names make."""
    out = in_folder(Path(__file__).parent / "license_texts")
    out += [(k, x) for k, t in TEXTS.items() for x in (t, *(f"{title}\n\n{t}" for title in TITLES[k]))]
    for k, names in NAMES.items():
        for n in names:
            out += [(k, f"{lead} {the}{n}.") for lead in LEADS for the in ("", "the ")]
        out.append((k, f"SPDX-License-Identifier: {k}"))
    return out


def known_table(spark: SparkSession) -> DataFrame:
    """``known()`` as a local relation, whose size Spark knows."""
    rows = known()
    named = {f"{side}{i}": x for i, r in enumerate(rows) for side, x in zip("lt", r, strict=True)}
    return spark.sql(f"SELECT * FROM VALUES {', '.join(f'(:l{i}, :t{i})' for i in range(len(rows)))} AS v(license, text)", args=named)


def from_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(license, text) of the .txt files of a folder that Spark can read, each whole."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1)
    return spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(name.alias("license"), F.col("value").alias("text"))


def _respelled(form: Column, spellings: list[tuple[str, str]]) -> Column:
    for a, b in spellings:
        form = F.replace(form, F.lit(a), F.lit(b))
    return form


def canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines, without those of which nothing is left."""
    bare = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "$1")
    form = _respelled(F.regexp_replace(bare, r"[^\p{L}\p{N}\n]+", " "), SPELLINGS)
    return F.filter(F.transform(F.split(form, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def canonical(lines: Column) -> Column:
    """The canonical form of a text from those of its lines; null where nothing is left."""
    joined = _respelled(F.array_join(lines, " "), [x for x in SPELLINGS if " " in x[0]])
    return F.nullif(joined, F.lit(""))


def digests(texts: DataFrame) -> DataFrame:
    """(digest, license) of known texts (license, text): one row a digest."""
    made = texts.select(F.sha2(canonical(canonical_lines(F.col("text"))), 256).alias("digest"), "license")
    return made.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with digest and license of the whole text (null if not known),
    notices (sorted licences of lines that are whole notices) and n_notice_lines."""
    found = digests(texts)
    rest = [c for c in docs.columns if c != text]
    kept = F.struct(*[docs[f"`{c}`"] for c in rest]) if rest else F.struct(F.lit(0).alias("_"))
    lined = docs.select(kept.alias("kept"), canonical_lines(docs[f"`{text}`"].cast("string")).alias("lines"))
    hashed = lined.select(F.monotonically_increasing_id().alias("row"), "kept", F.sha2(canonical(F.col("lines")), 256).alias("digest"), F.transform("lines", lambda x: F.unhex(F.sha2(x, 256))).alias("lines"))
    stored = written(hashed, "text-digests")
    parts = stored.select("row", F.explode("lines").alias("line"))
    hits = parts.join(found.select(F.unhex("digest").alias("line"), "license"), "line").groupBy("row").agg(F.sort_array(F.collect_set("license")).alias("notices"), F.count(F.lit(1)).alias("n_notice_lines"))
    whole = stored.drop("lines").join(found, "digest", "left").join(hits, "row", "left")
    clash = {"digest", "license", "notices", "n_notice_lines"}
    return whole.select(*[F.col("kept")[c].alias(c) for c in rest if c not in clash], "digest", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"), F.coalesce("n_notice_lines", F.lit(0).cast("bigint")).alias("n_notice_lines"))
