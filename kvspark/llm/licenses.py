"""License scans by canonical digest lookup, with DataFrame functions only.

Texts are made canonical: lower case, one spelling for words that licences spell
in several ways, no copyright holders, and nothing but letters and digits between
single spaces. An entire text, each of its paragraphs and each of its lines is
then looked up by SHA-256 in a table of the digests of known licence texts and
notices. A text with one more or fewer word than the known one is not found; that
is what a digest means. A known text below a README or above code
is found by its paragraphs: all of them have to be there. What is part of another
text that is found (BSD-2-Clause of BSD-3-Clause) isn't named.

The table of digests is a constant of this module (``TABLE``, or the caller's list),
so it is broadcast; the scan is one pass over the documents, and what is shuffled
is one small row per document with a finding.

Defined results: a null or empty text, or one of copyright lines only, has no licence.
A text of any length is read whole. Repeated rows are scanned alike, each on its own. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that begin with these words name a holder; what the SQL takes out, see ``HOLDER``. For (?im) with ``\n`` as the only line end.
COPYRIGHT = r"^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|©|all rights reserved\b)[^\n]*$"
#: What may follow a holder in its line and is looked up: a notice, or a sentence after a word that is no abbreviation.
_NOTICE_WORDS = r"all rights reserved|licen[sc]ed? |licen[sc]e:|released |distributed |this (?:work|software|project|file|program) |permission |spdx"
_END = (
    rf"(?:[.,;]?[ \t]+(?={_NOTICE_WORDS})"
    r"|(?<=[\p{L}\p{N})]{2})(?<!\b(?:inc|ltd|co|corp|dr|mr|ms|mrs|jr|sr|st|llc|prof))\.[ \t]+(?=(?-i:\p{Lu}))|$)"
)
_NAME = r"(?-i:\p{Lu}[\p{L}.'-]*(?:[ \t]+(?:and[ \t]+)?\p{Lu}[\p{L}.'-]*){0,5}[ \t]*)"
_YEAR = r"[ \t]*[:,]?[ \t]*(?:\(c\)|©|\d{4}|by\b|[\[<{(](?:yyyy|year|date)\b|year\b)"
#: Start of a line that names a holder, up to its end. A line may begin with the word within a sentence, so it counts only
#: before a mark, a year, or a name after the word itself capitalised; ``(c)`` only before a year or a name, as it also
#: numbers clauses.
HOLDER = (
    rf"^[^\p{{L}}\p{{N}}\n]*(?:copyright\b(?={_YEAR})"
    r"|(?-i:Copyright)\b(?=[ \t]+(?-i:\p{Lu}))(?![ \t]+(?:holders?|owners?|notices?|laws?|licen[sc]es?|statements?|treat(?:y|ies)|acts?)\b)"
    r"|©|all rights reserved\b"
    rf"|\(c\)(?=[ \t]*(?:copyright\b|\d{{4}}|{_NAME}(?:[.,]?$|[.,]?[ \t]+(?:{_NOTICE_WORDS}))))"
    rf")[^\n]*?{_END}"
)
#: Spelling -> the one that is kept; applied to lower-case text.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("acknowledgment", "acknowledgement"),
    ("organization", "organisation"),
    ("authorization", "authorisation"),
    ("authorized", "authorised"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("per cent", "percent"),
    ("https://", "http://"),
    ("version v", "version "),
    ("&", " and "),
)

_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_NOTICE = """The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""
_BSD_1 = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer."""
_BSD_2 = """2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""


def _names(spdx: str, *names: str) -> list[tuple[str, str]]:
    lead = ("Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.",
            "This software is licensed under the {}.", "This project is licensed under the {}.",
            "Distributed under the {}.", "This work is licensed under {}.", "Released under {}.", "License: {}.")
    return [(spdx, text.format(name)) for name in names for text in lead]


#: (licence, text): full texts and the notices that stand for them.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", "\n\n".join((_PERMISSION, _NOTICE, _AS_IS))),
    ("MIT", "\n\n".join(("MIT License", _PERMISSION, _NOTICE, _AS_IS))),
    ("MIT", "\n\n".join(("The MIT License (MIT)", _PERMISSION, _NOTICE, _AS_IS))),
    ("BSD-2-Clause", "\n\n".join((_BSD, _BSD_1, _BSD_2, _BSD_AS_IS))),
    ("BSD-2-Clause", "\n\n".join(("BSD 2-Clause License", _BSD, _BSD_1, _BSD_2, _BSD_AS_IS))),
    ("BSD-3-Clause", "\n\n".join((_BSD, _BSD_1, _BSD_2, _BSD_3, _BSD_AS_IS))),
    ("BSD-3-Clause", "\n\n".join(("BSD 3-Clause License", _BSD, _BSD_1, _BSD_2, _BSD_3, _BSD_AS_IS))),
    ("ISC", "\n\n".join((_ISC, _ISC_AS_IS))),
    ("ISC", "\n\n".join(("ISC License", _ISC, _ISC_AS_IS))),
    ("Apache-2.0", _APACHE),
    *_names("MIT", "MIT License", "MIT"),
    *_names("Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    *_names("GPL-3.0", "GNU General Public License, version 3", "GNU General Public License v3.0", "GPL version 3", "GPLv3"),
    *_names("GPL-2.0", "GNU General Public License, version 2", "GNU General Public License v2.0", "GPL version 2", "GPLv2"),
    *_names("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    *_names("AGPL-3.0", "GNU Affero General Public License, version 3"),
    *_names("BSD-2-Clause", "BSD 2-Clause License"),
    *_names("BSD-3-Clause", "BSD 3-Clause License"),
    *_names("ISC", "ISC License"),
    *_names("MPL-2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    *_names("CC0-1.0", "CC0 1.0", "CC0 1.0 Universal"),
    *(
        x
        for kind, words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
                            ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
        for version in ("4.0", "3.0")
        for x in _names(
            f"CC-{kind}-{version}", f"CC {kind} {version}", f"Creative Commons {words} {version}",
            f"Creative Commons {words} {version} International License",
        )
    ),
)


#: Entire texts, as published: one file a licence.
TEXTS: tuple[tuple[str, str], ...] = tuple(
    (path.stem, path.read_text(encoding="utf-8")) for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
)
TABLE = KNOWN + TEXTS
#: Shorter paragraphs of a known text (headings, addresses) say nothing about a licence.
LEAST_PARAGRAPH = 60


def canonical(text: Column) -> Column:
    """Canonical text; lines stay apart, and so do paragraphs."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    # Twice: a holder, and the rights reserved after it.
    for _ in range(2):
        out = F.regexp_replace(out, "(?imd)" + HOLDER, "")
    out = F.lower(out)
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    return F.regexp_replace(out, r" ?\n ?", "\n")


def _one_line(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def scan(
    docs: DataFrame, known: Sequence[tuple[str, str]] = TABLE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, whole, licenses, n_units): one row per row of ``docs``; ``known`` are (licence, text) pairs.

    ``whole`` is the licence that the entire text is, ``licenses`` are those of
    any unit or text inside, sorted, and ``n_units`` counts the paragraphs and lines found.
    """
    table = F.broadcast(_digests(docs.sparkSession, known))
    own = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), canonical(F.col(text)).alias("t")
    )
    lines = F.filter(F.split("t", "\n"), lambda x: x != "")
    paragraphs = F.filter(F.split("t", r"\n{2,}"), lambda x: F.contains(F.trim(x), F.lit("\n")))
    unit = lambda kind, t: F.struct(F.lit(kind).alias("kind"), F.sha2(_one_line(t), 256).alias("digest"))
    units = own.select(
        "row",
        "doc_id",
        F.explode(
            F.concat(
                F.array(unit("whole", F.col("t"))),
                F.transform(paragraphs, lambda x: unit("part", x)),
                F.transform(lines, lambda x: unit("part", x)),
            )
        ).alias("u"),
    ).select("row", "doc_id", "u.kind", "u.digest")
    # Every document has its whole text as a unit, so grouping by row returns every document, combined before the shuffle.
    looked = units.join(table, "digest", "left")
    part = F.col("kind") == "part"
    got = looked.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("kind") == "whole", F.col("license"))).alias("whole"),
        F.collect_set("license").alias("licenses"),
        F.count(F.when(part & F.col("license").isNotNull(), 1)).alias("n_units"),
        F.collect_set(F.when(part & F.col("texts").isNotNull(), F.struct("digest", "texts"))).alias("parts"),
    )
    # A text is there if as many of its paragraphs are as it has, and is named unless it is part of another one there.
    seen = F.flatten(F.transform("parts", lambda p: p["texts"]))
    got = got.withColumn("seen", seen).withColumn(
        "there", F.filter(F.array_distinct("seen"), lambda x: F.size(F.filter("seen", lambda y: y["k"] == x["k"])) == x["need"])
    )
    there = F.filter("there", lambda x: ~F.arrays_overlap(x["larger"], F.transform("there", lambda y: y["k"])))
    return got.withColumn("there", there).select(
        "doc_id",
        "whole",
        F.sort_array(F.array_union("licenses", F.transform("there", lambda x: x["license"]))).alias("licenses"),
        (F.col("n_units") + F.size(F.filter("parts", lambda p: F.arrays_overlap(
            F.transform(p["texts"], lambda y: y["k"]), F.transform("there", lambda y: y["k"]))))).alias("n_units"),
    )


def _digests(spark: SparkSession, known: Sequence[tuple[str, str]]) -> DataFrame:
    """(digest, license, texts): the licence of an entire text or notice; the texts of several paragraphs that a paragraph is of."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in known])
    table = spark.range(1).select(F.inline(rows)).select("license", canonical(F.col("text")).alias("t"))
    parts = F.filter(F.transform(F.split("t", r"\n{2,}"), _one_line), lambda p: F.length(p) >= LEAST_PARAGRAPH)
    table = table.select("license", F.sha2(_one_line("t"), 256).alias("digest"), F.transform(parts, lambda p: F.sha2(p, 256)).alias("parts"))
    whole: dict[str, str] = {}
    texts: dict[frozenset[str], str] = {}
    for r in table.collect():
        whole[r.digest] = min(r.license, whole.get(r.digest, r.license))
        own = frozenset(r.parts)
        if len(own) > 1:
            texts[own] = min(r.license, texts.get(own, r.license))
    numbered = list(texts.items())
    of: dict[str, list[tuple[int, str, int, list[int]]]] = {}
    for k, (own, name) in enumerate(numbered):
        larger = [j for j, (other, _) in enumerate(numbered) if own < other]
        for digest in own:
            of.setdefault(digest, []).append((k, name, len(own), larger))
    found = [(d, whole.get(d), of.get(d)) for d in sorted(whole.keys() | of.keys())]
    return spark.createDataFrame(
        found, "digest string, license string, texts array<struct<k: int, license: string, need: int, larger: array<int>>>"
    )
