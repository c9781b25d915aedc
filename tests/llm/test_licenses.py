import random
import re
import textwrap

from helpers import AWKWARD, empty, prose, table

from kvspark.llm.licenses import KNOWN, TEXTS, scan

MIT = next(t for name, t in KNOWN if name == "MIT")


def test_entire_texts_paragraphs_and_lines(spark):
    rng = random.Random(0)
    texts = [
        MIT,
        "Copyright (c) 2020 Someone Else\n" + MIT.upper().replace("\n", "  \n"),
        "(c) 1999 A. Body. All rights reserved.\n\n" + MIT.replace('"', "''").replace("license", "licence"),
        MIT.replace("free of charge", "for a fee"),
        prose(rng, 50) + "\nLICENCED under the Apache Licence, version 2.0\n" + prose(rng, 30),
        prose(rng, 50) + "\nThis work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License!\n",
        "I think it is released under the MIT License.",
        "Licensed under CC BY-NC 4.0.",
        *AWKWARD,
    ]
    got = {r.doc_id: (r.whole, r.licenses) for r in scan(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert [got[i][0] for i in range(8)] == ["MIT", "MIT", "MIT", None, None, None, None, "CC-BY-NC-4.0"]
    assert got[0][1] == ["MIT"] and got[3][1] == [] and got[6][1] == []
    assert got[4][1] == ["Apache-2.0"] and got[5][1] == ["GPL-3.0", "MIT"] and got[7][1] == ["CC-BY-NC-4.0"]
    assert all(got[i] == (None, []) for i in range(8, len(texts)))


def test_every_known_text_is_found_and_names_agree(spark):
    texts = [t for _, t in KNOWN]
    got = {r.doc_id: r.whole for r in scan(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [name for name, _ in KNOWN]


def test_own_table_repeated_rows_and_empty(spark):
    docs = table(spark, ["Mine alone", "mine, ALONE.", None], ids=[1, 1, None])
    rows = scan(docs, [("X", "mine alone")]).collect()
    assert sorted((r.doc_id or 0, r.whole or "") for r in rows) == [(0, ""), (1, "X"), (1, "X")]
    assert scan(empty(spark)).collect() == []


def test_entire_long_licences_and_paragraphs_among_other_text(spark):
    rng = random.Random(3)
    bsd = {name: text for name, text in KNOWN if text.startswith("Redistribution")}
    texts = [
        *[text for _, text in TEXTS],
        "# A tool\n\n" + prose(rng, 40) + "\n\n" + MIT + "\n\nimport os\n",
        prose(rng, 40) + "\n\n" + bsd["BSD-3-Clause"],
        prose(rng, 40) + "\n\n" + bsd["BSD-2-Clause"],
        "MIT\n\nDefinitions.\n\n" + prose(rng, 20),
    ]
    got = {r.doc_id: (r.whole, r.licenses, r.n_units) for r in scan(table(spark, texts)).collect()}
    n = len(TEXTS)
    assert [name for name, _ in TEXTS] == ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]
    assert [got[i][0] for i in range(n)] == [name for name, _ in TEXTS]
    assert got[n] == (None, ["MIT"], 3)
    assert got[n + 1][1] == ["BSD-3-Clause"] and got[n + 1][2] == 5
    assert got[n + 2][1] == ["BSD-2-Clause"]
    assert got[n + 3] == (None, [], 0)


def test_only_the_holder_is_taken_out_of_a_copyright_line(spark):
    texts = [
        "Copyright (c) 2021 A. Body. Licensed under the Apache License, Version 2.0.",
        "All rights reserved. Released under the MIT License.",
        "// (c) 2020 Some One Inc. All rights reserved. Licensed under CC BY-NC 4.0.",
        "Copyright 2019 Body, Inc., released under the MIT License.",
        "(c) Some Body\nReleased under the MIT License.",
        "(c) You must not sell it.", "(c) You may sell it.",
        "Copyright (c) 2020 The St. Louis Group, Acme Ltd. All rights reserved.",
    ]
    known = [*KNOWN, ("X", "(c) You may sell it.")]
    got = {r.doc_id: (r.whole, r.licenses) for r in scan(table(spark, texts), known).collect()}
    assert [got[i][1] for i in range(8)] == [["Apache-2.0"], ["MIT"], ["CC-BY-NC-4.0"], ["MIT"], ["MIT"], [], ["X"], []]
    assert got[4][0] == "MIT"


def wrapped(text, width):
    """Paragraphs filled to a width; lines that name a holder stay lines of their own."""
    out = []
    for paragraph in re.split(r"\n[ \t]*\n", text):
        lines = []
        for line in paragraph.split("\n"):
            if re.match(r"\s*copyright \(c\)", line, re.I) or (lines and re.match(r"\s*copyright \(c\)", lines[-1], re.I)):
                lines.append(line)
            elif lines:
                lines[-1] += " " + line
            else:
                lines.append(line)
        fill = lambda x: x if re.match(r"\s*copyright \(c\)", x, re.I) else textwrap.fill(" ".join(x.split()), width, break_on_hyphens=False, break_long_words=False)
        out.append("\n".join(map(fill, lines)))
    return "\n\n".join(out)


def test_every_entire_text_is_found_at_every_width(spark):
    entire = {}
    for name, text in [*KNOWN, *TEXTS]:
        if len(text) > 400:
            entire.setdefault(name, text)
    assert len(entire) == 11
    cases = [(name, width, wrapped(text, width)) for name, text in entire.items() for width in (56, 60, 61, 65, 68, 72, 76, 79, 80, 81, 90, 93, 100)]
    got = {r.doc_id: r.whole for r in scan(table(spark, [t for _, _, t in cases])).collect()}
    assert [(name, width) for i, (name, width, _) in enumerate(cases) if got[i] != name] == []


def test_no_python_in_the_plan(spark):
    plan = scan(table(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
