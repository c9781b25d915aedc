import random

import numpy as np
import pytest
from helpers import AWKWARD, empty, prose, table

from kvspark.llm.attribution import allocate, encode, encoding, token_counts
from kvspark.llm.catalog import BYTE_BPE

coder, _ = encoding(BYTE_BPE)


def spans_of_tokens(text):
    """Byte span of every token, one at a time."""
    at, out = 0, []
    for i in coder.encode_ordinary(text):
        n = len(coder.decode_single_token_bytes(i))
        out.append((at, at + n))
        at += n
    assert at == len(text.encode())
    return out


def brute(text, sections, rule):
    """Tokens per section (code-point spans), and outside (-1)."""
    bounds = [(len(text[:a].encode()), len(text[:b].encode())) for a, b in sections]
    counts, crossing = {}, {}
    for a, b in spans_of_tokens(text):
        share = [max(0, min(b, d) - max(a, c)) for c, d in bounds]
        place = {"start": a, "end": b - 1}.get(rule)
        if rule == "most":
            own = share.index(max(share)) if share and max(share) else -1
        else:
            own = next((k for k, (c, d) in enumerate(bounds) if c <= place < d), -1)
        counts[own] = counts.get(own, 0) + 1
        if own >= 0 and share[own] < b - a:
            crossing[own] = crossing.get(own, 0) + 1
    return counts, crossing


def lines(text):
    out, at = [], 0
    for line in text.splitlines(keepends=True) if "\r" not in text else [x + "\n" for x in text.split("\n")]:
        out.append((at, at + len(line)))
        at += len(line)
    return out or [(0, 0)]


TEXTS = [*AWKWARD, "one\n\n\ntwo  \n three\n", "ünï\ncödé 日本\n\n語", "<|endoftext|> is text", prose(random.Random(0), 300).replace("w1", "\n")]


def test_lines_of_whole_texts(spark):
    rows = token_counts(table(spark, TEXTS), BYTE_BPE).collect()
    for i, text in enumerate(TEXTS):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.section)
        sections = lines((text or "").replace("\u2028", " "))
        assert [(r.start, r.end) for r in own] == sections
        counts, crossing = brute(text or "", sections, "start")
        assert {r.section: r.n_tokens for r in own if r.n_tokens} == counts
        assert {r.section: r.n_crossing for r in own if r.n_crossing} == crossing


@pytest.mark.parametrize("rule", ["start", "end", "most"])
def test_given_spans_with_gaps(spark, rule):
    rng = random.Random(4)
    rows, want = [], []
    for i in range(40):
        text = prose(rng, 40) + " äöü 日本語 " + prose(rng, 10)
        cuts = sorted(rng.sample(range(len(text) + 1), 8))
        sections = [(cuts[k], cuts[k + 1]) for k in range(0, 8, 2)]
        rows.append((i, text, sections))
        want.append(brute(text, sections, rule))
    docs = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:int,end:int>>")
    got = token_counts(docs, BYTE_BPE, rule, spans="parts").collect()
    for i, (counts, crossing) in enumerate(want):
        assert {r.section: r.n_tokens for r in got if r.doc_id == i and r.n_tokens} == counts
        assert {r.section: r.n_crossing for r in got if r.doc_id == i and r.n_crossing} == crossing


def test_repeated_rows_null_spans_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", None), (1, "a b", None), (2, None, [])], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    got = sorted((r.doc_id, r.section, r.n_tokens) for r in token_counts(docs, BYTE_BPE, spans="parts").collect())
    assert got == [(1, -1, 2), (1, -1, 2)]
    assert token_counts(empty(spark), BYTE_BPE).collect() == []
    with pytest.raises(ValueError):
        token_counts(docs, BYTE_BPE, "middle")


def test_most_prefers_the_earlier_of_equals():
    n, crossing, out = allocate(np.array([4]), np.array([0, 2]), np.array([2, 4]), "most")
    assert n.tolist() == [1, 0] and crossing.tolist() == [1, 0] and out == 0


def test_long_runs_of_white_space_are_encoded_as_they_are(spark):
    for run in (" " * 3000, "\n" * 2001, " \n" * 1500 + "\u3000" * 1200, "\t" * 1000):
        for text in (f"x{run}y", f"x{run}", run, f"{run}  9{run}.", f"a {run}\x1c{run}b"):
            assert encode(coder, text).tolist() == coder.encode_ordinary(text), repr(text[:20])
    long = "x" + " " * 2_000_000 + "y" + "\n" * 1_000_000
    rows = token_counts(table(spark, [long, "é" * 2_000_000, "?!" * 1_000_000]), BYTE_BPE).filter("section < 2").collect()
    assert {(r.doc_id, r.section) for r in rows} == {(0, 0), (0, 1), (1, 0), (2, 0)}
