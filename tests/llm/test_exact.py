import hashlib
import random
import re

from helpers import AWKWARD, empty, prose, table
from pyspark.sql import functions as F

from kvspark.llm.exact import HIGH, chunks, drop_exact_copies, exact_groups, normalised


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def brute(docs):
    groups = {}
    for d in docs:
        groups.setdefault(norm(d.text), []).append(d)
    out = []
    for text, rows in groups.items():
        keep = min(rows, key=lambda d: (-len(d.text or ""), d.doc_id))
        for d in rows:
            out.append((d.doc_id, keep.doc_id, len(rows), d.doc_id == keep.doc_id, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def cases():
    rng = random.Random(0)
    base = [prose(rng, n) for n in (3, 100, 3000, 20000)]
    texts = list(AWKWARD) + ["\u00a0", "a\u00a0b", "ab", "A b", "a  b", "a b"]
    for t in base:
        texts += [t, t.replace(" ", "\n"), t.replace(" ", "  ", 3), t[:-1], t + "x", t.replace("w1", "w2", 1)]
    return texts


def _rows(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_groups_are_those_of_brute_force(spark):
    docs = table(spark, cases())
    assert _rows(exact_groups(docs)) == brute(docs.collect())


def test_ambiguous_identifiers_are_told_apart(spark):
    docs = table(spark, cases())
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(3))
    assert _rows(exact_groups(docs, identify=weak)) == brute(docs.collect())
    constant = lambda c: F.lit(1).cast("long")
    assert _rows(exact_groups(docs, identify=constant)) == brute(docs.collect())


def test_chunks_join_to_the_text_and_are_content_defined(spark):
    rng = random.Random(1)
    text = norm(prose(rng, 20000, 10**6).replace("7 ", "7. "))
    df = spark.createDataFrame([(0, text), (1, "inserted" + text)], "i int, t string").select("i", chunks(F.col("t")).alias("c"))
    a, b = (r.c for r in df.orderBy("i").collect())
    assert "".join(a) == text and "".join(b) == "inserted" + text and max(map(len, a)) <= HIGH + 2
    assert len(set(a) & set(b)) > 0.8 * len(a)


def test_chunks_of_other_scripts_are_content_defined(spark):
    rng = random.Random(2)
    scripts = {"ru": range(0x430, 0x450), "el": range(0x3B1, 0x3CA), "zh": range(0x4E00, 0x6000), "ar": range(0x627, 0x64A), "de": [*range(97, 123), 0xE4, 0xDF]}
    for letters in scripts.values():
        text = "".join(chr(rng.choice(letters)) for _ in range(60_000))
        df = spark.createDataFrame([(0, text), (1, text[:7] + "新" + text[7:])], "i int, t string").select("i", chunks(F.col("t")).alias("c"))
        a, b = (r.c for r in df.orderBy("i").collect())
        assert "".join(a).encode("latin-1").decode() == text and max(map(len, a)) <= HIGH + 2
        if letters != scripts["de"]:
            assert len(a) > len(text.encode()) / 1500 and len(set(a) & set(b)) > 0.9 * len(a)


def test_repeated_rows_keep_exactly_one(spark):
    docs = table(spark, ["a b", "a b", "ab", None, ""], ids=[4, 4, 9, None, 1])
    rows = exact_groups(docs).collect()
    assert sorted((r.keep_id, r.group_size) for r in rows if r.text_sha256 == hashlib.sha256(b"ab").hexdigest()) == [(4, 3)] * 3
    assert sum(r.kept for r in rows) == 2
    # Null ids come last, so of the empty texts row 1 stays.
    assert {r.keep_id for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()} == {1}


def test_hot_group_and_rest_meet(spark):
    docs = table(spark, ["same text"] * 3000 + [f"text {i}" for i in range(3000)])
    rows = exact_groups(docs).collect()
    assert len(rows) == 6000 and sum(r.kept for r in rows) == 3001


def test_stage_keeps_rows_and_columns(spark):
    docs = table(spark, cases() + cases())
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    texts = [norm(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({norm(t) for t in cases()})
    assert exact_groups(empty(spark)).collect() == [] and drop_exact_copies(empty(spark)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = exact_groups(table(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert normalised(F.col("a")) is not None
