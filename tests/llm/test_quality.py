import random
from collections import Counter

import regex
from helpers import AWKWARD, empty, prose, table, words

from pyspark.sql import functions as F

from kvspark.llm.quality import Rule, quality_rules


def brute(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, g in enumerate(windows) if seen[g] > 1 for k in range(3)}
    held = [line for line in text.split("\n") if words(line)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(held) - len(set(held)),
        "n_repeat_words": len(covered),
        "n_unlettered": sum(not any(regex.match(r"\p{L}", c) for c in x) for x in w),
        "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w),
    }


def texts():
    rng = random.Random(0)
    out = list(AWKWARD)
    for n in (3, 4, 49, 50, 51, 400, 3000):
        for vocabulary in (3, 8, 400, 10**6):
            out.append(prose(rng, n, vocabulary))
    out += ["word\u2028 wor\u2029- \x85word \x85 - \u2028\u2029 1\x85 a\x85"]
    out += ["a b a b a b", "x y z x y z", "é 日本 | < > é 日本 |", "l1 a\nl1 a\n\n \nl1 a\r\nl1 a", "the " * 60 + prose(rng, 60)]
    return out


def test_counts_are_those_of_brute_force(spark):
    cases = texts()
    docs = table(spark, cases)
    out = quality_rules(docs)
    assert out.columns == [*docs.columns, "quality"]
    got = {r.doc_id: r.quality.asDict() for r in out.collect()}
    for i, text in enumerate(cases):
        want = brute(text)
        assert {k: got[i][k] for k in want} == want, text
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_clean_prose_is_kept_and_junk_is_not(spark):
    rng = random.Random(1)
    stops = ["the", "of", "and", "to", "in"]
    clean = " ".join(rng.choice(stops) if rng.random() < 0.3 else f"word{rng.randrange(10**6):x}" for _ in range(300))
    junk = [" ".join(f"{w}###" for w in clean.split()), " | ".join(clean.split()), "\n".join([clean[:200]] * 30)]
    kept = [r.quality.kept for r in quality_rules(table(spark, [clean, *junk])).orderBy("doc_id").collect()]
    assert kept == [True, False, False, False]


def test_own_thresholds_and_empty_table(spark):
    docs = table(spark, ["a b c"])
    assert quality_rules(docs, base=[Rule("n_words", low=2)], rules=[]).first().quality.kept
    assert not quality_rules(docs, base=[], rules=[Rule("n_words", high=2)]).first().quality.kept
    assert quality_rules(empty(spark)).collect() == []


def test_one_projection(spark):
    plan = quality_rules(table(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_own_stop_words_and_clashing_columns(spark):
    text = " ".join(f"и слово{i:x}" for i in range(60))
    docs = table(spark, [text]).withColumn("__words", F.lit(1)).withColumn("__K", F.lit(2)).withColumn("__counts", F.lit(3))
    assert not quality_rules(docs).first().quality.kept
    assert not quality_rules(docs, stop_words={"ru": "не на"}).first().quality.kept
    for lists in ({"ru": "и не на"}, {}):
        kept = quality_rules(docs, stop_words=lists)
        assert kept.columns == [*docs.columns, "quality"]
        r = kept.first()
        assert r.quality.kept and (r["__words"], r["__K"], r["__counts"]) == (1, 2, 3)
