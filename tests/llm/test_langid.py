import random
import zlib

import numpy as np
from helpers import AWKWARD, empty, table

from kvspark.llm.langid import WINDOW, Scorer, _pooled, identify, train

SYLLABLES = {"aa": ["the", "ing", "tion", "er"], "bb": ["ße", "ung", "sch", "ei"], "cc": ["ção", "ñe", "los", "qu"]}


def _docs(n, rng):
    texts, langs = [], []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        texts.append(" ".join("".join(rng.choices(SYLLABLES[lang], k=2)) for _ in range(rng.randrange(20, 200))))
        langs.append(lang)
    return texts, langs


def test_held_out_accuracy_and_contract(spark):
    texts, langs = _docs(450, random.Random(0))
    rows = identify(table(spark, texts, langs=langs)).collect()
    assert len(rows) == 450
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_texts(spark):
    texts, langs = _docs(90, random.Random(1))
    rows = identify(table(spark, texts + AWKWARD, langs=langs + [None] * len(AWKWARD))).collect()
    got = {r.doc_id - 90: (r.lang_pred, r.score) for r in rows if r.doc_id >= 90}
    for i, text in enumerate(AWKWARD):
        lettered = any(c.isalpha() for c in text or "")
        assert (got[i][0] != "und") == lettered
        assert lettered or got[i][1] == 0


def test_whole_text_counts(spark):
    texts, langs = _docs(240, random.Random(2))
    rng = random.Random(3)
    head = " ".join("".join(rng.choices(SYLLABLES["aa"], k=2)) for _ in range(100))
    tail = " ".join("".join(rng.choices(SYLLABLES["bb"], k=2)) for _ in range(3000))
    rows = identify(table(spark, [*texts, head + " " + tail], langs=[*langs, None])).collect()
    assert next(r.lang_pred for r in rows if r.doc_id == 240) == "bb"


def test_nothing_to_learn_from_and_empty(spark):
    rows = identify(table(spark, ["abc", None], langs=[None, None])).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    assert identify(empty(spark)).collect() == []


def test_table_lookup_is_the_network():
    rng = np.random.default_rng(0)
    windows = rng.integers(1, 255, (40, WINDOW)).astype(np.uint8)
    net = train(windows, ["a", "b"] * 20, epochs=1)
    pooled, _ = _pooled(net, windows)
    z = pooled @ net.out + net.out_bias
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(Scorer(net).windows(windows), want, atol=1e-3)
    again = train(windows, ["a", "b"] * 20, epochs=1)
    assert all(np.array_equal(a, b) for a, b in zip(net.kernels, again.kernels, strict=True))
