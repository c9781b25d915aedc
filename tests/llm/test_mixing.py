import random
from collections import defaultdict

import numpy as np
from helpers import AWKWARD, empty, prose, table, words

from kvspark.llm.mixing import mix, round_bucket, take_mix


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        if not rest:
            return full
        left = total - sum(full.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > most * sizes[s]]
        if not above:
            return full | share
        for s in above:
            full[s] = most * sizes[s]


def docs(spark, n=900, seed=0):
    rng = random.Random(seed)
    texts = [prose(rng, int(rng.lognormvariate(4, 1))) for _ in range(n)] + AWKWARD
    names = ["é", "a", "Z", "b", None, "tiny"]
    sources = [rng.choices(names, [50, 20, 10, 8, 10, 1])[0] for _ in texts]
    return table(spark, texts, sources=sources)


def test_targets_and_taken(spark):
    frame = docs(spark)
    rows = mix(frame, leaf=60, fan=2).collect()
    given = frame.collect()
    sizes = defaultdict(int)
    for d in given:
        sizes[d.source] += len(words(d.text))
    want = brute_targets(dict(sizes))
    assert len(rows) == len(given)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) < max(60, 0.05 * want[s]), (s, n, want[s])
    by_id = {d.doc_id: len(words(d.text)) for d in given}
    assert all(r.size == by_id[r.doc_id] for r in rows)


def test_reruns_agree(spark):
    first = sorted((r.doc_id, r.copies) for r in mix(docs(spark), leaf=60, fan=2).collect())
    again = sorted((r.doc_id, r.copies) for r in mix(docs(spark).repartition(7), leaf=60, fan=2).collect())
    assert first == again


def test_rounding_keeps_sums_and_expectations():
    rng = np.random.default_rng(0)
    size = np.sort(rng.lognormal(5, 1, 25))[::-1]
    part = rng.random(25)
    total = np.zeros(25)
    for _ in range(4000):
        out = round_bucket(size, part, rng.random(25))
        assert abs((out * size).sum() - (part * size).sum()) < 1e-6
        assert ((out > 0) & (out < 1)).sum() <= 1
        total += out
    assert np.abs(total / 4000 - part).max() < 0.04


def test_sources_without_words_repeated_rows_and_empty(spark):
    frame = table(spark, [None, "", "a b c", "a b c", "d"], sources=["e", "e", "x", "x", None], ids=[1, 1, 2, 2, None])
    rows = mix(frame).collect()
    assert len(rows) == 5
    assert all(r.target == 0 and r.taken == 0 for r in rows if r.source == "e")
    assert mix(table(spark, [None, ""])).count() == 2
    assert mix(empty(spark)).collect() == []


def test_stage_repeats_documents(spark):
    frame = docs(spark, 300)
    out = take_mix(frame)
    assert out.columns == frame.columns
    copies = {r.doc_id: r.copies for r in mix(frame).collect()}
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
    assert dict(got) == {k: n for k, n in copies.items() if n}


def test_documents_too_large_to_be_drawn_dont_miss_the_target():
    rng = np.random.default_rng(1)
    size = np.sort(rng.lognormal(5, 1, 200))[::-1].round()
    for p in (0.01, 0.04, 0.5, 0.96, 0.99):
        for _ in range(20):
            out = round_bucket(size, np.full(200, p), rng.random(200))
            assert abs((out * size).sum() - p * size.sum()) < 1e-6 * size.sum()
            left = np.flatnonzero((out > 0) & (out < 1))
            assert len(left) <= 1 and size[left].sum() < 0.005 * size.sum()
    # A document that nothing can take the place of stays open.
    assert round_bucket(np.array([50.0, 1.0]), np.array([0.5, 0.5]), np.array([0.3, 0.4]))[1] in (0, 1)


def test_every_source_of_a_table_comes_near_its_target(spark):
    rows = mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 0.01 * r.target for r in rows)
