import random

import numpy as np
import pandas as pd
import pytest
from helpers import AWKWARD, empty, table, words

from kvspark.llm import lshforest
from kvspark.llm.graph import components
from kvspark.llm.lshforest import (
    MOST_TRIES, agreement, candidates, drop_near_copies, forest_recall, forest_shape, most_bits, near, near_groups, own_shingles,
    possible, simhash, verify_classes,
)
from kvspark.llm.shingles import jaccard, shingle_sets


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts):
    """Class (smallest place) of every text."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return [top(i) for i in range(len(texts))]


def corpus(rng, families=30, lone=60):
    texts = [" ".join(f"u{rng.randrange(5000)}" for _ in range(rng.randrange(6, 300))) for _ in range(lone)]
    for _ in range(families):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(40, 400))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            texts.append("  ".join(copy))
    rng.shuffle(texts)
    return texts


def test_shingle_hashes_count_like_shingles():
    texts = [t or "" for t in AWKWARD] + corpus(random.Random(5), 5, 5)
    sets = [g for g, _ in shingle_sets([t.encode() for t in texts])]
    assert [len(g) for g in sets] == [len(shingles(t)) for t in texts]
    for i in range(0, len(texts), 3):
        for j in range(len(texts)):
            a, b = shingles(texts[i]), shingles(texts[j])
            assert abs(jaccard(sets[i], sets[j]) - (len(a & b) / len(a | b) if a and b else 0)) < 1e-12


def test_agreement_is_that_of_simhash():
    rng = np.random.default_rng(0)
    same = []
    for _ in range(60):
        both = rng.integers(0, 2**63, 600, dtype=np.uint64)
        a, b = np.unique(both[:540]), np.unique(np.concatenate((both[:480], both[540:])))
        same.append(128 - int(np.bitwise_count(simhash(a) ^ simhash(b)).sum()))
    assert abs(np.mean(same) / 128 - agreement(480 / 600)) < 0.02


def test_forest_grows_deeper_with_more_tries():
    shapes = [forest_shape(n) for n in (10, 10**4, 10**6, 10**8)]
    assert shapes[0] == (0, 1) and shapes == sorted(shapes)


def _pairs_at(rng, n, both, extra_a, extra_b):
    """SimHashes of n pairs of random sets with so many common and own shingles."""
    for _ in range(n):
        x = rng.integers(0, 2**63, both + extra_a + extra_b, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, both + extra_a + extra_b, dtype=np.uint64)
        yield simhash(x[: both + extra_a]), simhash(np.concatenate((x[:both], x[both + extra_a :])))


def test_recall_at_production_depth_is_met(spark):
    """Pairs at exactly 0.8, of long and of the shortest texts, in the forest of ten million texts; brute force says all match."""
    rng = np.random.default_rng(8)
    depth, tries = forest_shape(10**7)
    assert depth == 14
    kinds = {"long": (1500, 480, 60, 60, False), "short": (1500, 4, 1, 0, True)}
    more = {"tries_short": forest_shape(10**7, short=True)[1], "most_short": most_bits(0.8, short=True)}
    for n, both, a, b, short in kinds.values():
        s = np.array([x for pair in _pairs_at(rng, n, both, a, b) for x in pair]).view(np.int64)
        rows = [(i, int(x), int(y), i, short) for i, (x, y) in enumerate(s)]
        nodes = spark.createDataFrame(rows, "node long, s1 long, s2 long, label long, short boolean")
        got = {(r.a, r.b) for r in candidates(nodes, depth, tries, most_bits(0.8), True, **more).collect()}
        assert len(got & {(i, i + 1) for i in range(0, 2 * n, 2)}) >= 0.985 * n


def test_classes_are_those_of_brute_force(spark):
    texts = corpus(random.Random(7)) + AWKWARD
    rows = near_groups(table(spark, texts), leaf=32, recall=0.999).collect()
    want = brute(texts)
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(want))
    assert all(r.class_size == want.count(want[r.doc_id]) for r in rows)


def test_dense_nodes_keep_a_family_together(spark):
    rng = random.Random(9)
    base = [f"v{i}" for i in range(300)]
    texts = []
    for k in range(150):
        copy = list(base)
        copy[rng.randrange(300)] = f"z{k}"
        texts.append(" ".join(copy))
    rows = near_groups(table(spark, texts), leaf=8, dense=16).collect()
    assert {r.class_id for r in rows} == {0} and len(rows) == 150


def test_star_far_above_dense_keeps_its_leaves(spark):
    """Leaves at 0.84 to the base and 0.7 to each other hang together by the base only."""
    rng = random.Random(12)
    base = [f"v{i}" for i in range(300)]
    texts = []
    for k in range(700):
        copy = list(base)
        for at in rng.sample(range(5, 295, 6), 5):
            copy[at] = f"z{k}.{at}"
        texts.append(" ".join(copy))
    texts.insert(350, " ".join(base))
    rows = near_groups(table(spark, texts), leaf=8, dense=16).collect()
    sizes = [r.class_size for r in rows]
    assert len(rows) == 701 and max(sizes) >= 0.95 * 701


def test_blocks_of_a_dense_node_meet_once_each(spark):
    rng = np.random.default_rng(4)
    s = rng.integers(0, 2**63, (300, 2), dtype=np.int64)
    s[100:] = s[0] ^ (np.int64(1) << rng.integers(0, 62, (200, 2)))
    rows = [(i, int(a), int(b), i // 3) for i, (a, b) in enumerate(s)]
    nodes = spark.createDataFrame(rows, "node long, s1 long, s2 long, label long")
    got = sorted((r.a, r.b) for r in candidates(nodes, 0, 1, 10, True, dense=16).collect())
    u = s.view(np.uint64)
    want = [
        (i, j) for i in range(300) for j in range(i + 1, 300) if i // 3 != j // 3 and np.bitwise_count(u[i] ^ u[j]).sum() <= 10
    ]
    assert got == want and len(want) > 19_000


def test_repeated_rows_nulls_and_empty(spark):
    text = " ".join(map(str, range(50)))
    rows = near_groups(table(spark, [text, text, None, "", None, text], ids=[5, 3, 1, 2, None, 3])).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.class_size) for r in rows) == sorted(
        [(5, 3, 3), (3, 3, 3), (1, 1, 1), (2, 2, 1), (-1, -1, 1), (3, 3, 3)]
    )
    assert near_groups(empty(spark)).collect() == []


def test_one_document_of_each_class_stays(spark):
    texts = corpus(random.Random(8), 12, 10) + ["", None, ""]
    docs = table(spark, texts)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = brute(texts)
    got = [want[r.doc_id] for r in kept.collect()]
    assert sorted(got) == sorted(set(want))


def test_near_finds_all_pairs_across_blocks():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 2**63, (70, 2), dtype=np.uint64)
    s[40:60] = s[:20] ^ np.uint64(5)
    got = {(int(i), int(j)) for a, b in near(s, np.arange(70), 10, block=16) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for j in range(70) for i in range(j) if np.bitwise_count(s[i] ^ s[j]).sum() <= 10}
    assert got == want


def test_components(spark):
    chain = [(i + 1, i) for i in range(100, 140)] + [(7, 3), (9, 7), (3, 3), (7, 3), (200, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {3: 3, 7: 3, 9: 3, 200: 3}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_the_search_climbs_where_tries_run_out():
    for n in (10**3, 10**5, 10**7, 10**9, 10**11):
        depth, tries = forest_shape(n)
        assert tries <= MOST_TRIES and forest_recall(depth, tries, 0.8, most_bits(0.8)) >= 0.99
        assert depth <= max(0, np.log2(n / 512)) and forest_shape(n, short=True)[0] == depth
    assert forest_shape(10**9)[0] < forest_shape(10**9, most_tries=10**6)[0]


@pytest.mark.parametrize("common", [0, 165])
def test_recall_of_default_parameters_over_many_texts(spark, common):
    """Pairs at similarity 0.8 to 0.81 among 20,000 unrelated sets, and sets that share a template (0.7 to each other)."""
    rng, n, size, pairs = np.random.default_rng(5), 20_000, 200, 600
    template = rng.integers(0, 2**63, common).astype(np.uint64)
    sets = [np.concatenate((template, rng.integers(0, 2**63, size - common).astype(np.uint64))) for _ in range(n)]
    for i in range(pairs):
        # 22 of 200 shingles differ: 178 / 222 = 0.802
        sets[n - 1 - i] = np.concatenate((sets[i][22:], rng.integers(0, 2**63, 22).astype(np.uint64)))
        assert jaccard(np.sort(sets[i]), np.sort(sets[n - 1 - i])) >= 0.8
    words = np.array([simhash(np.sort(x)) for x in sets]).view(np.int64)
    label = np.where(np.arange(n) >= n - pairs, np.arange(n), -1)
    frame = spark.createDataFrame(
        pd.DataFrame({"node": np.arange(n), "s1": words[:, 0], "s2": words[:, 1], "label": label}), "node long, s1 long, s2 long, label long"
    )
    depth, tries = forest_shape(n)
    found = candidates(frame, depth, tries, most_bits(0.8), True).filter(f"a + b = {n - 1}").count()
    print("recall", common, found / pairs)
    assert found >= 0.95 * pairs


def test_a_family_below_the_threshold_is_not_verified_pair_by_pair(spark, monkeypatch):
    """Texts of one template, 0.64 to each other, beside a class of near copies of the template: near by SimHash, not similar."""
    rng = random.Random(3)
    base = [f"v{i}" for i in range(300)]

    def changed(k, places):
        copy = list(base)
        for at in rng.sample(range(5, 295, 6), places):
            copy[at] = f"z{k}.{at}"
        return " ".join(copy)

    texts = [changed(k, 13) for k in range(300)] + [changed(k, 2) for k in range(300, 400)]
    counted = {}

    def counting(df, label, written=lshforest.written):
        out = written(df, label)
        counted[label] = out.count() if label == "second-pairs" else None
        return out

    monkeypatch.setattr(lshforest, "written", counting)
    rows = near_groups(table(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(brute(texts)))
    assert counted["second-pairs"] <= len(texts)


def test_no_similar_pair_is_above_its_bound(spark):
    texts = [t for t in corpus(random.Random(11), 15, 20) if t]
    held = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    own = {r.node: r.own for r in own_shingles(held.unionByName(held.limit(5))).collect()}
    sets = [shingles(t) for t in texts]
    for i, mine in enumerate(sets):
        rest = set().union(*(x for j, x in enumerate(sets) if j != i))
        assert own.get(i, 0) == len(mine - rest)
    n = np.array([len(x) for x in sets])
    common = n - np.array([own.get(i, 0) for i in range(len(n))])
    similar = 0
    for i in range(len(n)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                assert possible(n[i], n[j], common[i], common[j], 0.8)
                assert common[i] >= 0.8 * n[i] - 1e-6 and common[j] >= 0.8 * n[j] - 1e-6
                similar += 1
    assert similar > 10
    # 4 of 5 is at 0.8 exactly
    assert possible(np.array([4]), np.array([5]), np.array([4]), np.array([4]), 0.8).all()
    assert not possible(np.array([4]), np.array([6]), np.array([4]), np.array([6]), 0.8).any()


def test_cells_verify_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(lshforest, "BLOCK", 1500)
    monkeypatch.setattr(lshforest, "CELL_PAIRS", 100)
    texts = corpus(random.Random(13), 8, 12)
    rows = [(i, i // 7, len(shingles(t)), t) for i, t in enumerate(texts)]
    held = spark.createDataFrame(rows + rows[:4], "node long, label long, n long, text string")
    want = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if i // 7 != j // 7]
    got = verify_classes(spark.createDataFrame(want, "a long, b long"), held, 0.8).collect()
    assert sorted(tuple(sorted((r.a, r.b))) for r in got) == want
    for r in got:
        a, b = shingles(texts[r.a]), shingles(texts[r.b])
        assert r.similar == (len(a & b) >= 0.8 * len(a | b))
