"""SimHash near-dedup with an LSH forest.

Texts become sets of five-word shingles, sets become 128-bit SimHashes. Each trie
of the forest orders all SimHashes by 64 of their bits in a random order, so a
node of the trie is a run of the sorted order with a common prefix. Depth follows
density: where a node holds more than ``DENSE`` texts, the search begins at longer
prefixes, bit by bit; elsewhere at the depth where a node holds ``LEAF`` texts on
average. From there it climbs to shorter prefixes until ``MOST_TRIES`` tries reach the target
recall at the similarity asked for, and the forest has as many tries as the prefix it
climbs to needs (shorter prefixes, fewer tries). All tries draw on the same
bits, so recall is taken over the distribution of the bits in which a pair differs.
Sets of few shingles differ in more bits: short texts have further tries, and a
larger number of bits up to which they are candidates. Texts of a node whose
SimHashes are near enough are candidates, and the shingle sets themselves decide.

Candidates are taken in two passes, so that a group of near copies costs its size
and not its square: first every text is paired with one candidate before and one
after it and verified pairs are joined to classes; then all candidates in
different classes are verified. The result is the one of verifying all.

The first pass is a shortcut: it is range-partitioned on (trie, bits, text), goes
deeper where a node holds more than ``DENSE`` texts, and pairs the texts of each
node passed on the way with the one nearest to the majority of their bits, the
likely origin of a family. What it may have missed stays open. The second pass
climbs to the prefix at which recall holds and compares whole nodes of it: one of more
than ``DENSE`` texts is cut to blocks, and every two blocks meet in a task, but texts of
one class aren't compared again. It runs twice: first it only marks the texts that have a
candidate in another class. Shingles that no other of these has cannot be common to a
pair, which bounds the similarity of every pair from above; the second time, pairs whose
bound is too low are left out. So a family of texts of one template that are near by
SimHash, but not similar, isn't verified pair by pair. What is left is verified in cells,
part of a class with part of the texts near it, so that a text moves once per cell.
Equal texts are one node from the start, and text moves only to verify.

Defined results: a text without words (or null) is a class of its own; with fewer
than five words, its word list is its one shingle. ``class_id`` is the smallest
``doc_id`` of the class. Repeated rows share their class. A text of any length is
sketched and compared whole. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.llm.graph import components
from kvspark.llm.shingles import jaccard, mix, shingle_sets
from kvspark.llm.tables import fresh, join_hot, written

BITS = 128
SIMILARITY = 0.8
RECALL = 0.99
#: Texts in a node on average, and at most before the trie goes deeper.
LEAF, DENSE = 512, 16_384
#: Tries at most: where a prefix needs more for the target recall, the search climbs to a shorter one.
MOST_TRIES = 128
#: Rows of one trie partition.
RANGE = 300_000
#: Shingles verified in one task at once, about; pairs of them in a cell of a class.
BLOCK, CELL_PAIRS = 400_000, 100_000
SEED = 3
#: Sets of at most so many shingles are short; SimHashes of sets above ``LIMIT`` differ as ``agreement`` says.
SHORT, LIMIT = 8, 24


def agreement(similarity: float) -> float:
    """Chance that one SimHash bit of two sets of this Jaccard similarity agrees."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def _differs(a: int, b: int, both: int) -> float:
    """Chance that a SimHash bit of sets of ``a`` and ``b`` shingles differs, of which ``both`` are common."""
    ones = lambda n: np.array([math.comb(n, k) / 2.0**n for k in range(n + 1)])
    common = np.arange(both + 1)[:, None]
    set_a = ((2 * (common + np.arange(a - both + 1)) > a) * ones(a - both)).sum(axis=1)
    set_b = ((2 * (common + np.arange(b - both + 1)) > b) * ones(b - both)).sum(axis=1)
    return float((ones(both) * (set_a * (1 - set_b) + set_b * (1 - set_a))).sum())


@lru_cache
def difference(similarity: float, short: bool = False) -> float:
    """The highest chance that a SimHash bit differs, over all pairs of at least this similarity: of two short sets, or others."""
    worst = 0.0 if short else 1 - agreement(similarity)
    for b in range(1, (SHORT if short else LIMIT) + 1):
        for a in range(1, b + 1):
            if short or b > SHORT:
                for both in range(max(1, math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)), a + 1):
                    worst = max(worst, _differs(a, b, both))
    return worst


def _chances(similarity: float, short: bool) -> np.ndarray:
    """Chance of each number of differing bits, at the highest difference."""
    q = difference(similarity, short)
    return np.array([math.comb(BITS, k) * q**k * (1 - q) ** (BITS - k) for k in range(BITS + 1)])


def most_bits(similarity: float, recall: float = RECALL, short: bool = False) -> int:
    """Differing bits up to which two SimHashes are candidates: a tenth of the loss allowed is above."""
    return int(np.searchsorted(np.cumsum(_chances(similarity, short)), 1 - (1 - recall) / 10))


def forest_recall(depth: int, tries: int, similarity: float, most: int, short: bool = False) -> float:
    """Chance that a pair shares a node of ``depth`` bits in some trie, over the distribution of its differing bits."""
    bits = range(most + 1)
    hit = np.array([math.comb(BITS - k, depth) / math.comb(BITS, depth) for k in bits])
    return float((_chances(similarity, short)[: most + 1] * (1 - (1 - hit) ** tries)).sum())


def _tries(depth: int, similarity: float, recall: float, short: bool) -> int:
    """The fewest tries with which prefixes of ``depth`` bits reach the target recall."""
    most = most_bits(similarity, recall, short)
    high = 1
    while forest_recall(depth, high, similarity, most, short) < recall:
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        if forest_recall(depth, middle, similarity, most, short) < recall:
            low = middle
        else:
            high = middle
    return high


def forest_shape(
    n: int, similarity: float = SIMILARITY, recall: float = RECALL, leaf: int = LEAF, short: bool = False, most_tries: int = MOST_TRIES
) -> tuple[int, int]:
    """(depth, tries) for ``n`` texts: of the prefix that is climbed to from the one that their density asks for.

    ``short`` texts have more tries at the same depth.
    """
    depth = min(60, max(0, math.floor(math.log2(max(n, 1) / leaf)))) if n > leaf else 0
    while depth and (tries := _tries(depth, similarity, recall, False)) > most_tries:
        depth -= 1
    if short or not depth:
        tries = _tries(depth, similarity, recall, short)
    return depth, tries


def simhash(shingles: np.ndarray) -> np.ndarray:
    """Two 64-bit words."""
    both = np.column_stack((shingles, mix(shingles ^ np.uint64(0x5851F42D4C957F2D))))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(both), 65536):
        ones += np.unpackbits(both[at : at + 65536].view(np.uint8), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(shingles)).view(np.uint64)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, n, s1, s2): digest of the text, number of distinct shingles, SimHash."""
    clean = F.coalesce(F.col(text), F.lit(""))
    columns = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(clean, 256)).alias("key"), clean.alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, sigs = [], []
                for grams, _ in shingle_sets([x.as_py().encode() for x in part.column(2)]):
                    n.append(len(grams))
                    sigs.append(simhash(grams))
                words = np.array(sigs).view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64())] + [pa.array(words[:, i]) for i in (0, 1)],
                    names=["doc_id", "key", "n", "s1", "s2"],
                )

    return columns.mapInArrow(sketch, f"doc_id {kind}, key binary, n long, s1 long, s2 long")


def _orders(tries: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return np.array([rng.permutation(BITS)[:64] for _ in range(tries)])


def _spread(
    batches: Iterator[pa.RecordBatch], orders: np.ndarray, tries: int
) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(trie, its 64 bits of every row, rows) of batches (node, s1, s2, label, short); from ``tries`` on of short rows."""
    for batch in batches:
        s = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)])
        bits = np.unpackbits(np.ascontiguousarray(s).view(np.uint8).reshape(-1, 16), axis=1)
        for t, order in enumerate(orders):
            if t == tries:
                few = batch.column(4).to_numpy(zero_copy_only=False)
                batch, bits = batch.filter(batch.column(4)), bits[few]
            if not batch.num_rows:
                break
            key = np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(">u8").ravel().astype(np.uint64)
            yield t, key, batch


def _prefix(bits: np.ndarray, depth: int) -> np.ndarray:
    return bits >> np.uint64(64 - depth) if depth else np.zeros(len(bits), np.uint64)


def _in_tries(nodes: DataFrame, tries: int, all_tries: int) -> DataFrame:
    """Every node once per trie, with the trie's 64 bits as an ordered long."""
    orders = _orders(all_tries)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, key, rows in _spread(batches, orders, tries):
            key = (key ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), t, np.int32)), pa.array(key), *rows.columns],
                names=["trie", "bits", "node", "s1", "s2", "label", "short"],
            )

    return nodes.select("node", "s1", "s2", "label", "short").mapInArrow(
        spread, "trie int, bits long, node long, s1 long, s2 long, label long, short boolean"
    )


def _dense_nodes(nodes: DataFrame, depth: int, tries: int, all_tries: int, dense: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per trie, the sorted prefixes of all its nodes of more than ``dense`` rows, and how many blocks they are cut to.

    A node above ``dense`` has more than its part of ``dense`` in some partition, so only such counts are sent.
    """
    orders = _orders(all_tries)
    least = dense // max(1, nodes.rdd.getNumPartitions())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((len(orders), 1 << depth), np.int32)
        for t, key, _ in _spread(batches, orders, tries):
            prefixes, n = np.unique(_prefix(key, depth).astype(np.int64), return_counts=True)
            tables[t, prefixes] += n.astype(np.int32)
        t, prefix = np.nonzero(tables > least)
        yield pa.RecordBatch.from_arrays(
            [pa.array(t), pa.array(prefix), pa.array(tables[t, prefix].astype(np.int64))], names=["trie", "prefix", "n"]
        )

    counted = nodes.select("node", "s1", "s2", "label", "short").mapInArrow(count, "trie long, prefix long, n long")
    # What isn't sent of a node is ``dense`` at most; with it, those that can't be above are left out.
    found = counted.groupBy("trie", "prefix").agg(F.sum("n").alias("n")).orderBy("trie", "prefix").collect()
    out = {}
    for t in {r.trie for r in found}:
        own = [r for r in found if r.trie == t]
        out[t] = np.array([r.prefix for r in own], np.uint64), np.array([math.ceil((r.n + dense) / dense) for r in own])
    return out


def _in_blocks(nodes: DataFrame, depth: int, tries: int, all_tries: int, dense: int) -> DataFrame:
    """Every node of the forest in each trie under its prefix; one of a dense prefix once for every pair of blocks it is part of.

    ``side`` is 0 where all rows of a (trie, prefix, pair) are to be compared, otherwise 1 or 2: with the other side only.
    """
    columns = ["node", "s1", "s2", "label", "short", "n", "common"]
    orders, big = _orders(all_tries), _dense_nodes(nodes, depth, tries, all_tries, dense)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, key, rows in _spread(batches, orders, tries):
            prefix = _prefix(key, depth)
            which = np.arange(len(key))
            pair, side = np.zeros(len(key), np.int64), np.zeros(len(key), np.int8)
            if t in big:
                dense_prefixes, n_blocks = big[t]
                at = np.minimum(np.searchsorted(dense_prefixes, prefix), len(dense_prefixes) - 1)
                k = np.where(dense_prefixes[at] == prefix, n_blocks[at], 1)
                which = np.repeat(which, k)
                other = np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k)
                k = k[which]
                node = rows.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
                mine = (mix(node)[which] % k.astype(np.uint64)).astype(np.int64)
                pair = np.minimum(mine, other) * k + np.maximum(mine, other)
                side = np.where(mine == other, 0, np.where(mine < other, 1, 2)).astype(np.int8)
            for c in range(0, len(which), 65536):
                part = which[c : c + 65536]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), t, np.int32)), pa.array(prefix[part].view(np.int64)),
                        pa.array(pair[c : c + 65536]), pa.array(side[c : c + 65536]), *rows.take(pa.array(part)).columns,
                    ],
                    names=["trie", "prefix", "pair", "side", *columns],
                )

    return nodes.select(columns).mapInArrow(
        spread,
        "trie int, prefix long, pair long, side byte, node long, s1 long, s2 long, label long, short boolean, n long, common long",
    )


def near(
    s: np.ndarray, label: np.ndarray, most: int, block: int | None = None, short: np.ndarray | None = None, most_short: int = 0
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, with at most ``most`` (two ``short``: ``most_short``) differing bits and different labels, block by block."""
    block = block or max(16, (1 << 21) // max(len(s), 1))
    for a in range(0, len(s), block):
        rows = s[a : a + block]
        rest = s[a:]
        apart = np.bitwise_count(rows[:, None, 0] ^ rest[None, :, 0]) + np.bitwise_count(rows[:, None, 1] ^ rest[None, :, 1])
        i, j = np.nonzero(apart <= (most if short is None else max(most, most_short)))
        keep = i < j
        if short is not None:
            keep &= (apart[i, j] <= most) | (short[a + i] & short[a + j] & (apart[i, j] <= most_short))
        i, j = i[keep] + a, j[keep] + a
        keep = label[i] != label[j]
        yield i[keep], j[keep]


def _splits(bits: np.ndarray, a: int, b: int, depth: int, dense: int, leads: list) -> Iterator[tuple[int, int]]:
    """Nodes of at most ``dense`` rows, or of one key, within rows a to b that share ``depth`` bits."""
    todo = [(a, b, depth)]
    while todo:
        a, b, depth = todo.pop()
        if b - a <= dense or depth >= 64 or bits[a] == bits[b - 1]:
            yield a, b
            continue
        leads.append((a, b))
        top = bits[a:b] >> np.uint64(63 - depth)
        cut = a + int(np.searchsorted(top, top[0], side="right"))
        todo.append((a, cut, depth + 1))
        if cut < b:
            todo.append((cut, b, depth + 1))


def compared(
    s: np.ndarray, label: np.ndarray, side: np.ndarray, most: int, short: np.ndarray, most_short: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) like those of ``near``: of all rows of side 0, of side 1 with side 2."""
    by_label = np.argsort(label, kind="stable")
    for left, right in ((0, 0), (1, 2)):
        rows, cols = by_label[side[by_label] == left], by_label[side[by_label] == right]
        step = max(16, (1 << 21) // max(len(cols), 1))
        for a in range(0, len(rows), step):
            mine, rest = rows[a : a + step], cols[a:] if left == right else cols
            if label[mine[0]] == label[mine[-1]]:
                rest = rest[label[rest] != label[mine[0]]]
            if not len(rest):
                continue
            apart = np.bitwise_count(s[mine, None, 0] ^ s[None, rest, 0]) + np.bitwise_count(s[mine, None, 1] ^ s[None, rest, 1])
            i, j = np.nonzero(apart <= max(most, most_short))
            apart = apart[i, j]
            i, j = mine[i], rest[j]
            keep = (label[i] != label[j]) & ((apart <= most) | (short[i] & short[j] & (apart <= most_short)))
            yield i[keep], j[keep]


def possible(n_a: np.ndarray, n_b: np.ndarray, common_a: np.ndarray, common_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of so many shingles, of which at most so many are in any other set, can have this Jaccard similarity."""
    return (1 + similarity) * np.minimum(common_a, common_b) >= similarity * (n_a + n_b) - 1e-6


def candidates(
    nodes: DataFrame, depth: int, tries: int, most: int, every: bool, dense: int = DENSE,
    tries_short: int = 0, most_short: int = 0, similarity: float = SIMILARITY, marked: bool = False,
) -> DataFrame:
    """Distinct (a, b), a < b: candidate pairs of ``nodes`` (node, s1, s2, label, perhaps short) with different labels.

    Short nodes are in ``tries_short`` tries, and two of them are candidates up to ``most_short`` bits, where that is more.
    With ``n`` and ``common`` (the most that each has in common with another), ``every`` leaves out pairs that can't be similar.
    ``marked``: instead of the pairs, (a, a) of each node that is in one.

    Not ``every``: of each node, the first candidate below it and the first above it, as far as one task sees them,
    and (a, a) of each node that may have others.
    """
    all_tries = max(tries, tries_short)
    if "short" not in nodes.columns:
        nodes = nodes.withColumn("short", F.lit(False))
    rows = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_if("short").alias("short")).first()
    n = max(1, math.ceil((rows.n * tries + rows.short * (all_tries - tries)) / RANGE))
    if every:
        for bound in ("n", "common"):
            if bound not in nodes.columns:
                nodes = nodes.withColumn(bound, F.lit(0).cast("long"))
        placed = _in_blocks(nodes, depth, tries, all_tries, dense)
        return _all_candidates(placed, most, most_short, n, similarity, marked)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        trie, key, node, s1, s2, label, short = (c.to_numpy() for c in table.columns)
        bits = key.view(np.uint64) ^ np.uint64(1 << 63)
        s = np.column_stack((s1, s2)).view(np.uint64)
        prefix = _prefix(bits, depth)
        edge = np.flatnonzero((trie[1:] != trie[:-1]) | (prefix[1:] != prefix[:-1])) + 1
        bounds = np.concatenate(([0], edge, [len(bits)]))
        found: list[np.ndarray] = []
        unsure: list[np.ndarray] = []
        size = 0
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            leads: list[tuple[int, int]] = []
            # The rest of a node at a range's border is in another task, and a dense one is split.
            if a == 0 or b == len(bits) or b - a > dense:
                unsure.append(node[a:b])
            for c, d in _splits(bits, int(a), int(b), depth, dense, leads):
                if d - c < 2:
                    continue
                if d - c > dense:
                    leads.append((c, d))
                    continue
                order = np.argsort(node[c:d], kind="stable") + c
                low, high = np.full(d - c, -1), np.full(d - c, -1)
                for i, j in near(s[order], label[order], most, None, short[order], most_short):
                    fresh = low[j] < 0
                    js, at = np.unique(j[fresh], return_index=True)
                    low[js] = i[fresh][at]
                    fresh = high[i] < 0
                    is_, at = np.unique(i[fresh], return_index=True)
                    high[is_] = j[fresh][at]
                for ends in (low, high):
                    k = np.flatnonzero(ends >= 0)
                    if len(k):
                        found.append(np.column_stack((node[order[k]], node[order[ends[k]]])))
                        size += len(k)
            for c, d in leads:
                lead = c + _central(s[c:d])
                apart = np.bitwise_count(s[c:d] ^ s[lead]).sum(axis=1)
                k = np.flatnonzero((apart <= most) & (label[c:d] != label[lead])) + c
                found.append(np.column_stack((node[k], np.full(len(k), node[lead]))))
                size += len(k)
            if size > 200_000:
                yield _pairs_batch(found)
                found, size = [], 0
        if size:
            yield _pairs_batch(found)
        alone = np.unique(np.concatenate(unsure))
        yield pa.RecordBatch.from_arrays([pa.array(alone), pa.array(alone)], names=["a", "b"])

    ordered = _in_tries(nodes, tries, all_tries).repartitionByRange(n, "trie", "bits", "node").sortWithinPartitions("trie", "bits")
    return ordered.mapInArrow(pairs, "a long, b long").distinct()


def _central(s: np.ndarray) -> int:
    """The row nearest to the majority of all rows' bits."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(s), 65536):
        ones += np.unpackbits(np.ascontiguousarray(s[at : at + 65536]).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    middle = np.packbits(2 * ones > len(s)).view(np.uint64)
    return int(np.bitwise_count(s ^ middle).sum(axis=1).argmin())


def _all_candidates(placed: DataFrame, most: int, most_short: int, n: int, similarity: float, marked: bool) -> DataFrame:
    """Every candidate pair of each whole node; ``marked``: (a, a) of all that are in one."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        trie, prefix, pair, side, node, s1, s2, label, short, size_of, common = (
            c.to_numpy() for c in pa.Table.from_batches(got).columns
        )
        s = np.column_stack((s1, s2)).view(np.uint64)
        new = (trie[1:] != trie[:-1]) | (prefix[1:] != prefix[:-1]) | (pair[1:] != pair[:-1])
        bounds = np.concatenate(([0], np.flatnonzero(new) + 1, [len(s)]))
        found: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        size = 0
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            in_pair = np.zeros(b - a, bool)
            for i, j in compared(s[a:b], label[a:b], side[a:b], most, short[a:b], most_short):
                keep = possible(size_of[a + i], size_of[a + j], common[a + i], common[a + j], similarity)
                i, j = i[keep], j[keep]
                if marked:
                    in_pair[i] = in_pair[j] = True
                    continue
                found.append(np.column_stack((node[a + i], node[a + j])))
                size += len(i)
                if size > 200_000:
                    yield _pairs_batch(found)
                    found, size = [], 0
            if marked and in_pair.any():
                marks.append(node[a:b][in_pair])
        if size:
            yield _pairs_batch(found)
        if marks:
            alone = np.unique(np.concatenate(marks))
            yield pa.RecordBatch.from_arrays([pa.array(alone), pa.array(alone)], names=["a", "b"])

    keys = ("trie", "prefix", "pair")
    return placed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(pairs, "a long, b long").distinct()


def _pairs_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    ab = np.concatenate(found)
    ab.sort(axis=1)
    ab = np.unique(ab[ab[:, 0] != ab[:, 1]], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])


def with_text(wanted: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``wanted`` (doc_id, key, others) with the text of a row of ``docs`` that has both."""
    texts = docs.select(
        F.col(doc_id).alias("its_id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("its_key"), F.col(text).alias("text")
    )
    return wanted.hint("shuffle_hash").join(
        texts, (F.col("key") == F.col("its_key")) & F.col("doc_id").eqNullSafe(F.col("its_id"))
    ).drop("its_id", "its_key")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str, similarity: float) -> DataFrame:
    """(a, b, similar) of every pair, by the Jaccard similarity of their shingle sets.

    Pairs meet in blocks: a text with one or more of its partners, as many as
    ``BLOCK`` shingles hold; a text with many partners is sent to many blocks.
    """
    sized = pairs.join(nodes.select(F.col("node").alias("b"), "n"), "b")
    blocks = sized.groupBy("a").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).alias("blocks"))
    placed = sized.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    placed = written(placed, "blocks")
    needs = placed.select("a", "block", F.col("b").alias("node")).unionByName(
        placed.select("a", "block", F.col("a").alias("node")).distinct()
    )
    owners = nodes.select("node", "doc_id", "key")
    held = with_text(needs.join(owners, "node"), docs, doc_id, text).select("a", "block", "node", "text")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        lead = int(pdf["a"].iloc[0])
        sets = dict(zip(pdf["node"], (g for g, _ in shingle_sets([t.encode() for t in pdf["text"]])), strict=True))
        mine = sets[lead]
        rest = [b for b in sets if b != lead]
        return pd.DataFrame({"a": lead, "b": rest, "similar": [jaccard(mine, sets[b]) >= similarity for b in rest]})

    return held.groupBy("a", "block").applyInPandas(compare, "a long, b long, similar boolean")


def own_shingles(held: DataFrame) -> DataFrame:
    """(node, own): how many of its shingles no other row of ``held`` (node, text) has; nodes with none are left out."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                node = part.column(0).to_numpy()
                for k, (grams, _) in enumerate(shingle_sets([x.as_py().encode() for x in part.column(1)])):
                    for c in range(0, len(grams), 65536):
                        own = grams[c : c + 65536].view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own), pa.array(np.full(len(own), node[k]))], names=["gram", "node"]
                        )

    counted = held.select("node", "text").mapInArrow(shingles, "gram long, node long").groupBy("gram")
    once = counted.agg(F.min("node").alias("node"), F.max("node").alias("last")).filter("node = last")
    return once.groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def verify_classes(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similar) like ``verify``, for pairs of ``held`` (node, label, n, text); a and b may change places.

    A pair belongs to the larger class of its two. The texts of a class and those to be compared with them are cut to parts
    of about ``BLOCK`` shingles, and two parts meet in a cell.
    """
    ends = held.select("node", "label", "n").distinct()
    members = ends.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    ends = written(ends.join(members, "label").select("node", F.struct("members", "label", "n", F.col("node").alias("id")).alias("end")), "ends")
    sided = pairs
    for side in ("a", "b"):
        sided = sided.join(ends.select(F.col("node").alias(side), F.col("end").alias(f"end_{side}")), side)
    lead, other = F.greatest("end_a", "end_b"), F.least("end_a", "end_b")
    sided = sided.select(lead.alias("x"), other.alias("y")).select(
        F.col("x.label").alias("lead"), F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")
    )
    sided = written(sided, "sided")
    per_a = sided.groupBy("lead", "a").agg(F.min("n_a").alias("n_a"), F.count(F.lit(1)).alias("pairs"))
    per_b = sided.groupBy("lead", "b").agg(F.min("n_b").alias("n_b"))
    sizes = per_a.groupBy("lead").agg(F.ceil(F.sum("n_a") / F.lit(BLOCK)).alias("parts_a"), F.sum("pairs").alias("pairs"))
    sizes = sizes.join(per_b.groupBy("lead").agg(F.ceil(F.sum("n_b") / F.lit(BLOCK)).alias("parts_b")), "lead")
    cells = F.ceil(F.col("pairs") / (F.col("parts_a") * F.lit(CELL_PAIRS)))
    sizes = written(sizes.withColumn("parts_b", F.greatest("parts_b", cells)), "cells")
    placed = join_hot(sided, sizes, "lead", "pairs", sided.count()).select(
        "lead", F.pmod(F.xxhash64("a"), F.col("parts_a")).alias("part_a"), F.pmod(F.xxhash64("b"), F.col("parts_b")).alias("part_b"), "a", "b"
    )
    placed = written(placed, "placed")
    cell = ["lead", "part_a", "part_b"]
    needs = placed.select(*cell, F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = needs.join(held.select("node", "text"), "node").toDF("node", "its_lead", "its_a", "its_b", "text")

    def compare(texts: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        sets = dict(zip(texts["node"], (g for g, _ in shingle_sets([t.encode() for t in texts["text"]])), strict=True))
        similar = [jaccard(sets[a], sets[b]) >= similarity for a, b in zip(its["a"], its["b"], strict=True)]
        return pd.DataFrame({"a": its["a"], "b": its["b"], "similar": similar})

    return texts.groupBy("its_lead", "its_a", "its_b").cogroup(placed.groupBy(*cell)).applyInPandas(compare, "a long, b long, similar boolean")


def near_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    leaf: int = LEAF,
    dense: int = DENSE,
) -> DataFrame:
    """(doc_id, class_id, class_size): one row per row of ``docs``."""
    own = written(sketches(docs, doc_id, text), "sketches")
    nodes = own.filter("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("s1").alias("s1"), F.min("s2").alias("s2"),
        F.count(F.lit(1)).alias("n_docs"),
    )
    nodes = nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("short", F.col("n") <= SHORT)
    nodes = written(nodes, "nodes")
    depth, tries = forest_shape(nodes.count(), similarity, recall, leaf)
    most = most_bits(similarity, recall)
    _, tries_short = forest_shape(nodes.count(), similarity, recall, leaf, short=True)
    for_short = {"tries_short": tries_short, "most_short": most_bits(similarity, recall, short=True)}

    tried = written(candidates(nodes.withColumn("label", F.col("node")), depth, tries, most, False, dense, **for_short), "first-pairs")
    first = tried.filter("a <> b")
    seen = written(verify(first, nodes, docs, doc_id, text, similarity), "first-links")
    links = seen.filter("similar").select(F.col("b").alias("u"), F.col("a").alias("v"))
    classes = written(components(links), "first-classes")
    # Only texts that have or may have a candidate at all, and pairs that cross classes and are still open.
    touched = tried.select(F.col("a").alias("node")).unionByName(tried.select(F.col("b").alias("node"))).distinct()
    open_nodes = nodes.join(touched, "node", "left_semi").join(classes, "node", "left")
    open_nodes = open_nodes.withColumn("label", F.coalesce("root", "node")).withColumn("common", F.col("n"))
    open_nodes = written(open_nodes, "open-nodes")
    shape = {"depth": depth, "tries": tries, "most": most, "every": True, "dense": dense, "similarity": similarity, **for_short}
    crossing = candidates(open_nodes, **shape, marked=True).select(F.col("a").alias("node"))
    held = with_text(open_nodes.join(crossing, "node", "left_semi").drop("common"), docs, doc_id, text)
    held = written(held, "crossing")
    # A row that is repeated is held as often.
    bounded = held.drop("text").distinct().join(own_shingles(held), "node", "left")
    bounded = bounded.withColumn("common", F.col("n") - F.coalesce("own", F.lit(0)))
    # What a text shares with another is at most ``common``, of at least its own ``n``.
    bounded = written(bounded.filter(F.col("common") >= F.lit(similarity) * F.col("n") - 1e-6), "bounded")
    second = candidates(bounded, **shape).join(first, ["a", "b"], "left_anti")
    second = written(second, "second-pairs")
    if not second.isEmpty():
        more = written(verify_classes(second, held, similarity), "second-links").filter("similar")
        links = links.unionByName(more.select(F.col("b").alias("u"), F.col("a").alias("v")))
        classes = written(components(links), "classes")

    rooted = nodes.join(classes, "node", "left").select("key", "doc_id", "n_docs", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "rooted")
    whole = rooted.groupBy("root").agg(
        F.min("doc_id").alias("class_id"), F.sum("n_docs").alias("class_size"), F.count(F.lit(1)).alias("n_texts")
    )
    whole = written(whole, "whole")
    named = join_hot(rooted, whole, "root", "n_texts", rooted.count())
    named = written(named.select("key", "n_docs", "class_id", "class_size"), "named")
    found = join_hot(own.filter("n > 0").select("doc_id", "key"), named, "key", "n_docs", own.count())
    alone = own.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return found.select("doc_id", "class_id", "class_size").unionByName(alone)


def drop_near_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that have an earlier row in their class."""
    row = fresh(docs, "__row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    dropped = near_groups(numbered, row, text).filter("doc_id <> class_id").select(F.col("doc_id").alias(row))
    return numbered.join(dropped, row, "left_anti").drop(row)
