"""Bloom filters as frames of set bits, or packed words, built and probed by expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspark.functions.hashes import M32, hash_for

SEED_STEP = 0xFBA4C795


def sizing(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes) for ``n`` keys at false-positive rate ``p``."""
    bits = math.ceil(n * math.log(p) / math.log(1 / 2 ** math.log(2)))
    return bits, round(bits / n * math.log(2))


def modulus(bits: int) -> int:
    """Bits in use: whole bytes."""
    return -(-bits // 8) * 8


def seeds(k: int) -> list[int]:
    return [((i * SEED_STEP & M32) ^ 0x80000000) - 0x80000000 for i in range(k)]


def positions(key: Column, token: str, m: int, k: int, custom: str | None = None) -> Column:
    """Array of the ``k`` bit positions of a key."""
    h = hash_for(token, custom)
    return F.array(*[F.pmod(h(key, s), F.lit(m)).cast("long") for s in seeds(k)])


def build(keys: DataFrame, token: str, bits: int, k: int, by: list[str] | None = None, custom: str | None = None) -> DataFrame:
    """(by..., bit) of the set bits of the keys, by group (such as run_id) if asked for."""
    m = modulus(bits)
    at = F.explode(positions(F.col("key"), token, m, k, custom)).alias("bit")
    return keys.select(*(by or []), at).distinct()


def lookup(filters: DataFrame, probes: DataFrame, token: str, bits: int, k: int, custom: str | None = None) -> DataFrame:
    """Every distinct probe (key) with ``maybe``: whether all its bits are set. No false negatives."""
    at = probes.select("key").distinct().select("key", F.explode(F.array_distinct(positions(F.col("key"), token, modulus(bits), k, custom))).alias("bit"))
    marked = at.join(filters.select("bit").distinct().withColumn("set", F.lit(True)), "bit", "left")
    return marked.groupBy("key").agg(F.bool_and(F.coalesce("set", F.lit(False))).alias("maybe"))


#: Probes that a task of ``lookup_runs`` holds, and bits of filters that it holds at once (32 MB).
KEYS_HELD, BITS_HELD = 500_000, 1 << 28
#: Bytes of hits, of eight runs each, that are unpacked at once.
HITS_AT_ONCE = 1 << 15


def lookup_runs(filters: DataFrame, probes: DataFrame, token: str, bits: int, k: int) -> DataFrame:
    """(key, run_id) of the runs whose filter (run_id, bit) may hold a probe.

    Every pair of a probe and a run is tested, eight runs to a byte: a task holds one block of the probes and goes
    through all filters, some at a time. No row is made for a pair before all of its bits are found.
    """
    from kvspark.sources.scratch import written

    spark, m = filters.sparkSession, modulus(bits)
    asked = written(probes.select("key").distinct().filter("key IS NOT NULL"), "asked")
    n = max(2 * spark.sparkContext.defaultParallelism, -(-asked.count() // KEYS_HELD))
    words = packed(filters.filter("bit IS NOT NULL"), ["run_id"]).groupBy("run_id").agg(F.collect_list(F.struct("word", "mask")).alias("w"))
    key, run = asked.schema["key"].dataType, filters.schema["run_id"].dataType
    runs = words.select(
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"), F.lit(1).alias("kind"), F.lit(None).cast(key).alias("key"), "run_id",
        F.col("w.word").alias("at"), F.col("w.mask").alias("mask"),
    )
    keys = asked.select(
        F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("part"), F.lit(0).alias("kind"), "key", F.lit(None).cast(run).alias("run_id"),
        positions(F.col("key"), token, m, k).alias("at"), F.array().cast("array<bigint>").alias("mask"),
    )
    ordered = keys.unionByName(runs).repartitionById(n, "part").sortWithinPartitions("kind")
    at_once = max(8, BITS_HELD // m // 8 * 8)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _hits(batches, m, k, min(512, at_once))

    types = f"key {key.simpleString()}, run_id {run.simpleString()}"
    return ordered.select("kind", "key", "run_id", "at", "mask").mapInArrow(find, types)


def _hits(batches: Iterator[pa.RecordBatch], m: int, k: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """(key, run_id) of probes (kind 0, bits in ``at``) and filters (kind 1, words and masks), probes first; ``at_once`` filters at a time."""
    held: list[tuple[pa.Array, np.ndarray]] = []
    table, n, ids = np.zeros((m, at_once // 8), np.uint8), 0, []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        n_keys = int(np.count_nonzero(kind == 0))
        if n_keys:
            own = batch.slice(0, n_keys)
            held.append((own.column("key"), own.column("at").flatten().to_numpy().astype(np.int64).reshape(n_keys, k)))
        if n_keys == len(kind) or not held:
            continue
        runs = batch.slice(n_keys)
        counts = np.diff(runs.column("at").offsets.to_numpy())
        ends = np.cumsum(counts)
        words, masks = runs.column("at").flatten().to_numpy(), runs.column("mask").flatten().to_numpy()
        for i in range(len(runs)):
            mine = slice(ends[i] - counts[i], ends[i])
            of_word, bit = np.nonzero(masks[mine, None] >> np.arange(63) & 1)
            table[words[mine][of_word] * 63 + bit, n // 8] |= np.uint8(1 << n % 8)
            ids.append(runs.column("run_id").slice(i, 1))
            n += 1
            if n == at_once:
                yield from _pairs(held, table, pa.concat_arrays(ids))
                table[:], n, ids = 0, 0, []
    if n:
        yield from _pairs(held, table, pa.concat_arrays(ids))


def _pairs(held: list[tuple[pa.Array, np.ndarray]], table: np.ndarray, ids: pa.Array) -> Iterator[pa.RecordBatch]:
    """The pairs of probes (keys, bits) and runs whose row of ``table`` (bits by runs, eight to a byte) is set at all bits."""
    for keys, at in held:
        found = table[at[:, 0]]
        for j in range(1, at.shape[1]):
            found &= table[at[:, j]]
        hit = np.flatnonzero(found)
        for a in range(0, len(hit), HITS_AT_ONCE):
            some = hit[a : a + HITS_AT_ONCE]
            byte, bit = np.nonzero(np.unpackbits(found.ravel()[some, None], axis=1, bitorder="little"))
            key, first = np.divmod(some[byte], table.shape[1])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(key)), ids.take(pa.array(first * 8 + bit))], names=["key", "run_id"])


def merge(filters: list[DataFrame]) -> DataFrame:
    """Union of filters of one size and number of hashes."""
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.distinct()


def set_bits(filters: DataFrame, bits: list[int]) -> DataFrame:
    """A filter with more bits set."""
    return merge([filters.select("bit"), filters.sparkSession.createDataFrame([(b,) for b in bits], "bit long")])


def unset_bits(filters: DataFrame, bits: list[int]) -> DataFrame:
    return filters.filter(~F.col("bit").isin(bits))


def packed(filters: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., word, mask): 63 bits to a long, for storage and bitwise merging."""
    at = filters.select(
        *(by or []),
        F.floor(F.col("bit") / 63).cast("long").alias("word"),
        F.expr("shiftleft(1L, CAST(bit % 63 AS INT))").alias("mask"),
    )
    return at.groupBy(*(by or []), "word").agg(F.bit_or("mask").alias("mask"))


def unpacked(words: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The set bits of packed words."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(62))).alias("b")
    at = words.select(*(by or []), "word", "mask", bit)
    return at.filter(F.getbit("mask", F.col("b")) == 1).select(*(by or []), (F.col("word") * 63 + F.col("b")).alias("bit"))


#: Words of 63 bits in a row of a stored filter.
BLOCK_WORDS = 4096
#: Bits of all filters together up to which a probe broadcasts them (8 MB); beyond, they are joined by shuffle.
BROADCAST_BITS = 64_000_000


def stored(filters: DataFrame, bits: int, by: list[str] | None = None) -> DataFrame:
    """(by..., block, words): a filter (by..., bit) of ``bits`` bits for storage, ``BLOCK_WORDS`` words of 63 bits to a row."""
    by = by or []
    n_words = -(-modulus(bits) // 63)
    words = packed(filters, by)
    # Every word is there, so a bit's place in its row follows from its number.
    if by:
        last = F.lit(n_words - 1).cast("long")
        blank = filters.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("word"))
    else:
        blank = filters.sparkSession.range(n_words).withColumnRenamed("id", "word")
    blank = blank.withColumn("mask", F.lit(0).cast("long"))
    dense = words.unionByName(blank).groupBy(*by, "word").agg(F.bit_or("mask").alias("mask"))
    block = F.floor(F.col("word") / BLOCK_WORDS).cast("long").alias("block")
    rows = dense.groupBy(*by, block).agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("w"))
    return rows.select(*by, "block", F.transform("w", lambda x: x["mask"]).alias("words"))


def probe(
    filters: DataFrame, sizes: dict, probes: DataFrame, token: str, custom: str | None = None
) -> DataFrame:
    """(key, run_id) of every distinct probe (key) and every stored filter (run_id, block, words) that may hold it.

    ``sizes`` has (bits, hashes) by run_id: a bounded number of runs, each with filters of its own size. Filters whose
    size is within ``BROADCAST_BITS`` are broadcast and a probe is one expression; larger ones are joined by block.
    """
    span = 63 * BLOCK_WORDS
    asked = probes.select("key").distinct()
    if not sizes:
        return asked.withColumn("run_id", F.lit(None).cast("string")).limit(0)
    places = [
        F.struct(F.lit(run).alias("run_id"), F.array_distinct(positions(F.col("key"), token, modulus(bits), k, custom)).alias("at"))
        for run, (bits, k) in sizes.items()
    ]
    at = asked.select("key", F.explode(F.array(*places)).alias("p")).select("key", "p.run_id", "p.at")
    single = all(modulus(bits) <= span for bits, _ in sizes.values())
    if single:
        at = at.withColumn("block", F.lit(0).cast("long"))
    else:
        at = at.withColumn("need", F.size("at")).withColumn("at", F.explode("at"))
        at = at.withColumn("block", F.floor(F.col("at") / span).cast("long")).withColumn("at", F.array("at"))
    small = sum(bits for bits, _ in sizes.values()) <= BROADCAST_BITS
    hit = at.join(F.broadcast(filters) if small else filters, ["run_id", "block"])
    is_set = lambda p: F.getbit(F.get("words", (F.floor(p / 63) % BLOCK_WORDS).cast("int")), (p % 63).cast("int")) == 1
    hit = hit.filter(F.forall("at", is_set))
    if not single:
        hit = hit.groupBy("key", "run_id").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).filter("n = need")
    return hit.select("key", "run_id")


def bytes_of(filters: DataFrame, bits: int) -> DataFrame:
    """(byte, value): the bytes of a filter (bit), bit 0 the lowest of byte 0, zeros included."""
    zeros = filters.sparkSession.range(modulus(bits) // 8).select(F.col("id").alias("byte"), F.lit(0).alias("value"))
    one = F.expr("shiftleft(1, CAST(bit % 8 AS INT))").alias("value")
    return zeros.unionByName(filters.select(F.floor(F.col("bit") / 8).cast("long").alias("byte"), one)).groupBy("byte").agg(F.bit_or("value").alias("value"))


def to_text(filters: DataFrame, bits: int) -> DataFrame:
    """(block, text): the bytes as comma-separated numbers, ``BLOCK_WORDS`` of them to a row."""
    rows = bytes_of(filters, bits).groupBy(F.floor(F.col("byte") / BLOCK_WORDS).cast("long").alias("block"))
    in_order = F.sort_array(F.collect_list(F.struct("byte", "value")))
    return rows.agg(F.array_join(F.transform(in_order, lambda x: x["value"].cast("string")), ",").alias("text"))


def from_text(texts: DataFrame) -> DataFrame:
    """The set bits of what :func:`to_text` wrote."""
    value = texts.select("block", F.posexplode(F.split("text", ",")).alias("i", "value"))
    bit = value.select((F.col("block") * BLOCK_WORDS + F.col("i")).alias("byte"), F.col("value").cast("int").alias("value"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b"))
    return bit.filter(F.getbit("value", F.col("b")) == 1).select((F.col("byte") * 8 + F.col("b")).alias("bit"))


def parquet_options(column: str, n: int) -> dict[str, str]:
    """Writer options for Parquet's own filter on a column: what prunes files in production."""
    return {f"parquet.bloom.filter.enabled#{column}": "true", f"parquet.bloom.filter.expected.ndv#{column}": str(n)}
