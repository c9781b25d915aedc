"""Logs, lookups, runs, filters, hashes and codecs on hand-made cases."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvspark.functions import codec, hashes
from kvspark.functions.types import KINDS, kind, quarter_points, token_of, width
from kvspark.operators import bloom, cache, lookup, oplog, runs

LOG = "key long, value double, ts timestamp_ntz, seq long, deleted boolean"


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)


def log(spark, *rows):
    return spark.createDataFrame([(k, v, at(t), s, v is None) for k, v, t, s in rows], LOG)


def pairs(df):
    return sorted((r.key, r.value) for r in df.select("key", "value").collect())


# --- log and fold ----------------------------------------------------------------------------------------------------


def test_tombstones_and_reinserts(spark):
    rows = log(spark, (1, 1.0, 0, 0), (1, None, 1, 1), (2, None, 0, 2), (2, 5.0, 3, 3), (3, 7.0, 0, 4))
    assert pairs(oplog.live(rows)) == [(2, 5.0), (3, 7.0)]
    assert sorted(r.key for r in oplog.fold(rows).filter("deleted").collect()) == [1]


def test_ties_of_time_go_to_the_later_write(spark):
    assert pairs(oplog.live(log(spark, (1, 1.0, 0, 5), (1, 2.0, 0, 9), (1, 3.0, 0, 7)))) == [(1, 2.0)]


def test_empty_log_one_key_and_largest_key(spark):
    none = log(spark)
    assert oplog.fold(none).collect() == [] and oplog.live(none).collect() == []
    edge = (1 << 63) - 1
    assert pairs(runs.compact(runs.to_runs(log(spark, (edge, 1.0, 0, 0), (-edge - 1, 2.0, 0, 1)), F.lit(0)), 0)) == [(-edge - 1, 2.0), (edge, 1.0)]


def test_deleting_writes_only_for_present_keys(spark):
    rows = log(spark, (1, 1.0, 0, 0), (2, 2.0, 0, 1))
    probes = spark.createDataFrame([(2,), (2,), (9,)], "key long")
    gone = oplog.delete_keys(rows, probes, F.lit(at(9)), F.lit(9).cast("long"))
    assert [r.key for r in gone.collect()] == [2]
    assert pairs(oplog.live(rows.unionByName(gone))) == [(1, 1.0)]
    assert oplog.live(oplog.cleared(rows)).collect() == []


def test_merge_of_runs_keeps_the_newest(spark):
    a, b = log(spark, (1, 1.0, 0, 0), (2, 2.0, 9, 1)), log(spark, (1, 5.0, 1, 2), (2, 6.0, 3, 3), (4, 1.0, 0, 4))
    assert pairs(oplog.merge_sorted([a, b])) == [(1, 5.0), (2, 2.0), (4, 1.0)]
    assert pairs(oplog.merge_sorted([b, a])) == pairs(oplog.merge_sorted([a, b]))


def test_numbers_follow_the_order(spark):
    rng = random.Random(0)
    keys = [rng.randrange(10**6) for _ in range(3000)]
    got = oplog.numbered(spark.createDataFrame([(k,) for k in keys], "key long"), "key").orderBy("rn").collect()
    assert [r.key for r in got] == sorted(keys) and [r.rn for r in got] == list(range(1, 3001))
    assert oplog.numbered(spark.createDataFrame([], "key long"), "key").collect() == []


# --- lookups ---------------------------------------------------------------------------------------------------------


def test_lookups(spark):
    state = oplog.fold(log(spark, *[(k, float(k), 0, k) for k in range(0, 40, 2)], (4, None, 1, 99)))
    probes = spark.createDataFrame([(2,), (3,), (4,), (4,)], "key long")
    assert pairs(lookup.multi_get(state, probes)) == [(2, 2.0), (3, None), (4, None), (4, None)]
    assert [r.key for r in lookup.has(state, probes).collect()] == [2]
    assert sorted(r.key for r in lookup.has_not(state, probes).collect()) == [3, 4, 4]
    assert lookup.get(state, 4).collect() == [] and lookup.get(state, 6).first().value == 6.0
    live = state.filter("NOT deleted")
    assert lookup.read_n(live, 0).first().key == 0 and lookup.read_n(live, -1).first().key == 38
    assert lookup.read_n(live, 2).first().key == 6 and lookup.read_n(live, 99).collect() == [] and lookup.read_n(live, -99).collect() == []
    assert sorted(r.key for r in lookup.range_scan(live, 6, 10).collect()) == [6, 8, 10]
    assert lookup.find_one(live, "value > 11").first().key == 12
    assert [r.key for r in lookup.read_all(live).collect()] == sorted(set(range(0, 40, 2)) - {4})


def test_page_floor(spark):
    run = spark.range(0, 5000, 2).withColumnRenamed("id", "key")
    index = lookup.sparse_index(run, 49, per_page=100)
    rows = sorted((r.page, r.first_key, r.offset) for r in index.collect())
    assert rows == [(i, 200 * i, 13 + 100 * i * 49) for i in range(25)]
    probes = spark.createDataFrame([(k,) for k in (-1, 0, 199, 200, 201, 4999, 10**9)], "key long")
    got = sorted((r.key, r.page) for r in lookup.page_floor(index, probes).collect())
    assert got == [(0, 0), (199, 0), (200, 1), (201, 1), (4999, 24), (10**9, 24)]


def test_equality_reaches_the_scan(spark, tmp_path):
    log(spark, *[(k, 1.0, 0, k) for k in range(100)]).write.parquet(f"{tmp_path}/log")
    plan = lookup.get(spark.read.parquet(f"{tmp_path}/log"), 7)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,7)" in plan


# --- runs ------------------------------------------------------------------------------------------------------------


def test_compaction_is_idempotent_and_keeps_the_state(spark):
    rows = log(spark, (1, 1.0, 0, 0), (1, 2.0, 1, 1), (2, None, 5, 2), (2, 1.0, 2, 3))
    once = runs.compact(runs.to_runs(rows, F.col("seq")), 0)
    assert pairs(oplog.live(once)) == pairs(oplog.live(rows))
    again = runs.compact(once.withColumn("run_id", F.lit(1)), 1)
    assert pairs(again) == pairs(once) and {r.level for r in again.collect()} == {2}
    last = runs.compact(runs.to_runs(rows, F.col("seq")), 0, last_level=0)
    assert pairs(last) == [(1, 2.0)] and {r.level for r in last.collect()} == {0}


def test_splits_chunks_and_triggers(spark):
    rows = log(spark, *[(k, 1.0, 0, k) for k in range(10)])
    assert sorted(r["count"] for r in runs.split(rows, 4).groupBy("part").count().collect()) == [2, 4, 4]
    assert sorted(r["count"] for r in runs.chunked(rows, 3).groupBy("chunk").count().collect()) == [2, 4, 4]
    many = runs.to_runs(rows, F.col("seq"))
    assert runs.due_levels(many, 10).first().runs == 10 and runs.due_levels(many, 11).collect() == []
    assert runs.flush(rows, 3).select("run_id").distinct().first().run_id == 3
    stat = runs.run_stats(runs.to_runs(rows, F.lit(0)), "u64", "f64").first()
    assert (stat.kv_count, stat.file_size, stat.pages) == (10, 13 + 490, 1)


# --- hashes (independent integer models) -----------------------------------------------------------------------------

M = (1 << 32) - 1


def s32(x):
    return ((int(x) & M) ^ 0x80000000) - 0x80000000


def model_int(n, seed):
    x = (s32(n) ^ s32(seed)) + s32(seed << 13)
    for _ in range(2):
        x = s32(x)
        x = int(float((x >> 16) ^ x) * 73244475.0)
    x = s32(x)
    return (x >> 16) ^ x


def model_u64(n, seed):
    low, high = n & M, n >> 32 & M
    h = s32((seed & M) ^ low)
    h = int(float(s32(h ^ ((h & M) >> 16))) * float(0x85EBCA6B))
    h = s32(h) ^ s32(high)
    h = int(float(s32(h ^ ((h & M) >> 13))) * float(0xC2B2AE35))
    return (s32(h) ^ ((h & M) >> 16)) & M


def model_murmur(data, seed):
    h = seed & M
    rot = lambda x, r: (x << r | x >> 32 - r) & M
    for i in range(0, len(data) // 4 * 4, 4):
        k = rot(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & M, 15) * 0x1B873593 & M
        h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & M
    if tail := data[len(data) // 4 * 4 :]:
        h ^= rot(int.from_bytes(tail, "little") * 0xCC9E2D51 & M, 15) * 0x1B873593 & M
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & M
    h = (h ^ h >> 13) * 0xC2B2AE35 & M
    return h ^ h >> 16


@pytest.mark.parametrize("seed", [0, -73087083, 42])
def test_integer_hashes(spark, seed):
    rng = random.Random(1)
    keys = [0, 1, -1, 2**31 - 1, -(2**31)] + [rng.randrange(-(2**31), 2**32) for _ in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = df.select("k", hashes.hash_int(F.col("k"), seed).alias("h")).collect()
    assert all(r.h == model_int(r.k, seed) and 0 <= r.h < 2**31 for r in got)
    wide = [0, 1, 2**63 - 1, 2**63, 2**64 - 1] + [rng.randrange(2**64) for _ in range(500)]
    df = spark.createDataFrame([(Decimal(k),) for k in wide], "k decimal(20,0)")
    got = df.select("k", hashes.hash_u64(hashes.long_bits(F.col("k")), seed).alias("h")).collect()
    assert all(r.h == model_u64(int(r.k), seed) for r in got)


def test_text_hashes(spark):
    texts = ["", "a", "ab", "abc", "abcd", "abcde", "123456789012345678", "ü€日", "x" * 101]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", hashes.murmur3(F.col("t"), 7).alias("m"), hashes.hash_fnv1a(F.col("t")).alias("f")).collect():
        data = r.t.encode()
        assert r.m == model_murmur(data, 7), r.t
        h = 2166136261
        for b in data:
            h = (h ^ b) * 16777619 & M
        assert r.f == h


def test_published_murmur3_values(spark):
    known = {("", 0): 0, ("", 1): 0x514E28B7, ("test", 0): 0xBA6BD213, ("hello", 0): 0x248BFA47, ("Hello, world!", 0): 0xC0363E43,
             ("The quick brown fox jumps over the lazy dog", 0): 0x2E4FF723}
    for (text, seed), h in known.items():
        assert spark.range(1).select(hashes.murmur3(F.lit(text), seed).alias("h")).first().h == h
        assert hashes.hash_keys(np.array([text.encode()], dtype=object), "str:64", seed).tolist() == [h]


@pytest.mark.parametrize("token", ["u32", "i32", "u64", "i64", "str:18"])
def test_hashes_of_files_are_those_of_columns(spark, token):
    rng = random.Random(4)
    k = kind(token)
    values = [f"{rng.randrange(10**18):018d}"[: rng.randrange(19)] for _ in range(300)] if token.startswith("str") else [k.low, k.high, 0, 1, *(rng.randint(k.low, k.high) for _ in range(300))]
    kept = [Decimal(v) if token == "u64" else v for v in values]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(kept)], f"i int, k {k.spark.simpleString()}")
    own = np.array([v.encode() for v in values], dtype=object) if token.startswith("str") else np.array(values, dtype="u8" if token == "u64" else "i8")
    for seed in bloom.seeds(2):
        column = hashes.long_bits(F.col("k")) if token == "u64" else F.col("k")
        got = [r.h for r in df.select("i", hashes.hash_for(token)(column, seed).alias("h")).orderBy("i").collect()]
        assert got == hashes.hash_keys(own, token, seed).tolist()


def test_checksums_of_every_length():
    xxhash = pytest.importorskip("xxhash")
    rng = np.random.default_rng(0)
    for size in (0, 1, 3, 4, 7, 8, 12, 15, 16, 17, 31, 32, 33, 100, 255):
        rows = rng.integers(0, 256, (5, size), dtype=np.uint8)
        assert hashes.xxh32_rows(rows).tolist() == [xxhash.xxh32_intdigest(r.tobytes(), 0xCAFEBABE) for r in rows]


def test_checksum_and_custom_hash(spark):
    xxhash = pytest.importorskip("xxhash")
    df = spark.createDataFrame([(b"abc",), (b"",), (None,)], "b binary")
    got = [r.h for r in df.select(hashes.xxh32("b").alias("h")).collect()]
    assert got == [xxhash.xxh32_intdigest(b"abc", 0xCAFEBABE), xxhash.xxh32_intdigest(b"", 0xCAFEBABE), None]
    hashes.register_hash("identity", lambda key, seed: key + seed * 0)
    assert hashes.hash_for("u32", "identity") is not hashes.hash_int
    with pytest.raises(KeyError):
        hashes.hash_for("u32", "unknown")


# --- filters ---------------------------------------------------------------------------------------------------------


def test_filter_sizes():
    assert [bloom.sizing(n, 0.2) for n in (10_000, 50_000, 100_000, 10**6)] == [(33499, 2), (167492, 2), (334984, 2), (3349835, 2)]
    assert bloom.modulus(33499) == 33504 and bloom.seeds(2) == [0, -73087083]


@pytest.mark.parametrize("token,sql", [("u32", "key"), ("u64", "key * 1000003"), ("str:18", "lpad(cast(key as string), 18, '7')")])
def test_filters_have_no_false_negatives(spark, token, sql):
    keys = spark.range(2000).selectExpr("id AS key").selectExpr(f"{sql} AS key")
    bits, k = bloom.sizing(2000, 0.2)
    filters = bloom.build(keys, token, bits, k)
    assert bloom.lookup(filters, keys, token, bits, k).filter("NOT maybe").count() == 0
    other = spark.range(10_000, 12_000).selectExpr("id AS key").selectExpr(f"{sql} AS key")
    wrong = bloom.lookup(filters, other, token, bits, k).filter("maybe").count()
    assert wrong < 2000 * 0.3
    back = bloom.unpacked(bloom.packed(filters))
    assert sorted(r.bit for r in back.collect()) == sorted(r.bit for r in filters.collect())


@pytest.mark.parametrize("n", [1, 5000, 90_000])
def test_stored_filters(spark, n):
    """Of one block and of several, by broadcast and by join, against the filter of bits."""
    keys, asked = spark.range(n).withColumnRenamed("id", "key"), spark.range(n // 2, n + 3000).withColumnRenamed("id", "key")
    bits, k = bloom.sizing(n, 0.2)
    built = bloom.build(keys, "i64", bits, k)
    filters = bloom.stored(built, bits).withColumn("run_id", F.lit("r"))
    assert filters.count() == -(-bloom.modulus(bits) // (63 * bloom.BLOCK_WORDS))
    want = sorted(r.key for r in bloom.lookup(built, asked, "i64", bits, k).filter("maybe").collect())
    for most in (bloom.BROADCAST_BITS, 0):
        before, bloom.BROADCAST_BITS = bloom.BROADCAST_BITS, most
        try:
            assert sorted(r.key for r in bloom.probe(filters, {"r": (bits, k)}, asked, "i64").collect()) == want
        finally:
            bloom.BROADCAST_BITS = before
    assert bloom.probe(filters, {}, asked, "i64").collect() == []


@pytest.mark.parametrize("token,sql", [("u32", "id"), ("str:8", "concat('k', id)")])
def test_filters_of_many_runs(spark, monkeypatch, token, sql):
    """Against a filter of bits for each run: no join pairs every bit of a probe with every run that has it set."""
    monkeypatch.setattr(bloom, "BITS_HELD", 1000 * 16, raising=False)
    monkeypatch.setattr(bloom, "HITS_AT_ONCE", 7, raising=False)
    log = spark.range(400).selectExpr("IF(id % 50 = 0, NULL, id) AS id", "IF(id >= 380, NULL, id DIV 10) AS run_id").selectExpr(f"{sql} AS key", "run_id")
    asked = spark.range(0, 3000, 3).selectExpr("IF(id = 0, NULL, id) AS id").selectExpr(f"{sql} AS key")
    built = bloom.build(log, token, 1000, 3, by=["run_id"])
    found = bloom.lookup_runs(built, asked.union(asked), token, 1000, 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    own = {}
    for r in built.collect():
        own.setdefault(r.run_id, set()).add(r.bit)
    places = asked.dropna().select("key", bloom.positions(F.col("key"), token, 1000, 3).alias("at")).collect()
    want = [(p.key, run) for p in places for run, bits in own.items() if bits.issuperset(p.at)]
    assert len(own) == 39 and len(want) > 100 and sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert bloom.lookup_runs(built, asked.limit(0), token, 1000, 3).count() == bloom.lookup_runs(built.limit(0), asked, token, 1000, 3).count() == 0


def test_zero_and_one_are_different_bits(spark):
    keys = spark.createDataFrame([(0,), (1,)], "key long")
    only = bloom.build(keys.filter("key = 0"), "u32", 1000, 1)
    got = {r.key: r.maybe for r in bloom.lookup(only, keys, "u32", 1000, 1).collect()}
    assert got[0] and not got[1]
    bits = bloom.set_bits(only, [7])
    assert 7 in {r.bit for r in bits.collect()} and 7 not in {r.bit for r in bloom.unset_bits(bits, [7]).collect()}


# --- types and codec -------------------------------------------------------------------------------------------------


def test_types():
    assert [width(t) for t in ("str:9", "i8", "u16", "i32", "u64", "f32", "f64", "bool")] == [9, 1, 2, 4, 8, 4, 8, 1]
    assert all(token_of(k.type_id, 5) in (k.token, "str:5") for k in KINDS.values())
    for bad in ("i7", "str", "str:x", "u32:4"):
        with pytest.raises(ValueError):
            kind(bad)
    assert quarter_points("u8") == [0, 63.75, 127.5, 191.25] and quarter_points("u64")[1] == 4611686018427387903
    assert quarter_points("i8") == [0, -0.25, -0.5, -0.75]
    with pytest.raises(ValueError):
        quarter_points("bool")


@pytest.mark.parametrize("token", ["i8", "i16", "i32", "i64", "u8", "u16", "u32", "u64"])
def test_integers_round_trip_and_sort(spark, token):
    k = kind(token)
    values = sorted({k.low, k.low + 1, 0, 1, k.high // 2, k.high - 1, k.high})
    df = spark.createDataFrame([(Decimal(v),) for v in values], "d decimal(20,0)").select(F.col("d").cast(k.spark).alias("v"))
    raw = df.select("v", codec.encode_value(F.col("v"), token).alias("b"))
    for r in raw.select("v", "b", codec.decode_value(F.col("b"), token).alias("back")).collect():
        assert r.v == r.back and bytes(r.b) == (int(r.v) % (1 << 8 * k.width)).to_bytes(k.width, "big")


def test_other_values_round_trip(spark):
    df = spark.createDataFrame([(1.5, True, "ab"), (-0.0, False, "é日"), (None, None, None)], "f double, b boolean, s string")
    for column, token in (("f", "f64"), ("f", "f32"), ("b", "bool"), ("s", "str:6")):
        got = df.select(column, codec.decode_value(codec.encode_value(F.col(column), token), token).alias("back")).collect()
        assert all(r[0] == r.back for r in got), token
    assert bytes(df.select(codec.encode_value(F.lit("ab"), "str:4").alias("b")).first().b) == b"ab\0\0"
    with pytest.raises(Exception, match="longer than"):
        df.select(codec.encode_value(F.lit("abcdef"), "str:4")).collect()
    wrapped = df.select(F.hex(codec.encode_value(F.lit(300), "u8")).alias("h")).first().h
    assert wrapped == "2C"


def test_records(spark):
    xxhash = pytest.importorskip("xxhash")
    df = spark.createDataFrame([(7, 9.5, False), (8, None, True)], "k long, v double, d boolean")
    raw = df.select("k", codec.encode_record(F.col("k"), F.col("v"), F.lit(123.0), F.col("d"), "u32", "f64").alias("b"))
    first = bytes(raw.filter("k = 7").first().b)
    assert len(first) == 33 + 4 + 8 and first[:4] == bytes.fromhex("53544152") and first[-4:] == bytes.fromhex("454e4445")
    assert first[28:32] == xxhash.xxh32_intdigest(first[16:28], 0xCAFEBABE).to_bytes(4, "little")
    back = codec.decode_record(F.col("b"), "u32", "f64")
    rows = raw.select(*[c.alias(n) for n, c in back.items()]).orderBy("key").collect()
    assert [tuple(r) for r in rows] == [(7, 9.5, 123.0, False, True), (8, None, 123.0, True, True)]
    broken = raw.select(F.unhex(F.regexp_replace(F.hex("b"), "^(.{36})..", "$1FF")).alias("b"))
    assert {r.valid for r in broken.select(codec.decode_record(F.col("b"), "u32", "f64")["valid"].alias("valid")).collect()} == {False}
    line = df.select(codec.encode_log(F.col("k"), F.col("v"), F.lit(1.0), codec.DELETE, "u32", "f64").alias("b"))
    got = line.select(*[c.alias(n) for n, c in codec.decode_log(F.col("b"), "u32", "f64").items()]).orderBy("key").first()
    assert (got.key, got.value, got.ts_ms, got.deleted) == (7, None, 1.0, True)


def test_positions_in_large_runs(spark, monkeypatch):
    monkeypatch.setattr(lookup, "SORTED", 50)
    rng = random.Random(6)
    for keys in ([rng.randrange(10**9) for _ in range(3000)], [7] * 400 + [3] * 100, [f"k{rng.randrange(900):04d}" for _ in range(1000)]):
        run = spark.createDataFrame([(k,) for k in keys], "key string" if isinstance(keys[0], str) else "key long")
        for n in (0, 1, 250, 499, -1, -400):
            assert lookup.read_n(run, n).first().key == sorted(keys)[n]
        assert lookup.read_n(run, len(keys)).collect() == [] and lookup.read_n(run, -len(keys) - 1).collect() == []


def test_cache_of_the_driver():
    own = cache.Lru(2)
    own.set("a", 1), own.set("b", 2)
    assert own.get("a") == 1
    own.set("c", 3)
    assert own.keys() == ["c", "a"] and not own.has("b") and own.values() == [3, 1] and own.size == 2
    assert own.delete("c") and not own.delete("c") and own.find(lambda v: v < 2) == 1 and own.find(lambda v: v > 2) is None
    assert own.map(lambda k, v: (k, v + 1)) == [("a", 2)]
    own.clear()
    assert own.size == 0 and own.get("a") is None


def test_cache_contents(spark):
    rows = log(spark, (1, 1.0, 0, 0), (2, 2.0, 0, 1), (1, 3.0, 0, 2), (3, 4.0, 0, 3))
    assert [(r.key, r.value) for r in cache.recent(rows, 2).collect()] == [(3, 4.0), (1, 3.0)]
    assert cache.find(rows, 2, "value < 4").first().key == 1 and cache.find(rows, 2, "key = 2").collect() == []
    assert sorted(r.mapped for r in cache.map_entries(rows, 3, F.col("value") + 1).collect()) == [3.0, 4.0, 5.0]
