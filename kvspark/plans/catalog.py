"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvspark.functions import codec, hashes
from kvspark.functions.types import KINDS, quarter_points
from kvspark.operators import bloom, cache, lookup, oplog, runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Add a query under its function's name."""

    def add(query):
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Fixtures: events as a log with tombstones (EV), orders as a log of unique keys (KV), lineitem with ties (LI), runs of EV.


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.to_log(table(spark, sf_dir, "events"), "user_id", "value", "ts", "event_id", "event_type = 'error'")


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.to_log(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", "o_orderdate", "o_orderkey")


def ev_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.to_runs(ev(spark, sf_dir), F.floor(F.col("seq") / 1000))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") * 13).alias("key"))


_EV = """ev AS (SELECT user_id AS key, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, ts,
  event_id AS seq, event_type = 'error' AS deleted FROM events)"""
_NEW = """new AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM ev) WHERE rn = 1)"""
_KV = "kv AS (SELECT o_orderkey AS key, o_totalprice AS value FROM orders)"
_PROBES = "probes AS (SELECT c_custkey * 13 AS key FROM customer)"
_RUNS = """runs AS (SELECT *, 0 AS level, CAST(seq // 1000 AS BIGINT) AS run_id FROM ev)"""

# --- lookups ---------------------------------------------------------------------------------------------------------


@register(f"WITH {_KV} SELECT key, value FROM kv WHERE key = 42")
def point_get(spark, sf_dir):
    return lookup.get(kv(spark, sf_dir), 42).select("key", "value")


@register(f"WITH {_KV}, {_PROBES} SELECT p.key, kv.value FROM probes p LEFT JOIN kv ON p.key = kv.key")
def multi_get(spark, sf_dir):
    return lookup.multi_get(kv(spark, sf_dir), probes(spark, sf_dir))


@register(f"WITH {_KV}, {_PROBES} SELECT key FROM probes WHERE key IN (SELECT key FROM kv)")
def has_key(spark, sf_dir):
    return lookup.has(kv(spark, sf_dir), probes(spark, sf_dir))


@register(f"WITH {_KV}, {_PROBES} SELECT key FROM probes WHERE key NOT IN (SELECT key FROM kv)")
def not_has(spark, sf_dir):
    return lookup.has_not(kv(spark, sf_dir), probes(spark, sf_dir))


@register(f"WITH {_EV}, {_NEW} SELECT key, value, ts, seq, deleted FROM new")
def fold_latest(spark, sf_dir):
    return oplog.fold(ev(spark, sf_dir))


@register(f"WITH {_EV}, {_NEW} SELECT key, value, ts, seq FROM new WHERE NOT deleted")
def live_state(spark, sf_dir):
    return oplog.live(ev(spark, sf_dir)).drop("deleted")


@register(f"WITH {_EV}, {_NEW} SELECT key, value, deleted FROM new")
def get_versioned(spark, sf_dir):
    return oplog.fold(ev(spark, sf_dir)).select("key", "value", "deleted")


@register(
    f"WITH {_EV} SELECT key, count(*) AS versions, CAST(sum(CAST(deleted AS INT)) AS BIGINT) AS tombstones,"
    " min(ts) AS first_ts, max(ts) AS last_ts FROM ev GROUP BY key"
)
def version_history(spark, sf_dir):
    return oplog.history(ev(spark, sf_dir))


@register("""
SELECT key, value, deleted FROM (SELECT l_suppkey AS key, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS value,
  l_returnflag = 'R' AS deleted, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC,
  l_linenumber DESC, l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1
""")
def fold_ties(spark, sf_dir):
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    log = oplog.to_log(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", "l_shipdate", seq, "l_returnflag = 'R'")
    return oplog.fold(log).select("key", "value", "deleted")


def _store(spark, sf_dir, *columns: str, **options):
    """A database of one table of i64 -> f64 columns."""
    from kvspark.plans.store import ColumnOptions, Database, TableOptions
    from kvspark.sources.scratch import scratch_path

    made = tuple(ColumnOptions(name, "i64", "f64", **options) for name in columns)
    return Database(spark, scratch_path(spark, "db"), [TableOptions("main", made)]).init()


# --- writes ----------------------------------------------------------------------------------------------------------


@register("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS value FROM orders")
def insert_overwrite(spark, sf_dir):
    log = kv(spark, sf_dir)
    later = log.filter("key % 10 = 0").withColumn("value", F.col("value") + 1).withColumn("seq", F.col("seq") + 1_000_000_000)
    return oplog.live(log.unionByName(later)).select("key", "value")


@register(f"WITH {_KV}, {_PROBES} SELECT DISTINCT p.key, true AS deleted FROM probes p JOIN kv ON p.key = kv.key")
def delete_blind(spark, sf_dir):
    now = F.lit("2030-01-01").cast("timestamp_ntz")
    gone = oplog.delete_keys(kv(spark, sf_dir), probes(spark, sf_dir), now, F.lit(10**12).cast("long"))
    return gone.select("key", "deleted")


@register(f"WITH {_KV}, {_PROBES} SELECT key, value FROM kv WHERE key NOT IN (SELECT key FROM probes)")
def delete_then_read(spark, sf_dir):
    log = kv(spark, sf_dir)
    now = F.lit("2030-01-01").cast("timestamp_ntz")
    gone = oplog.delete_keys(log, probes(spark, sf_dir), now, F.lit(10**12).cast("long"))
    return oplog.live(log.unionByName(gone)).select("key", "value")


@register("SELECT 'kept' AS col, count(*) AS n FROM orders")
def clear_column(spark, sf_dir):
    """Two columns with the same records, one of them cleared and read back."""
    db = _store(spark, sf_dir, "kept", "gone")
    for name in ("kept", "gone"):
        db.table("main").column(name).insert_frame(kv(spark, sf_dir))
    db.clear("main", "gone")
    both = [db.table("main").column(name).state().withColumn("col", F.lit(name)) for name in ("kept", "gone")]
    return both[0].unionByName(both[1]).groupBy("col").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {_EV}, {_NEW} SELECT key, value, deleted FROM new ORDER BY key")
def memtable_sorted(spark, sf_dir):
    return oplog.by_key(ev(spark, sf_dir)).select("key", "value", "deleted")


# --- runs ------------------------------------------------------------------------------------------------------------


@register(f"""WITH {_EV}, {_RUNS} SELECT level, run_id, count(*) AS records, count(DISTINCT key) AS keys,
  min(key) AS first_key, max(key) AS last_key FROM runs GROUP BY level, run_id""")
def run_summary(spark, sf_dir):
    return runs.run_summary(ev_runs(spark, sf_dir))


@register(f"""WITH {_EV}, half AS (SELECT *, CASE WHEN seq < 500 THEN 0 ELSE 1 END AS run_id FROM ev),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY ts DESC, seq DESC) AS rn FROM half) WHERE rn = 1)
SELECT 0 AS level, CAST(run_id AS BIGINT) AS run_id, count(*) AS records, count(*) AS keys, min(key) AS first_key, max(key) AS last_key
FROM one GROUP BY run_id""")
def flush_runs(spark, sf_dir):
    """The log in two parts, each flushed to a run, written and read back."""
    from kvspark.sources.scratch import written

    log = ev(spark, sf_dir)
    parts = [runs.flush(log.filter("seq < 500"), 0), runs.flush(log.filter("seq >= 500"), 1)]
    back = [written(part, "run") for part in parts]
    return runs.run_summary(back[0].unionByName(back[1]))


@register(f"""WITH {_EV}, {_RUNS} SELECT level, run_id, count(*) AS kv_count, CAST(13 + count(*) * 49 AS BIGINT) AS file_size,
  CAST(ceil(count(*) / 1000.0) AS BIGINT) AS pages FROM runs GROUP BY level, run_id""")
def run_stats(spark, sf_dir):
    return runs.run_stats(ev_runs(spark, sf_dir), "u64", "f64")


@register(f"WITH {_EV}, {_RUNS} SELECT level, count(DISTINCT run_id) AS runs, count(*) AS records FROM runs GROUP BY level")
def level_stats(spark, sf_dir):
    return runs.level_stats(ev_runs(spark, sf_dir))


@register(f"WITH {_EV}, {_RUNS} SELECT level, count(DISTINCT run_id) AS runs FROM runs GROUP BY level HAVING count(DISTINCT run_id) >= 10")
def compaction_trigger(spark, sf_dir):
    return runs.due_levels(ev_runs(spark, sf_dir), 10)


@register(f"WITH {_EV}, {_NEW} SELECT key, value, ts, seq, deleted, 1 AS level FROM new")
def compact_level(spark, sf_dir):
    return runs.compact(ev_runs(spark, sf_dir), 0)


@register(f"WITH {_EV}, {_NEW} SELECT key, value, ts, seq, 0 AS level FROM new WHERE NOT deleted")
def compact_last_level(spark, sf_dir):
    return runs.compact(ev_runs(spark, sf_dir), 0, last_level=0).drop("deleted")


@register(f"""WITH {_KV}, r AS (SELECT key, (row_number() OVER (ORDER BY key) - 1) // 4000 AS part FROM kv)
SELECT CAST(part AS BIGINT) AS part, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM r GROUP BY part""")
def compact_split(spark, sf_dir):
    parts = runs.split(kv(spark, sf_dir), 4000)
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@register(f"""WITH {_KV}, r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i FROM kv)
SELECT CAST(i // 1000 AS BIGINT) AS page, key AS first_key, CAST(13 + i * 49 AS BIGINT) AS "offset" FROM r WHERE i % 1000 = 0""")
def sparse_index(spark, sf_dir):
    return lookup.sparse_index(kv(spark, sf_dir), runs.record_bytes("u64", "f64"))


@register(f"""WITH {_KV}, {_PROBES}, r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i FROM kv),
x AS (SELECT i // 1000 AS page, key AS first_key FROM r WHERE i % 1000 = 0)
SELECT p.key, CAST(max(x.page) AS BIGINT) AS page FROM probes p JOIN x ON x.first_key <= p.key GROUP BY p.key""")
def page_floor(spark, sf_dir):
    index = lookup.sparse_index(kv(spark, sf_dir), runs.record_bytes("u64", "f64"))
    return lookup.page_floor(index, probes(spark, sf_dir))


@register(f"WITH {_KV} SELECT key, value FROM kv ORDER BY key LIMIT 1 OFFSET 1234")
def read_n(spark, sf_dir):
    return lookup.read_n(kv(spark, sf_dir), 1234).select("key", "value")


@register(f"WITH {_KV} SELECT key, value FROM kv ORDER BY key DESC LIMIT 1 OFFSET 2")
def read_n_neg(spark, sf_dir):
    return lookup.read_n(kv(spark, sf_dir), -3).select("key", "value")


@register(f"WITH {_KV} SELECT key, value FROM kv")
def read_all(spark, sf_dir):
    return lookup.read_all(kv(spark, sf_dir)).select("key", "value")


@register(f"""WITH {_KV}, n AS (SELECT count(*) AS n FROM kv), r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i FROM kv),
c AS (SELECT key, i // CAST(ceil(n / 7.0) AS BIGINT) AS chunk FROM r, n)
SELECT CAST(chunk AS BIGINT) AS chunk, count(*) AS n, min(key) AS first_key FROM c GROUP BY chunk""")
def chunkify(spark, sf_dir):
    return runs.chunked(kv(spark, sf_dir), 7).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))


@register(f"WITH {_EV} SELECT count(*) AS entries, CAST(5 + count(*) * 43 AS BIGINT) AS file_size FROM ev")
def wal_stats(spark, sf_dir):
    return runs.log_stats(ev(spark, sf_dir), "u64", "f64")


@register(f"WITH {_EV} SELECT count(DISTINCT key) AS keys, count(*) AS writes FROM ev")
def memtable_stats(spark, sf_dir):
    return runs.memtable_stats(ev(spark, sf_dir))


@register(f"""WITH {_KV} SELECT 'main' AS "table", 'price' AS "column", count(*) AS keys, count(*) - 100 AS live, CAST(100 AS BIGINT) AS entries,
  CAST(5 + 100 * 43 AS BIGINT) AS log_bytes, CAST(1 AS BIGINT) AS runs, CAST(1 AS BIGINT) AS levels, count(*) AS run_records,
  CAST(13 + count(*) * 49 AS BIGINT) AS run_bytes, CAST(ceil(count(*) * ln(0.2) / ln(1 / pow(2, ln(2)))) AS BIGINT) AS filter_bits FROM kv""")
def db_stats(spark, sf_dir):
    """A store of all orders, flushed, and a hundred deletes that aren't."""
    db = _store(spark, sf_dir, "price")
    column = db.table("main").column("price")
    column.insert_frame(kv(spark, sf_dir))
    column.flush()
    column.delete_keys(spark.range(100).withColumnRenamed("id", "key"))
    return db.stats()


def _filled(spark, sf_dir):
    """A column of all orders, in seven appends that are flushed one by one."""
    db = _store(spark, sf_dir, "price", memtable=1, growth=3, levels=3)
    column = db.table("main").column("price")
    for i in range(7):
        column.insert_frame(kv(spark, sf_dir).filter(F.col("key") % 7 == i))
    return column


@register(f"""WITH {_KV} SELECT CASE WHEN key % 7 < 6 THEN 1 ELSE 0 END AS level, CAST(CASE WHEN key % 7 < 3 THEN 0 WHEN key % 7 < 6 THEN 1 ELSE 2 END AS INT) AS run,
  count(*) AS records, CAST(13 + count(*) * 49 AS BIGINT) AS file_size, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS pages FROM kv GROUP BY ALL""")
def store_levels(spark, sf_dir):
    """Seven flushes with three runs a level: two merged runs at level 1 and one at level 0."""
    found = _filled(spark, sf_dir).runs()
    order = F.array_position(F.lit([r["run_id"] for r in found.orderBy(F.desc("level"), "run_id").collect()]), F.col("run_id")) - 1
    return found.select("level", order.cast("int").alias("run"), "records", "file_size", "pages")


@register(f"WITH {_KV}, {_PROBES} SELECT p.key FROM probes p JOIN kv ON p.key = kv.key")
def store_has(spark, sf_dir):
    return _filled(spark, sf_dir).has_many(probes(spark, sf_dir))


@register(f"WITH {_KV}, {_PROBES} SELECT count(DISTINCT key) AS present, CAST(0 AS BIGINT) AS missed, true AS few_wrong FROM probes WHERE key IN (SELECT key FROM kv)")
def store_bloom_check(spark, sf_dir):
    """Stored filters of all runs: no key that is there is missed, and at most 0.7 of the others (three runs at 0.2 each) are let through."""
    told = _filled(spark, sf_dir).may_have_many(probes(spark, sf_dir))
    there = kv(spark, sf_dir).select("key", F.lit(True).alias("there"))
    told = told.join(there, "key", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    return told.agg(
        F.count_if("there").alias("present"), F.count_if(F.col("there") & ~F.col("maybe")).alias("missed"),
        (F.count_if(~F.col("there") & F.col("maybe")) <= 0.7 * F.count_if(~F.col("there"))).alias("few_wrong"),
    )


@register(f"WITH {_KV}, {_PROBES} SELECT key, value FROM kv WHERE key NOT IN (SELECT key FROM probes)")
def store_delete_compact(spark, sf_dir):
    column = _filled(spark, sf_dir)
    column.delete_keys(probes(spark, sf_dir))
    column.compact()
    return column.log().select("key", "value")


# --- hashes ----------------------------------------------------------------------------------------------------------


def _w32(x: str) -> str:
    """SQL: the low 32 bits of x as a signed number."""
    return f"(((({x}) % 4294967296) + 6442450944) % 4294967296 - 2147483648)"


def _u32(x: str) -> str:
    return f"(((({x}) % 4294967296) + 4294967296) % 4294967296)"


def _chain(source: str, *steps: str) -> str:
    """SQL: h computed step by step from (key, h); each step is an expression of h and key."""
    out = source
    for i, step in enumerate(steps):
        out = f"(SELECT key, {step} AS h FROM {out} AS s{i})"
    return out


def _product(x: str, factor: int) -> str:
    return f"CAST(CAST({x} AS DOUBLE) * {float(factor)} AS BIGINT)"


def _int_sql(seed: int, source: str = "kv") -> str:
    signed = ((seed & 0xFFFFFFFF) ^ 0x80000000) - 0x80000000
    moved = (((seed << 13) & 0xFFFFFFFF) ^ 0x80000000) - 0x80000000
    return _chain(
        f"(SELECT key, CAST(key AS BIGINT) AS h FROM {source})",
        f"xor({_w32('h')}, CAST({signed} AS BIGINT)) + {moved}",
        _w32("h"), _product("xor(h >> 16, h)", 73244475), _w32("h"), _product("xor(h >> 16, h)", 73244475), _w32("h"), "xor(h >> 16, h)",
    )


def _fold_sql(bits: int) -> str:
    return f"xor({_w32('h')}, {_u32('h')} >> {bits})"


def _u64_sql(seed: int, source: str = "kv") -> str:
    return _chain(
        f"(SELECT key, CAST(key AS BIGINT) AS h FROM {source})",
        f"xor({_u32('h')}, CAST({seed & 0xFFFFFFFF} AS BIGINT))", _product(_fold_sql(16), 0x85EBCA6B),
        f"xor({_w32('h')}, {_w32('CAST(key AS BIGINT) >> 32')})", _product(_fold_sql(13), 0xC2B2AE35), _u32(_fold_sql(16)),
    )


def _big_sql(seed: int) -> str:
    return _chain(
        "(SELECT key, CAST(key AS BIGINT) AS h FROM kv)",
        f"xor(xor({_u32('h')}, {_u32('h >> 32')}), CAST({seed & 0xFFFFFFFF} AS BIGINT))", _product(_fold_sql(16), 0x85EBCA6B),
        _fold_sql(13), _product(_fold_sql(13), 0xC2B2AE35), _u32(_fold_sql(16)),
    )


_S1 = bloom.seeds(2)[1]


@register(f"WITH {_KV} SELECT a.key, a.h AS h0, b.h AS h1 FROM {_int_sql(0)} a JOIN {_int_sql(_S1)} b ON a.key = b.key")
def hash_int(spark, sf_dir):
    return kv(spark, sf_dir).select("key", hashes.hash_int(F.col("key"), 0).alias("h0"), hashes.hash_int(F.col("key"), _S1).alias("h1"))


@register(f"WITH {_KV} SELECT a.key, a.h AS h0, b.h AS h1 FROM {_u64_sql(0)} a JOIN {_u64_sql(_S1)} b ON a.key = b.key")
def hash_u64(spark, sf_dir):
    return kv(spark, sf_dir).select("key", hashes.hash_u64(F.col("key"), 0).alias("h0"), hashes.hash_u64(F.col("key"), _S1).alias("h1"))


@register(f"WITH {_KV} SELECT key, h FROM {_big_sql(42)}")
def hash_bigint(spark, sf_dir):
    return kv(spark, sf_dir).select("key", hashes.hash_big(F.col("key"), 42).alias("h"))


def _ids(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.concat_ws("_", F.col("o_orderkey").cast("string"), F.col("o_orderpriority")).alias("id"))


_IDS = "ids AS (SELECT CAST(o_orderkey AS VARCHAR) || '_' || o_orderpriority AS id FROM orders)"
_BYTES = "[ascii(c) FOR c IN regexp_extract_all(id, '.')]"


@register(f"""WITH {_IDS} SELECT id, CAST(list_reduce(list_prepend(CAST(xor(2166136261, 42) AS BIGINT), [CAST(x AS BIGINT) FOR x IN {_BYTES}]),
  lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS BIGINT) AS h FROM ids""")
def hash_fnv(spark, sf_dir):
    return _ids(spark, sf_dir).select("id", hashes.hash_fnv1a(F.col("id"), 42).alias("h"))


_CHARS = f"""(SELECT id AS key, CAST(list_reduce(list_prepend(CAST(42 AS BIGINT), [CAST(x AS BIGINT) FOR x IN {_BYTES}]),
  lambda h, b: (h * 31 + b) % 4294967296) AS BIGINT) AS h FROM ids)"""


@register(
    f"WITH {_IDS} SELECT key AS id, h FROM "
    + _chain(_CHARS, _product(_fold_sql(16), 0x85EBCA6B), _product(_fold_sql(13), 0xC2B2AE35), _u32(_fold_sql(16)))
)
def hash_charwise(spark, sf_dir):
    return _ids(spark, sf_dir).select("id", hashes.hash_chars(F.col("id"), 42).alias("h"))


def _u(x: str | int) -> str:
    return f"CAST({x} AS UBIGINT)"


_WRAP = 4294967296


def _murmur_mix(k: str) -> list[str]:
    """SQL: the steps that a block goes through, as templates of x."""
    return [f"x * {_u(0xCC9E2D51)} % {_WRAP}", f"x * 32768 % {_WRAP} + x // 131072", f"x * {_u(0x1B873593)} % {_WRAP}"]


def _murmur_sql(seed: int, source: str) -> str:
    """SQL: (key, h) of ASCII keys."""
    byte = f"(SELECT key, [CAST(ascii(c) AS UBIGINT) FOR c IN regexp_extract_all(key, '.')] AS b FROM {source})"
    blocks = (
        f"(SELECT key, len(b) AS n, list_transform(generate_series(0, len(b) // 4 - 1), lambda i: b[4 * i + 1] + 256 * b[4 * i + 2]"
        f" + 65536 * b[4 * i + 3] + 16777216 * b[4 * i + 4]) AS ks, coalesce(list_sum(list_transform(generate_series(0, len(b) % 4 - 1),"
        f" lambda i: b[len(b) // 4 * 4 + i + 1] * [1, 256, 65536][i + 1])), 0) AS tail FROM {byte})"
    )
    ks, tail = "ks", _u("tail")
    for step in _murmur_mix("x"):
        ks = f"list_transform({ks}, lambda x: {step})"
        tail = f"list_transform([{tail}], lambda x: {step})[1]"
    body = f"list_reduce(list_prepend({_u(seed & 0xFFFFFFFF)}, {ks}), lambda h, k: ((xor(h, k) * 8192 % {_WRAP} + xor(h, k) // 524288) * 5 + {0xE6546B64}) % {_WRAP})"
    out = f"(SELECT key, xor(xor({body}, {tail}), {_u('n')}) AS h FROM {blocks})"
    for i, (bits, factor) in enumerate(((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1))):
        out = f"(SELECT key, {_u(f'xor(h, h // {1 << bits})')} * {_u(factor)} % {_WRAP} AS h FROM {out} AS m{i})"
    return f"(SELECT key, CAST(h AS BIGINT) AS h FROM {out} AS m)"


@register(f"WITH {_IDS}, k AS (SELECT id AS key FROM ids) SELECT key AS id, h FROM {_murmur_sql(0, 'k')}")
def hash_murmur3(spark, sf_dir):
    return _ids(spark, sf_dir).select("id", hashes.murmur3(F.col("id"), 0).alias("h"))


def _swapped(x: str) -> str:
    return f"(({x}) % 256 * 16777216 + ({x}) // 256 % 256 * 65536 + ({x}) // 65536 % 256 * 256 + ({x}) // 16777216)"


def _xxh32_sql(source: str) -> str:
    """SQL: (key, h) of the eight big-endian bytes of non-negative keys."""
    out = f"(SELECT key, {_u('key')} AS whole, {_u((0xCAFEBABE + 0x165667B1 + 8) % _WRAP)} AS h FROM {source})"
    for i, lane in enumerate((_swapped(f"whole // {_WRAP}"), _swapped(f"whole % {_WRAP}"))):
        out = f"(SELECT key, whole, (h + {lane} * {_u(0xC2B2AE3D)} % {_WRAP}) % {_WRAP} AS h FROM {out} AS a{i})"
        out = f"(SELECT key, whole, (h * 131072 % {_WRAP} + h // 32768) * {_u(0x27D4EB2F)} % {_WRAP} AS h FROM {out} AS b{i})"
    for i, (bits, factor) in enumerate(((15, 0x85EBCA77), (13, 0xC2B2AE3D), (16, 1))):
        out = f"(SELECT key, whole, {_u(f'xor(h, h // {1 << bits})')} * {_u(factor)} % {_WRAP} AS h FROM {out} AS c{i})"
    return f"(SELECT key, CAST(h AS BIGINT) AS h FROM {out} AS d)"


@register(f"WITH {_KV} SELECT key, h AS checksum FROM {_xxh32_sql('kv')}")
def checksum_xxh32(spark, sf_dir):
    raw = codec.encode_value(F.col("key"), "u64")
    return kv(spark, sf_dir).select("key", hashes.xxh32(raw).alias("checksum"))


@register("SELECT o_orderkey AS key, o_orderkey % 3 = 0 AS valid FROM orders")
def checksum_validate(spark, sf_dir):
    """Of every three records, one has a changed value byte and one a changed end marker."""
    log = kv(spark, sf_dir)
    raw = F.hex(codec.encode_record(F.col("key"), F.col("value"), F.lit(0.0), F.lit(False), "u64", "f64"))
    flipped = lambda at: F.overlay(F.col("raw"), F.when(F.substring("raw", at, 2) == "5A", "A5").otherwise("5A"), at, 2)
    harmed = F.when(F.col("key") % 3 == 1, flipped(2 * 24 + 1)).when(F.col("key") % 3 == 2, flipped(2 * 47 + 1)).otherwise(F.col("raw"))
    records = log.select("key", raw.alias("raw")).select("key", F.unhex(harmed).alias("raw"))
    return records.select("key", codec.decode_record(F.col("raw"), "u64", "f64")["valid"].alias("valid"))


# --- filters ---------------------------------------------------------------------------------------------------------


@register("""SELECT n, CAST(ceil(n * ln(0.2) / ln(1 / pow(2, ln(2)))) AS BIGINT) AS bits,
  CAST(round(ceil(n * ln(0.2) / ln(1 / pow(2, ln(2)))) / n * ln(2)) AS BIGINT) AS hashes
  FROM (VALUES (CAST(10000 AS BIGINT)), (50000), (100000), (1000000)) AS v(n)""")
def bloom_sizing(spark, sf_dir):
    rows = [(n, *bloom.sizing(n, 0.2)) for n in (10_000, 50_000, 100_000, 1_000_000)]
    return spark.createDataFrame(rows, "n long, bits long, hashes long")


_BITS, _K = bloom.sizing(10_000, 0.2)
_M = bloom.modulus(_BITS)


def _positions(token: str, source: str) -> str:
    sql = _int_sql if token == "u32" else _u64_sql
    parts = [f"SELECT key, CAST(h % {_M} AS BIGINT) AS bit FROM {sql(s, source)}" for s in bloom.seeds(_K)]
    return " UNION ALL ".join(parts)


def _half(spark, sf_dir):
    return kv(spark, sf_dir).filter("key % 2 = 0").select("key")


_EVEN = f"{_KV}, even AS (SELECT key FROM kv WHERE key % 2 = 0)"


@register(f"WITH {_KV} SELECT DISTINCT bit FROM ({_positions('u32', 'kv')})")
def bloom_bits(spark, sf_dir):
    return bloom.build(kv(spark, sf_dir).select("key"), "u32", _BITS, _K)


@register(f"WITH {_KV} SELECT DISTINCT bit FROM ({_positions('u64', 'kv')})")
def bloom_bits_u64(spark, sf_dir):
    return bloom.build(kv(spark, sf_dir).select("key"), "u64", _BITS, _K)


_STR = "k AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 18, '0') AS key FROM orders)"


@register(f"WITH {_STR} SELECT DISTINCT bit FROM ("
          + " UNION ALL ".join(f"SELECT key, CAST(h % {_M} AS BIGINT) AS bit FROM {_murmur_sql(s, 'k')}" for s in bloom.seeds(_K)) + ")")
def bloom_bits_str(spark, sf_dir):
    keys = kv(spark, sf_dir).select(F.lpad(F.col("key").cast("string"), 18, "0").alias("key"))
    return bloom.build(keys, "str:18", _BITS, _K)


_CHECK = f"""WITH {_EVEN}, {_PROBES}, bits AS (SELECT DISTINCT bit FROM ({_positions('u32', 'even')})),
p AS ({_positions('u32', '(SELECT DISTINCT key FROM probes)')})
SELECT p.key, bool_and(b.bit IS NOT NULL) AS maybe FROM p LEFT JOIN bits b ON p.bit = b.bit GROUP BY p.key"""


@register(_CHECK)
def bloom_check(spark, sf_dir):
    """Half of the keys are in the filter, so that probes of the others can go either way."""
    filters = bloom.stored(bloom.build(_half(spark, sf_dir), "u32", _BITS, _K), _BITS).withColumn("run_id", F.lit("all"))
    asked = probes(spark, sf_dir)
    hits = bloom.probe(filters, {"all": (_BITS, _K)}, asked, "u32").select("key", F.lit(True).alias("hit"))
    return asked.distinct().join(hits, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("maybe"))


@register(f"SELECT count(*) AS absent, CAST(sum(CAST(maybe AS INT)) AS BIGINT) AS false_positives FROM ({_CHECK}) WHERE key % 2 = 1")
def bloom_fpp(spark, sf_dir):
    found = bloom_check(spark, sf_dir).filter("key % 2 = 1")
    return found.agg(F.count(F.lit(1)).alias("absent"), F.sum(F.col("maybe").cast("long")).alias("false_positives"))


@register(f"WITH {_KV} SELECT DISTINCT bit FROM ({_positions('u32', 'kv')})")
def bloom_merge(spark, sf_dir):
    keys = kv(spark, sf_dir).select("key")
    return bloom.merge([bloom.build(keys.filter(f"key % 2 = {i}"), "u32", _BITS, _K) for i in (0, 1)])


@register(f"WITH {_KV} SELECT DISTINCT bit FROM ({_positions('u32', 'kv')})")
def bloom_pack_roundtrip(spark, sf_dir):
    return bloom.unpacked(bloom.packed(bloom.build(kv(spark, sf_dir).select("key"), "u32", _BITS, _K)))


@register(f"WITH {_KV} SELECT DISTINCT bit FROM ({_positions('u32', 'kv')})")
def bloom_text_roundtrip(spark, sf_dir):
    return bloom.from_text(bloom.to_text(bloom.build(kv(spark, sf_dir).select("key"), "u32", _BITS, _K), _BITS))


@register(f"""WITH {_EV}, {_RUNS}, keys AS (SELECT DISTINCT key FROM runs),
places AS ({_positions('u32', 'keys')}), bits AS (SELECT DISTINCT r.run_id, p.bit FROM runs r JOIN places p ON r.key = p.key),
q AS (SELECT DISTINCT c_custkey AS key FROM customer), qa AS (SELECT DISTINCT key, bit FROM ({_positions('u32', 'q')}) AS x),
need AS (SELECT key, count(*) AS n FROM qa GROUP BY key)
SELECT qa.key, bits.run_id FROM qa JOIN bits ON qa.bit = bits.bit JOIN need ON need.key = qa.key
GROUP BY qa.key, bits.run_id, need.n HAVING count(*) = need.n""")
def bloom_prune_runs(spark, sf_dir):
    filters = bloom.build(ev_runs(spark, sf_dir), "u32", _BITS, _K, by=["run_id"])
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return bloom.lookup_runs(filters, asked, "u32", _BITS, _K)


# --- codec -----------------------------------------------------------------------------------------------------------


@register(f"WITH {_KV} SELECT key, printf('%08X', key) AS raw FROM kv")
def encode_u32(spark, sf_dir):
    return kv(spark, sf_dir).select("key", F.hex(codec.encode_value(F.col("key"), "u32")).alias("raw"))


@register(f"WITH {_KV} SELECT key, key AS back FROM kv")
def decode_u32(spark, sf_dir):
    raw = kv(spark, sf_dir).select("key", codec.encode_value(F.col("key"), "u32").alias("raw"))
    return raw.select("key", codec.decode_value(F.col("raw"), "u32").alias("back"))


@register("""SELECT o_orderkey AS key, '53544152' || '08000000' || '04000000' || '04000000' || printf('%016X', o_orderkey)
  || printf('%08X', o_orderkey % 1000) AS head FROM orders""")
def record_head(spark, sf_dir):
    log = kv(spark, sf_dir)
    raw = codec.encode_record(F.col("key"), F.col("key") % 1000, F.lit(0.0), F.lit(False), "u64", "u32")
    return log.select("key", F.hex(F.substring(raw, 1, 28)).alias("head"))


@register()
def record_hex(spark, sf_dir):
    log = kv(spark, sf_dir)
    raw = codec.encode_record(F.col("key"), F.col("key") % 1000, F.lit(0.0), F.lit(False), "u64", "u32")
    return log.select("key", F.hex(raw).alias("raw"))


@register("SELECT o_orderkey AS key, o_totalprice AS value, 1000.0::DOUBLE AS ts_ms, o_orderkey % 7 = 0 AS deleted FROM orders WHERE o_orderkey % 7 <> 0 "
          "UNION ALL SELECT o_orderkey, NULL, 1000.0::DOUBLE, true FROM orders WHERE o_orderkey % 7 = 0")  # fmt: skip
def record_roundtrip(spark, sf_dir):
    gone = F.col("key") % 7 == 0
    raw = codec.encode_record(F.col("key"), F.col("value"), F.lit(1000.0), gone, "i64", "f64")
    back = codec.decode_record(F.col("raw"), "i64", "f64")
    return kv(spark, sf_dir).select(raw.alias("raw")).select(*[back[c].alias(c) for c in ("key", "value", "ts_ms", "deleted")])


@register("SELECT o_orderkey AS key, o_totalprice AS value, 5.0::DOUBLE AS ts_ms, false AS deleted FROM orders")
def wal_roundtrip(spark, sf_dir):
    raw = codec.encode_log(F.col("key"), F.col("value"), F.lit(5.0), codec.PUT, "i64", "f64")
    back = codec.decode_log(F.col("raw"), "i64", "f64")
    return kv(spark, sf_dir).select(raw.alias("raw")).select(*[back[c].alias(c) for c in ("key", "value", "ts_ms", "deleted")])


@register("""SELECT * FROM (VALUES ('str', 0, 0), ('i8', 1, 1), ('i16', 2, 2), ('i32', 3, 4), ('i64', 4, 8), ('u8', 5, 1),
  ('u16', 6, 2), ('u32', 7, 4), ('u64', 8, 8), ('f32', 9, 4), ('f64', 10, 8), ('bool', 11, 1)) AS v(token, type_id, width)""")
def type_table(spark, sf_dir):
    return spark.createDataFrame([(k.token, k.type_id, k.width) for k in KINDS.values()], "token string, type_id int, width int")


@register("""SELECT token, i, i * ((lo + (hi - lo) / 2) / 2) AS point FROM
  (VALUES ('i8', -128.0::DOUBLE, 127.0::DOUBLE), ('i16', -32768, 32767), ('i32', -2147483648, 2147483647), ('u8', 0, 255),
          ('u16', 0, 65535), ('u32', 0, 4294967295)) AS v(token, lo, hi), (VALUES (0), (1), (2), (3)) AS n(i)""")
def type_range4(spark, sf_dir):
    rows = [(t, i, float(p)) for t in ("i8", "i16", "i32", "u8", "u16", "u32") for i, p in enumerate(quarter_points(t))]
    return spark.createDataFrame(rows, "token string, i int, point double")


# --- binary files and snapshots --------------------------------------------------------------------------------------


def _binary(spark, sf_dir, source: str) -> DataFrame:
    from kvspark.sources import binary
    from kvspark.sources.scratch import scratch_path

    binary.register(spark)
    path = scratch_path(spark, source)
    types = {"key_type": "i64", "value_type": "f64", "path": path}
    log = oplog.fold(ev(spark, sf_dir)) if source == "kv_run" else kv(spark, sf_dir)
    log = log.repartitionByRange("key").sortWithinPartitions("key")
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("double")
    log.select("key", "value", ms.alias("ts_ms"), "deleted").write.format(source).options(**types).mode("append").save()
    return spark.read.format(source).options(**types).load().select("key", "value", "deleted")


@register(f"WITH {_EV}, {_NEW} SELECT key, value, deleted FROM new")
def run_file_roundtrip(spark, sf_dir):
    return _binary(spark, sf_dir, "kv_run")


@register(f"WITH {_KV} SELECT key, value, false AS deleted FROM kv")
def wal_file_roundtrip(spark, sf_dir):
    return _binary(spark, sf_dir, "kv_log")


def _run_files(spark, sf_dir, **options):
    """All orders as run files in key order, and their options."""
    from kvspark.sources import binary
    from kvspark.sources.scratch import scratch_path

    binary.register(spark)
    path = {"key_type": "i64", "value_type": "f64", "path": scratch_path(spark, "run-files")}
    log = kv(spark, sf_dir).repartitionByRange(4, "key").sortWithinPartitions("key")
    rows = log.select("key", "value", F.lit(0.0).alias("ts_ms"), "deleted")
    rows.write.format("kv_run").options(**path).mode("append").save()
    return path


@register(f"WITH {_KV} SELECT key, value FROM kv WHERE key = 4242 % (SELECT count(*) FROM kv)")
def run_file_key(spark, sf_dir):
    """One key through the files' filters and indexes: a page of one file is read."""
    path = _run_files(spark, sf_dir)
    n = kv(spark, sf_dir).count()
    return spark.read.format("kv_run").options(**path, key=4242 % n).load().select("key", "value")


@register(f"WITH {_KV} SELECT key, value FROM kv ORDER BY key DESC LIMIT 1 OFFSET 6")
def run_file_record(spark, sf_dir):
    """One record by its position from the end."""
    return spark.read.format("kv_run").options(**_run_files(spark, sf_dir), record=-7).load().select("key", "value")


@register(f"WITH {_KV} SELECT count(*) AS n, bool_and(there) AS there FROM (SELECT key, true AS there FROM kv)")
def run_file_index(spark, sf_dir):
    """Every key has a page of an index file that begins at or before it: their last first keys, looked up for all keys."""
    path = _run_files(spark, sf_dir)
    index = spark.read.format("kv_index").options(**path).load()
    numbered = index.select("first_key", F.row_number().over(Window.orderBy("first_key")).cast("long").alias("page"))
    found = lookup.page_floor(numbered, kv(spark, sf_dir).select("key"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("page") >= 1).alias("there"))


@register(f"WITH {_KV} SELECT count(*) AS present FROM kv")
def run_file_filter(spark, sf_dir):
    """Keys that the filter files of the run files let through: every one."""
    stored = spark.read.format("kv_bloom").options(**_run_files(spark, sf_dir)).load()
    keys = kv(spark, sf_dir).select("key")
    found = None
    for r in stored.groupBy("file", "bits", "hashes").count().collect():
        own = stored.filter(F.col("file") == r["file"]).select("bit")
        hit = bloom.lookup(own, keys, "i64", r["bits"], r["hashes"]).filter("maybe").select("key")
        found = hit if found is None else found.unionByName(hit)
    return found.distinct().agg(F.count(F.lit(1)).alias("present"))


@register(f"WITH {_KV} SELECT key, value FROM kv")
def snapshot_roundtrip(spark, sf_dir):
    from kvspark.plans.store import ColumnOptions, Database, TableOptions
    from kvspark.sources.scratch import scratch_path

    db = Database(spark, scratch_path(spark, "db"), [TableOptions("main", (ColumnOptions("price", "i64", "f64"),))]).init()
    column = db.table("main").column("price")
    column.insert_frame(kv(spark, sf_dir))
    kept = db.snapshot()
    db.clear("main")
    db.restore(kept)
    return column.state().select("key", "value")


@register("SELECT * FROM (VALUES ('column', 1), ('database', 1), ('run', 3), ('table', 1)) AS v(what, answers)")
def ping(spark, sf_dir):
    """How many parts of a store of three runs answer, each with a time above 0."""
    column = _filled(spark, sf_dir)
    table_ = column.table
    times = [("column", column.ping()), ("table", table_.ping()), ("database", table_.database.ping())]
    times += [("run", ms) for _, ms in column.ping_runs()]
    asked = spark.createDataFrame(times, "what string, ms double")
    return asked.groupBy("what").agg(F.count_if(F.col("ms") > 0).cast("int").alias("answers"))


# --- cache -----------------------------------------------------------------------------------------------------------

_TRACE = f"""{_EV}, c AS (SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM (SELECT * FROM ev WHERE NOT deleted)
  GROUP BY key ORDER BY max(seq) DESC LIMIT 50)"""


def _trace(spark, sf_dir):
    return ev(spark, sf_dir).filter("NOT deleted")


@register(f"WITH {_TRACE} SELECT key, seq, value FROM c")
def lru_contents(spark, sf_dir):
    return cache.recent(_trace(spark, sf_dir), 50)


@register(f"WITH {_TRACE} SELECT key, seq, value FROM c WHERE value > 50 ORDER BY seq DESC LIMIT 1")
def lru_find(spark, sf_dir):
    return cache.find(_trace(spark, sf_dir), 50, "value > 50")


@register(f"WITH {_TRACE} SELECT key, value * 2 AS mapped FROM c")
def lru_map(spark, sf_dir):
    return cache.map_entries(_trace(spark, sf_dir), 50, F.col("value") * 2)


# --- streams ---------------------------------------------------------------------------------------------------------


def _stream_files(spark, sf_dir) -> tuple[str, DataFrame]:
    from kvspark.sources.scratch import scratch_path

    path = scratch_path(spark, "stream-in")
    log = ev(spark, sf_dir)
    log.repartitionByRange(3, "seq").write.parquet(path)
    return path, log


@register(f"WITH {_EV}, {_NEW} SELECT key, value, ts, seq, deleted FROM new")
def stream_fold(spark, sf_dir):
    """The fold kept up by a stream, one file a batch; the last batch's table is the result."""
    from kvspark.sources.scratch import scratch_path
    from kvspark.streaming.flush import fold_stream, log_stream

    path, log = _stream_files(spark, sf_dir)
    out = scratch_path(spark, "stream-out")
    stream = fold_stream(log_stream(spark, path, log.schema, 1))
    keep = lambda batch, i: batch.write.mode("overwrite").parquet(out)
    query = stream.writeStream.outputMode("complete").foreachBatch(keep)
    query.option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(log.schema).parquet(out)


@register(f"WITH {_EV}, {_NEW} SELECT key, value, ts, seq, deleted FROM new")
def stream_flush_compact(spark, sf_dir):
    """A run per micro-batch, compacted when two are there; folding what is left gives the state."""
    from kvspark.sources.scratch import scratch_path
    from kvspark.streaming.flush import Flusher, log_stream

    path, log = _stream_files(spark, sf_dir)
    flusher = Flusher(scratch_path(spark, "runs"), growth=2, last_level=2)
    # The last level would drop tombstones, so the levels end above what three runs reach.
    flusher.last_level = 3
    flusher.start(log_stream(spark, path, log.schema, 1), scratch_path(spark, "flush-state")).awaitTermination()
    return oplog.fold(flusher.runs(spark).select(*log.columns))


# --- extensions ------------------------------------------------------------------------------------------------------


@register(f"WITH {_KV} SELECT key, value FROM kv WHERE key BETWEEN 100 AND 200")
def range_scan(spark, sf_dir):
    return lookup.range_scan(kv(spark, sf_dir), 100, 200).select("key", "value")


@register(f"WITH {_KV} SELECT key, value FROM kv WHERE value > 300000")
def find_many(spark, sf_dir):
    return lookup.find_many(kv(spark, sf_dir), "value > 300000").select("key", "value")


@register(f"WITH {_KV} SELECT key, value FROM kv WHERE value > 300000 ORDER BY key LIMIT 1")
def find_one(spark, sf_dir):
    return lookup.find_one(kv(spark, sf_dir), "value > 300000").select("key", "value")
