"""Databases, binary files and streams."""

import os
import threading
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvspark.operators import bloom
from kvspark.operators.oplog import fold
from kvspark.plans import catalog
from kvspark.plans.store import ColumnOptions, Database, Mutex, StoreError, TableOptions, merge_options
from kvspark.sources import binary
from kvspark.streaming.flush import Flusher, activity, log_stream

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def db(spark, tmp_path):
    tables = [
        TableOptions("main", (ColumnOptions("money"), ColumnOptions("big", "u64", "f64"), ColumnOptions("name", "str:8", "str:4"))),
        TableOptions("other", (ColumnOptions("x"),)),
    ]
    return Database(spark, f"file://{tmp_path}/db", tables).init()


def test_writes_reads_and_deletes(db):
    db.insert("main", "money", 1, 100)
    assert db.get("main", "money", 1).value == 100 and db.has("main", "money", 1) and not db.has("main", "money", 2)
    db.insert("main", "money", 1, 200)
    assert db.get("main", "money", 1).value == 200
    assert db.may_have("main", "money", 1) and not db.has("main", "big", 1)
    assert db.delete("main", "money", 1) and not db.delete("main", "money", 77)
    assert db.get("main", "money", 1) is None and not db.has("main", "money", 1)
    assert db.table("main").column("money").get_versioned(1).deleted
    db.insert("main", "money", 1, 300)
    assert db.get("main", "money", 1).value == 300
    column = db.table("main").column("money")
    column.insert_many([(5, 1), (6, 2), (5, 3)])
    column.compact()
    assert sorted((r.key, r.value) for r in column.state().collect()) == [(1, 300), (5, 3), (6, 2)]
    assert column.log().count() == 3


def test_types_and_guards(db):
    db.insert("main", "big", 2**64 - 1, 0.5)
    assert int(db.get("main", "big", 2**64 - 1).key) == 2**64 - 1
    db.insert("main", "name", "ключ", "wert")
    assert db.get("main", "name", "ключ").value == "wert"
    for table, column, key, value in (("main", "money", -1, 0), ("main", "money", 1, 2**32), ("main", "name", "x" * 9, "")):
        with pytest.raises(StoreError):
            db.insert(table, column, key, value)
    for table, column in (("nothing", "money"), ("main", "nothing")):
        with pytest.raises(StoreError):
            db.get(table, column, 1)
    assert db.table("main").has_column("money") and not db.table("main").has_column("x") and db.size == 2
    with pytest.raises(StoreError):
        Database(db.spark, db.path, [TableOptions("t", (ColumnOptions("c", "f64"),))])
    db.close()
    with pytest.raises(StoreError):
        db.get("main", "money", 1)
    assert merge_options(ColumnOptions("a"), cache=5).cache == 5 and ColumnOptions("a").cache == 10_000


def test_clear_snapshot_restore_and_reopen(db, spark):
    db.insert("main", "money", 1, 1)
    db.insert("other", "x", 2, 2)
    kept = db.snapshot()
    db.insert("main", "money", 1, 9)
    db.clear("main", "money")
    assert db.get("main", "money", 1) is None and db.get("other", "x", 2).value == 2
    db.clear("other")
    db.restore(kept)
    again = Database(spark, db.path, [t.options for t in db.tables.values()]).init()
    assert again.get("main", "money", 1).value == 1 and again.get("other", "x", 2).value == 2
    stats = {(r.table, r.column): r for r in again.stats().collect()}
    assert stats["main", "money"].live == 1 and stats["main", "big"].keys == 0 and again.ping() > 0


def column_of(spark, tmp_path, **options):
    made = ColumnOptions("c", "i64", "f64", **options)
    return Database(spark, f"file://{tmp_path}/db", [TableOptions("t", (made,))]).init().table("t").column("c")


def frame(spark, a, b, plus=0.0):
    return spark.range(a, b).select(F.col("id").alias("key"), (F.col("id") + plus).alias("value"))


def test_flushes_levels_and_filters(spark, tmp_path):
    column = column_of(spark, tmp_path, memtable=100, growth=2, levels=2)
    column.insert_frame(frame(spark, 0, 60))
    assert column.manifest()["runs"] == [] and column.memtable().count() == 60 and column.read_logs().first().key == 0
    column.insert_frame(frame(spark, 50, 120, 0.5))
    assert [(r["level"], r["n"]) for r in column.manifest()["runs"]] == [(0, 120)] and column.manifest()["segments"] == []
    assert column.get(55).value == 55.5 and column.get(10).value == 10.0 and column.get(500) is None
    assert column.delete(10) and column.get(10) is None and column.get_versioned(10).deleted and not column.has(10)
    column.insert_frame(frame(spark, 200, 300))
    # The second run at level 0 is merged with the first at level 1, where one run is not due.
    assert [(r.level, r.records) for r in column.runs().collect()] == [(1, 220)]
    column.insert_frame(frame(spark, 300, 400)), column.insert_frame(frame(spark, 400, 500))
    # Two runs at level 0 again, hence two at the last level, which are merged in place without tombstones.
    assert [(r.level, r.records) for r in column.runs().collect()] == [(1, 419)]
    assert column.state().count() == 419 and column.get_versioned(10) is None
    told = {r.key: r.maybe for r in column.may_have_many(frame(spark, 0, 2000)).collect()}
    live = {r.key for r in column.state().collect()}
    assert all(told[k] for k in live) and sum(told.values()) < 419 + 0.3 * 1600
    assert column.may_have(55) and sum(column.may_have(k) for k in (1000, 1001, 1002, 1003, 1004, 1005)) < 6
    assert len(column.ping_runs()) == 1 and column.ping() > 0
    before = len(os.listdir(f"{tmp_path}/db/t/c"))
    assert column.vacuum(0) > 5 and len(os.listdir(f"{tmp_path}/db/t/c")) < before and column.state().count() == 419


def test_an_append_during_a_compaction_stays(spark, tmp_path):
    column = column_of(spark, tmp_path)
    column.insert_frame(frame(spark, 0, 10))
    held, run = column._run, column._run

    def slow(records, level, **options):
        made = held(records, level, **options)
        column._append(frame(spark, 100, 105).selectExpr("key", "value", "current_timestamp() ts", "1L seq", "false deleted"))
        return made

    column._run = slow
    assert column.compact()
    column._run = run
    assert column.state().count() == 15 and len(column.manifest()["segments"]) == 1
    # What a clear took away meanwhile doesn't come back.
    column._run = lambda records, level, **options: (held(records, level, **options), column.clear())[0]
    assert not column.compact() and not column.flush() and column.state().count() == 0


def test_locks(spark, tmp_path):
    column = column_of(spark, tmp_path)
    mutex, other = column.mutex, Mutex(column.files, lambda: f"{column.path}/LOCK", timeout=0.2, stale=60)
    with mutex.held():
        assert mutex.is_locked and other.is_locked
        with pytest.raises(StoreError):
            other.lock()
    assert not mutex.is_locked
    # A lock that a dead process left is taken over.
    open(f"{tmp_path}/db/t/c/LOCK", "w").close()
    os.utime(f"{tmp_path}/db/t/c/LOCK", (1, 1))
    with mutex.held():
        pass
    threads = [threading.Thread(target=column.insert, args=(i, 1.0)) for i in range(6)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert column.state().count() == 6 and len(column.manifest()["segments"]) == 6


def test_cache_follows_writes_of_others(spark, tmp_path):
    column, other = column_of(spark, tmp_path), column_of(spark, tmp_path)
    column.insert(1, 1.0)
    assert column.get(1).value == 1.0 and column.cache.has(1)
    other.insert(1, 2.0)
    assert column.get(1).value == 2.0
    column.insert(1, 3.0)
    assert column.get(1).value == 3.0 and other.get(1).value == 3.0
    column.insert_frame(spark.createDataFrame([(1, 4.0), (1, 5.0)], "key long, value double").coalesce(1))
    assert column.get(1).value == 5.0
    column.truncate_log()
    assert column.get(1) is None
    column.set_path(f"file://{tmp_path}/elsewhere")
    assert column.init().state().count() == 0 and column.path.endswith("elsewhere")


@pytest.mark.parametrize("key_type", ["i64", "u32", "str:8"])
def test_keys_and_records_of_run_files(spark, tmp_path, key_type):
    binary.register(spark)
    key = "concat('k,', lpad(id, 6, '0'))" if key_type.startswith("str") else "id"
    rows = spark.range(0, 9000, 2).selectExpr(f"{key} AS key", "id AS value", "0D AS ts_ms", "false AS deleted")
    options = {"path": f"{tmp_path}/r", "key_type": key_type, "value_type": "u32"}
    rows.repartitionByRange(2, "key").sortWithinPartitions("key").write.format("kv_run").options(**options).mode("append").save()
    spell = (lambda i: f"k,{i:06d}") if key_type.startswith("str") else str
    load = lambda **more: spark.read.format("kv_run").options(**options, **more).load()
    for i in (0, 1998, 2000, 2002, 4498, 8998):
        assert [r.value for r in load(key=spell(i)).collect()] == [i]
    assert load(key=spell(2001)).collect() == [] and load(key=spell(9999)).collect() == []
    assert [load(record=n).first().value for n in (0, 7, -1)] == [0, 14, 8998] and load(record=4500).collect() == []
    reader = binary.RunReader({**options, "key": spell(2000)})
    assert sum(p.count for p in reader.partitions()) <= 2 * binary.PAGE
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert [r.value for r in load(pushdown=True).filter(F.col("key") == (spell(2000) if key_type.startswith("str") else 2000)).collect()] == [2000]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    index = spark.read.format("kv_index").options(**options).load().orderBy("first_key").collect()
    size = binary.record_type(key_type, "u32").itemsize
    assert all(r.offset == 13 + 1000 * r.page * size for r in index) and len(index) >= 5 and index[0].first_key in (0, spell(0))
    stats = binary.file_stats(options["path"], key_type, "u32")
    assert sum(s["records"] for s in stats) == 4500 and all(s["filter_bits"] and s["pages"] for s in stats)
    held = spark.read.format("kv_bloom").options(**options).load()
    assert held.select("file").distinct().count() == 2
    log = {**options, "path": f"{tmp_path}/w"}
    rows.write.format("kv_log").options(**log).mode("append").save()
    binary.truncate_log(log["path"])
    assert spark.read.format("kv_log").options(**log).load().count() == 0


@pytest.mark.parametrize("n", [1, 1500, 300_000])
def test_filter_files_are_written_and_read_in_pieces(spark, tmp_path, n):
    """What is held at once doesn't grow with the file; the bits are those of a filter built by expressions."""
    binary.register(spark)
    options = {"path": f"{tmp_path}/r", "key_type": "i64", "value_type": "u32"}
    rows = spark.range(n).selectExpr("id * 7 AS key", "id AS value", "0D AS ts_ms", "false AS deleted")
    rows.coalesce(1).sortWithinPartitions("key").write.format("kv_run").options(**options).mode("append").save()
    reader = binary._SiblingReader(options, ".bloom")
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert max(b.num_rows for b in batches) < 100_000
    bits, k = batches[0].column("bits")[0].as_py(), batches[0].column("hashes")[0].as_py()
    assert (bits, k) == bloom.sizing(n, binary.ERROR_RATE)
    want = sorted(r.bit for r in bloom.build(rows.select("key"), "i64", bits, k).collect())
    assert [x for b in batches for x in b.column("bit").to_pylist()] == want
    assert binary.file_stats(options["path"], "i64", "u32")[0]["filter_bits"] == bits
    index = [r.asDict() for r in spark.read.format("kv_index").options(**options).load().orderBy("page").collect()]
    assert [(r["page"], r["first_key"]) for r in index] == [(i, 7000 * i) for i in range(-(-n // 1000))]
    assert [r.value for r in spark.read.format("kv_run").options(**options, key=7 * (n - 1)).load().collect()] == [n - 1]
    keys = np.arange(n) * 7
    blocks = (keys[i : i + binary.BLOCK] for i in range(0, n, binary.BLOCK))
    tracemalloc.start()
    pieces = sum(len(x) > 0 for x in binary.filter_text(n, blocks, "i64"))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pieces > n // 100_000 and most < 8e6


TYPES = [("i64", "f64"), ("u32", "u32"), ("u64", "i8"), ("str:6", "str:3"), ("u16", "f32"), ("i32", "bool")]


@pytest.mark.parametrize("key_type,value_type", TYPES)
def test_binary_files_round_trip(spark, tmp_path, key_type, value_type):
    binary.register(spark)
    from kvspark.functions.types import kind

    k, v = kind(key_type).spark, kind(value_type).spark
    value = {"str:3": "concat('v', id % 9)", "bool": "id % 2 = 0"}.get(value_type, "id % 100")
    key = "concat('k', id)" if key_type.startswith("str") else "id"
    rows = spark.range(500).select(
        F.expr(key).cast(k).alias("key"), F.expr(f"IF(id % 5 = 0, NULL, {value})").cast(v).alias("value"),
        F.col("id").cast("double").alias("ts_ms"), (F.col("id") % 5 == 0).alias("deleted"),
    )
    for source in ("kv_run", "kv_log"):
        options = {"path": f"{tmp_path}/{source}", "key_type": key_type, "value_type": value_type}
        rows.repartition(3).write.format(source).options(**options).mode("append").save()
        back = spark.read.format(source).options(**options).load().select(*rows.columns)
        assert back.schema.simpleString() == rows.schema.simpleString()
        assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_damaged_and_wrong_files_are_refused(spark, tmp_path):
    binary.register(spark)
    options = {"path": f"{tmp_path}/r", "key_type": "u32", "value_type": "u32"}
    rows = spark.range(10).selectExpr("id AS key", "id AS value", "0D AS ts_ms", "false AS deleted").coalesce(1)
    rows.write.format("kv_run").options(**options).mode("append").save()
    name = next(f for f in os.listdir(options["path"]) if f.endswith(".sst"))
    data = bytearray(open(f"{options['path']}/{name}", "rb").read())
    assert len(data) == 13 + 10 * 41
    with pytest.raises(Exception, match="key type is u32"):
        spark.read.format("kv_run").options(**options | {"key_type": "i32"}).load().collect()
    data[13 + 17] ^= 1
    open(f"{options['path']}/{name}", "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        spark.read.format("kv_run").options(**options).load().collect()
    assert spark.read.format("kv_run").options(**options, verify="false").load().count() == 10
    with pytest.raises(binary.FormatError):
        binary.header("str:200", "str:50")
    with pytest.raises(binary.FormatError):
        binary.check_header(b"nothing at all", "u32", "u32")


def test_flusher_restarts_without_repeating(spark, tmp_path):
    log = catalog.ev(spark, DATA)
    log.repartitionByRange(4, "seq").write.parquet(f"{tmp_path}/in")
    flusher = Flusher(f"file://{tmp_path}/runs", growth=2, last_level=4)
    stream = lambda: log_stream(spark, f"{tmp_path}/in", log.schema, 1)
    for _ in range(2):
        flusher.start(stream(), f"{tmp_path}/state").awaitTermination()
    want = sorted(map(str, fold(log).collect()))
    assert sorted(map(str, fold(flusher.runs(spark).select(*log.columns)).collect())) == want
    assert flusher.runs(spark).select("level").distinct().count() <= 2


def test_windows_of_activity(spark, tmp_path):
    log = catalog.ev(spark, DATA)
    log.write.parquet(f"{tmp_path}/in")
    query = activity(log_stream(spark, f"{tmp_path}/in", log.schema)).writeStream.format("memory").queryName("activity")
    query.outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("activity").agg(F.sum("writes")).first()[0] == log.count()
