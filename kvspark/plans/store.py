"""Database, tables and columns over operation logs in a shared folder.

A column is a set of immutable Parquet folders named by a manifest, a small file
that is swapped atomically:

* segments, the write-ahead log: one per append, and together the memtable;
* runs, at levels: what a flush or a compaction wrote, sorted by key, one version
  per key, each with a stored filter of its keys.

An append adds a segment. Once the segments hold ``memtable`` records (an upper bound
of their distinct keys) they are flushed to a run at level 0; a level of ``growth`` runs is
merged to one run at the next level, and the last level drops tombstones. Whatever
changes the manifest does so under the column's lock, from the manifest of that moment:
an append during a compaction stays, and a compaction whose inputs have gone gives
up. Folders that the manifest no longer names stay for readers until ``vacuum``.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvspark.functions.types import kind
from kvspark.operators import bloom, lookup, oplog
from kvspark.operators.cache import Lru
from kvspark.operators.runs import HEADER, log_stats, record_bytes


class StoreError(Exception):
    """An operation that can't be done, with where it was tried."""

    def __init__(self, where: str, message: str) -> None:
        super().__init__(f"[{where}]: {message}")


#: Segments after which a flush is due however few records they hold.
MOST_SEGMENTS = 64


@dataclass(frozen=True)
class ColumnOptions:
    """``memtable``: records that are flushed together; ``cache``: keys kept in the driver after reads and single writes;
    ``levels`` and ``growth``: see above; ``run_records`` times ``growth`` is the most a file of a merged run holds."""

    name: str
    key_type: str = "u32"
    value_type: str = "u32"
    memtable: int = 100_000
    cache: int = 10_000
    levels: int = 4
    growth: int = 10
    run_records: int = 100_000
    page_records: int = 1_000
    error_rate: float = 0.2
    custom_hash: str | None = None


@dataclass(frozen=True)
class TableOptions:
    name: str
    columns: tuple[ColumnOptions, ...] = field(default_factory=tuple)


def merge_options(defaults, **given):
    """``defaults`` with what is given replaced."""
    return replace(defaults, **given)


class _Files:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        where, fs = self._at(path)
        return fs.exists(where)

    def text(self, path: str) -> str:
        where, fs = self._at(path)
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """Write beside and rename over, so that readers see the old or the new text."""
        new, fs = self._at(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(new)
        stream.write(text.encode())
        stream.close()
        where, _ = self._at(path)
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()) if where.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, where, options)

    def remove(self, path: str) -> None:
        where, fs = self._at(path)
        fs.delete(where, True)

    def create(self, path: str) -> bool:
        """Make an empty file; False where it is already there."""
        where, fs = self._at(path)
        fs.mkdirs(where.getParent())
        try:
            fs.create(where, False).close()
        except Exception as e:  # the file system's own error, as the JVM raises it
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def folders(self, path: str) -> list[tuple[str, float]]:
        """(name, seconds since it was last changed) of what is in a folder."""
        where, fs = self._at(path)
        now = time.time()
        return [(x.getPath().getName(), now - x.getModificationTime() / 1000) for x in fs.listStatus(where)] if fs.exists(where) else []

    def age(self, path: str) -> float | None:
        """Seconds since a file was last changed; None without it."""
        where, fs = self._at(path)
        try:
            return time.time() - fs.getFileStatus(where).getModificationTime() / 1000
        except Exception as e:
            if "FileNotFound" in str(e):
                return None
            raise


class Mutex:
    """A lock between threads and, by a file in a shared folder, between processes.

    It is held for the swap of a manifest only. A file older than ``stale`` seconds was left by a process that died.
    """

    def __init__(self, files: _Files, path: Callable[[], str], timeout: float = 120, stale: float = 60) -> None:
        self.files, self.path, self.timeout, self.stale = files, path, timeout, stale
        self._threads = threading.Lock()

    @property
    def is_locked(self) -> bool:
        return self._threads.locked() or self.files.exists(self.path())

    def lock(self) -> None:
        until = time.monotonic() + self.timeout
        if not self._threads.acquire(timeout=self.timeout):
            raise StoreError("Mutex#lock", f"{self.path()} is held by another thread")
        while not self.files.create(self.path()):
            age = self.files.age(self.path())
            if age is not None and age > self.stale:
                self.files.remove(self.path())
            elif time.monotonic() > until:
                self._threads.release()
                raise StoreError("Mutex#lock", f"{self.path()} is held by another process")
            else:
                time.sleep(0.02)

    def unlock(self) -> None:
        self.files.remove(self.path())
        self._threads.release()

    @contextmanager
    def held(self) -> Iterator[None]:
        self.lock()
        try:
            yield
        finally:
            self.unlock()


class Column:
    """One versioned map from key to value."""

    def __init__(self, options: ColumnOptions, table: Table) -> None:
        if not kind(options.key_type).is_key:
            raise StoreError("Column", f"{options.key_type} can't be a key type")
        self.options, self.table = options, table
        self.mutex = Mutex(table.database.files, lambda: f"{self.path}/LOCK")
        self.cache = Lru(options.cache)
        self._seen = self._path = None
        self._seq = 0

    @property
    def spark(self) -> SparkSession:
        return self.table.database.spark

    @property
    def files(self) -> _Files:
        return self.table.database.files

    @property
    def path(self) -> str:
        return self._path or f"{self.table.path}/{self.options.name}"

    def set_path(self, path: str) -> None:
        """Move on to another folder; ``init`` opens it."""
        self._path = path.rstrip("/")
        self.cache.clear()

    @property
    def schema(self) -> T.StructType:
        key, value = kind(self.options.key_type).spark, kind(self.options.value_type).spark
        return T.StructType(
            [T.StructField("key", key), T.StructField("value", value), T.StructField("ts", T.TimestampType()),
             T.StructField("seq", T.LongType()), T.StructField("deleted", T.BooleanType())]
        )

    def init(self) -> Column:
        if not self.files.exists(f"{self.path}/CURRENT"):
            with self.mutex.held():
                if not self.files.exists(f"{self.path}/CURRENT"):
                    self.files.put(f"{self.path}/CURRENT", json.dumps({"version": 0, "segments": [], "runs": []}))
        self._seq = time.time_ns()
        self._seen = None
        return self

    def close(self) -> None:
        """Segments are durable when a write returns, so there is nothing to flush; the cache goes."""
        self.cache.clear()

    # --- manifest ---

    def manifest(self) -> dict:
        """{version, segments: [{path, n}], runs: [{path, level, n, bits, hashes}]}"""
        return json.loads(self.files.text(f"{self.path}/CURRENT"))

    @property
    def version(self) -> int:
        return self.manifest()["version"]

    def _commit(self, change: Callable[[dict], None]) -> dict:
        """Apply ``change`` to the manifest of this moment; what it raises leaves all as it was."""
        with self.mutex.held():
            now = self.manifest()
            change(now)
            now["version"] += 1
            self.files.put(f"{self.path}/CURRENT", json.dumps(now))
        return now

    def _read(self, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p['path']}" for p in parts])

    def _written(self, records: DataFrame, name: str, **options) -> dict:
        """``records`` as a folder of the column; {path, n, seq}."""
        seen = Observation()
        counted = records.select(*self.schema.fieldNames()).observe(seen, F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq"))
        path = f"{name}-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        counted.write.options(**bloom.parquet_options("key", self.options.run_records), **options).parquet(f"{self.path}/{path}")
        return {"path": path, **seen.get}

    def _run(self, records: DataFrame, level: int, **options) -> dict:
        """``records`` (one version per key) as a run with its stored filter."""
        run = self._written(records.repartitionByRange("key").sortWithinPartitions("key"), "run", **options)
        bits, hashes = bloom.sizing(max(1, run["n"]), self.options.error_rate)
        hashes = max(hashes, 1)
        keys = self._read([run]).select("key")
        filters = bloom.stored(bloom.build(keys, self.options.key_type, bits, hashes, custom=self.options.custom_hash), bits)
        filters.withColumn("run_id", F.lit(run["path"])).write.parquet(f"{self.path}/{run['path']}.filter")
        return {"path": run["path"], "n": run["n"], "level": level, "bits": bits, "hashes": hashes}

    def _replace(self, segments: list[dict], runs: list[dict], new: Callable[[], list[dict]]) -> bool:
        """Put runs in the place of segments and runs; False, and nothing changed, if one of them has gone meanwhile."""
        made = new()
        gone = {p["path"] for p in (*segments, *runs)}

        def change(m: dict) -> None:
            if not gone <= {p["path"] for p in (*m["segments"], *m["runs"])}:
                raise _Conflict
            m["segments"] = [p for p in m["segments"] if p["path"] not in gone]
            m["runs"] = [p for p in m["runs"] if p["path"] not in gone] + [r for r in made if r["n"]]

        try:
            self._commit(change)
        except _Conflict:
            return False
        return True

    # --- segments, memtable, runs ---

    def log(self) -> DataFrame:
        """All records of the column."""
        m = self.manifest()
        return self._read(m["segments"] + m["runs"])

    def read_logs(self) -> DataFrame:
        """Records that aren't flushed yet, in the order of their writing."""
        return self._read(self.manifest()["segments"]).orderBy("ts", "seq")

    def memtable(self) -> DataFrame:
        """What replaying the segments gives: the newest version of every key that isn't flushed yet."""
        return oplog.fold(self._read(self.manifest()["segments"]))

    def state(self) -> DataFrame:
        return oplog.live(self.log())

    def runs(self) -> DataFrame:
        """(level, run_id, records, bits, hashes, file_size, pages) of every run; there are a bounded number."""
        size, per_page = record_bytes(self.options.key_type, self.options.value_type), self.options.page_records
        rows = [
            (r["level"], r["path"], r["n"], r["bits"], r["hashes"], HEADER + r["n"] * size, -(-r["n"] // per_page))
            for r in self.manifest()["runs"]
        ]
        return self.spark.createDataFrame(
            rows, "level int, run_id string, records long, bits long, hashes int, file_size long, pages long"
        )

    def _append(self, records: DataFrame) -> int:
        """A new segment; its number of records."""
        own = self._written(records, "log")
        self._seq = max(self._seq, own["seq"] or 0)
        if own["n"]:
            m = self._commit(lambda m: m["segments"].append({"path": own["path"], "n": own["n"]}))
            if self._seen == m["version"] - 1:
                self._seen = m["version"]
            if sum(p["n"] for p in m["segments"]) >= self.options.memtable or len(m["segments"]) >= MOST_SEGMENTS:
                self.flush()
        return own["n"]

    def flush(self) -> bool:
        """The segments of this moment as a run at level 0, then compaction where due; False if there was nothing to do."""
        segments = self.manifest()["segments"]
        done = bool(segments) and self._replace(segments, [], lambda: [self._run(oplog.fold(self._read(segments)), 0)])
        if done:
            self.compact_due()
        return done

    def truncate_log(self) -> None:
        """Forget what isn't flushed yet."""

        def change(m: dict) -> None:
            m["segments"] = []

        self._commit(change)
        self.cache.clear()

    def due_levels(self) -> list[int]:
        """Levels that hold ``growth`` runs or more, the last level included."""
        levels = [r["level"] for r in self.manifest()["runs"]]
        return sorted(k for k in set(levels) if levels.count(k) >= self.options.growth)

    def compact_due(self) -> None:
        """Merge levels that are due, from the first one on."""
        while due := self.due_levels():
            if not self.compact_level(due[0]):
                return

    def compact_level(self, level: int) -> bool:
        """All runs of a level as one at the next; the last level in place, without tombstones."""
        own = [r for r in self.manifest()["runs"] if r["level"] == level]
        last = level >= self.options.levels - 1

        def merged() -> list[dict]:
            newest = oplog.fold(self._read(own))
            most = self.options.run_records * self.options.growth
            return [self._run(newest.filter("NOT deleted") if last else newest, level if last else level + 1, maxRecordsPerFile=most)]

        return bool(own) and self._replace([], own, merged)

    def compact(self) -> bool:
        """Everything as one run of live keys at the last level; False if something of it has gone meanwhile."""
        m = self.manifest()
        everything = m["segments"] + m["runs"]
        merged = lambda: [self._run(oplog.live(self._read(everything)), self.options.levels - 1)]
        return self._replace(m["segments"], m["runs"], merged)

    def vacuum(self, older_than: float = 3600) -> int:
        """Remove folders that the manifest doesn't name, unchanged for ``older_than`` seconds; how many."""
        m = self.manifest()
        named = {p["path"] for p in m["segments"] + m["runs"]} | {r["path"] + ".filter" for r in m["runs"]}
        old = [n for n, age in self.files.folders(self.path) if n.startswith(("log-", "run-")) and n not in named and age >= older_than]
        for name in old:
            self.files.remove(f"{self.path}/{name}")
        return len(old)

    # --- writes ---

    def _next(self, n: int) -> int:
        """First of ``n`` sequence numbers, above all that this process gave before."""
        first = max(self._seq + 1, time.time_ns())
        self._seq = first + n
        return first

    def _checked(self, rows: Iterable[tuple]) -> list[tuple]:
        out = []
        for key, value in rows:
            for x, token in ((key, self.options.key_type), (value, self.options.value_type)):
                k = kind(token)
                if token.startswith("str:"):
                    if len(x.encode()) > k.width:
                        raise StoreError("Column#insert", f"{x!r} is longer than {token}")
                elif token != "bool" and not k.low <= x <= k.high:
                    raise StoreError("Column#insert", f"{x} is out of range for {token}")
            out.append((key, value))
        return out

    def insert(self, key, value) -> None:
        self.insert_many([(key, value)])

    def insert_many(self, rows: Iterable[tuple]) -> None:
        """Put (key, value) pairs, later ones winning."""
        rows = self._checked(rows)
        first = self._next(len(rows))
        now = time.time()
        data = [self._typed((k, v, None, first + i, False)) for i, (k, v) in enumerate(rows)]
        self._forget_others()
        df = self.spark.createDataFrame(data, self.schema)
        self._append(df.withColumn("ts", F.timestamp_micros(F.lit(int(now * 1e6)))))
        for key, _ in rows:
            self.cache.delete(key)

    def _typed(self, r: tuple) -> tuple:
        from decimal import Decimal

        cast = lambda x, token: Decimal(x) if token == "u64" and x is not None else x
        return (cast(r[0], self.options.key_type), cast(r[1], self.options.value_type), *r[2:])

    def insert_frame(self, frame: DataFrame) -> None:
        """Put the rows (key, value) of a DataFrame in one distributed append; of rows that repeat a key, the last one wins."""
        first = self._next(1)
        self._append(
            frame.select(
                F.col("key").cast(self.schema["key"].dataType), F.col("value").cast(self.schema["value"].dataType),
                F.current_timestamp().alias("ts"), (F.lit(first) + F.monotonically_increasing_id()).alias("seq"),
                F.lit(False).alias("deleted"),
            )
        )
        self.cache.clear()

    def delete(self, key) -> bool:
        """Write a tombstone; False and nothing written where no key was ever put."""
        done = self.delete_keys(self._probe(key))
        self.cache.delete(key)
        return done

    def delete_keys(self, probes: DataFrame) -> bool:
        """Tombstones for the keys that were put: filters leave out most that were not, and runs that can't hold any."""
        m = self.manifest()
        maybe = self._maybe(m, probes)
        held = [r["run_id"] for r in maybe.select("run_id").distinct().collect()] if m["runs"] else []
        log = self._read(m["segments"] + [r for r in m["runs"] if r["path"] in held])
        gone = oplog.delete_keys(log, probes, F.current_timestamp(), F.lit(self._next(1)))
        n = self._append(gone)
        self.cache.clear()
        return n > 0

    def clear(self) -> None:
        def change(m: dict) -> None:
            m["segments"], m["runs"] = [], []

        self._commit(change)
        self.cache.clear()

    def restore(self, records: DataFrame) -> None:
        """Make ``records`` all that the column has."""
        run = self._run(oplog.fold(records), self.options.levels - 1)

        def change(m: dict) -> None:
            m["segments"], m["runs"] = [], [run] if run["n"] else []

        self._commit(change)
        self.cache.clear()

    # --- reads ---

    def _probe(self, key) -> DataFrame:
        return self.spark.createDataFrame([(self._typed((key, None))[0],)], T.StructType([self.schema["key"]]))

    def _literal(self, key):
        return F.lit(self._typed((key, None))[0]).cast(self.schema["key"].dataType)

    def _forget_others(self) -> dict:
        """The manifest; the cache goes where another process has changed it."""
        m = self.manifest()
        if m["version"] != self._seen:
            self.cache.clear()
            self._seen = m["version"]
        return m

    def _maybe(self, m: dict, probes: DataFrame) -> DataFrame:
        """(key, run_id) of the runs whose stored filter may hold a probe."""
        sizes = {r["path"]: (r["bits"], r["hashes"]) for r in m["runs"]}
        filters = self.spark.createDataFrame([], "block long, words array<bigint>, run_id string")
        if sizes:
            filters = self.spark.read.schema(filters.schema).parquet(*[f"{self.path}/{run}.filter" for run in sizes])
        return bloom.probe(filters, sizes, probes, self.options.key_type, self.options.custom_hash)

    def get(self, key) -> Row | None:
        """The newest live version: from the cache, else from the segments and the runs whose filters may hold the key."""
        m = self._forget_others()
        if (found := self.cache.get(key)) is not None:
            return found
        newest = self._newest(m, key)
        if newest is None or newest["deleted"]:
            return None
        self.cache.set(key, newest)
        return newest

    def _newest(self, m: dict, key) -> Row | None:
        held = {r["run_id"] for r in self._maybe(m, self._probe(key)).collect()} if m["runs"] else set()
        parts = m["segments"] + [r for r in m["runs"] if r["path"] in held]
        # The key reaches the scan before the fold.
        return oplog.fold(self._read(parts).filter(F.col("key") == self._literal(key))).first() if parts else None

    def get_versioned(self, key) -> Row | None:
        """The newest version, tombstone or not."""
        return self._newest(self.manifest(), key)

    def has(self, key) -> bool:
        return self.get(key) is not None

    def multi_get(self, probes: DataFrame) -> DataFrame:
        return lookup.multi_get(self.state(), probes)

    def has_many(self, probes: DataFrame) -> DataFrame:
        """The probes (key) that are live."""
        return lookup.has(self.state(), probes)

    def may_have(self, key) -> bool:
        """Probabilistic membership over the keys of the segments and runs: no false negatives."""
        m = self._forget_others()
        if self.cache.has(key):
            return True
        if not self._read(m["segments"]).filter(F.col("key") == self._literal(key)).isEmpty():
            return True
        return bool(m["runs"]) and not self._maybe(m, self._probe(key)).isEmpty()

    def may_have_many(self, probes: DataFrame) -> DataFrame:
        """(key, maybe) of every distinct probe, by the segments' keys and the stored filters."""
        m = self.manifest()
        asked = probes.select("key").distinct()
        hits = self._maybe(m, probes).select("key")
        if m["segments"]:
            hits = hits.unionByName(asked.join(self._read(m["segments"]).select("key"), "key", "left_semi"))
        return asked.join(hits.distinct().withColumn("maybe", F.lit(True)), "key", "left").select("key", F.coalesce("maybe", F.lit(False)).alias("maybe"))

    def stats(self) -> DataFrame:
        m = self.manifest()
        key, value = self.options.key_type, self.options.value_type
        n = F.count(F.lit(1))
        state = oplog.fold(self._read(m["segments"] + m["runs"])).agg(n.alias("keys"), F.count(F.when(~F.col("deleted"), 1)).alias("live"))
        wal = log_stats(self._read(m["segments"]), key, value).withColumnsRenamed({"file_size": "log_bytes"})
        both = state.withColumn("one", F.lit(1)).join(wal.withColumn("one", F.lit(1)), "one").drop("one")
        runs = m["runs"]
        known = {
            "runs": len(runs), "levels": len({r["level"] for r in runs}), "run_records": sum(r["n"] for r in runs),
            "run_bytes": sum(HEADER + r["n"] * record_bytes(key, value) for r in runs), "filter_bits": sum(r["bits"] for r in runs),
        }
        return both.select(
            F.lit(self.table.name).alias("table"), F.lit(self.options.name).alias("column"), "*",
            *[F.lit(v).cast("long").alias(k) for k, v in known.items()],
        )

    def ping_runs(self) -> list[tuple[str, float]]:
        """(run, milliseconds for reading one record of it) of every run."""
        out = []
        for run in self.manifest()["runs"]:
            began = time.perf_counter()
            self._read([run]).limit(1).collect()
            out.append((run["path"], (time.perf_counter() - began) * 1000))
        return out

    def ping(self) -> float:
        """Mean milliseconds for reading one record of a run; of the segments where there is no run."""
        if pings := [ms for _, ms in self.ping_runs()]:
            return sum(pings) / len(pings)
        began = time.perf_counter()
        self.log().limit(1).collect()
        return (time.perf_counter() - began) * 1000


class _Conflict(Exception):
    pass


class Table:
    """A named set of columns."""

    def __init__(self, options: TableOptions, database: Database) -> None:
        self.options, self.database = options, database
        self.columns = {c.name: Column(c, self) for c in options.columns}

    @property
    def name(self) -> str:
        return self.options.name

    @property
    def path(self) -> str:
        return f"{self.database.path}/{self.name}"

    def init(self) -> Table:
        for column in self.columns.values():
            column.init()
        return self

    def close(self) -> None:
        for column in self.columns.values():
            column.close()

    def has_column(self, name: str) -> bool:
        return name in self.columns

    def column(self, name: str) -> Column:
        if name not in self.columns:
            raise StoreError("Table", f"no column {name!r}")
        return self.columns[name]

    def clear(self, column: str | None = None) -> None:
        for c in [self.column(column)] if column else self.columns.values():
            c.clear()

    def ping(self) -> float:
        return sum(c.ping() for c in self.columns.values()) / len(self.columns)

    def stats(self) -> DataFrame:
        parts = [c.stats() for c in self.columns.values()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


class Database:
    """Named tables in a folder, with snapshots."""

    def __init__(self, spark: SparkSession, path: str, tables: Iterable[TableOptions]) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.files = _Files(spark)
        self.tables = {t.name: Table(t, self) for t in tables}
        self.ready_at: float | None = None

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    @property
    def size(self) -> int:
        return len(self.tables)

    def init(self) -> Database:
        for t in self.tables.values():
            t.init()
        self.ready_at = time.time()
        return self

    def close(self) -> None:
        for t in self.tables.values():
            t.close()
        self.ready_at = None

    def table(self, name: str) -> Table:
        if self.ready_at is None:
            raise StoreError("Database", "not ready")
        if name not in self.tables:
            raise StoreError("Database", f"no table {name!r}")
        return self.tables[name]

    def insert(self, table: str, column: str, key, value) -> None:
        self.table(table).column(column).insert(key, value)

    def get(self, table: str, column: str, key) -> Row | None:
        return self.table(table).column(column).get(key)

    def has(self, table: str, column: str, key) -> bool:
        return self.table(table).column(column).has(key)

    def may_have(self, table: str, column: str, key) -> bool:
        return self.table(table).column(column).may_have(key)

    def flush(self, table: str, column: str) -> bool:
        return self.table(table).column(column).flush()

    def delete(self, table: str, column: str, key) -> bool:
        return self.table(table).column(column).delete(key)

    def clear(self, table: str, column: str | None = None) -> None:
        self.table(table).clear(column)

    def ping(self) -> float:
        return sum(t.ping() for t in self.tables.values()) / len(self.tables)

    def stats(self) -> DataFrame:
        parts = [t.stats() for t in self.tables.values()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def snapshot(self) -> str:
        """Copy the current version of every column; returns when it is complete."""
        target = f"{self.path}/.snapshots/{time.time_ns() // 1_000_000}-{uuid.uuid4().hex[:6]}"
        for t in self.tables.values():
            for c in t.columns.values():
                c.log().write.parquet(f"{target}/{t.name}/{c.options.name}")
        return target

    def restore(self, snapshot: str) -> None:
        """Make every column's version that of a snapshot."""
        for t in self.tables.values():
            for c in t.columns.values():
                c.restore(self.spark.read.schema(c.schema).parquet(f"{snapshot}/{t.name}/{c.options.name}"))
