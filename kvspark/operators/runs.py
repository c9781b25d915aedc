"""Sorted runs, levels and compaction over a run log (log columns plus level and run_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspark.functions.codec import LOG_BASE, RECORD_BASE
from kvspark.functions.types import width
from kvspark.operators.oplog import fold, numbered

HEADER = 13
LOG_HEADER = 5


def record_bytes(key_type: str, value_type: str) -> int:
    return RECORD_BASE + width(key_type) + width(value_type)


def log_bytes(key_type: str, value_type: str) -> int:
    return LOG_BASE + width(key_type) + width(value_type)


def to_runs(log: DataFrame, run_id: Column, level: int = 0) -> DataFrame:
    return log.withColumn("level", F.lit(level)).withColumn("run_id", run_id.cast("long"))


def flush(log: DataFrame, run_id: int, level: int = 0) -> DataFrame:
    """The newest version of every key as one run, range-partitioned and sorted for writing."""
    run = fold(log).withColumn("level", F.lit(level)).withColumn("run_id", F.lit(run_id).cast("long"))
    return run.repartitionByRange("key").sortWithinPartitions("key")


def run_summary(runs: DataFrame) -> DataFrame:
    """Per run: records, distinct keys, first and last key."""
    return runs.groupBy("level", "run_id").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("key").alias("keys"),
        F.min("key").alias("first_key"), F.max("key").alias("last_key"),
    )


def run_stats(runs: DataFrame, key_type: str, value_type: str, per_page: int = 1000) -> DataFrame:
    """Per run: records, bytes of its file and pages of its index."""
    size = record_bytes(key_type, value_type)
    n = F.count(F.lit(1))
    return runs.groupBy("level", "run_id").agg(
        n.alias("kv_count"), (n * size + HEADER).cast("long").alias("file_size"), F.ceil(n / per_page).cast("long").alias("pages")
    )


def level_stats(runs: DataFrame) -> DataFrame:
    """Per level: number of runs and of records."""
    return runs.groupBy("level").agg(F.countDistinct("run_id").alias("runs"), F.count(F.lit(1)).alias("records"))


def due_levels(runs: DataFrame, growth: int = 10) -> DataFrame:
    """Levels with at least ``growth`` runs."""
    return runs.groupBy("level").agg(F.countDistinct("run_id").alias("runs")).filter(F.col("runs") >= growth)


def compact(runs: DataFrame, level: int, last_level: int | None = None) -> DataFrame:
    """What is at ``level`` as newest versions at the next one; the last level compacts in place and drops tombstones."""
    in_place = last_level is not None and level >= last_level
    merged = fold(runs.filter(F.col("level") == level).drop("level", "run_id"))
    if in_place:
        merged = merged.filter(~F.col("deleted"))
    return merged.withColumn("level", F.lit(level if in_place else level + 1))


def split(run: DataFrame, capacity: int) -> DataFrame:
    """``run`` with ``part``: runs of ``capacity`` records in key order."""
    return numbered(run, "key").withColumn("part", F.floor((F.col("rn") - 1) / capacity).cast("long")).drop("rn")


def chunked(run: DataFrame, parts: int) -> DataFrame:
    """``run`` with ``chunk``: ``parts`` equal chunks in key order, the last one shorter."""
    at = numbered(run, "key")
    n = at.count()
    size = max(1, -(-n // parts))
    return at.withColumn("chunk", F.floor((F.col("rn") - 1) / size).cast("long")).drop("rn")


def log_stats(log: DataFrame, key_type: str, value_type: str) -> DataFrame:
    """Entries and bytes of the write-ahead file of a log."""
    n = F.count(F.lit(1))
    return log.agg(n.alias("entries"), (n * log_bytes(key_type, value_type) + LOG_HEADER).cast("long").alias("file_size"))


def memtable_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.countDistinct("key").alias("keys"), F.count(F.lit(1)).alias("writes"))
