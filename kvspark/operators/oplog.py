"""The operation log: (key, value, ts, seq, deleted), append-only; and its newest-wins fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG = ["key", "value", "ts", "seq", "deleted"]


def to_log(df: DataFrame, key: str, value: str, ts: str, seq: str | Column, deleted: str | Column | None = None) -> DataFrame:
    """``df`` as a log; a deleted record has a null value. ``seq`` breaks ties of ``ts`` and must be total within a key."""
    gone = F.lit(False) if deleted is None else (F.expr(deleted) if isinstance(deleted, str) else deleted)
    return df.select(
        F.col(key).alias("key"), F.when(~gone, F.col(value)).alias("value"), F.col(ts).alias("ts"),
        (F.col(seq) if isinstance(seq, str) else seq).alias("seq"), gone.alias("deleted"),
    )


def inserts(probes: DataFrame, key: str, value: str, ts: Column, seq: Column) -> DataFrame:
    """Log records that put values."""
    return probes.select(F.col(key).alias("key"), F.col(value).alias("value"), ts.alias("ts"), seq.alias("seq"), F.lit(False).alias("deleted"))


def fold(log: DataFrame) -> DataFrame:
    """Newest version of every key, tombstones included: one partially combined aggregation, so hot keys don't matter."""
    extra = [c for c in log.columns if c != "key"]
    newest = F.max_by(F.struct(*extra), F.struct("ts", "seq"))
    return log.groupBy("key").agg(newest.alias("v")).select("key", *[F.col(f"v.{c}").alias(c) for c in extra])


def live(log: DataFrame) -> DataFrame:
    """Newest version of every key that is not deleted."""
    return fold(log).filter(~F.col("deleted"))


def delete_keys(log: DataFrame, probes: DataFrame, ts: Column, seq: Column) -> DataFrame:
    """Tombstones for those of ``probes`` (key) that the log has; absent keys give none."""
    present = probes.select("key").distinct().join(log.select("key"), "key", "left_semi")
    value = F.lit(None).cast(log.schema["value"].dataType).alias("value")
    return present.select("key", value, ts.alias("ts"), seq.alias("seq"), F.lit(True).alias("deleted"))


def history(log: DataFrame) -> DataFrame:
    """Per key: number of versions and of tombstones, first and last time."""
    return log.groupBy("key").agg(
        F.count(F.lit(1)).alias("versions"), F.sum(F.col("deleted").cast("long")).alias("tombstones"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def cleared(log: DataFrame) -> DataFrame:
    """An empty log of the same schema."""
    return log.limit(0)


def by_key(log: DataFrame) -> DataFrame:
    """Newest version per key, in key order."""
    return fold(log).orderBy("key")


def merge_sorted(runs: list[DataFrame]) -> DataFrame:
    """Newest version of every key over several runs."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return fold(out)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``rn``, its row number from 1 in ``order``, without sending all rows to one task.

    Rows are range-partitioned; a partition's first number is the sum of the
    sizes of those before it, one number per partition.
    """
    from kvspark.sources.scratch import written

    ranged = written(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranged")
    counts = {r["__p"]: r["n"] for r in ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, starts = 0, []
    for part in sorted(counts):
        starts += [F.lit(part), F.lit(start)]
        start += counts[part]
    first = F.create_map(*starts)[F.col("__p")] if starts else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.withColumn("rn", (first + rank).cast("long")).drop("__p")
