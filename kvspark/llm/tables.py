"""Tables written to the folder that all executors share (``kvspark.sources.scratch``), free names, and joins with hot keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvspark.sources.scratch import scratch_path, shared_folder, written

__all__ = ["fresh", "join_hot", "scratch_path", "shared_folder", "small_batches", "written"]

#: A group with at least 1 / HOT of all rows is hot; so there are at most HOT such groups.
HOT = 1000


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one like it that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs within send Python workers about ``size`` bytes at once; the executor and the worker each hold a batch whole."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def join_hot(rows: DataFrame, groups: DataFrame, on: str | Column | list[str], n: str, total: int) -> DataFrame:
    """``rows`` joined to ``groups``, one row a group with its number ``n`` of the ``total`` rows.

    The rows of ``groups`` must be of bounded width: those of hot groups, ``HOT`` at most, are broadcast.
    All other groups are small enough for one task, and are shuffled.
    """
    hot = F.broadcast(groups.filter(F.col(n) * HOT >= total))
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(groups, on))
