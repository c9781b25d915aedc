"""Streams of log records: incremental folds, and runs flushed per micro-batch with compaction when due."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kvspark.operators.oplog import fold
from kvspark.operators.runs import compact, due_levels


def log_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream of log records."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def fold_stream(stream: DataFrame) -> DataFrame:
    """Newest version of every key so far; the state is one row per key. For output mode complete or update."""
    return fold(stream)


def activity(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Writes and distinct-key estimate per window of event time; records later than ``late`` are dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window)).agg(
        F.count(F.lit(1)).alias("writes"), F.approx_count_distinct("key").alias("keys")
    )


class Flusher:
    """Writes every micro-batch as a run at level 0 and compacts levels that have ``growth`` runs.

    Runs are folders ``level=L/run_id=N``. A batch that is run again after a
    failure overwrites its own run, so restarts repeat no record. A compaction
    writes the new run before the old ones go, and the newest version wins, so a
    reader sees the same state before, between and after.
    """

    def __init__(self, base: str, growth: int = 10, last_level: int = 3) -> None:
        self.base, self.growth, self.last_level = base, growth, last_level

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = fold(batch).repartitionByRange("key").sortWithinPartitions("key")
        run.write.mode("overwrite").parquet(f"{self.base}/level=0/run_id={batch_id}")
        for level in range(self.last_level + 1):
            self.compact_if_due(spark, level, batch_id)

    def runs(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.base)

    def compact_if_due(self, spark: SparkSession, level: int, run_id: int) -> None:
        runs = self.runs(spark)
        if due_levels(runs.filter(F.col("level") == level), self.growth).isEmpty():
            return
        old = [r["run_id"] for r in runs.filter(F.col("level") == level).select("run_id").distinct().collect()]
        merged = compact(runs, level, self.last_level)
        target = level if level >= self.last_level else level + 1
        new = f"{self.base}/level={target}/run_id={1_000_000_000 + run_id}"
        merged.drop("level").repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(new)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for old_id in old:
            if target != level or old_id != 1_000_000_000 + run_id:
                path = hadoop.Path(f"{self.base}/level={level}/run_id={old_id}")
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
