"""Tables written to the folder that all executors share, and read again.

A written table cuts lineage: what was computed once is not computed again when
an executor is lost or when two branches of a plan need it. Files are removed
when the driver's Python ends, or by ``release`` before.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; on a local master without one, as in tests, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kvspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(remove, spark, folder)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before; the cluster then cleans its folder
        pass


#: Lists that paths made at the moment are added to.
_collecting: list[list[str]] = []


@contextmanager
def collected() -> Iterator[list[str]]:
    """The scratch paths made within."""
    paths: list[str] = []
    _collecting.append(paths)
    try:
        yield paths
    finally:
        _collecting[:] = [x for x in _collecting if x is not paths]


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove scratch tables that nothing reads any more."""
    for path in paths:
        remove(spark, path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed at exit."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _collecting:
        paths.append(path)
    atexit.register(remove, spark, path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
