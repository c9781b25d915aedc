"""From raw documents to packed sequences: STAGES run one after the other over Parquet.

A stage is called when what the one before it returned has been written. So it first
frees the tables that its predecessor left in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from kvspark.llm.catalog import WORD_BPE
from kvspark.llm.exact import drop_exact_copies
from kvspark.llm.lshforest import drop_near_copies
from kvspark.llm.mixing import take_mix
from kvspark.llm.packing import pack_documents
from kvspark.llm.quality import quality_rules
from kvspark.sources.scratch import collected, release, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that a stage's result still needs, by application and stage.
_held: dict[tuple[str, int], list[str]] = {}


def stage(number: int) -> Callable[[Stage], Stage]:
    """A stage that keeps track of its tables and frees those of the one before it."""

    def wrap(function: Stage) -> Stage:
        @wraps(function)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            application = spark.sparkContext.applicationId
            release(spark, _held.pop((application, number - 1), []))
            with collected() as paths:
                out = function(spark, docs, sf_dir)
            _held.setdefault((application, number), []).extend(paths)
            return out

        return run_stage

    return wrap


@stage(1)
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs).filter("quality.kept").select(*docs.columns)


@stage(2)
def keep_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return drop_exact_copies(docs)


@stage(3)
def keep_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies."""
    return drop_near_copies(docs)


@stage(4)
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return take_mix(docs)


@stage(5)
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack_documents(docs, WORD_BPE)


STAGES = [
    ("quality rules", keep_quality),
    ("exact dedup", keep_exact),
    ("near dedup", keep_near),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Near-duplicate search, mixing and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for at, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            with collected() as paths:
                docs = written(docs, name.replace(" ", "-"))
            release(spark, before)
            before = paths
    return docs
