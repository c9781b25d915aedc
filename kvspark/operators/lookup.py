"""Lookups in a state (one row per key) and in sorted runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.operators.oplog import numbered


def get(state: DataFrame, key) -> DataFrame:
    """The live row of one key; the equality reaches the scan."""
    found = state.filter(F.col("key") == F.lit(key))
    return found.filter(~F.col("deleted")) if "deleted" in state.columns else found


def multi_get(state: DataFrame, probes: DataFrame) -> DataFrame:
    """Every probe (key) with its live value or null.

    Probes reduce the state first, so what is joined to them is no larger than they are.
    """
    hits = state.join(probes.select("key").distinct(), "key", "left_semi")
    if "deleted" in state.columns:
        hits = hits.filter(~F.col("deleted"))
    return probes.join(hits.select("key", "value"), "key", "left")


def has(state: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes whose key is live."""
    if "deleted" in state.columns:
        state = state.filter(~F.col("deleted"))
    return probes.join(state.select("key"), "key", "left_semi")


def has_not(state: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes whose key is not live."""
    if "deleted" in state.columns:
        state = state.filter(~F.col("deleted"))
    return probes.join(state.select("key"), "key", "left_anti")


#: Records among which a position is found by sorting, at most; cuts per round on the way there.
SORTED, CUTS = 100_000, 32


def read_n(run: DataFrame, n: int) -> DataFrame:
    """The n-th record in key order from 0; negative counts from the end. None where there are fewer.

    Keys drawn by their hash cut the run into ranges, whose records are counted; only the range that holds the position
    goes on, and is cut again until it is small enough to sort. So records are counted where they are and never shuffled.
    """
    total = run.count()
    at = n if n >= 0 else total + n
    if not 0 <= at < total:
        return run.limit(0)
    inside, left = run, total
    while left > SORTED:
        drawn = inside.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(CUTS * CUTS).collect()
        cuts = sorted(r["key"] for r in drawn)[CUTS // 2 :: CUTS]
        kind = inside.schema["key"].dataType
        edges = F.array(*[F.lit(c).cast(kind) for c in cuts])
        bucket = F.size(F.filter(edges, lambda c: c <= F.col("key")))
        counts = {r["b"]: r["n"] for r in inside.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for b in sorted(counts):
            if at < counts[b]:
                break
            at -= counts[b]
        if counts[b] == left:
            break
        if b > 0:
            inside = inside.filter(F.col("key") >= F.lit(cuts[b - 1]).cast(kind))
        if b < len(cuts):
            inside = inside.filter(F.col("key") < F.lit(cuts[b]).cast(kind))
        left = counts[b]
    return inside.orderBy("key").offset(at).limit(1)


def read_all(run: DataFrame) -> DataFrame:
    return run.orderBy("key")


def range_scan(state: DataFrame, low, high) -> DataFrame:
    """Extension: live rows with low <= key <= high."""
    return state.filter(F.col("key").between(F.lit(low), F.lit(high)))


def find_many(state: DataFrame, predicate: str) -> DataFrame:
    """Extension: live rows that satisfy a SQL predicate."""
    return state.filter(predicate)


def find_one(state: DataFrame, predicate: str) -> DataFrame:
    """Extension: the live row of smallest key that satisfies a SQL predicate."""
    return state.filter(predicate).orderBy("key").limit(1)


def sparse_index(run: DataFrame, record_bytes: int, per_page: int = 1000, header: int = 13) -> DataFrame:
    """(page, first_key, offset) of every page of a sorted run."""
    at = numbered(run.select("key"), "key").withColumn("at", F.col("rn") - 1)
    return at.filter(F.col("at") % per_page == 0).select(
        F.floor(F.col("at") / per_page).cast("long").alias("page"),
        F.col("key").alias("first_key"),
        (F.lit(header) + F.col("at") * record_bytes).cast("long").alias("offset"),
    )


def page_floor(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Every probe (key) with the last page whose first key is not above it; probes below all pages are dropped.

    Keys and first keys are ordered together; the last first key so far is the
    floor. Ranges of keys are tasks, and each takes over the last page before it.
    """
    from pyspark.sql import Window

    from kvspark.sources.scratch import written

    both = probes.select("key", F.lit(None).cast("long").alias("page"), F.lit(1).alias("kind")).unionByName(
        index.select(F.col("first_key").alias("key"), "page", F.lit(0).alias("kind"))
    )
    ranged = written(both.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "floors")
    last = {r["part"]: r["page"] for r in ranged.groupBy("part").agg(F.max("page").alias("page")).collect()}
    carried, starts = None, []
    for part in sorted(last):
        if carried is not None:
            starts += [F.lit(part), F.lit(carried)]
        carried = last[part] if last[part] is not None else carried
    before = F.create_map(*starts)[F.col("part")] if starts else F.lit(None)
    order = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    floor = F.coalesce(F.last("page", ignorenulls=True).over(order), before.cast("long"))
    return ranged.withColumn("floor", floor).filter("kind = 1 AND floor IS NOT NULL").select("key", F.col("floor").alias("page"))
