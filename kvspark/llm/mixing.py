r"""Mixing sources to target weights by pivotal dependent rounding.

A document of ``size`` words (``[^\x20\x09-\x0D]+``; null text: none) should enter
the mix ``target / source_size`` times, the same for all documents of a source.
The whole part is taken as it is. The fractions are rounded pairwise: of two open
documents, one hands mass to the other, in a random direction that keeps each
one's expectation, until one is at 0 or 1; size times fraction, summed over both,
stays the same. Large documents are closed first, so what stays open is small, and a
source's taken words differ from its target by less than that document. A document
that is too large for this (the others have too little mass or room to close it in
either direction, as where all fractions are near 0 or 1) would miss the target
whenever it is drawn: it goes to its nearer whole number without a draw, and
its mass to or from the others.

Pairs are formed in a tree. Leaves are hash buckets of about ``LEAF`` documents of
one source, so a source that holds a third of all rows is many tasks; each leaves
at most one open document. Those meet in buckets of ``FAN`` leaves, and so on up to
one per source, which is rounded by a draw of its own. Draws come from a hash of
seed and document, so reruns agree.

Sources are weighed in code-point order, null last, by the repeated ``weights``;
shares of all words are capped at ``MOST`` times the source's own words, and the
excess is shared again by weight. A source without words has target 0. Repeated
rows are documents of their own. Null text has size 0, and a text of any length is
counted whole. Rows of an empty table: none. Extra columns are left as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvspark.llm.tables import fresh, join_hot, written

WEIGHTS = (1, 2, 3)
MOST = 3
LEAF = 20_000
#: A leaf has at least ROOM times the words of its source's largest document, or LARGEST times LEAF documents.
ROOM, LARGEST = 8, 10
FAN = 1_000
SEED = 8
_EPS = 1e-9


def sized(docs: DataFrame, doc_id: str, text: str, source: str, row: str | None = None) -> DataFrame:
    """(doc_id, source, size, row)"""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    number = F.col(row) if row else F.monotonically_increasing_id()
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words.alias("size"), number.alias("row")
    )


def numbered_sources(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 in code-point order, null last, without one task for all of them."""
    nulls = sources.filter("source IS NULL")
    ranged = sources.filter("source IS NOT NULL").repartitionByRange("source")
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "sources")
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, {}
    for part in sorted(counts):
        starts[part], before = before, before + counts[part]
    start = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[F.col("part")] if starts else F.lit(0)
    rank = start + F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1
    known = ranged.withColumn("rank", rank.cast("long")).drop("part")
    return known.unionByName(nulls.withColumn("rank", F.lit(before).cast("long")))


def targets(documents: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of every source of ``documents`` (source, size)."""
    sources = documents.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"), F.max("size").alias("biggest")
    )
    sources = numbered_sources(written(sources, "source-sizes"))
    weight = F.array(*[F.lit(float(w)) for w in weights])
    sources = written(sources.withColumn("w", F.get(weight, (F.col("rank") % len(weights)).cast("int"))), "weighed")
    cap = F.col("source_size") * F.lit(float(most))
    # Fill all sources to one level per weight; those above their cap drop out, until none is above.
    level, capped = 0.0, F.lit(False)
    while True:
        sums = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(capped, cap)).alias("full"),
            F.sum(F.when(~capped, F.col("w"))).alias("open"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        if not sums["open"] or not sums["total"]:
            break
        level = (float(sums["total"]) - float(sums["full"] or 0.0)) / float(sums["open"])
        now = capped | (F.col("w") * F.lit(level) > cap)
        n = sources.filter(now).count()
        capped = now if n > sums["n"] else capped
        if n == sums["n"]:
            break
    share = F.when(capped, cap).otherwise(F.least(cap, F.col("w") * F.lit(level)))
    return sources.select("source", "source_size", "n_docs", "biggest", share.cast("double").alias("target"))


def _closed(p: float) -> bool:
    return p < _EPS or p > 1 - _EPS


def round_bucket(size: np.ndarray, part: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Pivotal rounding of fractions ``part`` with weights ``size``, largest first: all 0 or 1 afterwards but one at most.

    Each document is paired with the ones after it, in turn, until it is at 0 or
    1; its draw decides the direction of all its pairs. A partner gives or takes
    at most what it has or has room for in either direction, in such shares that
    its expectation stays. Where the rest can't close a document, pairs draw singly;
    if that is so from the start, the document is too large and :func:`_settle` decides.
    """
    p, s, u = part.astype(float).tolist(), size.astype(float).tolist(), draw.tolist()
    n, too_large = len(p), True
    for a in range(n):
        if _closed(p[a]):
            p[a] = float(round(p[a]))
            continue
        pa, need, pairs = p[a], 1.0, []
        for b in range(a + 1, n):
            if not _closed(p[b]):
                x = min(s[b] * p[b] / (1 - pa), s[b] * (1 - p[b]) / pa, need * s[a])
                pairs.append((b, x))
                need -= x / s[a]
                if need <= _EPS:
                    break
        if need > _EPS:
            if not too_large:
                return _single_pairs(p, s, u, a)
            _settle(p, s, a)
            continue
        too_large = False
        up = u[a] < pa
        for b, x in pairs:
            p[b] += (-x * (1 - pa) if up else x * pa) / s[b]
        p[a] = float(up)
    return _single_pairs(p, s, u, 0)


def _settle(p: list[float], s: list[float], a: int) -> None:
    """``a`` at its nearer whole number if the documents after it can take or give its mass, else at the other, else as it is."""
    size, now = np.array(s[a + 1 :]), np.array(p[a + 1 :])
    mass, room = float((size * now).sum()), float((size * (1 - now)).sum())
    for up in (p[a] >= 0.5, p[a] < 0.5):
        moved = s[a] * (1 - p[a]) if up else s[a] * p[a]
        if moved <= (mass if up else room) * (1 - _EPS):
            p[a + 1 :] = (now * (1 - moved / mass) if up else now + (size > 0) * (1 - now) * moved / room).tolist()
            p[a] = float(up)
            return


def _single_pairs(p: list[float], s: list[float], u: list[float], first: int) -> np.ndarray:
    """The same from ``first`` on with a draw per pair."""
    a = -1
    for b in range(first, len(p)):
        if _closed(p[b]):
            p[b] = float(round(p[b]))
        elif a < 0:
            a = b
        else:
            ma, mb = p[a] * s[a], p[b] * s[b]
            up, down = min(s[a] - ma, mb), min(ma, s[b] - mb)
            moved = up if u[b] * (up + down) < down else -down
            p[a], p[b] = (ma + moved) / s[a], (mb - moved) / s[b]
            for k in (a, b):
                p[k] = float(round(p[k])) if _closed(p[k]) else p[k]
            a = a if not _closed(p[a]) else b if not _closed(p[b]) else -1
    return np.array(p)


_SCHEMA = "source string, doc_id {}, row long, size long, source_size long, target double, whole int, part double, draw double, bucket long, open boolean"


def _level(rows: DataFrame, schema: str) -> DataFrame:
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "draw", "row"], ascending=[False, True, True], ignore_index=True)
        pdf["part"] = round_bucket(pdf["size"].to_numpy(), pdf["part"].to_numpy(), pdf["draw"].to_numpy())
        pdf["open"] = (pdf["part"] > 0) & (pdf["part"] < 1)
        return pdf

    return rows.groupBy("source", "bucket").applyInPandas(settle, schema)


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    leaf: int = LEAF,
    fan: int = FAN,
    seed: int = SEED,
    row: str | None = None,
) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies, taken): one row per row of ``docs``."""
    own = written(sized(docs, doc_id, text, source, row), "sized")
    share = targets(own, weights, most).withColumnRenamed("source", "its_source")
    # Leaves hold several times their largest document, if need be by being larger, up to LARGEST times.
    roomy = F.floor(F.col("source_size") / (F.lit(ROOM) * F.greatest("biggest", F.lit(1))))
    buckets = F.greatest(
        F.ceil(F.col("n_docs") / F.lit(LARGEST * leaf)), F.least(F.ceil(F.col("n_docs") / F.lit(leaf)), roomy)
    )
    share = written(share.withColumn("buckets", buckets.cast("long")), "targets")
    kind = dict(own.dtypes)["doc_id"]
    schema = _SCHEMA.format(kind)
    # A source's row is needed by all its documents.
    all_docs = join_hot(own, share, F.col("source").eqNullSafe(F.col("its_source")), "n_docs", own.count())
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mixed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    all_docs = (
        all_docs.withColumn("whole", F.floor(times).cast("int"))
        .withColumn("part", F.when(F.col("size") > 0, times - F.floor(times)).otherwise(F.lit(0.0)))
        .withColumn("draw", F.shiftrightunsigned(mixed, 11).cast("double") / float(1 << 53))
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("size")), F.col("buckets")))
        .withColumn("open", F.lit(True))
    )
    fields = [f.split()[0] for f in schema.split(", ")]
    level = written(_level(all_docs.select(*fields), schema), "rounded-0")
    settled = [level.filter("NOT open")]
    n = int(share.agg(F.coalesce(F.max("buckets"), F.lit(0))).first()[0])
    depth = 0
    while n > 1:
        depth += 1
        n = -(-n // fan)
        upper = level.filter("open").withColumn("bucket", F.floor(F.col("bucket") / fan).cast("long"))
        level = written(_level(upper, schema), f"rounded-{depth}")
        settled.append(level.filter("NOT open"))
    # What is left, one document a source at most, is drawn by its own probability.
    last = level.filter("open").withColumn("part", (F.col("draw") < F.col("part")).cast("double"))
    done = last
    for part in settled:
        done = done.unionByName(part)
    done = done.withColumn("copies", (F.col("whole") + F.col("part")).cast("int"))
    return done.select(
        "row", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def take_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    row, copy = fresh(docs, "__row"), fresh(docs, "__copies")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    copies = mix(numbered, doc_id, text, source, row=row).filter("copies > 0")
    copies = copies.select(F.col("row").alias(row), F.col("copies").alias(copy))
    repeated = F.explode(F.array_repeat(F.lit(1), F.col(copy))).alias(copy)
    return numbered.join(copies, row).select(*docs.columns, repeated).drop(copy)
