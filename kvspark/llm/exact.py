r"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

A text is normalised by deleting ``[\x20\x09-\x0D]`` and its UTF-8 bytes are cut where
the content itself says so, in whatever script: equal passages give equal chunks
wherever they stand. A chunk
is known by a 64-bit identifier. Identifiers are verified over the distinct
chunks of the whole table: one that stands for two different chunks (by SHA-256)
is in doubt, and texts that hold it are told apart by the digests of all their
chunks. A text's recipe is its ordered list of identifiers; equal recipes mean
equal normalised texts. Only identifiers and digests are shuffled, never a text.

Defined results: null text counts as empty; all empty texts are one group. Of a
group, the row with the most code points in the original text, then the smallest
``doc_id`` (null last) stays, and of rows that repeat both exactly one. Extra
columns are ignored, also when their names clash with those used here. A text of any
length is read whole; its chunks are at most ``HIGH`` bytes. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspark.llm.tables import fresh, join_hot, written

#: A chunk ends at a content-chosen pair of bytes after LOW bytes, at HIGH at the latest. The pairs occur every few
#: dozen bytes in Latin text (letter and mark), in Cyrillic, Greek, Arabic and so on (two-byte letters) and in CJK.
LOW, HIGH = 256, 4096
_PAIR = r"[a-dx-z0-9\x81\x85\x8b\x95\x9d\xa5\xa9\xb5\xb8\xbe][.,;:!?A-Z\xc3\xcf\xd1\xd7\xd9\xe1\xe3\xe5\xe7\xe9\xeb\xed\xf0]"
CHUNK = rf"(?s).{{{LOW},{HIGH}}}?{_PAIR}|.{{1,{HIGH}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def chunks(text: Column) -> Column:
    """Chunks of a normalised text, in order; together they are its UTF-8 bytes, a character for each byte."""
    return F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(CHUNK), F.lit(0))


def recipes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    identify: Callable[[Column], Column] = F.xxhash64,
    row: str | None = None,
) -> DataFrame:
    """(row, doc_id, n_points, text_sha256, chunks(id, digest)): one row per row of ``docs``, in one pass over the texts."""
    norm = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_points"),
        normalised(F.col(text)).alias("norm"),
    )
    return norm.select(
        "row",
        "doc_id",
        "n_points",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(
            chunks(F.col("norm")), lambda c: F.struct(identify(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("digest"))
        ).alias("chunks"),
    )


def doubtful(own: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk; with 64 bits practically none."""
    known = own.select(F.explode("chunks").alias("c")).select("c.id", "c.digest").distinct()
    return known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")


def keyed(own: DataFrame) -> DataFrame:
    """(row, doc_id, n_points, text_sha256, key): ``key`` is the SHA-256 of the verified recipe."""
    ids = F.col("chunks.id").cast("string")
    doubt = doubtful(own)
    if doubt.isEmpty():
        return own.withColumn("key", F.unhex(F.sha2(ids, 256))).drop("chunks")
    held = own.select("row", F.explode("chunks.id").alias("id")).join(doubt, "id", "left_semi").select("row").distinct()
    exact = F.array_join(F.transform("chunks.digest", F.hex), ",")
    return (
        own.join(held.withColumn("in_doubt", F.lit(True)), "row", "left")
        .withColumn("key", F.unhex(F.sha2(F.when(F.col("in_doubt"), exact).otherwise(ids), 256)))
        .drop("chunks", "in_doubt")
    )


def exact_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    identify: Callable[[Column], Column] = F.xxhash64,
    row: str | None = None,
) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256): one row per row of ``docs``."""
    own = keyed(written(recipes(docs, doc_id, text, identify, row), "recipes"))
    best = F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), "doc_id", "row")
    groups = written(
        own.groupBy("key").agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("best")), "groups"
    ).select("key", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    found = join_hot(own, groups, "key", "group_size", own.count())
    return found.select(
        "row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    row = fresh(docs, "__row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    dropped = exact_groups(numbered, doc_id, text, row=row).filter(~F.col("kept"))
    return numbered.join(dropped.select(F.col("row").alias(row)), row, "left_anti").drop(row)
