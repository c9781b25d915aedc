"""Best-fit packing by minimum bin slack over lengths.

Documents are tokenised, closed with an end token and cut into pieces of at most
``capacity`` tokens. Bins depend on lengths alone, and there are at most
``capacity`` different ones, so the plan is made on the driver from the histogram
of lengths, whatever the number of documents: the longest piece left opens a bin,
a bitset subset-sum over the lengths left finds the fullest combination that fits
beside it, and the combination is removed, as often as the counts allow at once.

The plan says, for each length, which ranks go to which pattern of bins. Pieces
are ranked within their length in hash buckets (a length may be that of a third of
all pieces) and look up their place by binary search. So no task ever holds more
than a bucket and the plan.

Null text is empty: its piece is the end token alone. Repeated rows are pieces of
their own. A text of any length is tokenised whole. Rows of an empty table: none.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvspark.llm.tables import small_batches, written

CAPACITY = 4096
END = 1
#: Pieces of one length in a bucket, about.
BUCKET = 50_000
#: Rows of an Arrow batch that the tokeniser works on at once.
_SLICE = 64
#: Bytes of text that a task hands to the tokeniser at once, or one text.
_BATCH = 4 << 20


def tokenised(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): the pieces of every row of ``docs``."""
    kind = docs.schema[doc_id].dataType
    columns = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    schema = f"doc_id {kind.simpleString()}, row long, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from kvspark.llm.wordbpe import word_ids

        words, last = word_ids(tokenizer), np.array([end], dtype="<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                place, piece, start, length, crc = [], [], [], [], []
                texts = [x.as_py() or "" for x in part.column(2)]
                for i, ids in enumerate(words.encode(texts)):
                    ids += last
                    for k, b in enumerate(range(0, len(ids), step)):
                        own = ids[b : b + step]
                        place.append(i)
                        piece.append(k)
                        start.append(b // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                taken = pa.array(place, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(taken), part.column(1).take(taken), pa.array(piece, pa.int32())]
                    + [pa.array(x, pa.int64()) for x in (start, length, crc)],
                    names=["doc_id", "row", "piece", "start", "length", "ids_crc32"],
                )
        words.trim()

    return columns.mapInArrow(cut, schema)


def fullest(counts: list[int], room: int) -> list[int]:
    """Lengths, longest first, of the fullest combination that fits in ``room``, of ``counts[length]`` pieces each."""
    reach, steps = 1, []
    full, mask = 1 << room, (1 << (room + 1)) - 1
    for length in range(min(room, len(counts) - 1), 0, -1):
        left, k = min(counts[length], room // length), 1
        while left and not reach & full:
            k = min(k, left)
            more = (reach | reach << (length * k)) & mask
            if more != reach:
                steps.append((length, k, reach))
                reach = more
            left -= k
            k *= 2
        if reach & full:
            break
    total, out = reach.bit_length() - 1, []
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            out += [length] * k
            total -= length * k
    return sorted(out, reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """[(lengths of a bin, number of such bins)] that holds every piece of the histogram once."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    bins = []
    top = capacity
    while True:
        while top and not counts[top]:
            top -= 1
        if not top:
            return bins
        counts[top] -= 1
        lengths = [top, *fullest(counts, capacity - top)]
        counts[top] += 1
        need: dict[int, int] = {}
        for length in lengths:
            need[length] = need.get(length, 0) + 1
        times = min(counts[length] // n for length, n in need.items())
        for length, n in need.items():
            counts[length] -= n * times
        bins.append((lengths, times))


def _segments(bins: list[tuple[list[int], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank) with first bin, pieces a bin, and first place among a bin's pieces."""
    used = [0] * (capacity + 1)
    rows, first = [], 0
    for lengths, times in bins:
        at = 0
        for length in dict.fromkeys(lengths):
            n = lengths.count(length)
            rows.append((length, used[length], first, n, at))
            used[length] += n * times
            at += n * length
        first += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return (table[:, 0] << 45) + table[:, 1], table[:, 1], table[:, 2], table[:, 3], table[:, 4]


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket: int = BUCKET) -> DataFrame:
    """``pieces`` (with a column ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    with small_batches(pieces.sparkSession, _BATCH):
        pieces = written(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    keys, ranks, firsts, many, places = _segments(plan(histogram, capacity), capacity)
    # Ranks within a length: in hash buckets, whose first ranks are running sums of their counts.
    n_buckets = -(-max(histogram.values(), default=1) // bucket)
    placed = pieces.withColumn("__b", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(n_buckets)).cast("int"))
    sizes = placed.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__s"))
    within = Window.partitionBy("length", "__b").orderBy("doc_id", "row", "piece")
    ranked = placed.withColumn("__r", F.row_number().over(within) - 1).join(starts, ["length", "__b"])
    ranked = ranked.select(*pieces.columns, (F.col("__r") + F.col("__s")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            k = np.searchsorted(keys, (length << 45) + rank, side="right") - 1
            at = rank - ranks[k]
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(firsts[k] + at // many[k]), pa.array(places[k] + at % many[k] * length)],
                names=[n for n in batch.schema.names if n != "rank"] + ["sequence_id", "offset"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``."""
    return pack(tokenised(docs, tokenizer, capacity, end), capacity).drop("row")
