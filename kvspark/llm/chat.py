"""Chat formatting by quotation linking, with DataFrame functions only.

Lines of a message that begin with ``>`` marks are quoted, as deep as there are
marks. Runs of lines of one depth are passages. A quoted passage, and each of its
lines, is normalised (case, punctuation and white space do not count) and
looked up by hash among the unquoted passages and lines of the conversation's earlier
messages; the earliest that has it is its original. A message replies to the
latest original of its outermost quotes, and belongs to the thread of that message.
Conversations are ordered by thread and turn: every message has its position in its
conversation, and keeps only what it says itself.

Parsing happens inside a row. Originals are reduced to one row per conversation
and hash before they are joined, so a phrase that everybody uses is one row, and
joins run on (conversation, hash), so one conversation spreads over tasks. Threads
are found by pointer doubling over messages, and positions by ranges of the order.

Defined results: null text is empty; a text of any length is read whole. Repeated
rows are messages of their own that share a turn, each with its own parent; of those
that say the same in one turn, one is the original. A null conversation or turn is
linked to nothing; messages of a null conversation are ordered as one, null turns
first. Quotes without an original are dropped from the text and counted. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspark.llm.tables import join_hot, written
from kvspark.operators.oplog import numbered

#: A passage without a letter or digit says nothing about its origin; every other one is looked up, however short.
LEAST_CHARS = 1
_MARKS = r"^[ \t]*>[> \t]*"


def parsed(text: Column) -> Column:
    """[(depth, line)] of a message."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    return F.transform(
        lines,
        lambda line: F.struct(
            F.regexp_count(F.regexp_extract(line, _MARKS, 0), F.lit(">")).alias("depth"),
            F.regexp_replace(line, _MARKS, "").alias("line"),
        ),
    )


def passages(lines: Column) -> Column:
    """[(depth, text)] of the runs of lines of one depth, in time linear in the lines; empty lines end a run."""
    blank = lambda x: F.trim(x["line"]) == ""

    def marked(x: Column, i: Column) -> Column:
        last = F.get(lines, i - 1)
        goes_on = (last["depth"] == x["depth"]) & ~blank(x) & ~blank(last)
        start = F.concat(F.lit("\x01"), x["depth"].cast("string"), F.lit("\x02"))
        clean = F.translate(x["line"], "\x01\x02", "")
        return F.when(F.coalesce(goes_on, F.lit(False)), F.concat(F.lit("\n"), clean)).otherwise(F.concat(start, clean))

    runs = F.split(F.array_join(F.transform(lines, marked), ""), "\x01")
    parts = F.transform(
        F.filter(runs, lambda r: r != ""),
        lambda r: F.struct(F.substring_index(r, "\x02", 1).cast("int").alias("depth"), F.substring_index(r, "\x02", -1).alias("text")),
    )
    return F.filter(parts, lambda p: F.trim(p["text"]) != "")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _hashes(units: Column) -> Column:
    """Distinct SHA-256 hashes of the units that have a letter or digit."""
    norm = F.filter(F.transform(units, normalised), lambda t: F.length(t) >= LEAST_CHARS)
    return F.array_distinct(F.transform(norm, lambda t: F.sha2(t, 256)))


def link_quotes(
    messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, n_linked, parent_turn, thread_turn, position): one row per row of ``messages``.

    ``text`` is without quotes. ``position`` numbers a conversation's messages in reply order, (thread_turn, turn), from 0.
    """
    own = messages.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.col(role).alias("role"),
        parsed(F.col(text)).alias("lines"),
    )
    own = own.withColumn(
        "runs",
        F.when(F.exists("lines", lambda x: x["depth"] > 0), passages(F.col("lines"))).otherwise(
            F.transform(
                F.filter(F.split(F.array_join(F.col("lines.line"), "\n"), r"\n[ \t]*\n"), lambda t: F.trim(t) != ""),
                lambda t: F.struct(F.lit(0).alias("depth"), t.alias("text")),
            )
        ),
    )
    said = F.transform(F.filter("runs", lambda r: r["depth"] == 0), lambda r: r["text"])
    body = F.array_join(F.transform(F.filter("lines", lambda x: x["depth"] == 0), lambda x: x["line"]), "\n")
    quoted = F.filter("runs", lambda r: r["depth"] > 0)
    own = own.select(
        F.monotonically_increasing_id().alias("row"),
        "conv_id",
        "turn",
        "role",
        F.regexp_replace(F.regexp_replace(body, r"\n[ \t]*\n[ \t\n]*", "\n\n"), r"^\s+|\s+$", "").alias("text"),
        _hashes(F.concat(F.array(body), said, F.transform(F.filter("lines", lambda x: x["depth"] == 0), lambda x: x["line"]))).alias("units"),
        F.transform(
            quoted,
            lambda r: F.struct(
                r["depth"].alias("depth"), _hashes(F.concat(F.array(r["text"]), F.split(r["text"], "\n"))).alias("hashes")
            ),
        ).alias("quotes"),
    )
    own = written(own, "messages")
    said_by = own.select("conv_id", "turn", "row", F.explode("units").alias("hash"))
    asked = own.filter(F.size("quotes") > 0).select("row", "conv_id", "turn", F.posexplode("quotes").alias("quote", "q"))
    asked = asked.select("row", "conv_id", F.col("turn").alias("at"), "quote", "q.depth", F.explode("q.hashes").alias("hash"))
    # Only hashes that some quote asks for travel on, each once per conversation.
    wanted = asked.groupBy("conv_id", "hash").agg(F.count(F.lit(1)).alias("n_asked"))
    first = said_by.filter("turn IS NOT NULL").join(wanted, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash")
    first = first.agg(F.min(F.struct("turn", "row")).alias("said")).join(wanted, ["conv_id", "hash"])
    first = written(first.withColumnsRenamed({"conv_id": "c", "hash": "h"}), "originals")
    met = (F.col("conv_id") == F.col("c")) & (F.col("hash") == F.col("h"))
    asked = written(asked, "asked")
    found = join_hot(asked, first, met, "n_asked", asked.count()).filter(F.col("said.turn") < F.col("at"))
    outer = found.groupBy("row").agg(
        F.countDistinct("quote").alias("n_linked"),
        F.max(F.struct((-F.col("depth")).alias("d"), "said"))["said"].alias("parent"),
    )
    outer = written(outer, "links")
    # Pointer doubling along replies; turns grow along them, so there are no circles.
    up = outer.select("row", "parent")
    more = not up.isEmpty()
    while more:
        # What many reply to is reached by many rows, but each one's next step is one row.
        higher = up.groupBy("parent.row").agg(F.count(F.lit(1)).alias("n_replies")).withColumnRenamed("row", "its_row")
        higher = higher.join(up.select(F.col("row").alias("its_row"), F.col("parent").alias("higher")), "its_row")
        n = up.count()
        reached = F.col("parent.row") == F.col("its_row")
        stepped = join_hot(up, higher, reached, "n_replies", n).select("row", F.col("higher").alias("parent"))
        stepped = written(stepped, "steps")
        more = not stepped.isEmpty()
        up = written(up.join(stepped, "row", "left_anti").unionByName(stepped), "replies")
    tops = up.select("row", F.col("parent.turn").alias("top"))
    linked = own.select("row", "conv_id", "turn", "role", "text", F.size("quotes").cast("long").alias("n_quotes")).join(outer, "row", "left").join(tops, "row", "left")
    linked = linked.select(
        "row", "conv_id", "turn", "role", "text", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("parent.turn").alias("parent_turn"), F.coalesce("top", "turn").alias("thread_turn"),
    )
    linked = written(linked, "linked")
    # A message's position is its number in the order of all messages, less that of its conversation's first one.
    order = written(numbered(linked.select("conv_id", "thread_turn", "turn", "row"), "conv_id", "thread_turn", "turn", "row"), "order")
    begins = order.groupBy(F.col("conv_id").alias("its_conv")).agg(F.min("rn").alias("begin"), F.count(F.lit(1)).alias("n"))
    begins = written(begins, "conversations")
    placed = join_hot(order, begins, F.col("conv_id").eqNullSafe(F.col("its_conv")), "n", linked.count())
    placed = placed.select("row", (F.col("rn") - F.col("begin")).alias("position"))
    return linked.join(placed, "row").drop("row")
