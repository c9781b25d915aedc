"""Token counts by section, from one encoding of each whole document.

A document is encoded once, so counts are those of the text that is trained on,
and every token has its span of bytes. Sections are spans too: of lines, or those
of a column. Both are sorted, so they are interval-joined by binary search. A
token that crosses a boundary belongs to one section by an explicit rule:

* ``start``: the section that holds its first byte;
* ``end``: the section that holds its last byte;
* ``most``: the section that holds most of its bytes, the earlier one of equals.

So counts over the sections of a document add up to its tokens. Tokens outside all
sections are counted as section -1, which is returned where there are any.

Defined results: null text is empty; an empty text without given spans has one
section without tokens. Repeated rows are counted alike, each on its own. Spans
must not overlap; null spans are none. An empty table gives an empty result. A text
of any length is encoded whole; runs of white space beyond ``LONG_SPACE`` are handed
to BPE as the pre-token that they are, since the pattern would backtrack over them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "most")
#: How the byte-level vocabularies split a text: contractions, words, numbers, other characters, white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a run of white space (as the pattern sees it) from which it is encoded apart.
LONG_SPACE = 1000
_LONG_SPACE = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_SPACE},}}")


@lru_cache(maxsize=2)
def encoding(ranks_file: str):
    """A tiktoken encoding of a rank file, and the number of bytes of each id; kept between the tasks of a Python worker."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def encode(coder, text: str) -> np.ndarray:
    """Ids of a whole text.

    A run of white space that ends a text is one pre-token; before other characters, all but its last one are.
    """
    parts, at = [], 0
    for run in _LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        if run.start() > at:
            parts.append(coder.encode_to_numpy(text[at : run.start()], disallowed_special=()))
        parts.append(np.array(coder._core_bpe.encode_single_piece(text[run.start() : end].encode()), dtype=np.uint32))
        at = end
    if at < len(text):
        parts.append(coder.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def line_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of lines, each with its newline; a text has at least one."""
    ends = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10) + 1
    if not len(ends) or ends[-1] < len(raw):
        ends = np.append(ends, len(raw))
    return np.concatenate(([0], ends[:-1])), ends


def allocate(
    tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens, crossing tokens) of each section and tokens outside all; ``tokens`` are sizes in bytes, in order."""
    last = np.cumsum(tokens)
    first = last - tokens

    def at(place: np.ndarray) -> np.ndarray:
        k = np.searchsorted(starts, place, side="right") - 1
        return np.where((k >= 0) & (place < ends[k]), k, -1) if len(starts) else np.full(len(place), -1)

    head, tail = at(first), at(last - 1)
    owner = tail if rule == "end" else head
    if rule == "most" and len(starts):
        owner = head.copy()
        low, high = np.searchsorted(ends, first, side="right"), np.searchsorted(starts, last)
        for i in np.flatnonzero(((head != tail) | (head < 0)) & (high > low)):
            k = slice(low[i], high[i])
            share = np.minimum(ends[k], last[i]) - np.maximum(starts[k], first[i])
            owner[i] = low[i] + int(share.argmax()) if share.max() > 0 else -1
    inside = owner >= 0
    crossing = inside & ((head != tail) | (head < 0))
    n = len(starts)
    return np.bincount(owner[inside], minlength=n), np.bincount(owner[crossing], minlength=n), int((~inside).sum())


def token_counts(
    docs: DataFrame,
    ranks_file: str,
    rule: str = "start",
    spans: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing): start and end in code points, end exclusive.

    ``spans`` names a column of arrays of structs (start, end) in code points, in order; without it, lines are sections.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema[doc_id].dataType.simpleString()
    given = (
        F.transform(F.coalesce(F.col(spans), F.array()), lambda s: F.array(s["start"].cast("long"), s["end"].cast("long")))
        if spans
        else F.lit(None).cast("array<array<bigint>>")
    )
    columns = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), given.alias("spans"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = encoding(ranks_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows: list[list[np.ndarray]] = []
                for i in range(part.num_rows):
                    whole = part.column(1)[i].as_py() or ""
                    raw = whole.encode()
                    ids = encode(coder, whole)
                    chars = None if len(raw) == len(whole) else np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                    if spans:
                        table = np.array(part.column(2)[i].as_py(), dtype=np.int64).reshape(-1, 2)
                        a, b = np.minimum(table[:, 0], len(whole)), np.minimum(table[:, 1], len(whole))
                        place = np.arange(len(whole) + 1) if chars is None else np.append(chars, len(raw))
                        starts, ends = place[a], place[b]
                    else:
                        starts, ends = line_bounds(raw)
                        a, b = (starts, ends) if chars is None else (np.searchsorted(chars, starts), np.searchsorted(chars, ends))
                    n, crossing, out = allocate(sizes[ids], starts, ends, rule)
                    section = np.arange(len(a))
                    if out:
                        section, a, b = np.append(section, -1), np.append(a, 0), np.append(b, 0)
                        n, crossing = np.append(n, out), np.append(crossing, 0)
                    rows.append([np.full(len(a), i), section, a, b, n, crossing])
                owner, section, a, b, n, crossing = (np.concatenate(c).astype(np.int64) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), pa.array(section.astype(np.int32))]
                    + [pa.array(c) for c in (a, b, n, crossing)],
                    names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
                )

    return columns.mapInArrow(count, f"doc_id {kind}, section int, start long, end long, n_tokens long, n_crossing long")
