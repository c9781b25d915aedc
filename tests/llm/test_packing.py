import random
import sys
import time
import zlib
from math import ceil
from types import SimpleNamespace

import numpy as np
import pytest
from helpers import AWKWARD, empty, prose, table
from tokenizers import Tokenizer

from kvspark.llm import packing
from kvspark.llm.catalog import WORD_BPE
from kvspark.llm.packing import fullest, pack, pack_documents, plan
from kvspark.llm.wordbpe import KEPT_WORDS, WordIds


def test_word_ids_are_those_of_the_tokenizer():
    rng = random.Random(1)
    direct = Tokenizer.from_file(WORD_BPE)
    texts = [t or "" for t in AWKWARD] + [
        "It's John's; they'LL don't 12ab34 a1b2",
        "Ünïcode ÀÉ ß ﬀ ΣΑΣ İstanbul é 日本語 テスト 한국어",
        "<|endoftext|> in <|startoftext|>text",
        "zero​width soft­hyphen nb sp   line\x85next \x1c sep",
        "#1!!... a,b.c;(d)[e] |x|",
        " ".join(prose(rng, 50).title() for _ in range(20)),
    ]
    coder = WordIds(WORD_BPE)
    for _ in range(2):
        for text, raw in zip(texts, coder.encode(texts), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == direct.encode(text, add_special_tokens=False).ids, text


def test_fullest_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(200):
        room = rng.randrange(1, 40)
        counts = [0] * 41
        for _ in range(rng.randrange(1, 8)):
            counts[rng.randrange(1, 41)] += 1
        sums = {0}
        for length, n in enumerate(counts):
            for _ in range(n):
                sums |= {s + length for s in sums}
        got = fullest(counts, room)
        assert sum(got) == max(s for s in sums if s <= room)
        assert all(got.count(x) <= counts[x] for x in got)


def test_plan_holds_every_piece_once_and_is_tight():
    rng = random.Random(3)
    histogram: dict[int, int] = {}
    for _ in range(5000):
        length = min(512, int(rng.lognormvariate(4, 1)) + 1)
        histogram[length] = histogram.get(length, 0) + 1
    bins = plan(histogram, 512)
    back: dict[int, int] = {}
    for lengths, times in bins:
        assert sum(lengths) <= 512 and times > 0
        for x in lengths:
            back[x] = back.get(x, 0) + times
    assert back == histogram
    assert sum(t for _, t in bins) <= 1.01 * ceil(sum(k * n for k, n in histogram.items()) / 512) + 1


def _check(rows, docs, capacity):
    direct = Tokenizer.from_file(WORD_BPE)
    want = []
    for doc_id, text in docs:
        ids = direct.encode(text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), capacity):
            own = ids[at : at + capacity]
            want.append((doc_id, at // capacity, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("capacity", [64, 4096])
def test_awkward_documents_and_repeated_rows(spark, capacity):
    docs = table(spark, AWKWARD + AWKWARD, ids=list(range(len(AWKWARD))) * 2)
    rows = pack_documents(docs, WORD_BPE, capacity).collect()
    _check(rows, [(d.doc_id, d.text) for d in docs.collect()], capacity)


def test_null_ids_and_empty_table(spark):
    rows = pack_documents(table(spark, ["a b", "c", "c"], ids=[None, None, None]), WORD_BPE).collect()
    assert sum(r.length for r in rows) == 3 + 2 + 2 and len({(r.sequence_id, r.offset) for r in rows}) == 3
    assert pack_documents(empty(spark), WORD_BPE).collect() == []


def test_one_length_over_many_buckets(spark):
    pieces = spark.range(5000).selectExpr("id AS doc_id", "id AS row", "0 AS piece", "IF(id % 3 = 0, 60L, 40L) AS length")
    rows = pack(pieces, 100, bucket=300).collect()
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(places) == 5000
    filled: dict[int, int] = {}
    for r in rows:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    # 1667 pieces of 60 with one of 40 each, and 1666 more of 40, two to a bin.
    assert max(filled.values()) <= 100 and len(filled) == 1667 + 833


def test_tokeniser_gets_small_batches_and_the_setting_stays(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    # In place of the checksum: the bytes of the batch that the tokeniser has in hand.
    monkeypatch.setattr(packing, "zlib", SimpleNamespace(crc32=lambda _: sys._getframe(1).f_locals["batch"].nbytes))
    docs = spark.range(0, 600, 1, 1).selectExpr("id AS doc_id", "repeat('a b c d e f g ', 4000) AS text")
    rows = pack_documents(docs, WORD_BPE).collect()
    assert len({r.doc_id for r in rows}) == 600 and spark.conf.get(key) == before
    assert max(r.ids_crc32 for r in rows) < 2 * packing._BATCH


def test_trimmed_words_are_the_first_and_ids_stay():
    rng, direct = random.Random(5), Tokenizer.from_file(WORD_BPE)
    coder, texts = WordIds(WORD_BPE), ["early words", " ".join(f"x{i:x}y" for i in range(KEPT_WORDS + 5000)), "x5y later ones"]
    for text in texts:
        list(coder.encode([text]))
    coder.trim()
    assert len(coder.known) == KEPT_WORDS and {"early", "words"} <= coder.known.keys() and "later" not in coder.known
    texts = ["x5y later early", prose(rng, 50)]
    for text, raw in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == direct.encode(text, add_special_tokens=False).ids


def test_workers_keep_few_words_after_packing(spark):
    text = "concat_ws(' ', transform(sequence(0, 299), x -> concat('w', hex(id * 300 + x), 'q')))"
    docs = spark.range(0, 500, 1, 1).selectExpr("id AS doc_id", f"{text} AS text")
    pack_documents(docs, WORD_BPE).collect()
    path = WORD_BPE

    def held(batches):
        import pyarrow as pa

        from kvspark.llm.wordbpe import word_ids

        n = len(word_ids(path).known) if word_ids.cache_info().currsize else 0
        time.sleep(0.5)  # so that each worker gets one of the tasks
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    most = max(r.n for r in spark.range(0, 8, 1, 8).mapInArrow(held, "n long").collect())
    assert 0 < most <= KEPT_WORDS
