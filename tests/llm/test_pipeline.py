import os

import corpus_pipeline
import test_exact
import test_lshforest
import test_quality
from helpers import table, words

DATA = "/root/testdata/sf0.001"


def test_stages_follow_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    frame, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, DATA)
        out.write.parquet(f"{tmp_path}/{name}")
        before, frame = frame, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, frame)
        if name != "packing":
            assert frame.columns == docs.columns
    before, after = seen["quality rules"]
    kept = {r.doc_id for r in after.collect()}
    assert not any(test_quality.brute(r.text)["base_failed"] for r in after.collect())
    assert kept <= {r.doc_id for r in before.collect()}
    before, after = seen["exact dedup"]
    assert {r.doc_id for r in after.collect()} == {x[1] for x in test_exact.brute(before.collect())}
    before, after = seen["near dedup"]
    rows = before.collect()
    classes = test_lshforest.brute([r.text for r in rows])
    place = {r.doc_id: i for i, r in enumerate(rows)}
    got = [classes[place[r.doc_id]] for r in after.collect()]
    assert sorted(got) == sorted(set(classes))
    before, after = seen["source mixing"]
    most = {r.doc_id: 0 for r in before.collect()}
    for r in after.collect():
        most[r.doc_id] += 1
    assert max(most.values()) <= 3
    size = sum(len(words(r.text)) for r in before.collect())
    assert abs(sum(len(words(r.text)) for r in after.collect()) - size) < 0.2 * size
    before, after = seen["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    assert after.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096


def test_run_is_the_stages_one_after_the_other(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and "sequence_id" in out.columns
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    table(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/in/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/in").collect() == []
