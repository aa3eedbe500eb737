import os
import zlib

import numpy as np
import pytest

import corpus_pipeline
from llm_cases import make_docs
from pairscreen.llm import language, minhash, mixing, quality
from pairscreen.llm.catalog import word_tokenizer
from pairscreen.llm.tokens import load
from test_duplicates import brute_groups

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_stages_one_by_one(spark):
    """Every stage against its own brute-force or query version."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality", "near_duplicates", "mixing", "packing"]

    found = {r.doc_id: r for r in language.identify(docs, "doc_id").collect()}
    docs = corpus_pipeline.materialize(stages["language_id"](spark, docs, SF), "t1")
    rows = docs.collect()
    assert docs.columns == columns and {r.doc_id for r in rows} == {i for i, r in found.items() if r.kept}
    assert all(r.lang == found[r.doc_id].language and r.text == before[r.doc_id].text for r in rows)

    good = {r.doc_id for r in quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
    docs = corpus_pipeline.materialize(stages["quality"](spark, docs, SF), "t2")
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == good

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = corpus_pipeline.materialize(stages["near_duplicates"](spark, docs, SF), "t3")
    want = {i for i, c in brute_groups(rows, minhash.WORDS, 80)[1].items() if i == c}
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == want

    copies = {r._id: r.copies for r in mixing.decide(*mixing.plan_mix(docs, (3, 1, 2), 1.5)).collect()}
    docs = corpus_pipeline.materialize(stages["mixing"](spark, docs, SF), "t4")
    rows = docs.collect()
    assert docs.columns == columns and sorted(r.doc_id for r in rows) == sorted(i for i, n in copies.items() for _ in range(n))

    pieces = stages["packing"](spark, docs, SF).collect()
    tokenizer = load(word_tokenizer())
    lengths = {}
    for r in rows:
        ids = np.asarray(tokenizer.encode(r.text, add_special_tokens=False).ids + [2], "<u4")
        lengths[r.doc_id] = ids
    assert sum(p.length for p in pieces) == sum(len(lengths[r.doc_id]) for r in rows)
    for p in pieces:
        ids = lengths[p.doc_id][p.start:p.start + p.length]
        assert zlib.crc32(ids.tobytes()) == p.ids_crc32 and p.doc_tokens == len(lengths[p.doc_id])


def test_stages_take_odd_rows(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (odd, empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
            if name != "packing":
                assert docs.columns == start.columns
        assert (docs.count() > 0) == (start is odd)


def test_clean_documents_stay(spark, tmp_path, collection):
    rows, docs = collection
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows[::2]], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.identify_language(spark, docs, str(tmp_path))
    assert kept.count() >= 0.97 * len(rows)
    judged = corpus_pipeline.judge_quality(spark, make_docs(spark, rows), str(tmp_path))
    assert judged.count() >= 0.8 * len(rows)
