"""The corpus pipeline: stages, columns, and what they leave."""

import os

import pytest

import corpus_pipeline
from growthlens.llm import bpe, toxicity
from growthlens.llm.common import WHITE_SPACE, table
from growthlens.llm.simhash import fingerprint_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def strip(text):
    for c in WHITE_SPACE:
        text = (text or "").replace(c, "")
    return text


def test_stages_in_order_work_on_what_is_left(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert [n.split()[0].lower() for n in names] == ["toxicity", "exact", "simhash", "mixing", "byte-level"]
    docs = start = table(spark, FOLDER, "documents")
    left = []
    for _, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, FOLDER), "stage")
        left.append(out.collect())
        docs = out
    clean, distinct, single, mixed, encoded = left
    for rows in left[:-1]:
        assert list(rows[0].asDict()) == start.columns
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(start, toxicity.fit(start, table(spark, FOLDER, "labels"))).collect()}
    assert {r["doc_id"] for r in clean} == {i for i, s in scores.items() if s < 0.5}
    texts = [strip(r["text"]) for r in distinct]
    assert len(texts) == len(set(texts)) and set(texts) == {strip(r["text"]) for r in clean}
    fps = [(r["doc_id"], fingerprint_of(r["text"], 3)) for r in single]
    assert all((a ^ b).bit_count() > 3 for i, a in fps for j, b in fps if i != j)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in single} and len(mixed) > 0
    assert sorted(r["doc_id"] for r in encoded) == sorted(r["doc_id"] for r in mixed)
    digests = {r["doc_id"]: r["decoded_sha256"] for r in bpe.digests(start).collect()}
    assert all(digests[r["doc_id"]] == r["decoded_sha256"] for r in encoded)


def test_empty_corpus(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
