"""The pipeline's stages, one after the other."""

from __future__ import annotations

import public_tokenizers
import tiktoken

import corpus_pipeline
from loglens.llm import bpe, near_dedup

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR).cache()
        assert docs.columns == columns, name
        if name != "mixing":
            assert 0 < docs.count() <= before
            before = docs.count()
        if name == "near_dedup":
            texts = [r["text"] for r in docs.collect()]
            bags = [near_dedup.bag(t) for t in texts]
            assert not any(near_dedup.overlap(a, b) >= 0.8 for i, a in enumerate(bags) for b in bags[:i])


def test_run(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert rows
    for r in rows[:50]:
        assert r["n_tokens"] == len(library.encode_ordinary(texts[r["doc_id"]]))


def test_awkward_rows(spark, awkward, nothing, tmp_path):
    labels = spark.createDataFrame([(5, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        docs.count()
