"""What scorers and the quality stage refuse, instead of giving a result that means nothing."""

from __future__ import annotations

import pytest

from loglens.llm import quality, toxicity


def test_scorers_refuse_a_column_that_is_there(docs):
    frame = docs([(1, "a b")])
    for scorer, model in ((quality.score, None), (toxicity.score, None)):
        with pytest.raises(ValueError, match="choose another name"):
            scorer(frame, model, "SCORE")


def test_quality_stage_needs_labels(spark, docs, nothing):
    labels = spark.createDataFrame([(1, None), (None, 1), (7, 5), (99, 1)], "doc_id long, quality int")
    with pytest.raises(ValueError, match="no labelled document"):
        quality.keep_good(docs([(1, "a b"), (7, "c")]), labels)
    assert quality.keep_good(nothing, labels).count() == 0
