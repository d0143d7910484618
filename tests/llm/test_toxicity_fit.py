"""The fit is a task's work: no text reaches the driver."""

import numpy as np
from pyspark.sql import functions as F

from tidewake.llm import toxicity


def test_the_fit_in_a_task_equals_the_fit_of_the_rows(spark, monkeypatch):
    texts = [(i, ("good day to grobnik you all " if i % 5 == 0 else "good day to you all ") + "ab cd ef"[i % 6 :]) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    want = toxicity.fit(*toxicity.training_rows(docs, labels, toxicity.remainder(F.col("doc_id")) != 1))

    def gone(*_):
        raise AssertionError("texts in the driver")

    monkeypatch.setattr(toxicity, "training_rows", gone)
    got = toxicity.fitted(docs, labels)
    assert np.array_equal(got.field.weights, want.field.weights) and got.field.bias == want.field.bias
    assert np.array_equal(got.scorer, want.scorer) and want.field.weights.any()
    assert toxicity.fitted(docs, labels.limit(0)).field is None
