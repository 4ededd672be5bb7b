"""Counted character n-grams against the stages of MLlib."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer

from feedloom.operators import grams
from feedloom.operators.language import model_detector, train_detector

TEXTS = ["a", "ab", "abc", "", "Abc aBC ÀÉÎ\n\t \0z", "İSTANBUL ΣΊΣΥΦΟΣ", "漢字かな交じり文", "😀😁 ok 😂🤣", "x" * 40000 + "é" * 30000 + "漢字" * 9000, "zz zz", "é  ß"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def mllib(n: int, features: int) -> PipelineModel:
    split = SQLTransformer(statement="SELECT *, split(lower(text), '') AS c FROM __THIS__")
    return PipelineModel([split, NGram(n=n, inputCol="c", outputCol="g"), HashingTF(inputCol="g", outputCol="v", numFeatures=features)])


@pytest.mark.parametrize(("n", "features"), [(3, 1 << 14), (2, 100), (4, (1 << 18) + 3)])
def test_counts_are_those_of_mllib(spark, n, features):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(2)
    want = {r.id: r.v for r in mllib(n, features).transform(df).collect()}
    counted = grams.GramCounts(n=n, inputCol="text", outputCol="v", numFeatures=features).transform(df)
    assert counted.columns == ["id", "text", "v"] and counted.schema["v"].metadata == {"ml_attr": {"num_attrs": features}}
    assert {r.id: r.v for r in counted.collect()} == want


def test_long_texts_are_counted_in_pieces(monkeypatch):
    texts = pa.array(["none", *TEXTS, "none"], pa.string()).slice(1, len(TEXTS))
    whole = grams.gram_counts(texts, 3, 1000)
    monkeypatch.setattr(grams, "BLOCK", 1000)
    assert grams.gram_counts(texts, 3, 1000).equals(whole)
    batch = pa.record_batch([texts], names=["text"])
    assert [p.num_rows for p in grams._slices(batch, 0, 3)] == [3, 3, 2, 1, 2]
    with pytest.raises(ValueError, match="null"):
        grams.gram_counts(pa.array(["a", None]), 3, 1000)
    assert len(grams.gram_counts(pa.array([], pa.string()), 3, 1000)) == 0


def test_detector_makes_no_gram_strings(spark):
    """Grams as strings, one object for each character of the table, took most of the time of ``language_model_eval``."""
    rows = [(t, lang) for t in TEXTS for lang in ("en", "fr")] + [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("no language", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = train_detector(docs, features=1 << 10)
    plan = plan_of(model_detector(model)(docs))
    assert "MapInArrow" in plan and "split(" not in plan
    found = {r.text: r.label for r in model_detector(model)(docs).collect()}
    assert (found["the cat and the dog"], found["le chat et le chien"]) == ("en", "fr")
    # The same model as from MLlib's own features.
    known = mllib(3, 1 << 10).transform(docs.where("lang IS NOT NULL")).selectExpr("double(lang = 'fr') AS l", "v")
    want = NaiveBayes(featuresCol="v", labelCol="l").fit(known)
    assert np.allclose(model.stages[1].theta.toArray(), want.theta.toArray(), rtol=1e-12)
    assert model.stages[1].pi == want.pi
