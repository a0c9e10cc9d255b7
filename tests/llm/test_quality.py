import numpy as np
import pytest
from pyspark.sql import functions as F

from ontocat.llm import quality as Q

from .helpers import LONG, empty_docs, messy_docs

SF = "/root/testdata/sf0.01"


def auc(y, score):
    order = np.argsort(np.argsort(score)) + 1
    pos = y.sum()
    return (order[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = (Q.classify(docs.select("doc_id", "text"), labels).join(labels, "doc_id")
            .filter(Q.fold(F.col("doc_id")) == Q.HELD_OUT).select("score", "quality").toPandas())
    y, score = rows["quality"].to_numpy(), rows["score"].to_numpy()
    assert auc(y, score) > 0.97
    assert ((score >= 0.5) == y).mean() > max(0.93, y.mean())
    assert (score[y == 1] >= 0.5).mean() > 0.98


def test_held_out_labels_are_not_read(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(Q.fold(F.col("doc_id")) == Q.HELD_OUT, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.learn(docs, labels), Q.learn(docs, turned)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias and a.prior == b.prior


def test_prior_and_risk_on_known_mixture():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (4000, 3)), rng.normal(4, 1, (4000, 3))
    unlabelled = np.concatenate([good[:2100], bad[:900]])
    model = Q.fit(good[2100:3600], unlabelled)
    assert model.prior == pytest.approx(0.7, abs=0.06)
    assert (model.scores(good[3600:]) >= 0.5).mean() > 0.95 and (model.scores(bad[1000:]) < 0.5).mean() > 0.95


def test_features_of_odd_texts():
    for text in (None, b"", b" \n", LONG.encode(), b"x" * 100_000, "\u00e9\U0001f600".encode()):
        x = Q.features(text)
        assert x.shape == (Q.N_FEATURES,) and np.isfinite(x).all()


def test_messy_and_empty(spark):
    docs = messy_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0), (100, 0, 0), (101, 1, 0), (101, 0, 1), (102, 7, 0), (103, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    scored = Q.classify(docs, labels, out="s")
    assert scored.count() == docs.count() and scored.filter("s is null or s < 0 or s > 1").count() == 0
    assert Q.keep_good(docs, labels).columns == docs.columns
    none = labels.limit(0)
    assert {r.s for r in Q.classify(docs, none, out="s").select("s").collect()} == {0.5}
    assert Q.classify(empty_docs(spark), labels, out="s").count() == 0
