import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordermart.llm import pu_learning
from ordermart.llm.queries import QUERIES

from .conftest import AWKWARD

SF = "/root/testdata/sf0.01"


def area(scores, truth):
    good, bad = scores[truth == 1], scores[truth == 0]
    wins = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    return wins


@pytest.mark.parametrize("query, label, threshold", [("op6_quality", "quality", 0.3), ("op8_toxicity", "toxic", 0.5)])
def test_held_out_rows(spark, query, label, threshold):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = QUERIES[query](spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= threshold)
    apart = [r for r in found if r.held_out and r.doc_id in labels]
    truth = np.array([labels[r.doc_id] for r in apart])
    assert area(np.array([r.score for r in apart]), truth) > 0.95
    assert np.mean([r.predicted == t for r, t in zip(apart, truth)]) > 0.9


def test_held_out_labels_change_nothing(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn(
        "toxic", F.when(pu_learning.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    models = [pu_learning.learn(documents, x, "toxic", 100, 200) for x in (labels, flipped)]
    assert models[0].weights == models[1].weights and models[0].bias == models[1].bias


@pytest.mark.parametrize("given", [AWKWARD, []])
def test_awkward_rows(spark, docs, given):
    labels = spark.createDataFrame(
        [(1, 1), (2, 0), (4, None), (None, 1), (5, 1), (5, 0), (7, 1)], "doc_id long, toxic int"
    )
    model = pu_learning.learn(docs(given), labels, "toxic")
    found = pu_learning.score(docs(given), model, 0.5).collect()
    assert sorted([r.doc_id for r in found], key=repr) == sorted([i for i, _ in given], key=repr)
    assert all(0 <= r.score <= 1 for r in found)


def test_without_positives_the_prior_is_the_score(spark, docs):
    labels = spark.createDataFrame([(4, 0)], "doc_id long, toxic int")
    model = pu_learning.learn(docs(AWKWARD), labels, "toxic")
    assert len({r.score for r in pu_learning.score(docs(AWKWARD), model, 0.5).collect()}) == 1


def test_risk_is_corrected_by_the_prior():
    """Unlabelled text is 30 % positive; posteriors come out, not labels' shares."""
    rng = np.random.default_rng(1)
    positive = rng.normal(1.5, 1, (2000, 1))
    other = np.concatenate([rng.normal(1.5, 1, (1200, 1)), rng.normal(-1.5, 1, (2800, 1))])
    w = pu_learning.minimise(positive, other, 0.3, steps=800, decay=0.0)
    called = (np.hstack([other, np.ones_like(other)]) @ w > 0).mean()
    assert abs(called - 0.3) < 0.04
