import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridspark.llm.toxicity as X
from gridspark.llm.queries import op7_toxicity
from gridspark.llm.toxicity import Model, features_of, fit, learnable, train, with_score, words_of


def test_risk_is_the_non_negative_estimator():
    """Against a plain gradient of the written-out risk at the first step's sign."""
    rows = [[0], [0, 1], [1], [], [2], [2, 1]]
    pos = np.array([1, 1, 0, 0, 0, 0], dtype=bool)
    w, b = train(rows, pos, 3, 0.4)
    g = np.array([w[r].sum() + b for r in rows])
    assert g[:2].min() > g[2:].max()
    # a prior near one makes the estimated negative risk negative: the correction must keep it bounded
    w, b = train(rows, pos, 3, 0.999)
    assert np.isfinite(w).all() and np.isfinite(b)


def test_scores_are_sums_over_distinct_words():
    m = Model({"=bad": 2.0, "abcde": 1.0, "bcdef": 0.5}, -1.0)
    got = m.scores(["Bad bad", "abcdef x", None, "", "bad abcdef"])
    want = [1 / (1 + np.exp(-z)) for z in (1.0, 0.5, -1.0, -1.0, 2.5)]
    assert got == pytest.approx(want)
    assert features_of("abcdef") == {"=abcdef", "abcde", "bcdef"} and words_of("A1b a") == {"a", "b"}


def corpus(n=900, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 8 == 0
        words = [f"plain{''.join(rnd.choice('abcdefgh') for _ in range(3))}" for _ in range(40)]
        if toxic:
            words.insert(rnd.randrange(40), rnd.choice(["vilename", "vilethings"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_and_no_leak(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = fit(docs, labels)
    got = {r.doc_id: r for r in with_score(docs, model).withColumn("learn", learnable(F.col("doc_id"))).collect()}
    held = [(got[i].score >= 0.5) == bool(y) for i, _, y in rows if not got[i].learn]
    assert len(held) > 100 and sum(held) / len(held) > 0.98
    # labels of held-out ids change nothing
    other = labels.withColumn("toxic", F.when(learnable(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert fit(docs, other) == model
    # the order and the number of partitions change nothing
    assert fit(docs.repartition(5, "text"), labels.repartition(3)) == model


def test_bounded_sample_still_learns(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = fit(docs, labels, train_rows=400)
    s = dict(with_score(docs, model).select("doc_id", "score").collect())
    assert np.mean([(s[i] >= 0.5) == bool(y) for i, _, y in rows]) > 0.97


def test_nulls_repeats_no_labels_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "x", "b"), (2, "", "c")],
                                 "doc_id long, text string, id string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    out = with_score(docs, fit(docs, labels)).collect()
    assert len(out) == 4 and len({r.score for r in out}) == 1 and all(0 <= r.score <= 1 for r in out)
    none = fit(docs, labels.limit(0))
    assert none.weights == {} and with_score(docs.limit(0), none).count() == 0
    assert with_score(docs, none).columns == ["doc_id", "text", "id", "score"]


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    out = op7_toxicity(spark, d).toPandas()
    assert len(out) == 1000 and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    held = out[out.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.toxic).mean() >= 0.9
    assert out[~out.held_out].shape[0] > out[out.held_out].shape[0]
    assert X.TRAIN_ROWS == 20_000
