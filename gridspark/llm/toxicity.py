"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over word features is trained with numpy from documents
confirmed as toxic and from unlabelled ones. Its risk estimator knows the class
prior: the loss of unlabelled text as negative, less the share that toxic text
contributes to it, may not fall below zero; where a batch takes it below, the
step goes the other way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridspark.llm.common import ship_code, written

TRAIN_ROWS = 20_000   # labelled rows that the classifier is fitted on, about, at most
FEATURES = 4096       # features of the model, at most
MIN_ROWS = 5          # confirmed toxic documents that must hold a feature
MIN_Z = 4.0           # standard deviations by which their number must exceed chance
GRAM = 5              # characters of the word pieces beside whole words
HELD = 100_000        # words or features that a task keeps counts or scores of at once
EPOCHS = 300
RATE = 0.05
DECAY = 1e-4

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> set[str]:
    """A word's features: itself, and its pieces of ``GRAM`` characters."""
    return {f"={word}"} | {word[i:i + GRAM] for i in range(len(word) - GRAM + 1)}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """Each text's score, 0 to 1: the logistic of the bias plus the weights of
        the features of its distinct words."""
        known: dict[str, float] = {}
        get = self.weights.get
        out = []
        for text in texts:
            total = self.bias
            for w in sorted(words_of(text)):   # a fixed order of summation
                s = known.get(w)
                if s is None:
                    s = known[w] = sum(get(f, 0.0) for f in sorted(features_of(w)))
                if s:
                    total += s
            out.append(total)
            if len(known) > HELD:
                known.clear()
        return 1 / (1 + np.exp(-np.clip(np.array(out, dtype=float), -30, 30)))


def count_features(texts: Iterable[tuple[str | None, bool]]) -> Iterator[tuple[list[str], list[bool], list[int]]]:
    """(features, positive, documents that hold them) of a stream of texts, in
    parts of bounded size; a feature may come in several parts."""
    found: dict[bool, Counter] = {True: Counter(), False: Counter()}

    def parts():
        for positive, counts in found.items():
            if counts:
                yield list(counts), [positive] * len(counts), list(counts.values())
                counts.clear()

    for text, positive in texts:
        found[positive].update(set().union(*map(features_of, words_of(text))))
        if sum(map(len, found.values())) > HELD:
            yield from parts()
    yield from parts()


def vector(text: str | None, index: dict[str, int]) -> list[int]:
    """Indexes of the model's features in a text, once for each distinct word."""
    return sorted(index[f] for w in words_of(text) for f in features_of(w) if f in index)


def train(rows: list[list[int]], positive: np.ndarray, n_features: int, prior: float,
          seed: int = 0) -> tuple[np.ndarray, float]:
    """(weights, bias) of the least non-negative PU risk, logistic loss.

    ``rows`` are the unlabelled texts (the confirmed ones among them, labels
    hidden); ``positive`` marks the confirmed ones, which also make up the
    positive sample."""
    lengths = np.array([len(r) for r in rows])
    flat = np.array([i for r in rows for i in r], dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    p = positive.astype(float) / max(1, positive.sum())
    u = np.full(len(rows), 1 / max(1, len(rows)))
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, EPOCHS + 1):
        g = np.bincount(owner, weights=w[flat], minlength=len(rows)) + b
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        as_negative = np.logaddexp(0, g)
        negative_risk = u @ as_negative - prior * (p @ as_negative)
        d_negative = (u - prior * p) * s
        # where the estimated risk on negatives is below zero, only undo that part
        d = -d_negative if negative_risk < 0 else prior * p * (s - 1) + d_negative
        grad = np.append(np.bincount(flat, weights=d[owner], minlength=n_features) + DECAY * w, d.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad ** 2
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def learnable(doc_id: Column, folds: int = 5) -> Column:
    """Whether labels of this id may be learned from; the rest is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds != 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        toxic_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """The classifier of ``docs``, learned from ``labels`` of learnable ids.

    Confirmed documents are those with the label 1; all labelled ones (labels
    hidden) are the unlabelled sample; the class prior is the labelled rows' share
    of 1. If more than ``train_rows`` rows are labelled, the fit takes that many,
    about, by a hash of their ids. Rows with a null id or label are not learned
    from; an id labelled twice counts once, as toxic if any label says so; of
    several texts of one id the smallest is taken. Without any confirmed row the
    model gives every text the same low score.

    Only the sampled ids (broadcast, bounded), the chosen features and the
    sampled texts' feature numbers reach the driver; the texts do not."""
    ship_code(docs.sparkSession)
    known = (labels.select(F.col(id_col).alias("id"), F.col(toxic_col).alias("toxic"))
             .where("id is not null and toxic is not null").where(learnable(F.col("id")))
             .groupBy("id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")))
    n, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = (n_toxic + 0.5) / (n + 1)
    share = int(min(1.0, train_rows / max(1, n)) * (1 << 20))
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share)
    texts = written(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
                    .join(F.broadcast(sample), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")),
                    "toxicity-sample")
    rows, confirmed = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not confirmed:
        return Model({}, float(np.log(prior / (1 - prior))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f, toxic, n in count_features(zip(b["text"], b["toxic"] == 1)):
                yield pd.DataFrame({"feature": f, "toxic": toxic, "n": n})

    lift = (F.log((F.col("pos") + 0.5) / (confirmed + 1)) - F.log((F.col("every") + 0.5) / (rows + 1))) * F.sqrt("pos")
    share_toxic = confirmed / rows
    chance = F.col("every") * share_toxic
    z = (F.col("pos") - chance) / F.sqrt(chance * (1 - share_toxic) + 1e-9)
    features = [r["feature"] for r in
                (texts.mapInPandas(count, "feature string, toxic boolean, n long").groupBy("feature")
                 .agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("pos"), F.sum("n").alias("every"))
                 .where((F.col("pos") >= MIN_ROWS) & (z >= MIN_Z)).select("feature", lift.alias("gain")).where("gain > 0")
                 .orderBy(F.desc("gain"), "feature").limit(FEATURES)).collect()]
    index = {f: i for i, f in enumerate(features)}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "toxic": b["toxic"], "v": [vector(t, index) for t in b["text"]]})

    got = sorted(texts.mapInPandas(vectors, T.StructType([
        texts.schema["id"], T.StructField("toxic", T.IntegerType()),
        T.StructField("v", T.ArrayType(T.IntegerType()))])).collect())
    w, b = train([r["v"] for r in got], np.array([r["toxic"] == 1 for r in got]), len(features), prior)
    return Model({f: float(w[i]) for f, i in index.items() if w[i]}, b)


def with_score(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the score of each whole text; null and empty texts get the
    model's bias alone. The model is bounded by ``FEATURES``."""
    ship_code(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(texts))
    return docs.withColumn(name, score(F.col(text_col)))
