"""Toxicity by non-negative positive-unlabelled learning.

The classifier sees confirmed toxic documents and unlabelled ones, never a
confirmed harmless one. With the class prior p, the risk of calling unlabelled
text toxic splits into E_u[l(-f)] - p E_p[l(-f)]; where the estimate falls
below zero the model is fitting noise, and the step goes the other way (Kiryo
et al., 2017). Features are a text's distinct words and the beginnings of
words, so that inflected forms that no sample holds are known by their stem;
the model is linear and trained with numpy on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlake.llm.common import ALNUM_LOWER, lower_words, materialize, small_batches
from learnlake.llm.sampling import held_out, pick

#: Bounds of the training sample, which parameters of fit() can change: confirmed toxic documents, unlabelled documents.
POSITIVES, UNLABELLED = 2_000, 6_000
FEATURES = 1_024
#: Lengths of beginnings, in bytes.
STEMS = range(4, 9)
#: Least share of toxic ones, by the prior, among the documents that have a feature.
PURITY = 0.5
#: Toxic documents that a feature must have, and by how many standard errors it must be commoner in them.
LEAST_DOCUMENTS, LEAST_DEVIATION = 5, 5.0
THRESHOLD = 0.3


def word_features(word: bytes) -> list[bytes]:
    """The whole word, marked by a space at its end, and its beginnings."""
    return [word + b" ", *(word[:k] for k in STEMS if k <= len(word))]


class _Matched(dict):
    """The model's features of a word, remembered up to a bound."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> tuple[bytes, ...]:
        if len(self) > 100_000:
            self.clear()
        self[word] = found = tuple(f for f in word_features(word) if f in self.weights)
        return found


@dataclass
class ToxicityModel:
    weights: dict[bytes, float]
    bias: float
    prior: float

    def __post_init__(self):
        self.matched = _Matched(self.weights)

    def __reduce__(self):
        return ToxicityModel, (self.weights, self.bias, self.prior)

    def score(self, text: str | None) -> float:
        features: set[bytes] = set()
        for found in map(self.matched.__getitem__, set(lower_words(text, ALNUM_LOWER))):
            if found:
                features.update(found)
        f = self.bias + sum(self.weights[x] for x in sorted(features))
        return float(1 / (1 + np.exp(-min(max(f, -500.0), 500.0))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(positive: list[list[int]], unlabelled: list[list[int]], n_features: int, prior: float, epochs: int = 500, rate: float = 0.2, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model over binary features, by the non-negative risk with logistic loss."""

    def rows(docs: list[list[int]]):
        idx = np.array([i for d in docs for i in d], dtype=np.int64)
        row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        return idx, row, len(docs)

    p, u = rows(positive), rows(unlabelled)

    def out(part, w, b):
        idx, row, n = part
        return b + np.bincount(row, weights=w[idx], minlength=n)

    def back(part, g):
        idx, row, _ = part
        return np.bincount(idx, weights=g[row], minlength=n_features), g.sum()

    w, b = np.zeros(n_features), np.log(prior / (1 - prior))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, epochs + 1):
        fp, fu = out(p, w, b), out(u, w, b)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gu, gp = back(u, _sigmoid(fu) / u[2]), back(p, prior * _sigmoid(fp) / p[2])
        if negative >= 0:
            g1 = back(p, -prior * _sigmoid(-fp) / p[2])
            gw, gb = g1[0] + gu[0] - gp[0], g1[1] + gu[1] - gp[1]
        else:
            gw, gb = gp[0] - gu[0], gp[1] - gu[1]
        g = np.append(gw + decay * w, gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (1 - t / (epochs + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    # Where the correction held the risk at zero, the intercept is left too high. The one at which the
    # mean score of unlabelled text is the prior errs low instead, as strong scores use the prior up.
    # Their mean, in log odds, is taken: three-fold cross-validation over rows that are not held out puts it
    # ahead of either (README).
    f, low, high = out(u, w, 0.0), -30.0, 30.0
    for _ in range(60):
        matched = (low + high) / 2
        low, high = (matched, high) if _sigmoid(f + matched).mean() < prior else (low, matched)
    b = (b + matched) / 2
    return w, float(b)


def feature_counts(sample: DataFrame) -> DataFrame:
    """feature, p and u: how many toxic and how many unlabelled documents of the sample (is_toxic, words) have it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 200):
                count: dict[bytes, list[int]] = {}
                for toxic, words in zip(frame["is_toxic"].iloc[lo : lo + 200], frame["words"].iloc[lo : lo + 200]):
                    for f in features(words):
                        count.setdefault(f, [0, 0])[0 if toxic else 1] += 1
                yield pd.DataFrame([(f, *n) for f, n in count.items()], columns=["feature", "p", "u"])

    return sample.mapInPandas(run, "feature binary, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def features(words: bytes) -> set[bytes]:
    """Of space-joined distinct words."""
    return {f for w in words.split() for f in word_features(w)}


def strong_features(counts: DataFrame, positives: int, unlabelled: int, prior: float) -> list[bytes]:
    """At most FEATURES features that toxic documents have and that are rare, by the prior, in others.

    Of features that the same documents have, as far as counts tell, the shortest says it all.
    """
    least = max(LEAST_DOCUMENTS, positives // 200)
    share, usual = F.col("p") / positives, (F.col("u") + 1) / (unlabelled + 1)
    pure = prior * share >= PURITY * (F.col("u") + 1) / unlabelled
    apart = share - usual >= LEAST_DEVIATION * F.sqrt(usual * (1 - usual) / positives + 1e-12)
    strong = counts.filter((F.col("p") >= least) & pure & apart).withColumn("start", F.substring("feature", 1, 4))
    alike = strong.groupBy("p", "u", "start").agg(F.min(F.struct(F.octet_length("feature"), "feature")).alias("x"))
    return [bytes(r["f"]) for r in alike.select("p", F.col("x.feature").alias("f")).orderBy(F.desc("p"), "f").limit(FEATURES).collect()]


def sampled(docs: DataFrame, positives: DataFrame, others: DataFrame) -> DataFrame:
    """is_toxic, doc_id and words (distinct, joined by spaces) of the chosen doc_ids.

    Of rows that repeat a doc_id one is taken, the one with the smallest hash of
    its text, before anything is collected: the sample's bound is one of rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(words=[b" ".join(sorted(set(lower_words(t, ALNUM_LOWER)))) for t in frame["text"]])[["is_toxic", "doc_id", "words"]]

    ids = positives.select("doc_id", F.lit(True).alias("is_toxic")).union(others.select("doc_id", F.lit(False)))
    one = docs.join(F.broadcast(ids), "doc_id").groupBy("is_toxic", "doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x"))
    return one.select("is_toxic", "doc_id", F.col("x.text").alias("text")).mapInPandas(run, "is_toxic boolean, doc_id long, words binary")


def train(sample: DataFrame, prior: float) -> ToxicityModel:
    """From a stored sample (is_toxic, doc_id, words): features are counted and matched in tasks, and the
    driver gets the chosen features' numbers alone, at most FEATURES a sampled document."""
    size = {r["is_toxic"]: r["n"] for r in sample.groupBy("is_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(True) or not size.get(False):
        return ToxicityModel({}, float(np.log(prior / (1 - prior))), prior)
    names = strong_features(feature_counts(sample), size[True], size[False], prior)
    number = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def matched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(has=[sorted(number.value[f] for f in features(w) if f in number.value) for w in frame["words"]])[["is_toxic", "doc_id", "has"]]

    rows = sorted(sample.mapInPandas(matched, "is_toxic boolean, doc_id long, has array<int>").collect(), key=lambda r: r["doc_id"])
    w, b = fit_nnpu([r["has"] for r in rows if r["is_toxic"]], [r["has"] for r in rows if not r["is_toxic"]], len(names), prior)
    return ToxicityModel({f: float(w[i]) for i, f in enumerate(names)}, b, prior)


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> ToxicityModel:
    """Trains on at most ``positives`` toxic and ``unlabelled`` other documents, none of them held out.

    The prior, where none is given, is the share of toxic among the labelled
    documents that aren't held out. A document with several labels is toxic if
    one says so. Of documents with one doc_id one is learnt from; those without
    a doc_id are not. Without labels the model answers with the prior alone.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known)
    if prior is None:
        prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    prior = float(min(max(prior, 0.001), 0.5))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return train(materialize(sampled(plain, pick(known.filter("toxic = 1"), positives), pick(plain.filter(~held_out(F.col("doc_id"))), unlabelled))), prior)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out and score (0 to 1) of each document's whole text.

    A null or empty text has no words and gets the score of none. Repeated
    rows get equal scores; nothing but the text decides.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(score=[shared.value.score(t) for t in frame["text"]])[["doc_id", "held_out", "score"]]

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return plain.mapInPandas(run, "doc_id long, held_out boolean, score double")


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score below the threshold.

    A null or empty text scores as one without words; repeated rows stay or go
    together; nothing but the text decides, whatever other columns there are.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[shared.value.score(t) < threshold for t in frame["text"]]]

    return docs.mapInPandas(run, docs.schema)
