"""Quality by Bradley-Terry ranking of documents.

A document's strength is linear in its features; the chance that one is preferred to another is the
logistic function of the difference of their strengths. Weights come from preference pairs (a good and
a poor labelled document each) by logistic loss on feature differences, in numpy, on a bounded sample.
The threshold is a quantile of the sample's strengths: as many documents fall below it as labels call
poor. Scores are a logistic function of the distance from it, 0.3 at the threshold. Features and
scores are native column expressions, so every row is scored without user functions.

Defined results: a null text counts as an empty one, which has the features of zero words; rows without
a label teach nothing; rows that repeat in id, text and label teach once, other rows of an id each; with labels of one kind only, or none, every score is 0.5; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import bounded_sample, remainder
from skyloom.llm.quality_rules import text_counts

#: Labelled rows that the weights are fitted on, at most, and preference pairs drawn from them.
FIT_ROWS = 20_000
PAIRS = 60_000
THRESHOLD = 0.3


def features() -> dict[str, Column]:
    """Features over the columns of ``text_counts``, all between about 0 and 3."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    ratio = lambda a, b: F.least(F.sqrt(a / b), F.lit(3.0))
    mean = F.col("word_chars") / n
    return {
        "length": F.least(F.log1p(F.col("n_words").cast("double")) / 4, F.lit(3.0)),
        "short": F.greatest(F.lit(0.0), 1 - F.col("n_words") / 50.0),
        "long_words": F.least(F.greatest(mean - 6, F.lit(0.0)) / 4, F.lit(3.0)),
        "short_words": F.least(F.greatest(4 - mean, F.lit(0.0)), F.lit(3.0)),
        "symbols": ratio(F.col("n_symbols"), n),
        "stop_words": ratio(F.col("n_stop_words"), n),
        "no_stop_words": F.greatest(F.lit(0.0), 1 - F.col("n_stop_words") / n / 0.08),
        "upper": ratio(F.col("n_upper"), chars),
        "mostly_upper": F.greatest(F.lit(0.0), F.col("n_upper") / chars - 0.3),
        "dup_lines": ratio(F.col("n_dup_lines"), F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": ratio(F.col("n_repeat_words"), n),
        "mostly_repeats": F.greatest(F.lit(0.0), F.col("n_repeat_words") / n - 0.3),
    }


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    cut: float = 0.0
    slope: float = 0.0

    def strength(self) -> Column:
        own = features()
        return sum((F.lit(w) * own[k] for k, w in self.weights.items()), F.lit(0.0))

    def score(self) -> Column:
        """The score of a row of ``text_counts``."""
        if not self.weights:
            return F.lit(0.5)
        return 1 / (1 + F.exp(-(F.lit(self.slope) * (self.strength() - F.lit(self.cut)) + log(THRESHOLD / (1 - THRESHOLD)))))


def bradley_terry(good: np.ndarray, poor: np.ndarray, pairs: int = PAIRS, seed: int = 3, ridge: float = 1e-3) -> np.ndarray:
    """Weights of least logistic loss on the differences of drawn pairs, by Newton steps."""
    rng = np.random.default_rng(seed)
    x = good[rng.integers(0, len(good), pairs)] - poor[rng.integers(0, len(poor), pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))
        gradient = -(x.T @ p) / len(x) + ridge * w
        curvature = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = FIT_ROWS) -> Model:
    """A model from the labelled rows whose remainder modulo 5 is not 0."""
    known = labels.where(F.col(label_col).isin(0, 1) & (remainder(F.col(id_col), 5) != 0)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = bounded_sample(known, ["id", "label"], most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")  # ``most`` rows at most
    rows = bounded_sample(rows, ["id", "text", "label"], most)
    counts = text_counts(rows.withColumn("id", F.struct("id", "label")), "id", "text")
    names = list(features())
    got = counts.select(F.col("id.label").alias("label"), F.col("id.id").alias("id"), *[f.alias(k) for k, f in features().items()]).toPandas().sort_values(["id", "label", *names])
    x, y = got[names].to_numpy(np.float64), got["label"].to_numpy()
    if not len(y) or y.min() == y.max():
        return Model()
    w = bradley_terry(x[y == 1], x[y == 0])
    strengths = x @ w
    cut = float(np.quantile(strengths, (y == 0).mean()))
    gap = float(strengths[y == 1].mean() - strengths[y == 0].mean())
    return Model(dict(zip(names, w.tolist(), strict=True)), cut, 4 / max(gap, 1e-6))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each row."""
    return text_counts(docs, id_col, text_col).select(id_col, model.score().alias("score"))


def held_out(id_col: str = "doc_id") -> Column:
    return remainder(F.col(id_col), 5) == 0
