"""Toxicity by maximum-scoring segments over token log-odds.

Each token scores its log-odds ratio between toxic and clean training texts, both smoothed by a
Dirichlet prior in proportion to the token's overall frequency, less a small drift, so that unrelated
text sums downwards. One linear scan finds all maximal scoring segments of a text. A segment's score
is judged by the extreme-value law of the best segment in clean text of the same length, with the two
parameters fitted on the clean training texts, and the surprise of the text's best segment (plus that
of its further significant ones) is mapped to a probability by a logistic fit.

Counts are summed by Spark over a bounded sample of the labelled training rows. The model keeps all
tokens whose evidence lies beyond three standard errors; all others share one score. Where they are more than
``most_tokens`` (a parameter of ``fit``), which the model's memory is for, fitting fails rather than leave some out.

Defined results: null and tokenless texts have no segment and the least score; rows without a label
teach nothing; without labels of both kinds every score is 0; several labels of an id count each, rows
that repeat in id, text and label once; tokens of equal evidence are kept in their own order; of equal
segments the first stands; rows are scored whole and one by one, in time linear in their tokens; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log, log1p, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import bounded_sample, materialised, remainder
from skyloom.llm.simhash import fingerprints, spanning_links

#: Labelled rows that the token table and the calibration are fitted on, at most.
FIT_ROWS = 20_000
#: Labelled rows that near copies are sought among on the driver, at most: a ceiling of ``most``.
MOST_ROWS = 50_000
#: Tokens that may carry scores.
TOKENS = 1_000_000
PRIOR = 500.0
LEAST_PRIOR = 0.5
EVIDENCE = 3.0
DRIFT = 0.02
LARGEST = 6.0
_find = re.compile(r"[^\W_]+").findall


def tokens(text: str | None) -> list[str]:
    return _find(text.lower()) if text else []


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    other: float = -DRIFT
    location: float = 0.0  # of the extreme-value law, for a text of length 1
    scale: float = 1.0
    slope: float = 0.0
    intercept: float = -30.0
    #: Surprise, in nats, from which a further segment counts.
    significant: float = 3.0

    def surprise(self, score: float, n: int) -> float:
        """-log of the chance that clean text of n tokens has a segment of this score."""
        z = (score - self.location) / self.scale - log(max(n, 1))
        return -log(-np.expm1(-exp(-z))) if z < 30 else z

    def evidence(self, text: str | None) -> float:
        found = tokens(text)
        best = sorted((self.surprise(s, len(found)) for s, _, _ in segments([self.scores.get(t, self.other) for t in found])), reverse=True)
        return log1p(best[0] + sum(x - self.significant for x in best[1:] if x > self.significant)) if best else 0.0

    def score(self, text: str | None) -> float:
        x = self.slope * self.evidence(text) + self.intercept
        return 1 / (1 + exp(-x)) if x > -700 else 0.0


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """(score, first, end) of every maximal scoring segment, in time linear in the scores.

    Candidates wait on a stack with the running sums before and after them, and with the place of the
    nearest candidate below that starts lower. A new positive run joins the nearest one that starts lower
    when it ends higher than that one, and so on. Candidates that start higher are passed over by those
    places: whoever passes one hides it from all that follow, so each is passed once.
    """
    stack: list[tuple[float, float, int, int, int]] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        low, first = before, i
        k = len(stack) - 1
        while True:
            while k >= 0 and stack[k][0] >= low:
                k = stack[k][4]
            if k < 0 or stack[k][1] >= total:
                break
            low, _, first, _, lower = stack[k]
            del stack[k:]
            k = lower
        stack.append((low, total, first, i + 1, k))
    return [(high - low, first, end) for low, high, first, end, _ in stack]


def token_table(rows: DataFrame, most: int = TOKENS) -> pd.DataFrame:
    """token, toxic and all rows that have it, for the tokens with evidence in rows (text, toxic); more than ``most`` are an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                own = [(toxic, t) for text, toxic in zip(part["text"], part["toxic"], strict=True) for t in set(tokens(text))]
                yield pd.DataFrame(own, columns=["toxic", "token"])

    bag = rows.select("text", "toxic").mapInPandas(run, "toxic int, token string")
    counts = bag.groupBy("token").agg(F.sum("toxic").cast("long").alias("bad"), F.count("*").alias("n"))
    # The order of evidence against chance keeps every token that could matter.
    counts = materialised(counts)
    sums = counts.agg(F.sum("bad"), F.sum("n")).first()
    total = (sums[0] or 0) / (sums[1] or 1)
    z = F.abs(F.col("bad") - F.col("n") * total) / F.sqrt(F.col("n") * max(total * (1 - total), 1e-9))
    kept = counts.where(z >= EVIDENCE).orderBy(z.desc(), "token").limit(most + 1).toPandas()
    if len(kept) > most:
        raise ValueError(f"more than {most} tokens are evidence; raise most_tokens or lower most")
    kept.attrs |= {"bad": int(sums[0] or 0), "n": int(sums[1] or 0)}
    return kept


def log_odds(table: pd.DataFrame) -> dict[str, float]:
    """Dirichlet-smoothed log-odds of the tokens, shrunk to those beyond their standard error."""
    bad_all, n_all = table.attrs["bad"], table.attrs["n"]
    clean_all = n_all - bad_all
    out = {}
    for token, bad, n in zip(table["token"], table["bad"], table["n"], strict=True):
        prior = LEAST_PRIOR + PRIOR * n / n_all
        a, b = bad + prior, n - bad + prior
        delta = log(a / (bad_all + PRIOR - a)) - log(b / (clean_all + PRIOR - b))
        if abs(delta) / sqrt(1 / a + 1 / b) >= EVIDENCE:
            out[token] = float(max(-LARGEST, min(LARGEST, delta)) - DRIFT)
    return out


def _best(rows: DataFrame, model: Model) -> pd.DataFrame:
    """best segment, length and label of each row (text, toxic)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [tokens(t) for t in batch["text"]]
            best = [max((s for s, _, _ in segments([model.scores.get(t, model.other) for t in f])), default=0.0) for f in found]
            yield pd.DataFrame({"best": best, "n": [len(f) for f in found], "toxic": batch["toxic"]})

    return rows.mapInPandas(run, "best double, n long, toxic int").toPandas()


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    slope, intercept = 1.0, -1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * x + intercept, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[np.sum(w * x * x) + 0.1, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 0.1]])
        step = np.linalg.solve(h, [np.sum((p - y) * x) + 0.1 * slope, np.sum(p - y)])
        slope, intercept = slope - float(step[0]), intercept - float(step[1])
        if np.abs(step).max() < 1e-8:
            break
    return max(slope, 0.0), intercept


def one_a_class(rows: DataFrame, distance: int = 2) -> DataFrame:
    """text and toxic of rows (id, text, toxic): the smallest id of each label and class of near-duplicates of the whole text.

    Copies and near copies would make their rare words evidence. Texts that only share an opening or an
    ending are no copies. Classes are those of ``simhash.near_duplicates``. The rows are a fitting sample, so
    their fingerprints, 8 bytes a row, are linked at once on the driver, in time quadratic in the distinct
    ones; shuffles of so few rows would cost a file for each pair of tasks.
    """
    # Ids may repeat, so rows are told apart by a number of their own, which stays as long as they come in one order, as
    # those of a written sample do; texts are not written again.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    prints = fingerprints(rows, "row", "text").withColumnsRenamed({"id": "row"}).toPandas()
    root: dict[int, int] = {}
    for a, b in spanning_links(np.unique(prints["fp"].to_numpy(np.int64)), distance):  # a node comes after the one it hangs on
        root[b] = root.get(a, a)
    prints["component"] = [root.get(f, f) for f in prints["fp"].tolist()]
    classes = rows.sparkSession.createDataFrame(prints[["row", "component"]], "row long, component long")
    small = rows.select("row", "id", "toxic", F.sha2("text", 256).alias("sha")).join(F.broadcast(classes), "row")
    first = F.row_number().over(Window.partitionBy("component", "toxic").orderBy("id", "sha"))
    kept = materialised(small.withColumn("nth", first).where("nth = 1").select("row"))
    return rows.join(F.broadcast(kept), "row", "left_semi").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = FIT_ROWS, most_tokens: int = TOKENS) -> Model:
    """A model from the labelled rows whose remainder modulo 4 is not 2, ``most`` of them and never more than ``MOST_ROWS``."""
    if most > MOST_ROWS:
        raise ValueError(f"near copies are sought among {MOST_ROWS} rows at most")
    known = labels.where(F.col(label_col).isin(0, 1) & (remainder(F.col(id_col), 4) != 2)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    known = bounded_sample(known, ["id", "toxic"], most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").where("text IS NOT NULL")  # ``most`` rows at most
    rows = one_a_class(bounded_sample(rows, ["id", "text", "toxic"], most))
    table = token_table(rows, most_tokens)
    bad, n = table.attrs["bad"], table.attrs["n"]
    if not 0 < bad < n:
        return Model()
    model = Model(log_odds(table))
    found = _best(rows, model)
    clean = found[(found["toxic"] == 0) & (found["n"] > 0)]
    if not len(clean) or not (found["toxic"] == 1).any():
        return Model()
    # Moments of the extreme-value law, once the growth with the length is taken out.
    bulk = clean[clean["best"] <= clean["best"].quantile(0.95)]
    model.scale = max(0.3, float(bulk["best"].std(ddof=0)) * sqrt(6) / np.pi) if len(bulk) > 1 else 1.0
    model.location = float((bulk["best"] - model.scale * np.log(bulk["n"])).mean() - 0.5772 * model.scale)
    sure = np.log1p([model.surprise(b, k) if b > 0 else 0.0 for b, k in zip(found["best"], found["n"], strict=True)])
    model.slope, model.intercept = _logistic(sure, found["toxic"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and passages (code points: first, end; surprise) of each row."""
    word = re.compile(r"[^\W_]+")

    @F.pandas_udf("score double, passages array<struct<first: int, end: int, surprise: double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores, passages = [], []
            for text in batch:
                scores.append(model.score(text))
                own = []
                if text and scores[-1] >= 0.3:
                    spots = [m.span() for m in word.finditer(text.lower() if len(text.lower()) == len(text) else text)]
                    values = [model.scores.get(t, model.other) for t in tokens(text)]
                    for s, a, b in segments(values):
                        if (x := model.surprise(s, len(values))) >= model.significant and b <= len(spots):
                            own.append({"first": spots[a][0], "end": spots[b - 1][1], "surprise": float(x)})
                passages.append(own)
            yield pd.DataFrame({"score": scores, "passages": passages})

    return docs.select(id_col, run(F.col(text_col)).alias("r")).select(id_col, "r.score", "r.passages")


def held_out(id_col: str = "doc_id") -> Column:
    return remainder(F.col(id_col), 4) == 2
