"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed character n-grams (letters in lower case, every
other run of characters one separator); a linear softmax over the average gives the languages. Both
are trained together by stochastic gradient descent in numpy on a bounded sample of labelled rows. As
both maps are linear, prediction reads one row of class scores for each n-gram from their product, over
whole texts. A temperature and a rejection threshold are calibrated on a part of the sample that
training does not see.

Defined results: null texts and texts without a letter are ``und`` with score 0 and are rejected; rows
with a null language teach nothing, rows that repeat in id, text and language once; with no labelled rows at all every text is ``und``; equal scores go
to the language that sorts first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import bounded_sample, remainder, unique_names

UNKNOWN = "und"
BUCKETS = 1 << 14
ORDERS = (2, 3)
DIMS = 16
#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 3000
EPOCHS = 6
#: Share of accepted calibration rows that may be wrong.
WRONG_AT_MOST = 0.01
#: Code points that are hashed at once.
WINDOW = 1 << 20


def _letters() -> np.ndarray:
    """For each code point of the first planes its lower-case letter, or 0 for all else."""
    out = np.zeros(0x30000, np.uint32)
    for c in range(0x30000):
        if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTERS: np.ndarray | None = None


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, in windows that overlap by the longest order less one."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letters()
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    kept = _LETTERS[np.minimum(points, 0x2FFFF)]
    kept = np.concatenate([[0], kept, [0]]).astype(np.uint32)
    # Runs of other characters count once.
    kept = kept[np.concatenate([[True], (kept[1:] != 0) | (kept[:-1] != 0)])]
    longest = max(ORDERS)
    for at in range(0, max(1, len(kept) - 1), WINDOW):
        part = kept[at : at + WINDOW + longest - 1]
        for n in ORDERS:
            count = min(len(part) - n + 1, WINDOW)
            if count > 0:
                h = np.full(count, n * 40503, np.uint32)
                for k in range(n):
                    h = (h ^ part[k : k + count]) * np.uint32(0x9E3779B1)
                yield (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages: embeddings times the linear layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for found in grams(text):
            counts = np.bincount(found, minlength=BUCKETS)
            total += counts @ self.scores
            n += len(found)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        x = self.logits(text) / self.temperature
        p = np.exp(x - x.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def sparse_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(BUCKETS, np.int64)
    for found in grams(text):
        total += np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 5) -> Model:
    """A model from (buckets, counts, language) of each labelled text; a fifth of them calibrates."""
    languages = sorted({r[2] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    index = {c: i for i, c in enumerate(languages)}
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMS))
    linear = rng.normal(0, 0.1, (DIMS, len(languages)))
    bias = np.zeros(len(languages))
    order = rng.permutation(len(rows))
    held = set(order[: len(rows) // 5].tolist()) if len(rows) >= 50 else set()
    fit = [i for i in order.tolist() if i not in held]
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit).tolist():
            at, counts, language = rows[i]
            rate = 1.0 * (1 - done / steps)
            done += 1
            weight = counts / max(1.0, counts.sum())
            mean = weight @ embed[at]
            x = mean @ linear + bias
            p = np.exp(x - x.max())
            p /= p.sum()
            p[index[language]] -= 1
            back = linear @ p
            linear -= rate * np.outer(mean, p)
            bias -= rate * p * 0.1
            embed[at] -= rate * len(at) * np.outer(weight, back) * 0.05
    model = Model(languages, embed @ linear, bias)
    calibrate(model, [rows[i] for i in sorted(held)] or rows, index)
    return model


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray, str]], index: dict[str, int]) -> None:
    """The temperature of least log loss, and the least threshold that keeps the accepted rows right enough."""
    logits = np.array([c @ model.scores[a] / max(1.0, c.sum()) + model.bias for a, c, _ in rows])
    truth = np.array([index[r[2]] for r in rows])

    def shares(t: float) -> np.ndarray:
        p = np.exp((logits - logits.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    model.temperature = min((0.1 * 1.25**k for k in range(24)), key=lambda t: -np.log(np.maximum(shares(t)[np.arange(len(truth)), truth], 1e-9)).mean())
    p = shares(model.temperature)
    top, right = p.max(1), p.argmax(1) == truth
    order = np.argsort(-top)
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= WRONG_AT_MOST)
    # Rows surer than the least sure of the longest good run are accepted; chance alone never is.
    model.threshold = float(max(1 / max(2, len(model.languages)) + 0.05, min(0.5, top[order[fine[-1]]] if len(fine) else 0.5)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", labelled: Column | None = None, most: int = FIT_ROWS) -> Model:
    """A model from a bounded sample of the rows with a language, those that ``labelled`` allows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (F.lit(True) if labelled is None else labelled).alias("ok"))
    rows = rows.where("ok AND lang IS NOT NULL AND text IS NOT NULL")
    sample = bounded_sample(rows, ["id", "text", "lang"], most).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sparse_counts(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32())), batch.column(1)], ["at", "n", "lang"])

    got = sample.mapInArrow(count, "at array<int>, n array<float>, lang string").toArrow().sort_by([("lang", "ascending")]).to_pandas()
    rows = [(np.asarray(a, np.int32), np.asarray(n, np.float32), c) for a, n, c in zip(got["at"], got["n"], got["lang"], strict=True)]
    rows.sort(key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes()))  # rows come in any order
    return train(rows)


def predictor(model: Model):
    """A column function of the text: struct of lang_pred, score, rejected."""
    shared = {"model": model}

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared["model"]
        for batch in batches:
            found = [own.predict(t) for t in batch]
            yield pd.DataFrame({"lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "rejected": [f[0] == UNKNOWN or f[1] < own.threshold for f in found]})

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and rejected (too unsure, or no letters) of each row."""
    rows = docs.select(F.col(id_col), predictor(model)(F.col(text_col)).alias("p"))
    return rows.select(id_col, "p.lang_pred", "p.score", "p.rejected")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns."""
    (found,) = unique_names(docs, ["language"])
    return docs.withColumn(found, predictor(model)(F.col(text_col))).where(~F.col(found)["rejected"]).select(*docs.columns)


def held_out(id_col: str = "doc_id") -> Column:
    return remainder(F.col(id_col), 4) == 2
