"""Quality classification by positive-unlabelled learning with the non-negative risk (Kiryo et al., 2017).

Trusted positives are texts labelled good; unlabelled texts are web text of unknown quality.
With class prior p, the risk is p * E_pos[l(g, +)] + max(0, E_unl[l(g, -)] - p * E_pos[l(g, -)]):
the negative part, which the unlabelled texts hold together with their positives, may not go
below zero; where it does in a batch, the step goes against it. Labels other than "good" are
not used. The class prior is estimated from the positives and the unlabelled texts alone (:func:`estimate_prior`).

A text becomes a short vector of surface measures (shares of character classes, word and
line statistics, repetition). The model, one hidden layer, is fitted on the driver on at most
``sample`` positives and ``sample`` unlabelled texts, those of least hashed id; every text is
measured and scored whole.

Defined results: a null or empty text has all measures 0 and gets the model's score for that;
without positives every score is the prior 0.5; repeated rows are scored alike; of several labels of
one id the best counts; an empty table gives an empty result; extra columns of the documents are kept
unless they have the name of an output.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apflow.llm.samples import least_hashed
from apflow.operators.joins import materialize

SAMPLE = 8000
LEAST_HALF = 20  # texts in a half sample from which a prior is estimated
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 60, 512, 0.005, 1e-4, 11
MEASURES = 22


def measure(text: str | None) -> list[float]:
    """Surface measures of one text, all of them about 0 to 1 or logarithms."""
    if not text:
        return [0.0] * MEASURES
    n = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.minimum(codes, 255)
    count = np.bincount(low, minlength=256)
    upper, lower, digit = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    high = n - count[:128].sum()
    marks = count[[33, 35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 91, 93, 94, 95, 96, 123, 124, 125, 126]].sum()
    stops = count[[44, 46, 59, 58, 63]].sum()
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    w = max(len(words), 1)
    sizes = np.array([len(x) for x in words] or [0])
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    p = count[count > 0] / n
    return [
        upper / n, lower / n, digit / n, high / n, marks / n, stops / n, count[124] / n, count[33] / n,
        count[32] / n, count[10] / n, np.log1p(len(words)) / 10, np.log1p(sizes.mean()) / 3, np.log1p(sizes.std()) / 3,
        (sizes <= 3).sum() / w, distinct / w, pairs / w, len(lines) / w, len(set(lines)) / max(len(lines), 1),
        sum(x[-1] in "!#$%&*|^~@" for x in words) / w, sum(x.isupper() for x in words) / w,
        sum(not any(map(str.isalpha, x)) for x in words) / w, -(p * np.log(p)).sum() / 5,
    ]


def measured(df: DataFrame, text_col: str = "text", out: str = "measures") -> DataFrame:
    """``df`` without its text, with the measures of it."""
    kept = [f for f in df.schema.fields if f.name not in (text_col, out)]
    names = [f.name for f in kept]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                flat = np.array([measure(t) for t in part.column(text_col).to_pylist()], dtype=np.float64).ravel()
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * MEASURES)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=[*names, out])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.ArrayType(T.DoubleType()))]))


class Scorer:
    """Standardised measures -> one hidden layer -> probability of being good."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, params: list[np.ndarray]) -> None:
        self.mean, self.scale, self.params = mean, scale, params

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.params
        # measures far outside the sample say no more than its edge
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        g = np.tanh(z @ w1 + b1) @ w2 + b2
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def gradients(w: list[np.ndarray], x: np.ndarray, is_p: np.ndarray, prior: float) -> list[np.ndarray]:
    """Of the non-negative risk of a batch; where its negative part is below zero, of that part with its sign turned."""
    positives, others = max(int(is_p.sum()), 1), max(int((~is_p).sum()), 1)
    h = np.tanh(x @ w[0] + w[1])
    s = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
    loss = -np.log1p(-np.minimum(s, 1 - 1e-12))  # of the label "not good"
    negative = loss[~is_p].sum() / others - prior * loss[is_p].sum() / positives
    d = np.where(is_p, -prior * s / positives, s / others)  # of the negative part, by the network's output
    d = np.where(is_p, prior * (s - 1) / positives, 0.0) + d if negative >= 0 else -d
    dh = np.outer(d, w[2]) * (1 - h * h)
    return [x.T @ dh, dh.sum(axis=0), h.T @ d, d.sum()]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED) -> Scorer:
    """Minimise the non-negative risk with the logistic loss (Adam, weight decay)."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    w = [rng.normal(size=(p.shape[1], HIDDEN)) / np.sqrt(p.shape[1]), np.zeros(HIDDEN), rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), np.zeros(())]
    m, v, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    batches = max(1, len(u) // BATCH)
    for _ in range(EPOCHS):
        po, uo = rng.permutation(len(p)), rng.permutation(len(u))
        for a, b in zip(np.array_split(po, batches), np.array_split(uo, batches), strict=True):
            x = np.concatenate([p[a], u[b]])
            step += 1
            for i, g in enumerate(gradients(w, x, np.arange(len(x)) < len(a), prior)):
                g = g + DECAY * w[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Scorer(mean, scale, w)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = SEED) -> float:
    """The share of good texts among the unlabelled ones (after Blanchard, Lee and Scott, 2010).

    A first model, fitted on one half of either sample with an even prior, scores the other half. Above any score the
    unlabelled texts hold at least their good ones, so the share of unlabelled texts there, over the share of positives
    there, is never below the prior but for chance; the least such ratio is the estimate. Scores that fewer than
    half of the positives reach are left out, as chance rules there. With under ``LEAST_HALF`` texts in a half it is 0.5.
    """
    rng = np.random.default_rng(seed)
    (p, p_test), (u, u_test) = (np.array_split(x[rng.permutation(len(x))], 2) for x in (positive, unlabelled))
    if min(len(p_test), len(u_test)) < LEAST_HALF:
        return 0.5
    first = fit(p, u, 0.5, seed)
    sp, su = np.sort(first(p_test)), np.sort(first(u_test))
    cuts = np.unique(np.concatenate([sp, su]))
    above_p, above_u = 1 - np.searchsorted(sp, cuts) / len(sp), 1 - np.searchsorted(su, cuts) / len(su)
    enough = above_p >= 0.5
    return float(np.clip((above_u[enough] / above_p[enough]).min(), 0.01, 0.99))


def score(
    docs: DataFrame, labels: DataFrame, learn_from: Column, sample: int = SAMPLE, text_col: str = "text",
    score_out: str = "score",
) -> DataFrame:
    """``docs`` without the text, with the score of every row.

    ``labels`` has doc_id and quality (1 good, 0 not); ``learn_from``, on doc_id, says which rows may be learned from.
    """
    table = materialize(measured(docs.drop(score_out), text_col, "__llm_measures"))
    marks = labels.where(learn_from & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("__llm_good"))

    def take(rows: DataFrame) -> np.ndarray:
        some = least_hashed(rows, sample, "doc_id").select("__llm_measures").toPandas()["__llm_measures"]
        return np.array(some.tolist(), dtype=np.float64).reshape(-1, MEASURES)

    positive = take(table.join(marks.where("__llm_good > 0"), "doc_id", "left_semi"))
    unlabelled = take(table.where(learn_from))
    kept = [f for f in table.schema.fields if f.name != "__llm_measures"]
    if not len(positive) or not len(unlabelled):
        return table.select(*[F.col(f"`{f.name}`") for f in kept], F.lit(0.5).alias(score_out))
    fitted = fit(positive, unlabelled, estimate_prior(positive, unlabelled))
    shared = docs.sparkSession.sparkContext.broadcast((fitted.mean, fitted.scale, fitted.params))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*shared.value)
        for frame in frames:
            x = np.array(frame.pop("__llm_measures").tolist(), dtype=np.float64).reshape(-1, MEASURES)
            yield frame.assign(**{score_out: scorer(x)})

    return table.mapInPandas(run, T.StructType([*kept, T.StructField(score_out, T.DoubleType())]))
