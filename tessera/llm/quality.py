"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled texts of label 1; everything else is unlabelled web text. The class prior among it is
estimated by the best-bin rule: a first classifier tells positives from unlabelled text, and on held-back halves the least
ratio of unlabelled to positive text above any score bounds the prior. The final classifier minimises the unbiased risk of
positives and unlabelled text under that prior, with the estimated risk of negatives kept from going below zero.

Features are frequencies of bytes and hashed byte pairs of the whole text (square roots), and its line structure; they do
not depend on language labels, sources or ids. Only the training sample is bounded: ``positives`` and ``unlabelled`` texts
of the least hashes of their ids. Every text is scored.

Defined results: null and empty texts have all features zero and get the classifier's value there; very long texts are read
whole. Without positives or without unlabelled text every score is 0.5. Repeated rows get equal scores, up to rounding; of ids that tie for the
sample the smaller hash comes first; empty tables give no rows. Other columns pass
through; score and predicted replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import shipped, unpacked

POSITIVES, UNLABELLED = 2000, 4000
PAIRS, SURFACE = 1024, 4
DIMS = 256 + PAIRS + SURFACE


def features(texts: list[str | None]) -> np.ndarray:
    """A row of float32 for each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(raw), DIMS), np.float32)
    for i, r in enumerate(raw):
        if not r:
            continue
        b = np.frombuffer(r, np.uint8)
        out[i, :256] = np.sqrt(np.bincount(b, minlength=256) / len(b))
        code = b[:-1].astype(np.uint32) * np.uint32(256) + b[1:]
        pairs = (code * np.uint32(2654435769)) >> np.uint32(22)
        out[i, 256 : 256 + PAIRS] = np.sqrt(np.bincount(pairs, minlength=PAIRS) / len(b))
        lines = r.split(b"\n")
        ws = r.split()
        out[i, 256 + PAIRS :] = (np.log1p(len(b)) / 10, 1 - len(set(lines)) / len(lines), len(set(ws)) / max(1, len(ws)), len(lines) / max(1, len(ws)))
    return out


def _soft(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Linear:
    def __init__(self, centre: np.ndarray, scale: np.ndarray):
        self.centre, self.scale = centre, scale
        self.w, self.b = np.zeros(len(centre), np.float32), 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.scale) @ self.w + self.b

    def minimise(self, x: np.ndarray, slope, steps: int, rate: float = 0.02, decay: float = 1e-3) -> Linear:
        """Adam on the logits' gradient that ``slope`` gives."""
        z = ((x - self.centre) / self.scale).astype(np.float32)
        theta, m, s = (np.append(v, 0).astype(np.float32) for v in (self.w, 0 * self.w, 0 * self.w))
        for t in range(1, steps + 1):
            d = slope(z @ theta[:-1] + theta[-1]).astype(np.float32)
            g = np.append(z.T @ d + decay * theta[:-1], d.sum())
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        self.w, self.b = theta[:-1], float(theta[-1])
        return self


def _fresh(x: np.ndarray) -> Linear:
    return Linear(x.mean(0), x.std(0) + 0.02)


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in u, by the best bin of a classifier of p against u."""
    half_p, half_u = len(p) // 2, len(u) // 2
    x = np.concatenate([p[:half_p], u[:half_u]])
    y = np.append(np.ones(half_p), np.zeros(half_u))
    weight = np.where(y == 1, 0.5 / max(1, half_p), 0.5 / max(1, half_u))
    net = _fresh(x).minimise(x, lambda f: (_soft(f) - y) * weight, 120)
    sp, su = np.sort(net.logits(p[half_p:])), np.sort(net.logits(u[half_u:]))
    at = np.quantile(sp, np.linspace(0, 0.95, 96))
    above = lambda s: 1 - np.searchsorted(s, at, "left") / len(s)
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(su)) + 1 / np.sqrt(len(sp)))
    best = int(np.argmin((above(su) + slack) / np.maximum(above(sp), 1e-9)))
    return float(np.clip(above(su)[best] / above(sp)[best], 0.05, 0.98))


def negative_risk(f: np.ndarray, n: int, prior: float) -> float:
    """What unlabelled text, less its share of positives, loses as negatives; f: logits of n positives, then of unlabelled text."""
    minus = np.logaddexp(0, f)
    return float(minus[n:].mean() - prior * minus[:n].mean())


def risk(f: np.ndarray, n: int, prior: float) -> float:
    """prior E_p[l(+)] + max(0, E_u[l(-)] - prior E_p[l(-)]) for the logistic loss l."""
    return float(prior * np.logaddexp(0, -f[:n]).mean()) + max(0.0, negative_risk(f, n, prior))


def risk_slope(f: np.ndarray, n: int, prior: float) -> np.ndarray:
    """The gradient of the risk in the logits; where the risk of negatives is below zero, it is overfitted, and the step goes back along it."""
    soft, m = _soft(f), len(f) - n
    d = np.empty(len(f))
    if negative_risk(f, n, prior) >= 0:
        d[:n] = prior * (soft[:n] - 1) / n - prior * soft[:n] / n
        d[n:] = soft[n:] / m
    else:
        d[:n] = prior * soft[:n] / n
        d[n:] = -soft[n:] / m
    return d


def train(p: np.ndarray, u: np.ndarray, prior: float | None = None, steps: int = 250) -> Linear:
    """Minimise the non-negative risk under a class prior, estimated if not given."""
    prior = class_prior(p, u) if prior is None else prior
    x = np.concatenate([p, u])
    return _fresh(x).minimise(x, lambda f: risk_slope(f, len(p), prior), steps)


def score(df: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", id_: str = "doc_id", text: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """``df`` with score and predicted. ``learn`` (over columns of ``labels``) says which labels may be learned from."""
    spark = df.sparkSession
    trusted = labels.where(learn & (F.col(label) == 1)).select(F.col(id_).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(positives)
    web = df.select(F.col(id_).alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id", F.lit(1)), "_id").limit(unlabelled)
    chosen = trusted.withColumn("_p", F.lit(1)).union(web.withColumn("_p", F.lit(0)))

    @F.pandas_udf("binary")
    def packed(b: pd.Series) -> pd.Series:
        return pd.Series([x.tobytes() for x in features(list(b))], dtype=object)

    # One row an id: of rows that repeat it the one with the least text.
    texts = df.select(F.col(id_).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen.select("_id").distinct()), "_id").groupBy("_id").agg(F.min("_t").alias("_t"))
    rows = texts.join(F.broadcast(chosen), "_id").select("_id", "_p", packed("_t").alias("x"))
    rows = rows.orderBy("_p", F.xxhash64("_id", F.lit(2)), "_id").collect()  # positives + unlabelled at most
    both = [np.array([np.frombuffer(r.x, np.float32) for r in rows if r._p == k]) for k in (1, 0)]
    model = train(*both) if min(map(len, both)) > 3 else None
    sent = shipped(spark, model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = unpacked(sent)
        for b in batches:
            if model is None:
                yield pd.Series(np.full(len(b), 0.5))
                continue
            texts = list(b)
            parts = [_soft(model.logits(features(texts[lo : lo + 256]))) for lo in range(0, len(texts), 256)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    out = df.drop("score", "predicted").withColumn("score", scored(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
