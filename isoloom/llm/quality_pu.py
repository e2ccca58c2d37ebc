"""Quality classifier learned from trusted positives and unlabelled web text.

Positives are labelled good; negatives are never used. The class prior of the unlabelled text is estimated
first: a logistic model tells positives from unlabelled rows, and the smallest ratio between the shares of
unlabelled and of positive rows above a threshold bounds the prior (with a confidence term). Then a logistic
model minimises the non-negative unbiased risk
    prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])
by full-batch Adam that climbs back on the second part whenever it turns negative.

Features are built-in column statistics of the whole text, and the fitted model is a column expression, so no
Python touches the rows. At most ``SAMPLE`` positives and ``SAMPLE`` unlabelled rows of numbers reach the
driver. Held-out rows give neither labels nor unlabelled text.

Cases: null and empty texts have all statistics 0 and get a score like any text; repeated rows are scored
alike; an id labelled good and bad is not trusted as good; without positives every score is the prior 1.0 (nothing
is known to be bad); only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, label_of, table
from .text_stats import with_stats

#: Rows of each kind that the model is fitted on, at most.
SAMPLE = 8_000
STEPS, RATE, DECAY = 1500, 0.05, 1e-4
CUT = 0.3

_per = {
    "symbols": ("n_symbols", "n_words"),
    "marks": ("n_marks", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "length": ("word_chars", "n_words"),
}


def features() -> dict[str, Column]:
    """Null-free doubles; each ratio also enters as a square root, which separates small values."""
    out: dict[str, Column] = {}
    for name, (a, b) in _per.items():
        r = F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")
        out[name] = F.least(r, F.lit(20.0))
        if name != "length":
            out[f"root_{name}"] = F.sqrt(F.least(r, F.lit(20.0)))
    out["log_words"] = F.log1p(F.col("n_words").cast("double"))
    out["few_words"] = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("n_words") / 20.0)
    return out


@dataclass
class Model:
    names: list[str]
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float
    prior: float

    def score(self) -> Column:
        """Probability of label 1; standardised features are clipped so that no text is an outlier."""
        got, z = features(), F.lit(self.bias)
        for n, m, s, w in zip(self.names, self.mean, self.scale, self.weights):
            z = z + F.least(F.lit(8.0), F.greatest(F.lit(-8.0), (got[n] - m) / s)) * w
        return 1.0 / (1.0 + F.exp(-z))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Best-bin bound: the least share(unlabelled above t) / share(positive above t) over thresholds t."""
    rng = np.random.default_rng(11)
    w, b = np.zeros(pos.shape[1]), 0.0
    a, c = rng.random(len(pos)) < 0.5, rng.random(len(unl)) < 0.5
    x, y = np.vstack([pos[a], unl[c]]), np.r_[np.ones(a.sum()), np.zeros(c.sum())]
    if not len(x) or y.min() == y.max():
        return 1.0
    for _ in range(300):
        g = _sigmoid(x @ w + b) - y
        w, b = w - 0.3 * (x.T @ g / len(y) + 1e-3 * w), b - 0.3 * g.mean()
    p, u = np.sort(pos[~a] @ w + b), np.sort(unl[~c] @ w + b)
    if not len(p) or not len(u):
        return 1.0
    cuts = np.quantile(p, np.linspace(0.0, 0.9, 46))
    above = lambda s: 1 - np.searchsorted(s, cuts) / len(s)
    slack = math.sqrt(math.log(200) / 2 / len(u)) + math.sqrt(math.log(200) / 2 / len(p))
    k = int(np.argmin((above(u) + slack) / np.maximum(above(p), 1e-9)))
    return float(np.clip(above(u)[k] / above(p)[k], 0.05, 0.99))


def learn(pos: np.ndarray, unl: np.ndarray, names: list[str]) -> Model:
    if not len(pos) or not len(unl):
        return Model(names, [0.0] * len(names), [1.0] * len(names), [0.0] * len(names), 40.0 if len(unl) or len(pos) else 0.0, 1.0)
    every = np.vstack([pos, unl])
    mean, scale = every.mean(0), every.std(0) + 1e-6
    p, u = (np.clip((v - mean) / scale, -8, 8) for v in (pos, unl))
    prior = estimate_prior(p, u)
    w, b = np.zeros(p.shape[1]), math.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, STEPS + 1):
        gp, gu = p @ w + b, u @ w + b
        soft = lambda z: np.logaddexp(0, z)  # noqa: E731  loss of calling a row with this margin negative
        rest = soft(gu).mean() - prior * soft(gp).mean()
        # derivatives of the loss of being called positive (dp) and negative (dn)
        dp, dn, du = -prior * _sigmoid(-gp) / len(p), -prior * _sigmoid(gp) / len(p), _sigmoid(gu) / len(u)
        if rest >= 0:
            g = np.r_[p.T @ (dp + dn) + u.T @ du, (dp + dn).sum() + du.sum()]
        else:
            g = -np.r_[p.T @ dn + u.T @ du, dn.sum() + du.sum()]
        g[:-1] += DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(names, mean.tolist(), scale.tolist(), w.tolist(), float(b), prior)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Positives: up to ``sample`` labelled good; unlabelled: about as many documents chosen by a hash of the id."""
    good = label_of(labels, "quality", sample, only=1)
    free = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample)
    chosen = F.broadcast(good.select("doc_id", F.lit(1).alias("kind")).unionByName(free.select("doc_id", F.lit(0).alias("kind"))))
    names = list(got := features())
    ids = chosen.select("doc_id").distinct()
    stats = with_stats(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")).select("doc_id", *[c.alias(n) for n, c in got.items()])
    rows = stats.join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "kind").select("kind", *names).limit(4 * sample).collect()
    x = np.array([[r[n] for n in names] for r in rows], dtype=float).reshape(-1, len(names))
    kind = np.array([r["kind"] for r in rows], dtype=int)
    return learn(x[kind == 1], x[kind == 0], names)


def score(docs: DataFrame, model: Model) -> DataFrame:
    got = with_stats(docs).withColumn("score", model.score())
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns."""
    return with_stats(docs, whole=True).where(model.score() >= CUT).select("row.*")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
