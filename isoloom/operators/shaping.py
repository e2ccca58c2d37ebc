"""PSI matrices, diagonals and tests over long assay rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def psi(inc: Column, exc: Column, depth_threshold: float) -> Column:
    """inc / (inc + exc); null below the depth."""
    return F.when(inc + exc >= depth_threshold, F.try_divide(inc, inc + exc))


def logit(p: Column, limit: float) -> Column:
    """log(p / (1 - p)), clamped; 0 and 1 take the limits."""
    return F.when(p <= 0, -limit).when(p >= 1, limit).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), F.log(p / (1 - p)))))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def psi_rows(assay: DataFrame, method: str = "PSI", depth_threshold: float = 10, logit_max: float = 5, na_max: float = 0.1, samples: int | None = None) -> DataFrame:
    """(event_id, sample, value) for events whose share of null samples is below ``na_max``."""
    got = assay.withColumn("p", psi(F.col("included"), F.col("excluded"), depth_threshold))
    total = F.lit(samples) if samples else F.col("n")
    keep = got.groupBy("event_id").agg(F.count("p").alias("have"), F.count("*").alias("n")).where(total - F.col("have") < na_max * total).select("event_id")
    got = got.join(keep, "event_id", "left_semi")
    if method == "PSI":
        return got.select("event_id", "sample", F.col("p").alias("value"))
    got = got.withColumn("l", F.when(F.col("p").isNotNull(), logit(F.col("p"), logit_max)))
    if method == "logit":
        return got.select("event_id", "sample", F.col("l").alias("value"))
    by = Window.partitionBy("event_id")
    z = F.try_divide(F.col("p") - F.avg("p").over(by), F.stddev_samp("p").over(by))
    return got.select("event_id", "sample", F.coalesce(z, F.lit(0.0)).alias("value"))


def to_matrix(rows: DataFrame, samples: list[str]) -> DataFrame:
    """Events by samples; samples are named, so no extra job looks for them."""
    return rows.groupBy("event_id").pivot("sample", samples).agg(F.first("value"))


def diagonal(assay: DataFrame, nom: str, denom: str, depth_threshold: float = 10, logit_max: float = 5) -> DataFrame:
    """Mean PSI of two conditions, averaged on the clamped logit scale."""
    p = psi(F.col("included"), F.col("excluded"), depth_threshold)
    got = assay.withColumn("l", F.when(p.isNotNull(), logit(p, logit_max)))
    side = lambda c: logistic(F.avg(F.when(F.col("condition") == c, F.col("l"))))
    return got.groupBy("event_id").agg(side(nom).alias("nom"), side(denom).alias("denom"))


def bh_adjust(df: DataFrame, p: str = "p", name: str = "p_adj", slices: int = 1024) -> DataFrame:
    """Benjamini-Hochberg: the least p * n / rank from this rank upwards, at most 1.

    Ranks are counts below: p values are cut into slices whose counts and minima are carried over, so no window
    holds all rows.
    """
    df = df.withColumn("__s", F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(p))) * slices).cast("int"))
    per = df.where(F.col(p).isNotNull()).groupBy("__s").agg(F.count("*").alias("__n"))
    # one row per slice: its rows and those before it
    order = Window.orderBy("__s")
    per = per.withColumn("__before", F.sum("__n").over(order) - F.col("__n")).withColumn("__all", F.sum("__n").over(Window.partitionBy()))
    got = df.join(F.broadcast(per), "__s", "left")
    rank = F.col("__before") + F.count(F.lit(1)).over(Window.partitionBy("__s").orderBy(p).rangeBetween(Window.unboundedPreceding, 0))
    got = got.withColumn("__q", F.col(p) * F.col("__all") / rank)
    low = got.where(F.col(p).isNotNull()).groupBy("__s").agg(F.min("__q").alias("__m"))
    low = low.withColumn("__later", F.min("__m").over(Window.orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, -1))).drop("__m")
    got = got.join(F.broadcast(low), "__s", "left")
    here = F.min("__q").over(Window.partitionBy("__s").orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0))
    return got.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), here, F.coalesce("__later", F.lit(1.0))))).drop("__s", "__n", "__before", "__all", "__q", "__later")


def two_sample_t(assay: DataFrame, value: str, nom: str, denom: str) -> DataFrame:
    """(event_id, t, df): equal-variance t statistic between two conditions; null without spread or rows."""
    side = lambda c: F.when(F.col("condition") == c, F.col(value))
    g = assay.groupBy("event_id").agg(*[f(side(c)).alias(n + k) for c, k in ((nom, "1"), (denom, "2")) for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))])
    c = F.col
    df = c("n1") + c("n2") - 2
    pooled = F.try_divide((c("n1") - 1) * F.coalesce("v1", F.lit(0.0)) + (c("n2") - 1) * F.coalesce("v2", F.lit(0.0)), df)
    t = F.try_divide(c("m1") - c("m2"), F.sqrt(pooled * (F.try_divide(F.lit(1.0), c("n1")) + F.try_divide(F.lit(1.0), c("n2")))))
    return g.select("event_id", t.alias("t"), df.cast("long").alias("df"))


def _beta_fraction(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, for arrays."""
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(x), 1 / away(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / away(1 + num * d), away(1 + num / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-13):
            break
    return h


#: Coefficients of Lanczos' series for the logarithm of the gamma function (g = 7, nine terms); fixed values.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y = x - 1
    s = LANCZOS[0] + sum(c / (y + k) for k, c in enumerate(LANCZOS[1:], 1))
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * np.log(t) - t + np.log(s)


def t_p_array(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p values of Student's t; NaN without a statistic or degrees of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    out = np.full(t.shape, np.nan)
    ok = ~np.isnan(t) & (df > 0)
    q = df[ok] / (df[ok] + t[ok] * t[ok])
    p = np.where(q <= 0, 0.0, 1.0)
    in_ = (q > 0) & (q < 1)
    x, a, b = q[in_], df[ok][in_] / 2, 0.5
    half = np.full(a.shape, b)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(half) + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1) / (a + b + 2)
    value = np.empty_like(x)
    value[low] = front[low] * _beta_fraction(a[low], half[low], x[low]) / a[low]
    value[~low] = 1 - front[~low] * _beta_fraction(half[~low], a[~low], 1 - x[~low]) / b
    p[in_] = value
    out[ok] = p
    return out


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return float(t_p_array(np.array([t]), np.array([df]))[0])


def t_p_values(t: Column, df: Column) -> Column:
    """Two-sided p values, a batch at a time; null without a statistic."""

    @F.pandas_udf("double")
    def values(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(t_p_array(t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)))

    return values(t.cast("double"), df.cast("double"))
