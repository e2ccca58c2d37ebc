"""Differential tests per event: linear contrasts with variance moderation, beta-binomial likelihood ratios.

Sums per event are DataFrame aggregates; only hyper-parameters (two numbers) are fitted on the driver, from moments of
all events' log variances.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shaping import bh_adjust, diagonal, t_p_values


def _digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def _trigamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f / 42))


def _inverse_trigamma(y: float) -> float:
    if y > 1e7:
        return 1 / math.sqrt(y)
    x = 0.5 + 1 / y
    for _ in range(50):
        t, h = _trigamma(x), 1e-4 * x
        slope = (_trigamma(x + h) - _trigamma(x - h)) / (2 * h)
        step = t * (1 - t / y) / slope
        x += step
        if abs(step) < 1e-8 * x:
            break
    return x


def prior_variance(mean_log: float, var_log: float, df: float) -> tuple[float, float]:
    """(degrees of freedom, variance) of the prior that all events' variances share, from moments of their logs."""
    e = mean_log - _digamma(df / 2) + math.log(df / 2)
    spread = var_log - _trigamma(df / 2)
    if spread <= 0:
        return math.inf, math.exp(e)
    d0 = 2 * _inverse_trigamma(spread)
    return d0, math.exp(e + _digamma(d0 / 2) - math.log(d0 / 2))


def linear_contrast(assay: DataFrame, value: str, nom: str, denom: str, batch: str | None = None) -> DataFrame:
    """(event_id, effect, t, df, p, p_adj): difference of log2(value + 1) between conditions, batches centred out.

    Balanced or not, conditions are compared within batches (weights n1 * n2 / (n1 + n2)); variances are moderated
    towards the prior shared by all events.
    """
    a = assay.where(F.col("condition").isin(nom, denom)).withColumn("y", F.log2(F.col(value) + 1.0)).withColumn("b", F.col(batch) if batch else F.lit(""))
    side = lambda c, f: f(F.when(F.col("condition") == c, F.col("y")))
    g = a.groupBy("event_id", "b").agg(side(nom, F.count).alias("n1"), side(denom, F.count).alias("n2"), side(nom, F.avg).alias("m1"), side(denom, F.avg).alias("m2"), F.count("y").alias("n"), F.avg("y").alias("m"), F.sum(F.col("y") * F.col("y")).alias("q"))
    w = F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))
    diff = F.coalesce(F.col("m1") - F.col("m2"), F.lit(0.0))
    g = g.withColumns({"w": w, "wd": w * diff, "wdd": w * diff * diff, "ss": F.col("q") - F.col("n") * F.col("m") * F.col("m")})
    g = g.groupBy("event_id").agg(F.sum("w").alias("w"), F.sum("wd").alias("wd"), F.sum("ss").alias("ss"), F.sum("n").alias("n"), F.count("*").alias("k"))
    effect = F.try_divide("wd", "w")
    g = g.withColumn("effect", effect).withColumn("df", (F.col("n") - F.col("k") - 1).cast("double"))
    g = g.withColumn("s2", F.try_divide(F.greatest(F.col("ss") - F.col("w") * effect * effect, F.lit(0.0)), F.when(F.col("df") > 0, F.col("df"))))
    m = g.where("s2 > 1e-12").agg(F.avg(F.log("s2")), F.var_samp(F.log("s2")), F.avg("df")).first()
    d0, s0 = prior_variance(m[0], m[1] or 0.0, m[2]) if m[0] is not None else (0.0, 1.0)
    post = F.lit(s0) if math.isinf(d0) else (F.lit(d0 * s0) + F.col("df") * F.coalesce("s2", F.lit(0.0))) / (F.lit(d0) + F.col("df"))
    g = g.withColumn("t", F.try_divide(F.col("effect"), F.sqrt(F.try_divide(post, F.col("w"))))).withColumn("dft", F.col("df") + (1e6 if math.isinf(d0) else d0))
    g = g.withColumn("p", t_p_values(F.col("t"), F.col("dft")))
    return bh_adjust(g).select("event_id", "effect", "t", F.col("dft").alias("df"), "p", "p_adj")


def beta_binomial_test(assay: DataFrame, nom: str, denom: str) -> DataFrame:
    """(event_id, lfc, deviance, p, p_adj): quasi-likelihood ratio of the included share between two conditions.

    Counts get 1 added to the included and 2 to all; the deviance over the fitted dispersion is referred to t**2. Both
    conditions and three samples are needed, else all but event_id are null. All sums are aggregates per event.
    """
    c = F.col
    a = assay.where(c("condition").isin(nom, denom)).select("event_id", "condition", (c("included") + 1).cast("double").alias("y"), (c("included") + c("excluded") + 2).cast("double").alias("m"))
    side = lambda cond, x: F.sum(F.when(c("condition") == cond, x))
    g = a.groupBy("event_id").agg(F.count("y").alias("n"), *[side(cond, x).alias(f"{k}{i}") for i, cond in ((1, nom), (0, denom)) for k, x in (("y", c("y")), ("m", c("m")), ("r", c("y") * c("y") / c("m")))])
    for i in (0, 1):
        g = g.withColumn(f"p{i}", F.try_divide(f"y{i}", f"m{i}"))
    g = g.withColumn("p", F.try_divide(c("y0") + c("y1"), c("m0") + c("m1")))
    # the parts of the deviances that do not depend on the shares cancel out
    gain = sum(c(f"y{i}") * F.log(c(f"p{i}") / c("p")) + (c(f"m{i}") - c(f"y{i}")) * F.log((1 - c(f"p{i}")) / (1 - c("p"))) for i in (0, 1))
    pearson = sum(F.try_divide(c(f"r{i}") - 2 * c(f"p{i}") * c(f"y{i}") + c(f"p{i}") * c(f"p{i}") * c(f"m{i}"), c(f"p{i}") * (1 - c(f"p{i}"))) for i in (0, 1))
    spread = F.greatest(F.lit(1.0), F.try_divide(pearson, c("n") - 2))
    fine = (c("n") >= 3) & c("y0").isNotNull() & c("y1").isNotNull()
    lfc = F.log2(c("p1") / (1 - c("p1")) / (c("p0") / (1 - c("p0"))))
    got = g.select("event_id", F.when(fine, lfc).alias("lfc"), F.when(fine, F.greatest(F.lit(0.0), 2 * gain) / spread).alias("deviance"), F.when(fine, (c("n") - 2).cast("double")).alias("df"))
    return bh_adjust(got.withColumn("p", t_p_values(F.sqrt("deviance"), F.col("df")))).select("event_id", "lfc", "deviance", "p", "p_adj")


def size_factors(assay: DataFrame, value: str) -> DataFrame:
    """(sample, factor): median over events without a zero of count over the event's geometric mean."""
    whole = assay.withColumn("y", F.floor(value)).groupBy("event_id").agg(F.avg(F.log(F.when(F.col("y") > 0, F.col("y")))).alias("g"), F.min("y").alias("low")).where("low > 0")
    ratio = assay.join(whole.select("event_id", "g"), "event_id").withColumn("r", F.log(F.floor(value)) - F.col("g"))
    got = ratio.groupBy("sample").agg(F.exp(F.percentile_approx("r", 0.5, 10_000)).alias("factor"))
    return assay.select("sample").distinct().join(got, "sample", "left").select("sample", F.coalesce("factor", F.lit(1.0)).alias("factor"))


def negative_binomial_test(assay: DataFrame, value: str, nom: str, denom: str) -> DataFrame:
    """(event_id, lfc, dispersion, p, p_adj): Wald test of the log ratio of two conditions' means.

    Counts are truncated to integers and divided by size factors (a row per sample, broadcast). Dispersions are
    pooled moments within conditions, averaged in logs with the trend a + b / mean, whose two numbers are fitted on
    the driver from sums over all events.
    """
    a = assay.where(F.col("condition").isin(nom, denom))
    a = a.join(F.broadcast(size_factors(a, value)), "sample").withColumn("y", F.floor(value) / F.col("factor"))
    side = lambda c, x: F.when(F.col("condition") == c, x)
    parts = [f(side(c, F.col("y"))).alias(n + k) for c, k in ((nom, "1"), (denom, "2")) for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))]
    g = a.groupBy("event_id").agg(*parts, *[F.avg(side(c, 1 / F.col("factor"))).alias(f"i{k}") for c, k in ((nom, "1"), (denom, "2"))])
    raw = lambda k: F.try_divide(F.col(f"v{k}") - F.col(f"m{k}") * F.col(f"i{k}"), F.col(f"m{k}") * F.col(f"m{k}"))
    w = lambda k: F.greatest(F.col(f"n{k}") - 1, F.lit(0))
    own = F.greatest(F.try_divide(F.coalesce(raw("1"), F.lit(0.0)) * w("1") + F.coalesce(raw("2"), F.lit(0.0)) * w("2"), w("1") + w("2")), F.lit(1e-8))
    g = g.withColumn("own", own).withColumn("mean", (F.col("m1") + F.col("m2")) / 2)
    x = F.try_divide(F.lit(1.0), F.col("mean"))
    m = g.where("own > 1e-7 AND mean > 0").agg(F.count("*"), F.avg(x), F.avg("own"), F.avg(x * x), F.avg(x * F.col("own"))).first()
    spread = (m[3] or 0) - (m[1] or 0) ** 2
    slope = max(0.0, (m[4] - m[1] * m[2]) / spread) if m[0] and spread > 1e-12 else 0.0
    base = max(1e-8, (m[2] or 1e-8) - slope * (m[1] or 0))
    trend = F.lit(base) + slope * F.coalesce(x, F.lit(0.0))
    g = g.withColumn("dispersion", F.exp((F.log(F.col("own")) + F.log(trend)) / 2))
    se2 = sum(F.try_divide(F.col(f"i{k}"), F.col(f"m{k}") * F.col(f"n{k}")) + F.try_divide(F.col("dispersion"), F.col(f"n{k}")) for k in ("1", "2"))
    z = F.try_divide(F.log((F.col("m1") + 0.5) / (F.col("m2") + 0.5)), F.sqrt(se2))
    g = g.withColumn("lfc", F.log2((F.col("m1") + 0.5) / (F.col("m2") + 0.5))).withColumn("p", t_p_values(z, F.lit(1e6)))
    return bh_adjust(g).select("event_id", "lfc", "dispersion", "p", "p_adj")


def check_contrast(conditions: Mapping[str, Sequence], factor: str, nom: str, denom: str, batches: Sequence[str] = ()) -> None:
    """Raises unless the factor and the batches are different columns of the samples' table and both levels occur.

    conditions: column name -> its values, one per sample.
    """
    if not (factor and nom and denom):
        raise ValueError("a factor and two of its levels are needed")
    for c in (factor, *batches):
        if c not in conditions:
            raise ValueError(f"the samples have no column {c}")
    for level in (nom, denom):
        if level not in conditions[factor]:
            raise ValueError(f"no sample has {factor} = {level}")
    if len({factor, *batches}) != 1 + len(batches):
        raise ValueError("the factor and the batches must be different columns")


def testable(events: DataFrame, anti_over: bool = True, anti_near: bool = False) -> DataFrame:
    """Events whose name tells of no known exon, no overlapping gene of the other strand and, if asked, none nearby."""
    marks = ["known-exon", *(["anti-over"] if anti_over else []), *(["anti-near"] if anti_near else [])]
    for m in marks:
        events = events.where(~F.coalesce(F.col("event_name"), F.lit("")).contains(m))
    return events


def with_results(results: DataFrame, row_data: DataFrame, assay: DataFrame, nom: str, denom: str) -> DataFrame:
    """Test results with their events' name, type, region and decay direction before them and both mean shares."""
    about = row_data.select("event_id", "event_name", "event_type", "region", "nmd_direction")
    mean = diagonal(assay, nom, denom).select("event_id", F.col("nom").alias(f"avg_psi_{nom}"), F.col("denom").alias(f"avg_psi_{denom}"))
    return results.join(about, "event_id", "left").join(mean, "event_id", "left").select(*about.columns, *mean.columns[1:], *[c for c in results.columns if c != "event_id"])
