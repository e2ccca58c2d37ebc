"""Statistics of depth histograms: rows (key, depth, n)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _cumulated(h: DataFrame, key: str) -> DataFrame:
    """Adds cum (bases up to this depth), prev (before it), total and the next deeper depth. A key is one region."""
    by = Window.partitionBy(key).orderBy("depth")
    h = h.withColumn("cum", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("prev", F.col("cum") - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    return h.withColumn("deeper", F.lead("depth").over(by))


def hist_mean(h: DataFrame, key: str) -> DataFrame:
    return h.groupBy(key).agg((F.sum(F.col("depth") * F.col("n")) / F.sum("n")).alias("mean"))


def hist_coverage(h: DataFrame, key: str) -> DataFrame:
    """Share of bases with depth above 0."""
    return h.groupBy(key).agg((F.sum(F.when(F.col("depth") > 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"))


def hist_percentiles(h: DataFrame, key: str, percents: Sequence[int] = (25, 50, 75)) -> DataFrame:
    """The value at rank (N + 1) * p / 100: linear between the floor's rank and the next, ends clamped."""
    c = _cumulated(h, key)
    out = []
    for p in percents:
        rank = (F.col("total") + 1) * p / 100.0
        low, rest = F.floor(rank), rank - F.floor(rank)
        # the bin that holds the floor's rank; the next rank is in the same bin unless the bin ends there
        inside = (F.col("prev") < F.greatest(low, F.lit(1))) & (F.col("cum") >= F.greatest(low, F.lit(1)))
        step = F.when((low >= 1) & (low == F.col("cum")) & F.col("deeper").isNotNull(), F.col("deeper") - F.col("depth")).otherwise(0)
        out.append(F.max(F.when(inside, F.col("depth") + rest * step)).alias(f"p{p}"))
    return c.groupBy(key).agg(*out)


def hist_trimmed_mean(h: DataFrame, key: str, center: int = 40) -> DataFrame:
    """Mean of the central ``center`` percent: floor(N * (100 - center) / 200) bases go on each side."""
    c = _cumulated(h, key).withColumn("skip", F.floor(F.col("total") * (100 - center) / 200.0))
    held = F.greatest(F.lit(0), F.least("cum", F.col("total") - F.col("skip")) - F.greatest("prev", "skip"))
    return c.groupBy(key).agg((F.sum(held * F.col("depth")) / F.max(F.col("total") - 2 * F.col("skip"))).alias("trimmed_mean"))
