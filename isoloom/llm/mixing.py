"""Mixing sources to target weights by subset-sum budget fitting.

Whole epochs of a source come first; the words still missing are a subset-sum problem over its documents' exact
lengths. Documents are counted by source and length. Each length gives a proportional share of its documents, rounded
down, and bounded-knapsack dynamic programming over the counts still free fills what remains of the budget: first in a
unit in which the remainder has ``CELLS`` steps (lengths rounded up, so that it never overshoots), then what that left
over in a finer one, at last in single words. The plan says how many documents of each length to take once more; a
seeded hash picks them.

Sizes are taken from the texts once and written to the shared folder. Only counts travel from there: one row per source
and length for the plan (solved per source, on executors), one number per source to the driver for the targets.
Documents are ranked by the hash in two steps: counts per hash slice find the slice in which a length's quota ends, and
only that slice's rows are ranked; the slices grow in number with the table, so none holds more than about
``SLICE_ROWS`` rows of it.

Cases: a null source is a source of its own, last in order; null and empty texts have size 0 and take 0; no
document is taken more than twice; repeated rows count as documents of their own and may be taken unlike each other
(``mix`` takes rows that share a doc_id alike); rows of equal hash are drawn by doc_id; empty tables give an empty
result; extra columns stay with ``mix``, whatever their names, and are not read by the digest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, stored, table, words

#: Fixed values of the contract.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
SEED = 17
#: Steps of the budget in a round of dynamic programming; a length takes part in a coarse round if it has FINE of them.
CELLS, FINE = 1 << 18, 16
#: The shortest documents that fit into the last round, and cells of a round that are never exceeded for them.
LAST, MOST_CELLS = 6, 1 << 24
#: Hash slices at least, and rows of the table in one of them.
SLICES, SLICE_ROWS = 128, 100_000
#: Rows of (doc_id, times) that may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.size(words(text)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words each source should give. Sources by code point, null last; the excess over ``most`` times a
    source's size is dealt again by weight among the others until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    w = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    rest, free, out = share * sum(n for _, n in order), dict(w), {}
    while free:
        total = sum(free.values())
        full = [s for s in free if rest * free[s] / total > cap[s]]
        if not full:
            out |= {s: rest * free[s] / total for s in free}
            break
        for s in full:
            out[s] = cap[s]
            del free[s]
        rest -= sum(cap[s] for s in full)
    return out


def knapsack(size: np.ndarray, free: np.ndarray, room: int) -> np.ndarray:
    """How many of each size to take, at most ``free``, so that they fill the room as far as they can.

    Counts go in as binary parts, short sizes first; for every sum the part that first reached it is kept, which is
    enough to go back from the largest sum.
    """
    take = np.zeros(len(size), np.int64)
    reach, by = np.zeros(room + 1, bool), np.zeros(room + 1, np.int32)
    reach[0] = True
    parts: list[tuple[int, int]] = []
    for i in np.argsort(size, kind="stable"):
        w = int(size[i])
        left, part = int(min(free[i], room // w)) if 0 < w <= room else 0, 1
        while left > 0:
            k = min(part, left)
            got = np.flatnonzero(reach[: room + 1 - w * k] & ~reach[w * k :]) + w * k
            if len(got):
                by[got] = len(parts)
                parts.append((int(i), k))
                reach[got] = True
            left -= k
            part *= 2
        if reach.all():
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, k = parts[by[at]]
        take[i] += k
        at -= int(size[i]) * k
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, cells: int = CELLS) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to the budget from below as the counts
    allow; exactly, wherever the last round can compose what is left."""
    size, have = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = sum(int(s) * int(n) for s, n in zip(size, have))
    budget = max(0, min(int(budget), total))
    if not budget:
        return np.zeros(len(size), np.int64)
    # proportional, so that every length is represented
    take = np.array([int(n) * budget // total if s else 0 for s, n in zip(size, have)], np.int64)
    left = budget - int((size * take).sum())
    while left > 0:
        fits = (size > 0) & (size <= left) & (have > take)
        if not fits.any():
            break
        # a round in single words comes last, with room for a few of the shortest documents left
        hold = min(max(cells // 2, LAST * int(size[fits].min())), MOST_CELLS // 2)
        cells = max(cells, 2 * hold)
        unit = 1 if left <= cells else -(-(left - hold) // cells)
        chosen = fits & (size >= FINE * unit) if unit > 1 else fits
        if unit > 1 and not chosen.any():  # short lengths only: as many as keep the last round's room
            for i in np.argsort(-size, kind="stable"):
                if fits[i]:
                    n = int(min(have[i] - take[i], max(0, left - hold) // size[i]))
                    take[i] += n
                    left -= n * int(size[i])
            cells = max(cells, left)
            continue
        at = np.flatnonzero(chosen)
        got = knapsack(-(-size[at] // unit), have[at] - take[at], (left if unit == 1 else left - hold) // unit)
        take[at] += got
        left -= int((size[at] * got).sum())
        if unit == 1:
            break
        if not got.any():
            cells *= 2
    return take


def draw(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and times (0 to 2) of each document."""
    sized = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("draw")), "sizes")
    slices = max(SLICES, -(-sized.count() // SLICE_ROWS))
    sized = sized.withColumn("slice", F.pmod(F.shiftright("draw", 20), F.lit(slices)).cast("int"))
    counts = stored(sized.groupBy("source", "size", "slice").agg(F.count("*").alias("n")), "size-counts")
    by_length = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = [(r["source"], int(r["t"] or 0)) for r in by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("t")).collect()]
    goal = targets(totals)
    spark = docs.sparkSession
    rows = [(s is None, s or "", s, t, float(goal.get(s, 0.0))) for s, t in totals]
    goals = spark.createDataFrame(rows, "no_source boolean, name string, source string, source_size long, target double")  # a row per source
    if len(rows) <= BROADCAST_ROWS:
        goals = F.broadcast(goals)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        epochs = min(int(MOST), int(target // whole)) if whole else 0
        budget = int(round(target - epochs * whole)) if epochs < MOST else 0
        extra = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), budget)
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "epochs": epochs, "quota": extra})

    key = lambda df: df.withColumns({"no_source": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))})
    own = ["no_source", "name"]
    plan = key(by_length).join(goals.drop("source"), own).select("source", "size", "n", "source_size", "target")
    plan = stored(plan.groupBy("source").applyInPandas(solve, "source string, size long, epochs int, quota long"), "plan")
    # where, among the slices of a length, its quota ends
    before = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = key(counts).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ends = ends.join(key(plan).select(*own, "size", "epochs", "quota"), [*own, "size"])
    ends = ends.select(*own, "size", "slice", "epochs", (F.col("quota") - F.col("before")).alias("room"), "n")
    got = key(sized).join(ends, [*own, "size", "slice"])
    sure = got.where((F.col("room") >= F.col("n")) | (F.col("room") <= 0)).withColumn("extra", (F.col("room") > 0).cast("int")).drop("n")
    part = got.where((F.col("room") < F.col("n")) & (F.col("room") > 0)).drop("n")
    rank = F.row_number().over(Window.partitionBy(*own, "size", "slice").orderBy("draw", "doc_id"))
    part = part.withColumn("extra", (rank <= F.col("room")).cast("int"))
    out = sure.unionByName(part).join(goals.drop("source"), own)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") + F.col("extra")).cast("int").alias("times"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns whatever their names. Rows that
    repeat a doc_id are taken alike, as often as the one taken most."""
    times = stored(draw(docs, seed).groupBy("doc_id").agg(F.max("times").alias("times")).where("times > 0").select(F.col("doc_id").alias("id"), "times"), "times")
    if times.count() <= BROADCAST_ROWS:
        times = F.broadcast(times)
    rows = docs.select(F.struct(*columns(docs)).alias("row"), F.col("doc_id").alias("of"))
    met = rows.join(times, F.col("of").eqNullSafe(F.col("id")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = draw(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))
