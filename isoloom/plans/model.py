"""The event-by-sample model: long assay rows with event and sample tables beside them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import filters as FL
from ..operators import intervals as I
from ..operators import relational as R

#: Loci of an island that one task settles, and groups of islands that go to tasks.
ISLAND, TASKS = 200_000, 512
#: The assays that a model holds.
ASSAYS = ("included", "excluded", "depth", "coverage", "min_depth", "up_inc", "down_inc", "up_exc", "down_exc")


@dataclass(frozen=True)
class EventModel:
    """assay: a row per event and sample. Every method returns a new model; nothing is computed until it is read."""

    assay: DataFrame
    row_data: DataFrame | None = None
    col_data: DataFrame | None = None

    def subset(self, events: DataFrame | None = None, types: Sequence[str] | None = None, samples: Sequence[str] | None = None) -> "EventModel":
        a, r, c = self.assay, self.row_data, self.col_data
        if types is not None:
            a = a.where(F.col("event_type").isin(*types))
            r = r and r.where(F.col("event_type").isin(*types))
        if samples is not None:
            a = a.where(F.col("sample").isin(*samples))
            c = c and c.where(F.col("sample").isin(*samples))
        if events is not None:
            a = a.join(events.select("event_id"), "event_id", "left_semi")
            r = r and r.join(events.select("event_id"), "event_id", "left_semi")
        return replace(self, assay=a, row_data=r, col_data=c)

    def cbind(self, other: "EventModel") -> "EventModel":
        """Adds the other's samples."""
        c = self.col_data.unionByName(other.col_data, allowMissingColumns=True) if self.col_data and other.col_data else self.col_data
        return replace(self, assay=self.assay.unionByName(other.assay), col_data=c)

    def rbind(self, other: "EventModel") -> "EventModel":
        """Adds the other's events."""
        r = self.row_data.unionByName(other.row_data, allowMissingColumns=True) if self.row_data and other.row_data else self.row_data
        return replace(self, assay=self.assay.unionByName(other.assay), row_data=r)

    def with_assay(self, name: str, value) -> "EventModel":
        return replace(self, assay=self.assay.withColumn(name, value))

    def checked(self) -> "EventModel":
        """self, if its tables fit together; raises else. Needed are the assays, one assay row per event and sample, and
        events and samples that the tables beside them have."""
        if lacking := [c for c in ASSAYS if c not in self.assay.columns]:
            raise ValueError(f"the model lacks the assays {', '.join(lacking)}")
        if not self.assay.groupBy("event_id", "sample").count().where("count > 1").isEmpty():
            raise ValueError("an event has two rows for one sample")
        for df, key in ((self.row_data, "event_id"), (self.col_data, "sample")):
            if df is not None and not self.assay.join(df.select(key), key, "left_anti").isEmpty():
                raise ValueError(f"the assays hold a {key} that its table lacks")
        return self

    def cleaned(self) -> "EventModel":
        """Samples' columns as tests need them: flags as text, columns without any value gone (never sample)."""
        c = self.col_data
        if c is None:
            return self
        has = c.agg(*[F.count(x).alias(x) for x in c.columns]).first()
        cols = [F.when(F.col(x), "TRUE").when(~F.col(x), "FALSE").alias(x) if t == "boolean" else F.col(x) for x, t in c.dtypes if x == "sample" or has[x]]
        return replace(self, col_data=c.select(*cols))

    def filtered(self, filters: Sequence[FL.EventFilter] | None = None, casettes: DataFrame | None = None) -> "EventModel":
        """The events that pass all filters; without ``casettes`` the middle exons of MXE events come from row_data."""
        if casettes is None and self.row_data is not None and "event2b" in self.row_data.columns:
            casettes = FL.casette_exons(self.row_data.where("event_type = 'MXE'"))
        return self.subset(events=FL.apply_filters(self.assay, FL.default_filters() if filters is None else filters, self.row_data, casettes))


def prune_round(loci: DataFrame, psi: str = "mean_psi") -> DataFrame:
    """Adds win: the locus has the highest mean PSI of its cluster of overlapping loci (ties win together)."""
    got = I.with_islands(loci)
    best = got.groupBy("seq", "strand", "island").agg(F.max(psi).alias("__best"))
    return got.join(best, ["seq", "strand", "island"]).withColumn("win", F.col(psi) == F.col("__best")).drop("island", "__best")


def _prune_locally(rows: DataFrame, columns: list[str], psi: str) -> DataFrame:
    """What prune_overlaps keeps of whole islands (seq, strand, __lo, __size), several of them in a task."""
    of = ["seq", "strand", "__lo"]

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = np.zeros(len(pdf), dtype=bool)
        code = pdf.groupby(of, sort=False).ngroup().to_numpy()
        order = np.lexsort((-pdf[psi].to_numpy(), code))  # islands one after another, by falling PSI, without a frame each
        code, value, start, end = (x[order].tolist() for x in (code, pdf[psi].to_numpy(), pdf["start"].to_numpy(), pdf["end"].to_numpy()))
        k, won_at, island = 0, [], None
        while k < len(code):
            if code[k] != island:
                island, starts, ends = code[k], [], []  # disjoint stretches that winners cover, in order
            n = k
            while n < len(code) and code[n] == island and value[n] == value[k]:  # ties win together
                n += 1
            won = [i for i in range(k, n) if not ((j := bisect_right(starts, end[i])) and ends[j - 1] >= start[i])]
            for i in won:
                lo, hi = bisect_left(ends, start[i]), bisect_right(starts, end[i])
                s, e = min([start[i], *starts[lo:hi]]), max([end[i], *ends[lo:hi]])
                starts[lo:hi], ends[lo:hi] = [s], [e]
            won_at += won
            k = n
        keep[order[won_at]] = True
        return pdf.loc[keep, columns]

    many = F.pmod(F.xxhash64(*of), F.lit(TASKS)).alias("__task")
    return rows.groupBy(many).applyInPandas(greedy, rows.select(*columns).schema)


def prune_overlaps(loci: DataFrame, psi: str = "mean_psi", island: int = ISLAND) -> DataFrame:
    """Loci that stay: winners of each round, then of the losers that overlap no winner, until none is left.

    Islands of at most ``island`` loci are settled whole inside a task, by falling PSI; larger ones take a checkpointed
    round each time, in which at least one locus wins, until their rests are small. Loci without PSI never win.
    """
    columns, left, kept = loci.columns, loci.where(F.col(psi).isNotNull()), None
    while True:
        got = I.with_islands(left)
        size = got.groupBy("seq", "strand", "island").agg(F.count("*").alias("__size"))
        got = R.settled(got.join(size, ["seq", "strand", "island"]).withColumnRenamed("island", "__lo"))
        done = got.where("__size = 1").select(*columns).unionByName(_prune_locally(got.where(F.col("__size").between(2, island)), columns, psi))
        kept = done if kept is None else kept.unionByName(done)
        big = got.where(F.col("__size") > island).select(*columns)
        if big.isEmpty():
            return kept
        got = R.settled(prune_round(big, psi))
        won, lost = (got.where(w).select(*columns) for w in ("win", "NOT win"))
        kept = R.settled(kept.unionByName(won))
        hit = I.overlap_join(lost, won.select("seq", "strand", "start", "end")).select("seq", "strand", "start", "end").distinct()
        left = lost.join(hit, ["seq", "strand", "start", "end"], "left_anti").select(*columns)
