"""Coverage tracks for display: windows, normalised means with intervals, t tracks, transcript layout."""

from __future__ import annotations

import math
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import relational as R
from .intervals import with_islands
from .shaping import t_p_value, t_p_values


def zoom_window(start: int, end: int, length: int, zoom: float = 0, flank: int = 100) -> tuple[int, int]:
    """The region widened 3**zoom times about its middle and by the flanks, inside the chromosome."""
    mid, half = (start + end) / 2, (end - start + 1) * 3**zoom / 2
    return max(1, math.floor(mid - half) - flank), min(length, math.ceil(mid + half) + flank)


def bin_width(start: int, end: int) -> int:
    return max(1, int(3 ** (math.floor(math.log((end - start) / 50, 3)) - 4))) if end - start >= 50 else 1


def bin_of(i: Column, n: int, width: float) -> Column:
    """Bin of base i (1-based) of n: evenly spaced breaks of about ``width``, the last one on n + 1."""
    k = math.ceil((n + 1) / width)
    return F.lit(1) if k <= 1 else F.least(F.floor((i - 1) * (k - 1) / n) + 1, F.lit(k - 1))


def t_quantile(df: int, p: float = 0.975) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_p_value(mid, df) > 2 * (1 - p) else (lo, mid)
    return lo


def condition_track(rows: DataFrame, by: list[str], value: str = "value", most: int = 200) -> DataFrame:
    """(by, n, mean, sd, ci): mean over samples with its 95 % interval; above ``most`` samples t is taken as 1.96."""
    table = F.create_map(*[F.lit(x) for k in range(1, most) for x in (k, t_quantile(k))])
    g = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    t = F.coalesce(F.element_at(table, (F.col("n") - 1).cast("int")), F.lit(1.959964))
    return g.withColumn("ci", F.when(F.col("n") > 1, t * F.col("sd") / F.sqrt(F.col("n").cast("double"))))


def normalised(runs: DataFrame, depths: DataFrame, least: float = 10) -> DataFrame:
    """Run depths over the sample's event depth, for samples whose event depth is at least ``least``."""
    return runs.join(depths.where(F.col("event_depth") >= least), "sample").withColumn("value", F.col("depth") / F.col("event_depth"))


def t_track(rows: DataFrame, by: list[str], nom: str, denom: str, value: str = "value") -> DataFrame:
    """(by, t, log_p): -log10 p of the equal-variance t test between two conditions."""
    side = lambda c, f: f(F.when(F.col("condition") == c, F.col(value)))
    g = rows.groupBy(*by).agg(*[side(c, f).alias(a + k) for c, k in ((nom, "1"), (denom, "2")) for f, a in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))])
    df = F.col("n1") + F.col("n2") - 2
    pooled = F.try_divide((F.col("n1") - 1) * F.coalesce("v1", F.lit(0.0)) + (F.col("n2") - 1) * F.coalesce("v2", F.lit(0.0)), df)
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (F.try_divide(F.lit(1.0), "n1") + F.try_divide(F.lit(1.0), "n2"))))
    return g.select(*by, t.alias("t"), (-F.log10(F.greatest(t_p_values(t, df), F.lit(1e-300)))).alias("log_p"))


def transcript_layout(spans: DataFrame) -> DataFrame:
    """(seq, tx, start, end, level): the first level whose last transcript ends before this one starts.

    Greedy and sequential within an island of overlapping transcripts; behind an island every level is free again, so
    islands are laid out apart with the same levels as a whole chromosome.
    """

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end", "tx"]).reset_index(drop=True)
        busy: list[tuple[int, int]] = []  # (end, level)
        free: list[int] = []
        level, used = [], 0
        for s, e in zip(pdf["start"], pdf["end"]):
            while busy and busy[0][0] < s:
                heappush(free, heappop(busy)[1])
            if free:
                k = heappop(free)
            else:
                k = used = used + 1
            heappush(busy, (e, k))
            level.append(k)
        pdf["level"] = level
        return pdf[["seq", "tx", "start", "end", "level"]]

    return with_islands(spans, ["seq"]).groupBy("seq", "island").applyInPandas(lay, "seq string, tx long, start long, end long, level int")


def sample_tracks(runs: DataFrame, seq: str, start: int, end: int, by: str = "sample") -> DataFrame:
    """(sample, bin, position, depth): mean depth of each sample in the bins of a region; bases without a run count as 0.

    runs: (sample, seq, start, end, depth), disjoint per sample. Runs are cut at bin borders, so no row per base is made.
    """
    n = end - start + 1
    width = bin_width(start, end)
    last = max(1, math.ceil((n + 1) / width) - 1)
    inside = runs.where((F.col("seq") == seq) & (F.col("start") <= end) & (F.col("end") >= start))
    a, b = F.greatest("start", F.lit(start)) - start + 1, F.least("end", F.lit(end)) - start + 1
    cut = inside.select(by, "depth", a.alias("a"), b.alias("b"), F.explode(F.sequence(bin_of(a, n, width).cast("long"), bin_of(b, n, width).cast("long"))).alias("bin"))
    # the first base of bin k is the least i whose bin is k
    first = lambda k: F.when(k > last, F.lit(n + 1)).otherwise(F.ceil((k - 1) * F.lit(n) / last) + 1).cast("long")
    k = F.col("bin")
    part = F.greatest(F.lit(0), F.least("b", first(k + 1) - 1) - F.greatest("a", first(k)) + 1)
    got = cut.groupBy(by, "bin").agg(F.sum(part * F.col("depth")).alias("s"))
    grid = inside.select(by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(last).cast("long"))))
    mean = F.coalesce("s", F.lit(0)) / (first(k + 1) - first(k))
    return grid.join(got, [by, "bin"], "left").select(by, "bin", (F.lit(start) + (first(k) + first(k + 1) - 3) / 2).alias("position"), mean.alias("depth"))


def event_highlight(events: DataFrame, intron: DataFrame, exons: DataFrame) -> DataFrame:
    """(event_id, isoform, tx, type, start, end): what a drawing of each event marks.

    Introns equal to one of an isoform's junctions, in any transcript; and, of the transcripts that have all junctions
    of the isoform, the exons that start or end beside one. Isoform 1 is the included side (two junctions for MXE and
    SE), 2 the other; retained introns have one isoform and no marked exons.
    events: (event_id, event_type, event1a, event2a, event1b, event2b).
    """
    k = F.col("event_type")
    part = lambda iso, e, test: F.when(test & F.col(e).isNotNull(), F.struct(F.lit(iso).alias("isoform"), F.col(e).alias("locus")))
    plain = ~k.isin("IR", "RI")
    parts = F.array_compact(F.array(part(1, "event1a", F.lit(True)), part(1, "event2a", k.isin("MXE", "SE")), part(2, "event1b", plain), part(2, "event2b", k == "MXE")))
    # a row per event; numbers instead of names below, and few enough rows to send to the transcripts, which stay in place
    names = R.settled(events.select("event_id").distinct().withColumn("__k", F.monotonically_increasing_id()))
    want = events.join(names, "event_id").select("__k", plain.alias("plain"), F.explode(parts).alias("p")).select("__k", "plain", "p.isoform", "p.locus").distinct()
    of = ["__k", "isoform"]
    want, names = R.small(want.withColumn("parts", F.count("*").over(Window.partitionBy(*of)))), R.small(names)
    met = intron.select("locus", "tx", "start", "end").distinct().join(want, "locus")
    # an isoform has two junctions at most, so the least and the greatest are all of them
    ends = {"start": F.col("start") - 1, "end": F.col("end") + 1}
    beside = [f(v).alias(f"{f.__name__}_{c}") for c, v in ends.items() for f in (F.min, F.max)]
    whole = met.where("plain").groupBy("tx", *of, "parts").agg(F.count("*").alias("has"), *beside).where("has = parts")
    marks = ["min_start", "max_start", "min_end", "max_end"]
    marked = whole.join(exons.select("tx", "start", "end").distinct(), "tx").where(F.col("start").isin(*[F.col(m) for m in marks]) | F.col("end").isin(*[F.col(m) for m in marks]))
    rows = lambda df, kind: df.join(names, "__k").select("event_id", "isoform", "tx", F.lit(kind).alias("type"), "start", "end")
    return rows(met, "intron").unionByName(rows(marked, "exon"))


#: Fixed value: tracks that one view holds.
MOST_TRACKS = 4


def check_view(genes: dict[str, int], tracks: list[str], samples: list[str], gene: str | None = None, region: tuple[str, int, int] | None = None, lengths: dict[str, int] | None = None) -> None:
    """Raises unless a view names one gene or one region inside a chromosome, and one to four tracks that exist.

    genes: how many genes have a name; samples: the tracks that there are.
    """
    if not 1 <= len(tracks) <= MOST_TRACKS:
        raise ValueError(f"a view has 1 to {MOST_TRACKS} tracks")
    if unknown := [t for t in tracks if t not in samples]:
        raise ValueError(f"no such tracks: {', '.join(unknown)}")
    if (gene is None) == (region is None):
        raise ValueError("a view is of one gene or of one region")
    if gene is not None:
        if gene not in genes:
            raise ValueError(f"no gene is named {gene}")
        if genes[gene] > 1:
            raise ValueError(f"{genes[gene]} genes are named {gene}; give the gene's id")
    if region is not None:
        seq, start, end = region
        if lengths is not None and seq not in lengths:
            raise ValueError(f"no chromosome is named {seq}")
        if not 1 <= start <= end or (lengths is not None and end > lengths[seq]):
            raise ValueError("the region does not lie inside its chromosome")
