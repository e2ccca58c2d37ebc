"""Splice events from numbered introns (tx, gene, seq, strand, start, end, n, n_all, locus) and their islands.

The operators that find events also take ``annotation.intron_steps``'s rows, which hold what they need of each intron once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.locus import locus
from . import relational as R


def skip_coords(intron: DataFrame) -> DataFrame:
    """Adds skip: the locus from this intron to the next in reading direction; null on the last of a transcript."""
    by = Window.partitionBy("tx").orderBy("n")
    nxt = F.lead(F.struct("start", "end", "locus")).over(by)
    df = intron.withColumn("__n", nxt)
    span = locus(F.col("seq"), F.least("start", "__n.start"), F.greatest("end", "__n.end"), F.col("strand"))
    return df.withColumn("skip", F.when(F.col("__n").isNotNull(), span)).withColumn("next", F.col("__n.locus")).drop("__n")


def _skips(intron: DataFrame) -> DataFrame:
    return (intron if "skip" in intron.columns else skip_coords(intron)).where("skip IS NOT NULL")


def skipped_exons(intron: DataFrame) -> DataFrame:
    """SE: (event1a, event2a, event1b): two introns around an exon and the real intron that skips it."""
    sk = _skips(intron).select(F.col("locus").alias("event1a"), F.col("next").alias("event2a"), F.col("skip").alias("event1b")).distinct()
    return R.semi_join(sk, intron.select(F.col("locus").alias("event1b")).distinct(), ["event1b"]).select("event1a", "event2a", "event1b")


def mutually_exclusive(intron: DataFrame) -> DataFrame:
    """MXE: pairs of transcripts' intron pairs over one skip locus that differ in both introns; a starts first."""
    sk = _skips(intron).select("skip", "locus", "next", "start", "end", "strand").distinct()
    minus = F.col("strand") == "-"
    order = [F.when(minus, F.col("end")).otherwise(F.col("start")), F.when(minus, -F.col("start")).otherwise(F.col("end")), F.col("next")]
    p = R.pair_combinations(sk.withColumns({"o1": order[0], "o2": order[1]}), ["skip"], ["o1", "o2", "locus", "next"], ["locus", "next"])
    p = p.where("a_locus <> b_locus AND a_next <> b_next")
    return p.select("skip", F.col("a_locus").alias("event1a"), F.col("a_next").alias("event2a"), F.col("b_locus").alias("event1b"), F.col("b_next").alias("event2b"))


def _sharing(site: DataFrame, acceptor: bool, cols: list[str]) -> DataFrame:
    """Pairs (a shorter) of introns that share the acceptor (donor) base on their chromosome and strand."""
    plus = F.col("strand") == "+"
    fixed = F.when(plus == F.lit(acceptor), F.col("end")).otherwise(F.col("start"))
    width = F.col("end") - F.col("start")
    site = site.withColumns({"site": fixed, "width": width})
    return R.pair_combinations(site, ["seq", "strand", "site"], ["width", "locus"], ["locus", *cols])


def alternative_sites(intron: DataFrame, islands: DataFrame, acceptor: bool) -> DataFrame:
    """A5SS (shared acceptor) or A3SS (shared donor): both introns flanked by the same pair of islands."""
    site = intron.select("seq", "strand", "start", "end", "locus").distinct().join(islands, "locus")
    p = _sharing(site.where("up IS NOT NULL AND down IS NOT NULL"), acceptor, ["up", "down"])
    return p.where("a_up = b_up AND a_down = b_down").select(F.col("a_locus").alias("event1a"), F.col("b_locus").alias("event1b"))


def alternative_ends(intron: DataFrame, sites: DataFrame, first: bool) -> DataFrame:
    """AFE (first introns that share their acceptor) or ALE (last ones that share their donor), without ``sites``."""
    steps = "first" in intron.columns
    at_end = intron.where(("first" if first else "last") if steps else "n = 1" if first else "n = n_all").select("seq", "strand", "start", "end", "locus").distinct()
    p = _sharing(at_end, first, []).select(F.col("a_locus").alias("event1a"), F.col("b_locus").alias("event1b"))
    return R.anti_join(p, sites, ["event1a", "event1b"])


def retained(intron: DataFrame, exons: DataFrame) -> DataFrame:
    """RI: introns inside an exon of another transcript, with that exon's bounds."""
    from . import intervals as I

    site = intron.select("seq", "strand", "start", "end", "locus").distinct()
    ex = exons.select("seq", "strand", "start", "end").distinct()
    return I.overlap_join(site, ex, how="within").select("locus", F.col("b_start").alias("exon_start"), F.col("b_end").alias("exon_end"))


def coding_rank(coding: list[str]) -> Column:
    return F.when(F.col("biotype").isin(coding), 0).otherwise(1)


def ranked_transcript(intron: DataFrame, coding: list[str]) -> DataFrame:
    """The transcript that names a locus: lowest support level text, coding before others, then name."""
    if "best" in intron.columns:
        return intron.groupBy("locus").agg(F.min("best").alias("best")).select("locus", "best.tx", "best.n")
    return R.distinct_on(intron.withColumn("code", coding_rank(coding)), ["locus"], ["tsl", "code", "tx"]).select("locus", "tx", "n")


def event_names(events: DataFrame, kind: str | None = None) -> DataFrame:
    """Adds event_name from tx_a, n_a, tx_b, n_b by the type's pattern; without ``kind`` by each row's event_type."""
    tx = lambda x: F.col(f"tx_{x}").cast("string")
    num = lambda x, by: (F.col(f"n_{x}") + by).cast("string")
    exon = lambda x, by: F.concat(tx(x), F.lit("-exon"), num(x, by))
    sides = {
        "MXE": (exon("a", 1), exon("b", 1)),
        "SE": (exon("a", 1), F.concat(tx("b"), F.lit("-int"), num("b", 0))),
        "AFE": (exon("a", 0), exon("b", 0)),
        "ALE": (exon("a", 1), exon("b", 1)),
        "A5SS": (exon("a", 0), exon("b", 0)),
        "A3SS": (exon("a", 1), exon("b", 1)),
        "RI": (exon("a", 0), F.concat(tx("b"), F.lit("-intron"), num("b", 0))),
    }
    of = {k: F.concat(F.lit(f"{k}:"), a, F.lit(";"), b) for k, (a, b) in sides.items()}
    return events.withColumn("event_name", of[kind] if kind else F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in of.items()]))
