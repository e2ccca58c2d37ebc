"""The whole chain over tables: reference from exons, counts from fragments, assays from samples, and the model.

Each step takes and gives DataFrames; ``settled`` tables are the ones that a build would write. Samples are kept apart
by carrying their name in front of the chromosome, so one plan serves all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import annotation as A
from ..operators import collate as C
from ..operators import events as E
from ..operators import quantify as Q
from ..operators import relational as R
from .model import EventModel

#: Types in stored order.
ORDER = ("MXE", "SE", "AFE", "ALE", "A5SS", "A3SS", "RI")
PARTS = ("event1a", "event2a", "event1b", "event2b")


def event_table(intron: DataFrame, flanks: DataFrame, exons: DataFrame, measurable: DataFrame) -> DataFrame:
    """All events: event_type, the four introns (null where a type has fewer) and the region of each. intron:
    ``annotation.introns`` or ``intron_steps``.

    The region is the skipping junction of SE, the common span of MXE, the intron of RI (measurable ones inside an exon)
    and the longer intron of the other types. flanks: (locus, up, down); measurable: (locus).
    """
    a5, a3 = (E.alternative_sites(intron, flanks, acceptor) for acceptor in (True, False))
    ri = R.semi_join(E.retained(intron, exons), measurable, ["locus"]).select(F.col("locus").alias("event1a")).distinct()
    found = {
        "MXE": E.mutually_exclusive(intron).withColumnRenamed("skip", "region"), "SE": E.skipped_exons(intron), "AFE": E.alternative_ends(intron, a5, True), "ALE": E.alternative_ends(intron, a3, False),
        "A5SS": a5, "A3SS": a3, "RI": ri.withColumn("event1b", F.col("event1a")),
    }
    out = None
    for kind in ORDER:
        df = found[kind]
        part = lambda c: (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c)  # noqa: B023, E731
        region = F.col("region") if kind == "MXE" else F.col("event1a" if kind == "RI" else "event1b")
        df = df.select(F.lit(kind).alias("event_type"), *[part(c) for c in PARTS], region.alias("region"))
        out = df if out is None else out.unionByName(df)
    return out


def with_islands_of(events: DataFrame, flanks: DataFrame, intron: DataFrame) -> DataFrame:
    """Adds strand, jg_up and jg_down: the islands whose reads an event shares; the downstream one of MXE is that of its
    second intron, and types with one shared side have one."""
    k = F.col("event_type")
    side = lambda e: flanks.select(F.col("locus").alias(e), F.col("up").alias(f"up_{e}"), F.col("down").alias(f"down_{e}"))
    got = events.join(side("event1a"), "event1a", "left").join(side("event2a"), "event2a", "left")
    got = got.join(intron.select(F.col("locus").alias("event1a"), "strand").distinct(), "event1a", "left")
    up = F.when(k.isin("MXE", "SE", "ALE", "A3SS", "RI"), F.col("up_event1a"))
    down = F.when(k == "MXE", F.col("down_event2a")).when(k.isin("SE", "AFE", "A5SS", "RI"), F.col("down_event1a"))
    return got.select(*events.columns, "strand", up.alias("jg_up"), down.alias("jg_down"))


def build_reference(exons: DataFrame, coding: Sequence[str], decay: str, retained: str = "intron", regions: DataFrame | None = None) -> dict[str, DataFrame]:
    """genes, islands, introns (of every transcript, not kept), sites (the distinct ones), flanks, measurable, junctions,
    points and events of an annotation.

    Transcripts are read twice, for what their introns and their exons differ in; all else follows from these two.
    """
    intron = R.settled(A.intron_steps(exons, list(coding), decay))
    rows = A.introns(exons)
    exons = R.settled(exons.select("gene", "seq", "strand", "start", "end", "biotype").distinct())
    islands = A.exon_islands(exons, retained)
    flanks = R.settled(A.rescue_islands(A.flanking_islands(intron, islands), intron, islands))
    usable = intron if regions is None else A.outside_regions(intron, regions)
    measurable = R.settled(A.measurable_blocks(usable, exons.where(~F.coalesce(F.col("biotype").rlike(retained), F.lit(False))), regions=regions))
    events = R.settled(with_islands_of(event_table(intron, flanks, exons, measurable), flanks, intron))
    rank = E.ranked_transcript(intron, list(coding))
    name = lambda x, e: rank.select(F.col("locus").alias(e), F.col("tx").alias(f"tx_{x}"), F.col("n").alias(f"n_{x}"))
    named = events.join(name("a", "event1a"), "event1a", "left").join(name("b", "event1b"), "event1b", "left")
    every = E.event_names(named).withColumn("event_id", F.xxhash64("event_type", *[F.coalesce(c, F.lit("")) for c in PARTS]))
    sites = R.settled(intron.select("seq", "start", "end", "strand", "locus").distinct())
    junctions = intron.groupBy("seq", "start", "end", "strand").agg(F.every("nmd_only").alias("nmd_only"))
    return {"genes": A.genes(exons), "islands": islands, "introns": rows, "sites": sites, "flanks": flanks, "measurable": measurable, "junctions": junctions, "points": A.span_points(sites), "events": R.settled(every)}


def quantify(frags: DataFrame, ref: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """junctions (sample, seq, start, end, neg, pos, total) and introns (the report of every measurable intron in every
    sample); frags: (sample, seq, direction, blocks), of which equal ones are counted first."""
    own = F.concat_ws("|", "sample", "seq")
    frags = frags if "times" in frags.columns else R.settled(Q.equal_fragments(frags.select("sample", "seq", "direction", "blocks")))
    keyed = frags.select(own.alias("seq"), "direction", "blocks", "times")
    apart = lambda df: df.select(F.substring_index("seq", "|", 1).alias("sample"), F.expr("substring(seq, instr(seq, '|') + 1)").alias("seq"), *[c for c in df.columns if c != "seq"])
    samples = frags.agg(F.sort_array(F.collect_set("sample"))).scalar()
    site = R.semi_join(ref["sites"], ref["measurable"], ["locus"])
    site = site.withColumn("sample", F.explode(samples)).select(F.concat_ws("|", "sample", "locus").alias("id"), "locus", "strand", own.alias("seq"), "start", "end")
    return {"junctions": apart(Q.junction_counts(keyed)), "introns": apart(Q.measure_introns(keyed, site))}


def collate(ref: dict[str, DataFrame], counts: dict[str, DataFrame], conditions: DataFrame) -> DataFrame:
    """Assay rows (event_id, event_type, sample, condition, included ... down_exc) of all events and measured introns;
    conditions: (sample, condition)."""
    c = F.col
    j = R.settled(counts["junctions"].join(ref["sites"], ["seq", "start", "end"]).join(ref["flanks"], "locus", "left").select("sample", "locus", "seq", "start", "end", "strand", c("total").alias("count"), c("up").alias("jg_up"), c("down").alias("jg_down")))
    so = R.settled(C.splice_over(j))
    ir = counts["introns"].join(so.select("sample", "locus", "so_l", "so_r"), ["sample", "locus"], "left").withColumns({"so_l": F.coalesce("so_l", F.lit(0)), "so_r": F.coalesce("so_r", F.lit(0))})
    ir = R.settled(ir.withColumns(C.intron_stats(c("depth"), c("coverage"), c("so_l"), c("so_r"))))
    ev = ref["events"]
    got = C.event_measures(ev, j.select("sample", "locus", "count"), ir.select("sample", "locus", "strand", "depth", c("span_left").alias("left"), c("span_right").alias("right"), "total_depth"), so)
    k, parts = c("event_type"), [c(f"n{p}").cast("double") for p in ("1a", "2a", "1b", "2b")]
    up, down = C.participation(k, *parts)
    both, ri, mxe = k.isin("MXE", "SE"), k == "RI", k == "MXE"
    splice = got.select(
        "event_id", "event_type", "sample", C.included(k, parts[0], parts[1], parts[0]).alias("included"), C.excluded(k, parts[2], parts[3], F.lit(0)).alias("excluded"), c("event_depth").alias("depth"),
        *[v.cast("double").alias(x) for x, v in C.event_coverage(k, up, down, c("total_up"), c("total_down")).items()],
        F.when(both, parts[0]).when(ri, parts[1]).alias("up_inc"), F.when(both, parts[1]).when(ri, parts[3]).alias("down_inc"), F.when(mxe, parts[2]).alias("up_exc"), F.when(mxe, parts[3]).alias("down_exc"),
    )
    minus = c("strand") == "-"
    kept = ir.select(
        F.xxhash64(F.lit("IR"), "locus").alias("event_id"), F.lit("IR").alias("event_type"), "sample", c("depth").alias("included"), c("splice_over_max").cast("double").alias("excluded"), c("total_depth").cast("double").alias("depth"),
        "coverage", c("depth").alias("min_depth"), F.when(minus, c("span_right")).otherwise(c("span_left")).cast("double").alias("up_inc"), F.when(minus, c("span_left")).otherwise(c("span_right")).cast("double").alias("down_inc"),
        F.lit(None).cast("double").alias("up_exc"), F.lit(None).cast("double").alias("down_exc"),
    )
    return splice.unionByName(kept).join(R.small(conditions), "sample", "left")  # a row per sample


def make_model(ref: dict[str, DataFrame], assay: DataFrame, conditions: DataFrame) -> EventModel:
    """The model of the collated rows: events with their introns beside them, samples with their conditions."""
    ev = ref["events"].select("event_id", "event_type", "event_name", "region", *PARTS)
    ir = R.semi_join(ref["sites"], ref["measurable"], ["locus"]).select("locus")
    ir = ir.select(F.xxhash64(F.lit("IR"), "locus").alias("event_id"), F.lit("IR").alias("event_type"), F.concat(F.lit("IR:"), "locus").alias("event_name"), F.col("locus").alias("region"), F.col("locus").alias("event1a"))
    return EventModel(assay, ev.unionByName(ir, allowMissingColumns=True), conditions)
