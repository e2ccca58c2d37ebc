"""Read quantification over two-block fragments and, for general fragments, arrays of blocks.

Alignments (read_name, flag, seq, pos, cigar) become fragments by ``cigar_blocks`` and ``pair_fragments``; the other
operators take rows (seq, direction, blocks: array<struct<start, end>>), 1-based and closed. Those of junctions, spans
and introns also take ``equal_fragments``'s rows, which stand for times fragments each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals as I
from . import relational as R

#: Flag bits.
UNMAPPED_SECONDARY_SUPPLEMENTARY, PAIRED, REVERSE, MATE_REVERSE, FIRST = 0x904, 0x1, 0x10, 0x20, 0x40


def read_gate(aln: DataFrame) -> DataFrame:
    return aln.where(F.col("flag").bitwiseAND(UNMAPPED_SECONDARY_SUPPLEMENTARY) == 0)


def cigar_blocks(pos: Column, cigar: Column) -> Column:
    """Aligned blocks of a read: M, =, X and D extend a block, N starts the next, other operations take no reference."""
    ops = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(0))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    init = F.struct(pos.cast("long").alias("at"), pos.cast("long").alias("from"), empty.alias("done"))

    def step(acc: Column, op: Column) -> Column:
        n = F.regexp_extract(op, "^[0-9]+", 0).cast("long")
        kind = F.substring(op, -1, 1)
        block = F.struct(acc["from"].alias("start"), (acc["at"] - 1).alias("end"))
        closed = F.when(acc["at"] > acc["from"], F.concat(acc["done"], F.array(block))).otherwise(acc["done"])
        over = acc["at"] + n
        return (
            F.when(kind.isin("M", "D", "=", "X"), F.struct(over.alias("at"), acc["from"].alias("from"), acc["done"].alias("done")))
            .when(kind == "N", F.struct(over.alias("at"), over.alias("from"), closed.alias("done")))
            .otherwise(acc)
        )

    last = lambda acc: F.when(acc["at"] > acc["from"], F.concat(acc["done"], F.array(F.struct(acc["from"].alias("start"), (acc["at"] - 1).alias("end"))))).otherwise(acc["done"])
    return F.aggregate(ops, init, step, last)


def direction(flag: Column) -> Column:
    """'-' or '+' of a fragment from one of its reads: the first read's strand, or the mate's for the second."""
    bit = lambda b: flag.bitwiseAND(b) != 0
    minus = F.when(bit(PAIRED) & ~bit(FIRST), bit(MATE_REVERSE)).otherwise(bit(REVERSE))
    return F.when(minus, "-").otherwise("+")


def pair_fragments(aln: DataFrame) -> DataFrame:
    """(read_name, seq, direction, kind, blocks): pairs of one name merged by their geometry.

    kind: single, unpaired (one record of a pair), chimeric (mates on two chromosomes; no blocks), long (disjoint
    mates), short (one inside the other), intersect (stitched) or inconsistent (both kept). More than two records
    of a name: the first two in (pos, flag) order.
    """
    got = read_gate(aln).withColumn("b", cigar_blocks(F.col("pos"), F.col("cigar")))
    rec = F.struct("pos", "flag", "seq", "b")
    g = got.groupBy("read_name").agg(F.sort_array(F.collect_list(rec)).alias("r"))
    one, two = F.get("r", 0), F.get("r", 1)
    end = lambda x: F.element_at(x["b"], -1)["end"]
    start = lambda x: F.element_at(x["b"], 1)["start"]
    swap = (start(one) == start(two)) & (end(one) > end(two))
    g = g.withColumns({"a": F.when(two.isNotNull() & swap, two).otherwise(one), "z": F.when(two.isNotNull() & swap, one).otherwise(two)})
    a, z = F.col("a"), F.col("z")
    at = F.filter(a["b"], lambda x: x["end"] >= start(z))
    meet = F.get(at, 0)
    before = F.filter(a["b"], lambda x: x["end"] < start(z))
    joined = F.concat(before, F.array(F.struct(meet["start"].alias("start"), F.get(z["b"], 0)["end"].alias("end"))), F.slice(z["b"], 2, F.greatest(F.size(z["b"]) - 1, F.lit(0))))
    paired = a["flag"].bitwiseAND(PAIRED) != 0
    kind = (
        F.when(~paired, "single").when(z.isNull(), "unpaired").when(a["seq"] != z["seq"], "chimeric")
        .when(end(a) < start(z), "long").when(end(a) >= end(z), F.when(swap, "intersect").otherwise("short"))
        .when(meet["start"] <= start(z), "intersect").otherwise("inconsistent")
    )
    g = g.withColumn("kind", kind)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    reads = (
        F.when(F.col("kind").isin("single", "unpaired", "short"), F.array(a["b"]))
        .when(F.col("kind") == "chimeric", F.array(none))
        .when(F.col("kind") == "intersect", F.array(joined))
        .otherwise(F.array(a["b"], z["b"]))
    )
    return g.select("read_name", a["seq"].alias("seq"), direction(a["flag"]).alias("direction"), "kind", reads.alias("reads"))


def equal_fragments(frags: DataFrame) -> DataFrame:
    """Equal rows once, with times: how often each is there."""
    return frags if "times" in frags.columns else frags.groupBy(*frags.columns).agg(F.count("*").alias("times"))


def _with_times(frags: DataFrame, *cols: str) -> list[str]:
    return [*cols, "times"] if "times" in frags.columns else list(cols)


def _reads(rows: DataFrame) -> list[Column]:
    """Fragments of rows by direction and in all: neg, pos and total."""
    if "times" not in rows.columns:
        return [F.count_if(F.col("direction") == "-").alias("neg"), F.count_if(F.col("direction") == "+").alias("pos"), F.count("*").alias("total")]
    n = lambda d: F.sum(F.when(F.col("direction") == d, F.col("times")).otherwise(F.lit(0).cast("long")))
    return [n("-").alias("neg"), n("+").alias("pos"), F.sum("times").alias("total")]


def junction_counts(frags: DataFrame, least: int = 5) -> DataFrame:
    """(seq, start, end, neg, pos, total): gaps between neighbouring blocks of at least ``least`` bases each."""
    j = frags.select(*_with_times(frags, "seq", "direction"), F.explode(F.transform(F.filter(F.transform("blocks", lambda x, i: F.struct(x.alias("l"), F.get("blocks", i + 1).alias("r"))), lambda x: x["r"].isNotNull()), lambda x: x)).alias("p"))
    wide = lambda x: x["end"] - x["start"] + 1 >= least
    j = j.where(wide(F.col("p.l")) & wide(F.col("p.r")) & (F.col("p.r.start") > F.col("p.l.end") + 1))
    return j.groupBy("seq", (F.col("p.l.end") + 1).alias("start"), (F.col("p.r.start") - 1).alias("end")).agg(*_reads(j))


def junction_sides(j: DataFrame) -> DataFrame:
    """(side, seq, at, total): junction reads by left and by right end."""
    left = j.groupBy("seq", F.col("start").alias("at")).agg(F.sum("total").alias("total")).withColumn("side", F.lit("left"))
    return left.unionByName(j.groupBy("seq", F.col("end").alias("at")).agg(F.sum("total").alias("total")).withColumn("side", F.lit("right"))).select("side", "seq", "at", "total")


def _by_direction() -> list[Column]:
    return [F.count_if(F.col("direction") == "-").alias("neg"), F.count_if(F.col("direction") == "+").alias("plus")]


def span_counts(frags: DataFrame, points: DataFrame, left: int = 5, right: int = 4) -> DataFrame:
    """(seq, pos, neg, plus): blocks longer than left + right that reach ``left`` bases before a point and past it."""
    blocks = frags.select(*_with_times(frags, "seq", "direction"), F.explode("blocks").alias("b")).select(*_with_times(frags, "seq", "direction"), F.col("b.start").alias("bs"), F.col("b.end").alias("be")).where(F.col("be") - F.col("bs") + 1 > left + right)
    zone = blocks.groupBy("seq", (F.col("bs") + left - 1).alias("start"), (F.col("be") - 1).alias("end")).agg(*_reads(blocks)[:2]).withColumnRenamed("pos", "plus")
    at = points.select("seq", F.col("pos").alias("start"), F.col("pos").alias("end")).distinct()
    hit = I.overlap_join(zone, at)
    n = hit.groupBy("seq", F.col("b_start").alias("pos")).agg(F.sum("neg").alias("neg"), F.sum("plus").alias("plus"))
    out = at.select("seq", F.col("start").alias("pos")).join(n, ["seq", "pos"], "left")
    return out.select("seq", "pos", F.coalesce("neg", F.lit(0)).alias("neg"), F.coalesce("plus", F.lit(0)).alias("plus"))


def fragment_spans(frags: DataFrame) -> DataFrame:
    return frags.select("seq", "direction", F.array_min(F.transform("blocks", lambda b: b["start"])).alias("start"), F.array_max(F.transform("blocks", lambda b: b["end"])).alias("end"))


def roi_counts(frags: DataFrame, roi: DataFrame) -> DataFrame:
    """(name, neg, plus): fragments that lie inside a region; roi: (name, seq, start, end)."""
    # spans and regions of the same bounds count once, however many fragments and names they have
    spans = fragment_spans(frags).groupBy("seq", "start", "end").agg(*_by_direction())
    at = ["seq", "start", "end"]
    hit = I.overlap_join(spans, roi.select(*at).distinct(), how="within").groupBy(*[F.col(f"b_{c}").alias(c) for c in at])
    n = roi.join(hit.agg(F.sum("neg").alias("neg"), F.sum("plus").alias("plus")), at).groupBy("name").agg(F.sum("neg").alias("neg"), F.sum("plus").alias("plus"))
    return roi.select("name").join(n, "name", "left").select("name", F.coalesce("neg", F.lit(0)).alias("neg"), F.coalesce("plus", F.lit(0)).alias("plus"))


def chrom_counts(frags: DataFrame) -> DataFrame:
    return frags.groupBy("seq").agg(F.count_if(F.col("direction") == "-").alias("neg"), F.count_if(F.col("direction") == "+").alias("plus"), F.count("*").alias("total"))


#: Bits of a junction in the reference.
ON_MINUS, ON_PLUS, DECAY_ONLY = 1, 2, 4


def junction_report(j: DataFrame, ref: DataFrame) -> DataFrame:
    """(seq, start, end, strand, total, pos, neg, annotated, nmd) of all junctions seen or annotated.

    strand: '-' where the reference has the junction on the minus strand (also if on both), '+', or '.' if it is not
    annotated; nmd: only decaying transcripts have it. ref: (seq, start, end, strand, nmd_only).
    """
    bit = F.when(F.col("strand") == "-", ON_MINUS).when(F.col("strand") == "+", ON_PLUS).otherwise(0)
    known = ref.groupBy("seq", "start", "end").agg(F.bit_or(bit.bitwiseOR(F.when(F.col("nmd_only"), DECAY_ONLY).otherwise(0))).alias("flag"))
    got = j.join(known, ["seq", "start", "end"], "full").withColumn("flag", F.coalesce("flag", F.lit(0)))
    has = lambda b: F.col("flag").bitwiseAND(b) != 0
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    strand = F.when(has(ON_MINUS), "-").when(has(ON_PLUS), "+").otherwise(".")
    return got.select("seq", "start", "end", strand.alias("strand"), zero("total"), zero("pos"), zero("neg"), (F.col("flag") != 0).alias("annotated"), has(DECAY_ONLY).alias("nmd"))


def junction_qc(report: DataFrame) -> DataFrame:
    """One row: reads over annotated junctions, over others, and over those of decaying transcripts alone."""
    reads = lambda test: F.coalesce(F.sum(F.when(test, F.col("total"))), F.lit(0))
    return report.agg(reads(F.col("annotated")).alias("annotated"), reads(~F.col("annotated")).alias("unannotated"), reads(F.col("nmd")).alias("nmd"))


def read_classes(roi: DataFrame, chrom: DataFrame) -> DataFrame:
    """One row of fragments by class: regions by the first part of their name, chromosomes by how theirs begins (M or MT,
    ERCC). roi: ``roi_counts`` with one row per region; chrom: ``chrom_counts``."""
    n = lambda test, v: F.coalesce(F.sum(F.when(test, v)), F.lit(0))
    both = F.col("neg") + F.col("plus")
    kinds = {"intergenic": "Intergenic", "rrna": "rRNA", "non_polya": "NonPolyA"}
    a = roi.agg(*[n(F.col("name").startswith(t), both).alias(c) for c, t in kinds.items()])
    b = chrom.agg(n(F.col("seq").startswith("M"), F.col("total")).alias("mitochondrial"), n(F.col("seq").startswith("ERCC"), F.col("total")).alias("ercc"))
    return a.join(F.broadcast(b))  # one row each


def directionality(j: DataFrame, ref: DataFrame, reads: int = 8, ratio: int = 4) -> DataFrame:
    """One row: junctions that agree with, oppose, or show no direction, scores, and the library's strand (-1, 0, 1).

    j has neg and pos; ref gives strands per (seq, start, end), where minus wins if both are annotated.
    """
    strand = ref.groupBy("seq", "start", "end").agg(F.min(F.when(F.col("strand") == "-", 0).otherwise(1)).alias("plus"))
    k = j.where(F.col("neg") + F.col("pos") > reads).join(strand, ["seq", "start", "end"], "left")
    lean = F.when(F.col("neg") > ratio * F.col("pos"), 0).when(F.col("pos") > ratio * F.col("neg"), 1)
    k = k.withColumn("lean", lean)
    one = k.agg(
        F.count_if(F.col("lean") == F.col("plus")).alias("same"), F.count_if(F.col("lean") != F.col("plus")).alias("opposed"),
        F.count_if(F.col("lean").isNull()).alias("none"), F.count_if(F.col("lean").isNotNull() & F.col("plus").isNotNull()).alias("known"), F.count_if(F.col("plus").isNotNull()).alias("annotated"),
    )
    score = F.floor(F.lit(10000) * F.col("known") / (F.col("annotated") + 1))
    return one.withColumn("score", score).withColumn("strand", F.when((score >= 9000) & (F.col("same") > 100 * F.col("opposed")), 1).when((score >= 9000) & (F.col("opposed") > 100 * F.col("same")), -1).otherwise(0))


def ir_ratio(depth: Column, coverage: Column, left: Column, right: Column) -> Column:
    """Retention ratio: coverage stands in for a depth below 1; 0 without depth and splices."""
    top = F.greatest(left, right)
    value = F.when(depth < 1, coverage).otherwise(depth)
    return F.when((depth == 0) & (top == 0), 0.0).otherwise(F.coalesce(F.try_divide(value.cast("double"), (value + top).cast("double")), F.lit(0.0)))


def ir_warning(depth: Column, exact: Column, left: Column, right: Column, span_left: Column, span_right: Column) -> Column:
    """Why a ratio may not hold; spans: reads over the intron's left and right end, which should be as deep as it is."""
    most, least = F.greatest(span_left, span_right), F.least(span_left, span_right)
    uneven = ((most > depth + 2) & (most > depth * 1.5)) | ((least + 2 < depth) & (least * 1.5 < depth))
    return F.when(exact + depth < 10, "LowCover").when(exact < 4, "LowSplicing").when(exact * 1.33333333 < F.greatest(left, right), "MinorIsoform").when(uneven, "NonUniformIntronCover").otherwise("-")


#: Bases skipped at both ends of an intron, and bases behind them whose depth is reported.
EDGE_SKIP, EDGE = 5, 50


def measure_introns(frags: DataFrame, introns: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """A row per intron with what the report of an unstranded library holds: excluded_bases, coverage, depth (trimmed
    mean), p25, p50, p75, span_left, span_right, first50, last50, splice_left, splice_right, splice_exact, ir_ratio and
    warning.

    introns: (id, seq, start, end), 1-based and closed; blocks: (id, seq, start, end), the parts of each intron that
    are measured, by default all of it. frags: (seq, direction, blocks).
    """
    from . import histogram as H

    star = F.lit("*").alias("strand")
    if blocks is None:
        blocks = introns.select("id", "seq", "start", "end")
    held = frags.select(*_with_times(frags, "seq"), F.explode("blocks").alias("b")).select(*_with_times(frags, "seq"), star, "b.*")
    runs = I.coverage_runs(held, times="times" if "times" in held.columns else None)
    edges = introns.select("seq", F.explode(F.array(F.struct(F.concat("id", F.lit("|first")).alias("id"), (F.col("start") + EDGE_SKIP).alias("start"), (F.col("start") + EDGE_SKIP + EDGE - 1).alias("end")), F.struct(F.concat("id", F.lit("|last")).alias("id"), (F.col("end") - EDGE_SKIP - EDGE + 1).alias("start"), (F.col("end") - EDGE_SKIP).alias("end")))).alias("x")).select("x.id", "seq", "x.start", "x.end")
    parts = blocks.select("id", "seq", "start", "end").unionByName(edges).withColumn("strand", F.lit("*"))
    h = R.settled(_region_hist(runs, parts))  # a row per intron and depth
    stats = H.hist_trimmed_mean(h, "id").join(H.hist_coverage(h, "id"), "id").join(H.hist_percentiles(h, "id"), "id").join(h.groupBy("id").agg(F.sum("n").alias("inclbases")), "id")
    whole = stats.where(~F.col("id").rlike("\\|(first|last)$")).withColumnRenamed("trimmed_mean", "depth")
    edge = lambda e: stats.where(F.col("id").endswith(f"|{e}")).select(F.expr(f"substring(id, 1, length(id) - {len(e) + 1})").alias("id"), F.col("trimmed_mean").alias(f"{e}50"))
    j = R.settled(junction_counts(frags))  # a row per junction
    sides = lambda c, n: j.groupBy("seq", c).agg(F.sum("total").alias(n))
    points = introns.select("seq", (F.col("start") - 1).alias("pos")).unionByName(introns.select("seq", F.col("end").alias("pos")))
    spans = span_counts(frags, points).select("seq", "pos", (F.col("neg") + F.col("plus")).alias("n"))
    got = introns.join(whole, "id").join(edge("first"), "id").join(edge("last"), "id")
    got = got.join(sides("start", "splice_left"), ["seq", "start"], "left").join(sides("end", "splice_right"), ["seq", "end"], "left")
    got = got.join(j.select("seq", "start", "end", F.col("total").alias("splice_exact")), ["seq", "start", "end"], "left")
    got = got.join(spans.select("seq", (F.col("pos") + 1).alias("start"), F.col("n").alias("span_left")), ["seq", "start"], "left").join(spans.select("seq", F.col("pos").alias("end"), F.col("n").alias("span_right")), ["seq", "end"], "left")
    got = got.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("splice_left", "splice_right", "splice_exact", "span_left", "span_right")})
    c = F.col
    return got.select(
        *introns.columns, (c("end") - c("start") + 1 - c("inclbases")).alias("excluded_bases"), "coverage", "depth", "p25", "p50", "p75", "span_left", "span_right", "first50", "last50", "splice_left", "splice_right", "splice_exact",
        ir_ratio(c("depth"), c("coverage"), c("splice_left"), c("splice_right")).alias("ir_ratio"), ir_warning(c("depth"), c("splice_exact"), c("splice_left"), c("splice_right"), c("span_left"), c("span_right")).alias("warning"),
    )


def _region_hist(runs: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, depth, n) over all parts of an id."""
    return I.depth_pieces(runs, parts, "id").select("id", F.inline_outer("hist")).groupBy("id", "depth").agg(F.sum("n").alias("n"))


def burden(measured: DataFrame, kind: Column) -> DataFrame:
    """One row: summed depths of clean introns, of those inside known exons, and of the others; kind is the last part of
    an intron's name."""
    depth = lambda test: F.coalesce(F.sum(F.when(test, F.col("depth"))), F.lit(0.0))
    clean, known = kind.startswith("clean"), kind.contains("known-exon")
    return measured.agg(depth(clean).alias("clean"), depth(~clean & known).alias("known_exon"), depth(~clean & ~known).alias("anti_sense"))


def oriented(frags: DataFrame, library: int) -> DataFrame:
    """Fragments of a stranded library with the strand they come from as direction: -1 turns them, 0 makes all '*'."""
    turned = F.when(F.col("direction") == "-", "+").otherwise("-")
    return frags.withColumn("direction", F.lit("*") if not library else turned if library < 0 else F.col("direction"))


def alignment_report(aln: DataFrame, pairs: DataFrame) -> DataFrame:
    """(name, value): reads by what became of them; aln: records before the gate, pairs: ``pair_fragments`` of them."""
    bit = lambda b: F.col("flag").bitwiseAND(b) != 0
    length = F.aggregate(F.flatten("reads"), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"] + 1)
    one = aln.agg(F.count("*").alias("records"), F.count_if(bit(0x4)).alias("unmapped"), F.count_if(~bit(0x4) & bit(0x900)).alias("secondary"))
    kinds = ("single", "long", "short", "intersect", "inconsistent", "chimeric", "unpaired")
    two = pairs.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.coalesce(F.sum(length), F.lit(0)).alias("nucleotides"))
    long = lambda d: d.select(F.explode(F.create_map(*[x for c in d.columns for x in (F.lit(c), F.col(c))])).alias("name", "value"))
    return long(one).unionByName(long(two))
