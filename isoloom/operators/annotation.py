"""Reference tables from exons (tx, gene, seq, strand, start, end, biotype, tsl): islands, introns, measurable blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.locus import locus
from . import intervals as I
from . import relational as R


def genes(exons: DataFrame) -> DataFrame:
    """Gene spans where the annotation has no gene rows."""
    return exons.groupBy("gene", "seq", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def gene_groups(exons: DataFrame, stranded: bool = True) -> DataFrame:
    """(gene, group): overlapping genes share a group. Groups are numbered over all chromosomes, by chromosome, start
    and strand, so a number names one group of the whole annotation."""
    keys = ["seq", "strand"] if stranded else ["seq"]
    got = R.settled(I.with_islands(genes(exons), keys))  # a row per gene
    spans = got.groupBy(*keys, "island").agg(F.min("start").alias("start"))
    per = spans.groupBy("seq").agg(F.count("*").alias("n"))  # a row per chromosome
    per = per.select("seq", F.coalesce(F.sum("n").over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    spans = R.row_ids(spans, ["seq"], ["start", *keys[1:]], "n").join(per, "seq")
    number = spans.select(*keys, "island", (F.col("before") + F.col("n")).alias("gene_group"))
    return got.join(number, [*keys, "island"]).select("gene", *keys, "gene_group")


def exon_islands(exons: DataFrame, retained: str = "intron") -> DataFrame:
    """Merged exons per gene group with their ordinal in reading direction.

    Exons of transcripts whose biotype matches ``retained`` would bridge introns and stay out, but for those that
    overlap no span of their strand's islands (ends of such transcripts outside all others).
    """
    group = gene_groups(exons).select("gene", "gene_group")
    ex = exons.select("gene", "seq", "strand", "start", "end", F.coalesce(F.col("biotype").rlike(retained), F.lit(False)).alias("ri")).distinct().join(group, "gene")
    ex = R.settled(ex.drop("gene").distinct())  # distinct exons of the annotation
    plain, late = ex.where("NOT ri").drop("ri"), ex.where("ri").drop("ri")
    spans = plain.groupBy("gene_group", "seq", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    inside = I.overlap_join(late, spans.select("seq", "strand", "start", "end")).select("seq", "strand", "start", "end").distinct()
    outside = R.settled(late.join(inside, ["seq", "strand", "start", "end"], "left_anti"))
    return R.settled(_islands(plain.unionByName(outside)))


def _islands(exons: DataFrame) -> DataFrame:
    keys = ["seq", "strand", "gene_group"]
    merged = I.reduce_intervals(exons, keys).drop("n")
    return R.strand_renumber(R.row_ids(merged, keys, ["start"], "exon_group"), keys, "exon_group")


def island_gaps(islands: DataFrame) -> DataFrame:
    """(seq, strand, gene_group, start, end, intron_number): stretches between neighbouring islands of a group, numbered
    in reading direction."""
    keys = ["seq", "strand", "gene_group"]
    gaps = I.group_gaps(islands, keys)
    return R.strand_renumber(R.row_ids(gaps, keys, ["start"], "intron_number"), keys, "intron_number")


def _numbered(exons: DataFrame) -> DataFrame:
    """Gaps between a transcript's exons, numbered in reading direction, with next: the start and end of the next gap in
    that direction. Two windows of one order: gaps, and what follows from the gaps."""
    by = Window.partitionBy("tx").orderBy("start", "end")
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("__e")
    of = [F.first(c).over(every).alias(c) for c in ("gene", "seq", "strand", "biotype", "tsl")]
    got = exons.where("tx IS NOT NULL").select("tx", "start", "end", *of, before).where(F.col("start") > F.col("__e") + 1)
    cols = ["tx", "start", "end", "gene", "seq", "strand", "biotype", "tsl"]
    got = got.select("tx", (F.col("__e") + 1).alias("start"), (F.col("start") - 1).alias("end"), *cols[3:])
    at = F.struct("start", "end")
    got = got.select(*cols, F.row_number().over(by).alias("__k"), F.count("*").over(every).alias("n_all"), F.lag(at).over(by).alias("__a"), F.lead(at).over(by).alias("__b"))
    minus = F.col("strand") == "-"
    n = F.when(minus, (F.col("n_all") + 1 - F.col("__k")).cast("int")).otherwise(F.col("__k"))
    return got.select(*cols, n.alias("n"), "n_all", F.when(minus, F.col("__a")).otherwise(F.col("__b")).alias("next"))


def introns(exons: DataFrame) -> DataFrame:
    """Gaps between a transcript's exons, numbered in reading direction, with locus and intron_id."""
    got = _numbered(exons).drop("next")
    got = got.withColumn("locus", locus(F.col("seq"), F.col("start"), F.col("end"), F.col("strand")))
    return got.withColumn("intron_id", F.concat_ws("_", F.col("tx").cast("string"), F.concat(F.lit("Intron"), F.col("n").cast("string"))))


def intron_steps(exons: DataFrame, coding: list[str], decay: str) -> DataFrame:
    """Introns and their next one in reading direction, each pair once however many transcripts have it: seq, strand,
    start, end, locus, next and skip (as ``events.skip_coords`` adds them), first and last (a transcript begins or ends
    with it), nmd_only (all that have it are of the decay biotype) and best (``events.ranked_transcript``'s choice: tsl,
    code, tx, n).
    """
    from . import events as E

    got = _numbered(exons).groupBy("seq", "strand", "start", "end", F.col("next.start").alias("__s"), F.col("next.end").alias("__e")).agg(
        F.max(F.col("n") == 1).alias("first"), F.max(F.col("n") == F.col("n_all")).alias("last"), F.every(F.col("biotype") == decay).alias("nmd_only"),
        F.min(F.struct("tsl", E.coding_rank(coding).alias("code"), "tx", "n")).alias("best"),
    )
    name = lambda start, end: locus(F.col("seq"), start, end, F.col("strand"))
    s, e = F.col("__s"), F.col("__e")
    has_next = s.isNotNull()
    return got.select(
        "seq", "strand", "start", "end", name(F.col("start"), F.col("end")).alias("locus"), F.when(has_next, name(s, e)).alias("next"),
        F.when(has_next, name(F.least("start", s), F.greatest("end", e))).alias("skip"), "first", "last", "nmd_only", "best",
    )


def _sites(intron: DataFrame) -> DataFrame:
    """(locus, seq, strand, side, start, end): the two bases around each splice site."""
    site = intron.select("locus", "seq", "strand", "start", "end").distinct()
    ends = F.array(F.struct(F.lit("left").alias("side"), (F.col("start") - 1).alias("start"), F.col("start").alias("end")), F.struct(F.lit("right").alias("side"), F.col("end").alias("start"), (F.col("end") + 1).alias("end")))
    return site.select("locus", "seq", "strand", F.explode(ends).alias("p")).select("locus", "seq", "strand", "p.*")


def flanking_islands(intron: DataFrame, islands: DataFrame) -> DataFrame:
    """up and down: the islands that the two bases around each splice site touch; the last hit wins.

    An island's key is its group's number, unique over all chromosomes, and its ordinal.
    """
    key = F.concat_ws("_", F.col("b_gene_group").cast("string"), F.col("b_exon_group").cast("string"))
    last = lambda side: F.max_by(key, F.when(F.col("side") == side, F.struct("b_gene_group", "b_start")))
    hit = I.overlap_join(_sites(intron), islands).groupBy("locus").agg(last("left").alias("left"), last("right").alias("right"))
    got = intron.select("locus", "strand").distinct().join(hit, "locus", "left")
    minus = F.col("strand") == "-"
    return got.select("locus", F.when(minus, F.col("right")).otherwise(F.col("left")).alias("up"), F.when(minus, F.col("left")).otherwise(F.col("right")).alias("down"))


def rescue_islands(flanks: DataFrame, intron: DataFrame, islands: DataFrame) -> DataFrame:
    """flanks with missing islands filled from the gap between islands that the splice site lies in (introns of
    retained transcripts end there): upstream the island before the gap, downstream the one behind it."""
    gaps = island_gaps(islands)
    missing = flanks.where("up IS NULL OR down IS NULL").select("locus")
    hit = I.overlap_join(_sites(intron.join(missing, "locus", "left_semi")), gaps)
    upstream = (F.col("side") == "left") == (F.col("strand") == "+")
    key = F.concat_ws("_", F.col("b_gene_group").cast("string"), (F.col("b_intron_number") + F.when(upstream, 0).otherwise(1)).cast("string"))
    last = lambda up: F.max_by(key, F.when(upstream == F.lit(up), F.struct("b_gene_group", "b_start")))
    found = hit.groupBy("locus").agg(last(True).alias("__up"), last(False).alias("__down"))
    return flanks.join(found, "locus", "left").select("locus", F.coalesce("up", "__up").alias("up"), F.coalesce("down", "__down").alias("down"))


def best_introns(intron: DataFrame, biotypes: list[str]) -> DataFrame:
    """One row per locus: the transcript of the best biotype (listed first), then support level, then name."""
    rank = F.array_position(F.array(*[F.lit(b) for b in biotypes]), F.col("biotype"))
    kept = intron.withColumn("rank", rank).where("rank > 0")
    return R.distinct_on(kept, ["locus"], ["rank", "tsl", "tx"]).drop("rank")


def known_exon(intron: DataFrame, exons: DataFrame, stranded: bool = True) -> DataFrame:
    """(locus, known): whether an annotated exon contains the intron."""
    site = intron.select("locus", "seq", "strand", "start", "end").distinct()
    hit = I.overlap_join(site, exons.select("seq", "strand", "start", "end").distinct(), how="within", ignore_strand=not stranded).select("locus").distinct().withColumn("known", F.lit(True))
    return site.select("locus").join(hit, "locus", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def anti_over_near(intron: DataFrame, gene: DataFrame, before: int = 5000, after: int = 1000) -> DataFrame:
    """(locus, anti_over, anti_near): a gene of the other strand overlaps, or lies within the flanks of one."""
    site = intron.select("locus", "seq", "strand", "start", "end").distinct()
    other = F.when(F.col("strand") == "-", "+").otherwise("-")
    turned = gene.select("seq", "strand", "start", "end").withColumn("strand", other)
    near = I.flank(turned, before).unionByName(I.flank(turned, after, upstream=False))
    hits = lambda g, c: I.overlap_join(site, g).select("locus").distinct().withColumn(c, F.lit(True))
    got = site.select("locus").join(hits(turned, "anti_over"), "locus", "left").join(hits(near, "anti_near"), "locus", "left")
    return got.select("locus", F.coalesce("anti_over", F.lit(False)).alias("anti_over"), F.coalesce("anti_near", F.lit(False)).alias("anti_near"))


def unusable_regions(*tables: DataFrame, gap: int = 9) -> DataFrame:
    """(seq, start, end): low-mappability and blacklisted regions of any strand, merged over gaps below ``gap``."""
    out = tables[0].select("seq", "start", "end")
    for t in tables[1:]:
        out = out.unionByName(t.select("seq", "start", "end"))
    return I.reduce_intervals(out, ["seq"], gap).drop("n")


def outside_regions(intron: DataFrame, regions: DataFrame) -> DataFrame:
    """Introns that do not lie whole inside one of the regions."""
    site = intron.select("locus", "seq", "start", "end").distinct()
    return intron.join(I.overlap_join(site, regions, how="within").select("locus").distinct(), "locus", "left_anti")


def excluded_zones(exons: DataFrame, widen: int = 5, regions: DataFrame | None = None) -> DataFrame:
    """(seq, strand, start, end): exons widened, and unusable regions on both strands, merged."""
    zone = exons.select("seq", "strand", (F.col("start") - widen).alias("start"), (F.col("end") + widen).alias("end"))
    if regions is not None:
        zone = zone.unionByName(regions.select("seq", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"), "start", "end"))
    return I.reduce_intervals(zone).drop("n")


def measurable_blocks(intron: DataFrame, exons: DataFrame, widen: int = 5, least: int = 50, share: float = 0.3, regions: DataFrame | None = None) -> DataFrame:
    """Parts of each intron (trimmed by ``widen``) outside the excluded zones: blocks and bases, if enough is left."""
    site = intron.select("locus", "seq", "strand", "start", "end").distinct().where(F.col("end") - F.col("start") + 1 > least)
    site = site.withColumns({"start": F.col("start") + widen, "end": F.col("end") - widen})
    hit = I.overlap_join(site, excluded_zones(exons, widen, regions))
    cut = hit.select("locus", F.greatest("start", "b_start").alias("start"), F.least("end", "b_end").alias("end"))
    bare = site.select("locus", F.col("start").alias("s"), F.col("end").alias("e"))
    sums = cut.groupBy("locus").agg(F.sum(F.col("end") - F.col("start") + 1).alias("excl"), F.count("*").alias("cuts"), F.min("start").alias("first"), F.max("end").alias("last"))
    got = bare.join(sums, "locus", "left").withColumn("width", F.col("e") - F.col("s") + 1)
    got = got.withColumn("excl", F.coalesce("excl", F.lit(0)))
    edge = F.coalesce((F.col("first") == F.col("s")).cast("int"), F.lit(0)) + F.coalesce((F.col("last") == F.col("e")).cast("int"), F.lit(0))
    blocks = F.coalesce("cuts", F.lit(0)) + 1 - edge
    return got.where(F.col("excl") / F.col("width") < share).select("locus", blocks.alias("num_blocks"), (F.col("width") - F.col("excl")).alias("inclbases"), F.col("excl").alias("exclbases"))


def span_points(intron: DataFrame) -> DataFrame:
    """Distinct ends of introns: the base before and the last base."""
    site = intron.select("seq", "strand", "start", "end")
    return site.select("seq", "strand", (F.col("start") - 1).alias("pos")).unionByName(site.select("seq", "strand", F.col("end").alias("pos"))).distinct()


def reference_junctions(intron: DataFrame, decay: str) -> DataFrame:
    """Distinct junctions; nmd_only if every transcript that has one is of the decay biotype."""
    return intron.groupBy("seq", "start", "end", "strand").agg(F.every(F.col("biotype") == decay).alias("nmd_only"))


def intergenic(gene: DataFrame, lengths: DataFrame, margin: int = 10_000, gap: int = 1000) -> DataFrame:
    """Chromosomes minus genes with their margins; lengths: (seq, length)."""
    zone = gene.select("seq", (F.col("start") - margin).alias("start"), (F.col("end") + margin).alias("end"))
    zone = I.reduce_intervals(zone, ["seq"], gap).drop("n")
    return I.setdiff_intervals(lengths.select("seq", F.lit(1).cast("long").alias("start"), F.col("length").alias("end")), zone, ["seq"])


def intron_names(site: DataFrame, stranded: bool) -> DataFrame:
    """Adds name, dir/gene/intron/strand/blocks/start/end/bases/excluded/flag of each measured intron.

    Stranded names are flagged known-exon or clean; unstranded ones (nd) list all of known-exon, anti-over and anti-near
    that hold. site: (gene, intron_id, strand, start, end, num_blocks, inclbases, exclbases, known) and, unstranded,
    anti_over and anti_near.
    """
    marks = {"known": "known-exon"} if stranded else {"known": "known-exon", "anti_over": "anti-over", "anti_near": "anti-near"}
    flags = F.concat_ws("+", *[F.when(F.col(c), text) for c, text in marks.items()])
    flag = F.when(flags == "", "clean").otherwise(flags)
    return site.withColumn("name", F.concat_ws("/", F.lit("dir" if stranded else "nd"), "gene", "intron_id", "strand", "num_blocks", F.col("start") - 1, "end", "inclbases", "exclbases", flag))


def measured_parts(intron: DataFrame, exons: DataFrame, widen: int = 5, regions: DataFrame | None = None) -> DataFrame:
    """(locus, seq, strand, start, end, blocks): the parts of each trimmed intron outside the excluded zones, in order;
    introns without any part are absent."""
    site = intron.select("locus", "seq", "strand", "start", "end").distinct().withColumns({"start": F.col("start") + widen, "end": F.col("end") - widen}).where("start <= end")
    hit = I.overlap_join(site, excluded_zones(exons, widen, regions)).groupBy("locus").agg(F.sort_array(F.collect_list(F.struct(F.col("b_start").alias("s"), F.col("b_end").alias("e")))).alias("cut"))
    got = site.join(hit, "locus", "left")
    none = F.array().cast("array<bigint>")
    starts = F.concat(F.array("start"), F.coalesce(F.transform("cut", lambda x: x["e"] + 1), none))
    ends = F.concat(F.coalesce(F.transform("cut", lambda x: x["s"] - 1), none), F.array("end"))
    blocks = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"))), lambda b: b["start"] <= b["end"])
    return got.withColumn("blocks", blocks).where(F.size("blocks") > 0).drop("cut")


def cover_table(stranded: DataFrame, unstranded: DataFrame) -> DataFrame:
    """The measured parts of both passes as one table (seq, start, end, name, strand, blocks), from the first part's
    start to the last one's end; rows: (name, seq, strand, blocks)."""
    both = stranded.select("name", "seq", "strand", "blocks").unionByName(unstranded.select("name", "seq", "strand", "blocks"))
    return both.select("seq", F.get("blocks", 0)["start"].alias("start"), F.element_at("blocks", -1)["end"].alias("end"), "name", "strand", "blocks")


def roi_table(transcripts: DataFrame, intergenic_parts: DataFrame, non_polya: DataFrame | None = None) -> DataFrame:
    """(name, seq, start, end) of ribosomal transcripts, regions without polyadenylation and intergenic stretches; the
    name's first part is the class. transcripts: (tx, gene, gene_name, biotype, seq, strand, start, end)."""
    rrna = transcripts.where(F.col("biotype").contains("rRNA"))
    out = rrna.select(F.concat_ws("/", F.lit("rRNA"), "seq", F.col("start") - 1, "end", "strand", "tx", "biotype", "gene", "gene_name").alias("name"), "seq", "start", "end")
    if non_polya is not None:
        out = out.unionByName(non_polya.select(F.lit("NonPolyA").alias("name"), "seq", "start", "end"))
    return out.unionByName(intergenic_parts.select(F.concat(F.lit("Intergenic/"), "seq").alias("name"), "seq", "start", "end"))


def chromosome_table(lengths: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(seq, length, alias): the alias is empty where a chromosome has none. aliases: (name, alias), names once."""
    if aliases is None:
        return lengths.select("seq", "length", F.lit("").alias("alias"))
    known = aliases.select(F.col("name").alias("seq"), "alias")
    return lengths.join(known, "seq", "left").select("seq", "length", F.coalesce("alias", F.lit("")).alias("alias"))


#: Annotation rows that are neither coding parts nor other features.
STRUCTURAL = ("gene", "transcript", "exon")


def coding_rows(gtf: DataFrame) -> DataFrame:
    return gtf.where("type = 'CDS'")


def other_rows(gtf: DataFrame) -> DataFrame:
    """Codons, untranslated parts and whatever else is not a gene, transcript, exon or coding part."""
    return gtf.where(~F.col("type").isin(*STRUCTURAL, "CDS"))


def view_reference(gtf: DataFrame) -> DataFrame:
    """(seq, start, end, strand, type, tx): what a track of transcripts draws: exons, coding parts and other features."""
    k = F.col("type")
    return gtf.where((k == "exon") | (k == "CDS") | ~k.isin(*STRUCTURAL, "CDS")).select("seq", "start", "end", "strand", "type", "tx")


def with_transcript_attributes(intron: DataFrame, transcripts: DataFrame, proteins: DataFrame, exons: DataFrame) -> DataFrame:
    """introns with transcript_support_level (its first word, NA without one), protein_id and ccds_id of their transcript.

    transcripts: (tx, transcript_support_level), proteins: (tx, protein_id), exons: (tx, ccds_id); the last value in
    order counts where a transcript has several, and an empty one counts as none.
    """
    got = intron
    for df, c in ((transcripts, "transcript_support_level"), (proteins, "protein_id"), (exons, "ccds_id")):
        got = R.update_join(got, df.select("tx", c).where(F.length(c) > 0), ["tx"], [c], [c])
    level = F.regexp_extract("transcript_support_level", r"^(\S+)", 1)
    return got.withColumn("transcript_support_level", F.coalesce(F.when(level != "", level), F.lit("NA")))
