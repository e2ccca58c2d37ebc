"""Coding sequence: decay prediction, peptide segments, synthetic reads, strands of novel junctions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequence as S
from .intervals import running
from .sequence import first_stop, reverse_complement, translate_codons

#: Splice motifs of the plus strand; their reverse complements mark the minus strand.
MOTIFS = ("GTAG", "GCAG", "ATAC", "ATAG")
#: What ACGT become at the error position, by window number modulo 3.
SUBSTITUTES = ("GATC", "TGCA", "CTAG")
DECAY_DISTANCE = 50


def novel_strand(motif: Column) -> tuple[Column, Column]:
    """(strand, motif in reading direction) of an unstranded junction; null where no motif fits."""
    back = reverse_complement(motif)
    strand = F.when(motif.isin(*MOTIFS), "+").when(back.isin(*MOTIFS), "-")
    return strand, F.when(strand == "+", motif).when(strand == "-", back)


def trim_to_start(exons: DataFrame, starts: DataFrame) -> DataFrame:
    """Exons of each transcript from its start codon on; starts: (tx, codon_start, codon_end). Empty exons go."""
    e = exons.join(starts, "tx")
    minus = F.col("strand") == "-"
    e = e.withColumns({"start": F.when(minus, F.col("start")).otherwise(F.greatest("start", "codon_start")), "end": F.when(minus, F.least("end", "codon_end")).otherwise(F.col("end"))})
    return e.where("start <= end").drop("codon_start", "codon_end")


def intron_class(introns: DataFrame, utr5: DataFrame, utr3: DataFrame, cds: DataFrame) -> DataFrame:
    """(tx, locus, class): whether the locus is a gap of the 5' UTR, the 3' UTR or the coding parts; coding wins.

    The three tables hold (tx, locus) of their own gaps.
    """
    kinds = utr5.select("tx", "locus", F.lit(1).alias("k")).unionByName(utr3.select("tx", "locus", F.lit(2).alias("k"))).unionByName(cds.select("tx", "locus", F.lit(3).alias("k")))
    best = kinds.groupBy("tx", "locus").agg(F.max("k").alias("k"))
    name = F.element_at(F.array(F.lit("UTR5"), F.lit("UTR3"), F.lit("CDS")), F.col("k"))
    return introns.select("tx", "locus").join(best, ["tx", "locus"], "left").select("tx", "locus", name.alias("class"))


def spliced_decay(parts: Column) -> dict[str, Column]:
    """stop (first base of the first stop codon before the last exon), to_junction, nmd of the exon sequences."""
    body = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "")
    stop = first_stop(body)
    rest = F.length(body) - stop
    return {"stop": stop, "to_junction": F.length(body) - stop, "nmd": F.coalesce(rest >= DECAY_DISTANCE, F.lit(False))}


def retained_decay(parts: Column, intron: Column, after: Column, prefix: int = 1000) -> dict[str, Column]:
    """The same for a transcript that keeps the intron behind exon number ``after``; a stop within ``prefix`` bases of
    the intron decides at once, else the whole sequence does."""
    up = F.array_join(F.slice(parts, 1, after), "")
    rest = F.size(parts) - after
    down = F.array_join(F.when(rest > 1, F.slice(parts, after + 1, F.greatest(rest - 1, F.lit(0)))).otherwise(F.array().cast("array<string>")), "")
    whole = F.concat(up, intron, down)
    short = first_stop(F.concat(up, F.substring(intron, 1, prefix)))
    stop = F.coalesce(short, first_stop(whole))
    left = F.length(whole) - stop
    return {"stop": stop, "to_junction": left, "nmd": F.coalesce(left >= DECAY_DISTANCE, F.lit(False))}


def _from(x: Column, at: Column) -> Column:
    return F.substring(x, at.cast("int"), F.greatest(F.length(x), F.lit(1)))


def _first(x: Column, n: Column) -> Column:
    return F.substring(x, F.lit(1), n.cast("int"))


def peptide_segments(up: Column, casette: Column, down: Column, phase: Column) -> dict[str, Column]:
    """Amino acids of the upstream, middle and downstream exons of an isoform, and of all; null exons are absent.

    The 5' end loses (3 - phase) mod 3 bases, split codons move to the middle exon (or downstream without one), and
    every segment is cut to whole codons.
    """
    cut = F.pmod(3 - phase, F.lit(3))
    up2 = _from(up, cut + 1)
    tail = F.length(up2) % 3
    carry = _from(up2, F.length(up2) - tail + 1)
    carry = F.when(tail > 0, carry).otherwise("")
    up3 = _first(up2, F.length(up2) - tail)
    mid = F.concat(carry, casette)
    lack = F.pmod(3 - F.length(mid) % 3, F.lit(3))
    mid2 = F.concat(mid, _first(down, lack))
    down2 = F.when(casette.isNull(), F.concat(carry, down)).otherwise(_from(down, lack + 1))
    whole = lambda x: _first(x, F.length(x) - F.length(x) % 3)
    aa = [F.coalesce(translate_codons(whole(x)), F.lit("")) for x in (up3, mid2, down2)]
    return {"aa_up": aa[0], "aa_casette": aa[1], "aa_down": aa[2], "aa_full": F.concat(*aa)}


def synthetic_reads(genome: DataFrame, name: str = "seqnames", read_len: int = 70, stride: int = 10, error_pos: int = 35) -> DataFrame:
    """(read_name, read): windows of each sequence with one base substituted, alternately reverse-complemented.

    Windows are numbered over all sequences in name order, kept ones apart; both numbers come from counts per
    sequence, summed in two levels, so no sequence waits for another. ``name`` is a number.
    """
    per = 64
    cut = S.pieces(genome.select(name, "seq", F.length("seq").alias("__n")), "seq", per * stride, per * stride - stride + read_len + 1)
    # a window begins at every stride that has more than read_len bases before the end
    n = F.least(F.lit(per), F.greatest(F.ceil((F.col("__n") - F.col("at") - read_len) / stride), F.lit(0))).cast("int")
    cut = cut.withColumn("n", n).where("n > 0")
    all_ = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct((F.col("at") / stride + i).cast("int").alias("i"), F.substring(F.col("piece"), i * stride + 1, F.lit(read_len)).alias("s")))
    kept = F.filter(all_, lambda w: F.length(F.translate(w["s"], "ACGT", "")) * 2 < read_len)
    plain = F.length(F.translate("piece", "ACGT", "")) == 0
    g = cut.select(name, "at", "piece", "n", F.when(plain, F.col("n")).otherwise(F.size(kept)).alias("kept_n"), F.lit(0).alias("__k"))
    # the text goes along once; a task holds the pieces of few sequences, and only their counts meet in one place
    g = running(g, ["__k"], [name, "at"], name, {"before": F.col("n"), "kept_before": F.col("kept_n")}, inclusive=False, chunk=64)
    g = g.select(name, (F.coalesce("before", F.lit(0)) - F.col("at") / stride).cast("long").alias("before"), F.coalesce("kept_before", F.lit(0)).alias("kept_before"), F.posexplode_outer(kept).alias("j", "w")).where("w IS NOT NULL")
    r = F.col("before") + F.col("w.i")
    base = F.substring("w.s", error_pos + 1, 1)
    new = F.lit("N")
    for k, to in enumerate(SUBSTITUTES):
        new = F.when(base.isin(*"ACGT") & (r % 3 == k), F.translate(base, "ACGT", to)).otherwise(new)
    read = F.concat(F.substring("w.s", 1, error_pos), new, F.substring("w.s", error_pos + 2, read_len))
    back = (F.col("kept_before") + F.col("j")) % 2 == 1
    label = F.concat(F.when(back, ">RR!").otherwise(">RF!"), F.col(name).cast("string"), F.lit("!"), (F.col("w.i") * stride + 1).cast("string"))
    return g.select(label.alias("read_name"), F.when(back, reverse_complement(read)).otherwise(read).alias("read"))
