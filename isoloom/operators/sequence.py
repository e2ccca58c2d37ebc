"""Nucleotide sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The standard genetic code, bases in the order TCAG for each place.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def fetch(chrom: Column, start: Column, end: Column, strand: Column) -> Column:
    """Bases start..end of a chromosome string, in reading direction."""
    s = F.substring(chrom, start, end - start + 1)
    return F.when(strand == "-", reverse_complement(s)).otherwise(s)


def translate_codons(seq: Column) -> Column:
    """Amino acids of the whole codons from the first base; ``X`` where a codon is not one of the 64, ``*`` for stop."""
    table = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    codons = F.coalesce(F.regexp_extract_all(seq, F.lit("(?s).{3}"), 0), F.array().cast("array<string>"))  # one pass, any length
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.element_at(table, c), F.lit("X"))), "")


def first_stop(seq: Column) -> Column:
    """1-based position of the first base of the first stop codon in frame; null without one."""
    p = F.instr(translate_codons(seq), "*")
    return F.when(p > 0, 3 * p - 2)


def phase_trim(seq: Column, phase: Column) -> Column:
    """Drops (3 - phase) mod 3 bases in front, then cuts to whole codons."""
    cut = F.pmod(3 - phase, F.lit(3))
    rest = F.substring(seq, (cut + 1).cast("int"), F.length(seq))
    return F.substring(rest, F.lit(1), (F.length(rest) - F.pmod(F.length(rest), F.lit(3))).cast("int"))


def pieces(df: DataFrame, seq: str, step: int, width: int) -> DataFrame:
    """A row per ``step`` bases of each sequence, instead of it: at (bases before) and piece, up to ``width`` bases from
    there on. One pass over a sequence; places inside a piece are found by its own length, not the sequence's. Pieces
    shorter than ``width - step + 1`` begin no window of that many bases and are left out."""
    cut = F.regexp_extract_all(F.col(seq), F.lit(f"(?s)(?=(.{{1,{width}}})).{{1,{step}}}"), F.lit(1))
    got = df.select(*[c for c in df.columns if c != seq], F.posexplode_outer(cut).alias("__i", "piece"))
    return got.where(F.length("piece") > width - step).withColumn("at", F.col("__i") * step).drop("__i")
