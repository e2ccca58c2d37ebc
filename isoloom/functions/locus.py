"""Locus strings and what hangs on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.sequence import fetch


def locus(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """``seq:start-end/strand``"""
    return F.concat(seq, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("/"), strand)


def parse(text: Column) -> Column:
    """Struct of seq, start, end, strand from ``seq:start-end/strand``, ``seq:start-end`` or ``seq:position``.

    A missing strand is ``*``; an end before its start, or anything else, raises.
    """
    shape = r"^([^:]+):([0-9]+)(?:-([0-9]+))?(?:/([-+*]))?$"
    part = lambda k: F.regexp_extract(text, shape, k)
    start = part(2).try_cast("long")
    end = F.coalesce(part(3).try_cast("long"), start)
    fine = text.isNull() | (text.rlike(shape) & (end >= start))
    got = F.struct(part(1).alias("seq"), start.alias("start"), end.alias("end"), F.when(part(4) == "", "*").otherwise(part(4)).alias("strand"))
    return F.when(fine, got).otherwise(F.raise_error(F.concat(F.lit("not a locus: "), text)).cast("struct<seq:string,start:bigint,end:bigint,strand:string>"))


def motif(chrom: Column, start: Column, end: Column, strand: Column) -> Column:
    """Two bases at each end of an intron, in reading direction."""
    left = fetch(chrom, start, start + 1, strand)
    right = fetch(chrom, end - 1, end, strand)
    return F.when(strand == "-", F.concat(right, left)).otherwise(F.concat(left, right))
