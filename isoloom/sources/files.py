"""Text sources of genomes and annotations, and sinks for coverage."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bases per row of a stored genome.
CHUNK = 100_000


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seqnames, seq): names end at the first blank or tab; blanks and line ends inside sequences go."""
    rows = spark.read.text(path, lineSep=">").where(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"[\s]", "")
    return rows.select(F.regexp_extract(head, r"^([^ \t]*)", 1).alias("seqnames"), body.alias("seq"))


def chunk_genome(genome: DataFrame, size: int = CHUNK) -> DataFrame:
    """(seqnames, chunk_start, seq), chunk starts 1-based."""
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length("seq"), F.lit(1)), F.lit(size)))
    return genome.withColumn("chunk_start", at).select("seqnames", "chunk_start", F.substring(F.col("seq"), F.col("chunk_start"), F.lit(size)).alias("seq"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """GTF rows with attributes as a map; compressed files by their suffix."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(F.split("value", "\t").alias("p"))
    pairs = F.regexp_extract_all(F.get("p", 8), F.lit(r'([A-Za-z0-9_]+)\s+"?([^";]*)"?'), F.lit(0))
    entry = lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("key"), F.regexp_extract(x, r'^\S+\s+"?([^";]*)"?', 1).alias("value"))
    seen = F.transform(pairs, entry)
    # a key may repeat (tags); its first value counts
    first = F.filter(seen, lambda x, i: F.array_position(F.transform(seen, lambda y: y["key"]), x["key"]) == i + 1)
    dot = lambda k: F.when(F.get("p", k) != ".", F.get("p", k))
    return rows.select(
        F.get("p", 0).alias("seqnames"), F.get("p", 1).alias("source"), F.get("p", 2).alias("type"), F.get("p", 3).cast("long").alias("start"), F.get("p", 4).cast("long").alias("end"),
        dot(5).cast("double").alias("score"), F.get("p", 6).alias("strand"), dot(7).cast("int").alias("phase"), F.map_from_entries(first).alias("attributes"),
    )


def fix_gtf(gtf: DataFrame) -> DataFrame:
    """Names default to ids and lose slashes; biotypes default to protein_coding, support levels to 1."""
    a = lambda *keys: F.coalesce(*[F.col("attributes")[k] for k in keys])
    clean = lambda c: F.regexp_replace(c, "/", "_")
    return gtf.withColumns({
        "gene_id": a("gene_id"), "transcript_id": a("transcript_id"), "exon_number": a("exon_number").cast("int"),
        "gene_name": clean(a("gene_name", "gene_id")), "transcript_name": clean(a("transcript_name", "transcript_id")),
        "gene_biotype": F.coalesce(a("gene_biotype", "gene_type"), F.lit("protein_coding")), "transcript_biotype": F.coalesce(a("transcript_biotype", "transcript_type"), F.lit("protein_coding")),
        "transcript_support_level": F.coalesce(F.regexp_extract(a("transcript_support_level"), r"^(\S+)", 1), F.lit("1")), "protein_id": a("protein_id"), "ccds_id": a("ccds_id"),
    })


def read_bed3(spark: SparkSession, path: str) -> DataFrame:
    """(seqnames, start, end): 0-based half-open rows as 1-based closed ones; a malformed row raises."""
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.split("value", r"\s+").alias("p"))
    start, end = F.get("p", 1).try_cast("long"), F.get("p", 2).try_cast("long")
    fine = (F.size("p") >= 3) & start.isNotNull() & end.isNotNull() & (start >= 0) & (end > start)
    return rows.select(F.when(fine, F.get("p", 0)).otherwise(F.raise_error(F.concat(F.lit("not a BED row: "), F.array_join("p", " ")))).alias("seqnames"), (start + 1).alias("start"), end.alias("end"))


def chromosome_aliases(rows: DataFrame) -> DataFrame:
    """(name, alias): the first row of each name, then of each alias, both non-empty. rows: (name, alias, n)."""
    from ..operators.relational import distinct_on

    rows = rows.where("length(name) > 0 AND length(alias) > 0")
    return distinct_on(distinct_on(rows, ["name"], ["n"]), ["alias"], ["n"])


def write_coverage(runs: DataFrame, path: str) -> None:
    """Runs partitioned by chromosome and strand and sorted by start, so that region reads prune files and groups."""
    runs.repartition("seq", "strand", F.floor(F.col("start") / (1 << 24))).sortWithinPartitions("seq", "strand", "start").write.mode("overwrite").partitionBy("seq", "strand").parquet(path)


def read_coverage(spark: SparkSession, path: str, seq: str | None = None, start: int | None = None, end: int | None = None, strand: str | None = None) -> DataFrame:
    """Runs of a region, clipped to it; filters reach the scan."""
    df = spark.read.parquet(path)
    if seq is not None:
        df = df.where(F.col("seq") == seq)
    if strand is not None:
        df = df.where(F.col("strand") == strand)
    if start is not None and end is not None:
        df = df.where((F.col("start") <= end) & (F.col("end") >= start)).withColumns({"start": F.greatest("start", F.lit(start)), "end": F.least("end", F.lit(end))})
    return df.select("seq", "strand", "start", "end", "depth")


def coverage_bases(runs: DataFrame) -> DataFrame:
    """One row per base."""
    return runs.select("seq", "strand", F.explode(F.sequence("start", "end")).alias("pos"), "depth")


def to_bedgraph(runs: DataFrame) -> DataFrame:
    return runs.select(F.concat_ws("\t", "seq", F.col("start") - 1, "end", "depth").alias("value"))


#: Fixed value: the colour of an exported part.
COLOUR = "255,0,0"


def to_bed12(parts: DataFrame) -> DataFrame:
    """Lines of a 12-column BED table; parts: (seq, start, end, name, strand, blocks), 1-based and closed."""
    size = F.array_join(F.transform("blocks", lambda b: (b["end"] - b["start"] + 1).cast("string")), ",")
    at = F.array_join(F.transform("blocks", lambda b: (b["start"] - F.col("start")).cast("string")), ",")
    return parts.select(F.concat_ws("\t", "seq", F.col("start") - 1, "end", "name", F.lit(0), "strand", F.col("start") - 1, "end", F.lit(COLOUR), F.size("blocks"), size, at).alias("value"))


def from_bed12(lines: DataFrame) -> DataFrame:
    """(seq, start, end, name, strand, blocks) of BED12 lines (value); a row whose blocks do not fit its ends raises."""
    p = lines.where(F.length(F.trim("value")) > 0).select(F.split("value", "\t").alias("p"))
    number = lambda k: F.transform(F.filter(F.split(F.get("p", k), ","), lambda x: x != ""), lambda x: x.cast("long"))
    start, end = F.get("p", 1).cast("long") + 1, F.get("p", 2).cast("long")
    blocks = F.zip_with(number(11), number(10), lambda at, n: F.struct((start + at).alias("start"), (start + at + n - 1).alias("end")))
    got = p.select(F.get("p", 0).alias("seq"), start.alias("start"), end.alias("end"), F.get("p", 3).alias("name"), F.get("p", 5).alias("strand"), blocks.alias("blocks"), F.get("p", 9).cast("int").alias("n"), F.array_join("p", " ").alias("line"))
    fits = (F.size("blocks") == F.col("n")) & (F.get("blocks", 0)["start"] == F.col("start")) & (F.element_at("blocks", -1)["end"] == F.col("end"))
    fine = F.when(F.coalesce(fits, F.lit(False)), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("not a BED12 row: "), "line")))
    return got.select(fine.alias("seq"), "start", "end", "name", "strand", "blocks")


#: Sections of a reference file, in written order; the last may be absent.
SECTIONS = ("ref-cover.bed", "ref-read-continues.ref", "ref-ROI.bed", "ref-sj.ref", "ref-chrs.ref")


def write_reference(tables: dict[str, DataFrame], path: str) -> None:
    """One folder per section, each with text lines (value) split over files, and a list of them: what a single file with
    section marks holds, without one writer for all of it. All sections but the chromosomes' aliases are needed."""
    if lacking := [s for s in SECTIONS[:-1] if s not in tables]:
        raise ValueError(f"the reference lacks {', '.join(lacking)}")
    save_model({s: tables[s].select("value") for s in SECTIONS if s in tables}, path, {"kind": "reference"})


def read_reference(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Lines (value) by section, of a folder written by ``write_reference``; raises if a needed one is missing."""
    got = load_model(spark, path)
    if lacking := [s for s in SECTIONS[:-1] if s not in got]:
        raise ValueError(f"the reference lacks {', '.join(lacking)}")
    return got


def read_reference_file(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Lines (value) by section of one file with marks: '# name' begins a section, '# EOF' ends the file. Sections may
    come in any order; a file without its end or a needed section raises. A line's section is the last mark before it in
    the file, whose lines are read as one row a section."""
    parts = spark.read.text(path, lineSep="\n# ").select(F.regexp_replace("value", r"^# ", "").alias("b"))
    split = parts.select(F.trim(F.regexp_extract("b", r"^([^\r\n]*)", 1)).alias("section"), F.regexp_replace("b", r"^[^\r\n]*\r?\n?", "").alias("body"))
    names = {r["section"] for r in split.select("section").distinct().collect()}
    if lacking := [s for s in (*SECTIONS[:-1], "EOF") if s not in names]:
        raise ValueError(f"the reference lacks {', '.join(lacking)}")
    lines = lambda s: split.where(F.col("section") == s).select(F.explode(F.split("body", r"\r?\n")).alias("value")).where(F.length("value") > 0)
    return {s: lines(s) for s in SECTIONS if s in names}


def read_sections(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a multi-section report: blocks between blank lines, each with a header; keyed by the header's first
    column. Reports are small (a row per junction of one sample); each block's cells are padded to its header."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\r?\n\s*\r?\n")).alias("b")).where(F.length(F.trim("b")) > 0)
    blocks = lines.select(F.split(F.trim("b"), r"\r?\n").alias("l")).withColumn("h", F.split(F.get("l", 0), "\t"))
    out = {}
    for r in blocks.select("h").distinct().collect():
        names = list(r["h"])
        part = blocks.where(F.get("h", 0) == names[0]).select(F.explode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))).alias("x")).select(F.split("x", "\t").alias("p"))
        out[names[0]] = part.select(*[F.coalesce(F.get("p", k), F.lit("")).alias(n) for k, n in enumerate(names)])
    return out


def find_samples(path: str, suffix: str = ".txt.gz", level: int = 0) -> list[tuple[str, str]]:
    """(sample, file) of the files below a local folder that end so; level 1 names a sample by its folder."""
    out = []
    for folder, _, names in os.walk(path):
        for n in sorted(names):
            if re.search(re.escape(suffix) + "$", n):
                out.append((os.path.basename(folder) if level else n[: -len(suffix)], os.path.join(folder, n)))
    return sorted(out)


def save_model(tables: dict[str, DataFrame], path: str, about: dict | None = None) -> None:
    """Tables as Parquet and a manifest with relative paths, so the folder can move."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    text = json.dumps({"tables": sorted(tables), "about": about or {}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")


def load_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    names = json.loads(spark.read.text(f"{path}/_manifest").first()["value"])["tables"]
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def genome_style(gtf: DataFrame) -> str:
    """``UCSC`` if chromosomes are named chr1 and so on, ``Ensembl`` if 1 and so on, else an empty string."""
    r = gtf.agg(F.max(F.col("seqnames").rlike("^chr([0-9]+|[XYM])$")), F.max(F.col("seqnames").rlike("^([0-9]+|[XY]|MT)$"))).first()
    return "UCSC" if r[0] else "Ensembl" if r[1] else ""


def shared_chromosomes(gtf: DataFrame, genome: DataFrame) -> DataFrame:
    """gtf's rows on chromosomes of the genome; raises if there are none."""
    got = gtf.join(genome.select("seqnames").distinct(), "seqnames", "left_semi")
    if got.isEmpty():
        raise ValueError("the annotation and the genome share no chromosome")
    return got
