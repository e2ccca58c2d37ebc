"""Sources on files that the tests write."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from isoloom.operators.quantify import pair_fragments
from isoloom.sources import bam, files


def bgzf(data: bytes, sizes: random.Random) -> bytes:
    out, at = b"", 0
    while at < len(data):
        part = data[at : at + sizes.randint(40, 400)]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
        at += len(part)
    return out + bam.EOF


def record(name, flag, ref, pos, cigar, bases):
    ops = [(n << 4) | bam.OPS.index(o) for n, o in cigar]
    codes = [bam.BASES.index(b) for b in bases] + [0]
    seq = bytes(codes[k] << 4 | codes[k + 1] for k in range(0, len(bases), 2))
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, 60, 0, len(ops), flag, len(bases), -1, -1, 0) + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + seq + b"\xff" * len(bases)
    return struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("split", [1, 300, 1 << 20])
def test_bam_round_trip(spark, tmp_path, split):
    r = random.Random(4)
    head = b"BAM\1" + struct.pack("<i", 5) + b"@HD\t1" + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1000) for n in ("c1", "c2"))
    rows = [(f"r{k}", 0, k % 2, r.randint(1, 900), [(10, "M"), (30, "N"), (5, "M")] if k % 3 else [(15, "M")], "".join(r.choice("ACGTN") for _ in range(15))) for k in range(80)]
    path = tmp_path / "x.bam"
    path.write_bytes(bgzf(head + b"".join(record(*x) for x in rows), r))
    spark.dataSource.register(bam.BamSource)
    df = spark.read.format("bam").option("splitbytes", split).load(str(path))
    got = sorted((x.read_name, x.flag, x.seq, x.pos, x.cigar, x.bases) for x in df.collect())
    assert got == sorted((n, f, f"c{k + 1}", p, "".join(f"{a}{b}" for a, b in c), b) for n, f, k, p, c, b in rows)
    assert pair_fragments(df.select("read_name", "flag", "seq", "pos", "cigar")).count() == 80
    (tmp_path / "y.bam").write_bytes(path.read_bytes()[:-5])
    with pytest.raises(Exception, match="truncated"):
        spark.read.format("bam").load(str(tmp_path / "y.bam")).count()


def test_text_sources(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 about it\nACGT\nAC GT\n>chr2\tx\r\nTTTT\r\n")
    genome = files.read_fasta(spark, str(tmp_path / "g.fa"))
    assert sorted(map(tuple, genome.collect())) == [("chr1", "ACGTACGT"), ("chr2", "TTTT")]
    assert sorted((r.chunk_start, r.seq) for r in files.chunk_genome(genome, 3).where("seqnames = 'chr1'").collect()) == [(1, "ACG"), (4, "TAC"), (7, "GT")]
    (tmp_path / "a.gtf").write_text('#c\nchr1\th\texon\t1\t5\t.\t+\t.\tgene_id "g"; transcript_id "t/1"; exon_number 2; tag "a"; tag "b";\n')
    row = files.fix_gtf(files.read_gtf(spark, str(tmp_path / "a.gtf"))).first()
    assert (row.gene_name, row.transcript_name, row.exon_number, row.gene_biotype, row.transcript_support_level, row.attributes["tag"]) == ("g", "t_1", 2, "protein_coding", "1", "a")
    (tmp_path / "b.bed").write_text("chr1\t0\t5\nchr1\t9\t12\tx\n")
    assert sorted(map(tuple, files.read_bed3(spark, str(tmp_path / "b.bed")).collect())) == [("chr1", 1, 5), ("chr1", 10, 12)]
    (tmp_path / "c.bed").write_text("chr1\t7\t5\n")
    with pytest.raises(Exception, match="not a BED row"):
        files.read_bed3(spark, str(tmp_path / "c.bed")).collect()
    (tmp_path / "r.txt").write_text("A\tB\n1\t2\n3\n\nC\tD\nx\ty\n")
    got = files.read_sections(spark, str(tmp_path / "r.txt"))
    assert sorted(map(tuple, got["A"].collect())) == [("1", "2"), ("3", "")] and got["C"].columns == ["C", "D"]


def test_coverage_round_trip_and_models(spark, tmp_path):
    runs = spark.createDataFrame([("c", "+", 1, 10, 2), ("c", "+", 11, 20, 0), ("d", "-", 5, 5, 7)], "seq string, strand string, start long, end long, depth long")
    files.write_coverage(runs, str(tmp_path / "cov"))
    got = files.read_coverage(spark, str(tmp_path / "cov"), "c", 5, 12, "+")
    assert sorted((r.start, r.end, r.depth) for r in got.collect()) == [(5, 10, 2), (11, 12, 0)]
    assert files.coverage_bases(got).count() == 8
    assert sorted(r.value for r in files.to_bedgraph(runs).collect())[0] == "c\t0\t10\t2"
    files.save_model({"runs": runs}, str(tmp_path / "m"))
    (tmp_path / "m").rename(tmp_path / "n")
    assert files.load_model(spark, str(tmp_path / "n"))["runs"].count() == 3
    assert files.find_samples(str(tmp_path), ".nothing") == []
    al = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("", "z", 4)], "name string, alias string, n int")
    assert [(r.name, r.alias) for r in files.chromosome_aliases(al).collect()] == [("a", "x")]
