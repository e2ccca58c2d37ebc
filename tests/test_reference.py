"""Reference tables, result tables, model checks and the text formats."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoloom.operators import annotation as A
from isoloom.operators import collate as C
from isoloom.operators import shaping as SH
from isoloom.operators import testing as T
from isoloom.operators import tracks as TR
from isoloom.plans.model import ASSAYS, EventModel
from isoloom.sources import bam, files

EXON = "tx long, gene long, seq string, strand string, start long, end long, biotype string, tsl string"


def parts_of(spark):
    exons = spark.createDataFrame([(1, 1, "c", "+", 1, 100, "F", "1"), (1, 1, "c", "+", 1000, 1100, "F", "1"), (2, 2, "c", "+", 300, 400, "F", "1")], EXON)
    return A.measured_parts(A.introns(exons), exons)


def test_measured_parts_leave_out_widened_exons(spark):
    (r,) = parts_of(spark).collect()
    assert (r.start, r.end) == (106, 994) and [(b.start, b.end) for b in r.blocks] == [(106, 294), (406, 994)]


def test_bed12_round_trip_and_bad_rows(spark):
    parts = A.cover_table(*[parts_of(spark).withColumn("name", F.lit(n)) for n in ("dir/x", "nd/x")])
    lines = files.to_bed12(parts)
    assert sorted(r.value for r in lines.collect())[0] == "c\t105\t994\tdir/x\t0\t+\t105\t994\t255,0,0\t2\t189,589\t0,300"
    assert sorted(files.from_bed12(lines).collect(), key=str) == sorted(parts.select("seq", "start", "end", "name", "strand", "blocks").collect(), key=str)
    with pytest.raises(Exception, match="not a BED12 row"):
        files.from_bed12(spark.createDataFrame([("c\t105\t994\tx\t0\t+\t105\t994\t0\t2\t189,9\t0,300",)], "value string")).collect()


def test_reference_tables_and_files(spark, tmp_path):
    lines = {s: spark.createDataFrame([(f"{s}\t{k}",) for k in range(3)], "value string") for s in files.SECTIONS}
    files.write_reference(lines, str(tmp_path / "r"))
    got = files.read_reference(spark, str(tmp_path / "r"))
    assert {s: sorted(r.value for r in df.collect()) for s, df in got.items()} == {s: [f"{s}\t{k}" for k in range(3)] for s in files.SECTIONS}
    with pytest.raises(ValueError, match="lacks ref-sj.ref"):
        files.write_reference({s: df for s, df in lines.items() if s != "ref-sj.ref"}, str(tmp_path / "x"))
    text = "".join(f"# {s}\n" + ("" if s == "ref-ROI.bed" else f"{s}\t1\n{s}\t2\n") for s in reversed(files.SECTIONS[:-1]))
    (tmp_path / "one.ref").write_text(text + "# EOF\n")
    one = files.read_reference_file(spark, str(tmp_path / "one.ref"))
    assert {s: df.count() for s, df in one.items()} == {"ref-cover.bed": 2, "ref-read-continues.ref": 2, "ref-ROI.bed": 0, "ref-sj.ref": 2}
    (tmp_path / "cut.ref").write_text(text)
    with pytest.raises(ValueError, match="lacks EOF"):
        files.read_reference_file(spark, str(tmp_path / "cut.ref"))


def test_bam_tags():
    tags = b"NHC\x02" + b"AS" + b"i" + struct.pack("<i", -7) + b"XSA+" + b"MDZ10A5\0" + b"ZBBs" + struct.pack("<Ihh", 2, -1, 300) + b"ffF"[:2] + b"f" + struct.pack("<f", 0.5) + b"NHC\x09"
    assert bam.read_tags(b"??" + tags, 2) == {"NH": "C:2", "AS": "i:-7", "XS": "A:+", "MD": "Z:10A5", "ZB": "Bs:-1,300", "ff": "f:0.5"}
    with pytest.raises(ValueError, match="unknown type"):
        bam.read_tags(b"XXq1234", 0)


def test_names_say_why_an_intron_is_left_out(spark):
    rows = [("g", f"t_Intron{k}", "+", 100, 200, 1, 91, 0, bool(k & 1), bool(k & 2), bool(k & 4)) for k in range(8)]
    df = spark.createDataFrame(rows, "gene string, intron_id string, strand string, start long, end long, num_blocks long, inclbases long, exclbases long, known boolean, anti_over boolean, anti_near boolean")
    nd = {r.name.split("/")[2]: r.name for r in A.intron_names(df, False).collect()}
    assert nd["t_Intron0"] == "nd/g/t_Intron0/+/1/99/200/91/0/clean" and nd["t_Intron7"].endswith("/known-exon+anti-over+anti-near") and nd["t_Intron6"].endswith("/anti-over+anti-near")
    named = A.intron_names(df, False).withColumn("event_name", F.col("name"))
    assert T.testable(named).count() == 2 and T.testable(named, anti_over=False).count() == 4 and T.testable(named, anti_near=True).count() == 1
    assert {r.name.rsplit("/", 1)[1] for r in A.intron_names(df, True).collect()} == {"clean", "known-exon"}


def test_contrasts_views_and_experiments_are_checked(spark):
    samples = {"sample": ["a", "b"], "kind": ["x", "y"], "lane": [1, 2]}
    T.check_contrast(samples, "kind", "x", "y", ["lane"])
    for args in [("kind", "x", "z"), ("sort", "x", "y"), ("kind", "x", "y", ["kind"]), ("kind", "x", "y", ["lane", "lane"]), ("kind", "x", ""), ("kind", "x", "y", ["none"])]:
        with pytest.raises(ValueError):
            T.check_contrast(samples, *args)
    TR.check_view({"g": 1}, ["a"], ["a", "b"], gene="g")
    TR.check_view({}, ["a"], ["a", "b"], region=("c", 1, 10), lengths={"c": 10})
    for kw in [dict(gene="h"), dict(gene="two"), dict(), dict(gene="g", region=("c", 1, 2)), dict(region=("c", 5, 11)), dict(region=("d", 1, 2)), dict(gene="g", tracks=["z"]), dict(gene="g", tracks=["a"] * 5)]:
        with pytest.raises(ValueError):
            TR.check_view({"g": 1, "two": 2}, kw.pop("tracks", ["a"]), ["a", "b"], lengths={"c": 10}, **kw)
    assert C.check_experiment(spark.createDataFrame([("a", "p"), ("b", "q")], "s string, p string")).columns == ["sample", "path"]
    for rows in ([("a", "p"), ("a", "q")], [("a", None)]):
        with pytest.raises(ValueError):
            C.check_experiment(spark.createDataFrame(rows, "s string, p string"))


def test_model_is_checked_and_cleaned(spark):
    assay = spark.createDataFrame([(1, "SE", s, *[1.0] * len(ASSAYS)) for s in "ab"], "event_id long, event_type string, sample string, " + ", ".join(f"{c} double" for c in ASSAYS))
    samples = spark.createDataFrame([("a", True, None, "x"), ("b", None, None, "y")], "sample string, flag boolean, none string, kind string")
    m = EventModel(assay, spark.createDataFrame([(1,)], "event_id long"), samples).checked().cleaned()
    assert {r.sample: (r.flag, r.kind) for r in m.col_data.collect()} == {"a": ("TRUE", "x"), "b": (None, "y")} and "none" not in m.col_data.columns
    for bad in (EventModel(assay.drop("depth")), EventModel(assay.unionByName(assay)), EventModel(assay, col_data=samples.where("sample = 'a'")), EventModel(assay, spark.createDataFrame([(2,)], "event_id long"))):
        with pytest.raises(ValueError):
            bad.checked()


def test_sample_tracks_equal_means_per_base(spark):
    r = random.Random(3)
    rows, at = [], 50
    while at < 1400:
        n = r.randint(1, 60)
        rows.append(("s", "c", at, at + n - 1, r.randint(1, 9)))
        at += n + r.choice([0, 7])
    start, end = 100, 1300
    depth = np.zeros(2000)
    for _, _, a, b, d in rows:
        depth[a : b + 1] = d
    got = TR.sample_tracks(spark.createDataFrame(rows, "sample string, seq string, start long, end long, depth long"), "c", start, end).orderBy("bin").collect()
    n, width = end - start + 1, TR.bin_width(start, end)
    last = max(1, -(-(n + 1) // width) - 1)
    bins = (np.arange(n) * last) // n
    want = [depth[start : end + 1][bins == k].mean() for k in range(last)]
    assert [x.depth for x in got] == pytest.approx(want) and [x.position for x in got] == pytest.approx([np.flatnonzero(bins == k).mean() + start for k in range(last)])


def test_p_values_of_t():
    assert SH.t_p_array([2.776445, 0.0, -12.7062, np.nan, 1.0], [4, 7, 1, 3, 0]) == pytest.approx([0.05, 1, 0.05, np.nan, np.nan], abs=1e-5, nan_ok=True)


def test_junction_report_prefers_minus(spark):
    from isoloom.operators import quantify as Q

    j = spark.createDataFrame([("c", 1, 9, 2, 3, 5), ("c", 2, 9, 0, 1, 1)], "seq string, start long, end long, neg long, pos long, total long")
    ref = spark.createDataFrame([("c", 1, 9, "-", False), ("c", 1, 9, "+", True), ("c", 3, 9, "+", True)], "seq string, start long, end long, strand string, nmd_only boolean")
    got = {r.start: (r.strand, r.total, r.annotated, r.nmd) for r in Q.junction_report(j, ref).collect()}
    assert got == {1: ("-", 5, True, True), 2: (".", 1, False, False), 3: ("+", 0, True, True)}
    assert tuple(Q.junction_qc(Q.junction_report(j, ref)).first()) == (5, 1, 5)
