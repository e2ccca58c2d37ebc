"""Tests, tracks, coding sequence and the stream."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoloom.operators import coding as C
from isoloom.operators import testing as T
from isoloom.operators import tracks as TR
from isoloom.streaming import junctions as J


def test_prior_recovers_its_parameters():
    r = np.random.default_rng(1)
    d0, s0, d = 8.0, 0.3, 6.0
    s2 = d0 * s0 / r.chisquare(d0, 40_000) * r.chisquare(d, 40_000) / d
    got = T.prior_variance(np.log(s2).mean(), np.log(s2).var(), d)
    assert got[0] == pytest.approx(d0, rel=0.15) and got[1] == pytest.approx(s0, rel=0.05)


def test_linear_contrast_and_beta_binomial_find_the_changed_event(spark):
    r = np.random.default_rng(2)
    rows = []
    for e in range(60):
        for k in range(8):
            c = "A" if k < 4 else "B"
            shift = 40 if e == 0 and c == "A" else 0
            rows.append((e, "SE", c, f"b{k % 2}", float(50 + shift + r.integers(-8, 9)), float(100 - shift + r.integers(-8, 9))))
    rows = [(*x[:4], f"s{k % 8}", *x[4:]) for k, x in enumerate(rows)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, condition string, batch string, sample string, included double, excluded double")
    nb = {x.event_id: x for x in T.negative_binomial_test(df, "included", "A", "B").collect()}
    assert nb[0].p_adj < 0.01 and nb[0].lfc > 0.5 and np.mean([x.p_adj > 0.05 for k, x in nb.items() if k]) > 0.95
    lin = {x.event_id: x for x in T.linear_contrast(df, "included", "A", "B", batch="batch").collect()}
    bb = {x.event_id: x for x in T.beta_binomial_test(df, "A", "B").collect()}
    assert lin[0].p_adj < 1e-3 and lin[0].effect > 0.4 and min(x.p_adj for k, x in lin.items() if k) > 0.01
    assert bb[0].p_adj < 0.05 and bb[0].lfc > 0.5 and np.mean([x.p_adj > 0.05 for k, x in bb.items() if k]) > 0.95


def test_tracks(spark):
    assert TR.zoom_window(100, 199, 1000, 1, 0) == (1, 300)
    assert TR.t_quantile(4) == pytest.approx(2.776445, abs=1e-4)
    got = spark.range(1, 11).select(TR.bin_of(F.col("id"), 10, 4).alias("b")).collect()
    assert [r.b for r in got] == [math.floor((i - 1) * 2 / 10) + 1 for i in range(1, 11)]
    rows = spark.createDataFrame([("x", 1, 1, 10), ("x", 2, 5, 20), ("x", 3, 11, 15), ("x", 4, 21, 30)], "seq string, tx long, start long, end long")
    assert {r.tx: r.level for r in TR.transcript_layout(rows).collect()} == {1: 1, 2: 2, 3: 1, 4: 1}


def test_peptides_without_a_middle_exon(spark):
    df = spark.createDataFrame([("ATGAT", None, "GTAAC"), ("ATGAT", "GT", "AACCC")], "u string, c string, d string")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in C.peptide_segments(F.col("u"), F.col("c"), F.col("d"), F.lit(0)).items()]).collect()]
    assert got[0][0] == "M" and got[0][3] == "MM*"
    assert got[1] == ("M", "M*", "P", "MM*P")


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    from isoloom.operators.quantify import junction_counts

    block = lambda a, b, c, d: [(a, b), (c, d)]
    rows = [("c", "+-"[k % 2], block(k % 3, 20, 40 + k % 2, 60)) for k in range(50)]
    df = spark.createDataFrame(rows, "seq string, direction string, blocks array<struct<start:bigint,end:bigint>>")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = J.merge_counts(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    key = lambda d: sorted(tuple(r) for r in d.select("seq", "start", "end", "neg", "pos", "total").collect())
    assert key(J.totals(spark, str(tmp_path / "out"))) == key(junction_counts(df))


def test_samples_must_share_their_introns(spark):
    from isoloom.operators.collate import intron_consistency

    ok = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "x")], "sample string, name string")
    assert intron_consistency(ok).count() == 2
    with pytest.raises(ValueError):
        intron_consistency(ok.where("NOT (sample = 'b' AND name = 'x')"))


def test_layout_has_every_transcript_at_the_first_free_level(spark):
    from isoloom.plans import extra_queries as Q
    from isoloom.plans import views as V

    sf = "/root/testdata/sf0.001"
    spans = V.exons(spark, sf).groupBy("seq", "tx").agg(F.min("start").alias("start"), F.max("end").alias("end")).collect()
    last, want = {}, set()
    for r in sorted(spans, key=lambda r: (r.start, r.end, r.tx)):
        ends = last.setdefault(r.seq, [])
        k = next((i for i, x in enumerate(ends) if x < r.start), len(ends))
        ends[k : k + 1] = [r.end]
        want.add((r.seq, r.tx, k + 1))
    assert {(r.seq, r.tx, r.level) for r in Q.transcript_layout(spark, sf).collect()} == want


def _fixpoint(loci):
    """Rounds over clusters of overlapping or adjacent loci, as often as needed."""
    left, kept = sorted(loci), []
    while left:
        clusters, end = [], None
        for x in left:
            if end is None or x[0] > end + 1:
                clusters.append([])
                end = x[1]
            clusters[-1].append(x)
            end = max(end, x[1])
        won = [x for c in clusters for x in c if x[2] == max(y[2] for y in c)]
        kept += won
        left = [x for x in left if x not in won and not any(x[0] <= w[1] and w[0] <= x[1] for w in won)]
    return sorted(kept)


def test_pruning_leaves_no_locus_undecided(spark):
    from isoloom.plans.model import prune_overlaps

    r = np.random.default_rng(6)
    chain = [(10 * k, 10 * k + 12, 1000 - k) for k in range(150)]  # a locus wins each round: 75 rounds
    mixed = sorted({(int(s), int(s + r.integers(0, 30)), int(r.integers(0, 6))) for s in r.integers(0, 900, 120)})
    mixed = list({x[:2]: x for x in mixed}.values())
    schema = "seq string, strand string, start long, end long, mean_psi long"
    df = spark.createDataFrame([("c", "+", *x) for x in chain] + [("m", "-", *x) for x in mixed], schema)
    got = prune_overlaps(df).collect()
    for seq, loci in (("c", chain), ("m", mixed)):
        assert sorted((x.start, x.end, x.mean_psi) for x in got if x.seq == seq) == _fixpoint(loci)
    got = prune_overlaps(df.where("seq = 'm'"), island=8).collect()  # large islands go by rounds first
    assert sorted((x.start, x.end, x.mean_psi) for x in got) == _fixpoint(mixed)
