"""Steps that grew faster than their input: the same results by plans that hold fewer rows."""

import random

from pyspark.sql import functions as F

from isoloom.operators import annotation as A
from isoloom.operators import collate as C
from isoloom.operators import events as E
from isoloom.operators import intervals as I
from isoloom.operators import quantify as Q
from isoloom.operators import tracks as TR
from isoloom.plans import views as V

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning")


def test_region_depths_make_no_pairs(spark, monkeypatch):
    """Regions of all lengths against their bases, without the overlap join."""
    r = random.Random(5)
    ends = [(k, r.choice("ab"), r.choice("+-*"), s, s + r.choice([0, 3, 127, 128, 129, 300, 2000])) for k, s in enumerate(r.sample(range(-300, 3000), 80))]
    df = spark.createDataFrame(ends, "id long, seq string, strand string, start long, end long")
    runs = I.coverage_runs(df, chunk=500)
    monkeypatch.setattr(I, "overlap_join", lambda *a, **k: 1 / 0)
    held = [x.asDict() for x in runs.collect()]
    for ignore in (False, True):
        want = {}
        for k, seq, strand, s, e in ends:
            left = e - s + 1
            for x in held:
                if x["seq"] == seq and x["depth"] and (ignore or x["strand"] == strand or "*" in (strand, x["strand"])):
                    n = min(e, x["end"]) - max(s, x["start"]) + 1
                    if n > 0:
                        want[k, x["depth"]] = want.get((k, x["depth"]), 0) + n
                        left -= n
            if left > 0:
                want[k, 0] = left
        assert {(x.id, x.depth): x.n for x in I.region_depths(runs, df, "id", ignore).collect()} == want


def test_introns_are_dealt_once(spark):
    """One shuffle of each table serves numbers, gaps and skips of a transcript."""
    assert exchanges(E.skip_coords(A.introns(V.exons(spark, SF)))) <= 2


def test_view_reference_reads_once(spark):
    """F17"""
    gtf = spark.createDataFrame([("a", 1, 2, "+", t, 1) for t in ("exon", "CDS", "stop_codon", "gene", None)], "seq string, start long, end long, strand string, type string, tx long")
    got = A.view_reference(gtf)
    assert "Union" not in plan(got)
    assert sorted(x.type for x in got.collect()) == ["CDS", "exon", "stop_codon"]


def test_event_counts_keep_events_in_place(spark):
    """an event is one row until it gets its samples."""
    ev = spark.createDataFrame([(1, "SE", "x", "y", "z", None), (2, "RI", "x", None, "x", None)], "event_id long, event_type string, event1a string, event2a string, event1b string, event2b string")
    ct = spark.createDataFrame([("S0", "x", 3), ("S1", "y", 4)], "sample string, locus string, count long")
    ri = spark.createDataFrame([("S1", "x", "-", 2.5, 6, 7)], "sample string, locus string, strand string, depth double, left long, right long")
    got = C.event_counts(ev, ct, ri)
    assert "hashpartitioning(event_id" not in plan(got)
    assert sorted(tuple(x) for x in got.collect()) == [(1, "SE", "S0", 3.0, 0, 0, 0), (1, "SE", "S1", 0.0, 4, 0, 0), (2, "RI", "S0", 0.0, 0, 3, 0), (2, "RI", "S1", 2.5, 7, 0, 6)]


def test_equal_fragments_and_regions_meet_once(spark, monkeypatch):
    """300 equal fragments and 40 equal regions are one pair."""
    fr = spark.range(300).select(F.lit("a").alias("seq"), F.lit("-").alias("direction"), F.array(F.struct(F.lit(5).cast("long").alias("start"), F.lit(9).cast("long").alias("end"))).alias("blocks"))
    roi = spark.range(40).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"), F.lit("a").alias("seq"), F.lit(1).cast("long").alias("start"), F.lit(20).cast("long").alias("end"))
    join, seen = I.overlap_join, []
    monkeypatch.setattr(I, "overlap_join", lambda *a, **k: seen.append(join(*a, **k)) or seen[-1])
    assert {(x.neg, x.plus) for x in Q.roi_counts(fr, roi).collect()} == {(300, 0)}
    assert seen[0].count() == 1


def test_highlights_are_not_shuffled_by_event(spark):
    """F4"""
    ev = spark.createDataFrame([("e", "SE", "p", "q", "r", None)], "event_id string, event_type string, event1a string, event2a string, event1b string, event2b string")
    intron = spark.createDataFrame([("p", 1, 11, 19), ("q", 1, 31, 39), ("r", 2, 11, 39), ("p", 3, 11, 19)], "locus string, tx long, start long, end long")
    exons = spark.createDataFrame([(1, 1, 10), (1, 20, 30), (1, 40, 50), (2, 1, 10), (2, 40, 50), (3, 1, 10), (3, 20, 25)], "tx long, start long, end long")
    got = TR.event_highlight(ev, intron, exons)
    assert "hashpartitioning(event_id" not in plan(got)
    marks = [("exon", 1, 1, 1, 10), ("exon", 1, 1, 20, 30), ("exon", 1, 1, 40, 50), ("exon", 2, 2, 1, 10), ("exon", 2, 2, 40, 50)]
    lines = [("intron", 1, 1, 11, 19), ("intron", 1, 1, 31, 39), ("intron", 1, 3, 11, 19), ("intron", 2, 2, 11, 39)]
    assert sorted((x.type, x.isoform, x.tx, x.start, x.end) for x in got.collect()) == marks + lines


def test_overlap_join_bins_one_side(spark):
    """only the side that the other needs takes several bins."""
    r = random.Random(7)
    rows = [(k, "a", r.choice("+-*"), s, s + r.randint(0, 49)) for k, s in enumerate(r.choices(range(50_000), k=2000))]
    df = spark.createDataFrame(rows, "id long, seq string, strand string, start long, end long")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[3] <= b[4] and a[4] >= b[3] and (a[2] == b[2] or "*" in (a[2], b[2])))
    got = I.overlap_join(df, df)
    assert sorted((x.id, x.b_id) for x in got.collect()) == want
    b = df.select([F.col(c).alias(f"b_{c}") for c in df.columns])
    assert I._binned(b, "b_", 0, I._levels(df), False).count() == len(rows)  # of equal levels only one side takes bins


def test_sweep_merges_without_a_second_pass(spark):
    """turns of the test are the borders, no segment is merged again."""
    a = spark.createDataFrame([("a", "+", 1, 10), ("a", "+", 5, 30), ("a", "+", 60, 70)], "seq string, strand string, start long, end long")
    b = spark.createDataFrame([("a", "+", 3, 4), ("a", "+", 5, 12), ("a", "+", 20, 65)], "seq string, strand string, start long, end long")
    key = lambda d: sorted((x.start, x.end) for x in d.collect())
    for chunk in (4, 1000):
        assert key(I.intersect_intervals(a, b, chunk=chunk)) == [(3, 12), (20, 30), (60, 65)]
        assert key(I.setdiff_intervals(a, b, chunk=chunk)) == [(1, 2), (13, 19), (66, 70)]
    assert "island" not in plan(I.intersect_intervals(a, b))


def test_mean_depth_joins_no_widths(spark):
    """the width comes from the region's two ends; intervals of depth 1 do as well as their runs."""
    iv = spark.createDataFrame([(1, "a", "+", 1, 10), (2, "a", "+", 6, 25), (3, "a", "-", 8, 9)], "id long, seq string, strand string, start long, end long")
    by = lambda runs: {x.id: x.mean_depth for x in I.mean_depth(runs, iv, "id").collect()}
    assert by(iv.withColumn("depth", F.lit(1))) == by(I.coverage_runs(iv)) == {1: 1.5, 2: 1.25, 3: 1.0}
    p = plan(I.mean_depth(iv.withColumn("depth", F.lit(1)), iv, "id"))
    assert p.count("SortMergeJoin") + p.count("BroadcastHashJoin") == 1  # the chunks' sums


def test_windows_of_long_sequences(spark):
    """pieces that overlap hold every window of a long sequence once; none is cut from the whole sequence."""
    from isoloom.operators import coding as CO
    from isoloom.operators import sequence as S

    r = random.Random(1)
    seqs = [(k, "".join(r.choice("ACGT") for _ in range(n))) for k, n in enumerate((0, 39, 40, 127, 128, 167, 168, 700, 5003))]
    df = spark.createDataFrame(seqs, "id long, seq string")
    got = S.pieces(df, "seq", 128, 167)
    assert max(len(x.piece) for x in got.collect()) == 167
    seen = {(x.id, x.at + k): x.piece[k : k + 40] for x in got.collect() for k in range(min(128, len(x.piece) - 39))}
    assert seen == {(k, i): s[i : i + 40] for k, s in seqs for i in range(len(s) - 39)}
    names = [x.read_name for x in CO.synthetic_reads(df, "id").collect()]
    assert len(names) == sum(max(-(-(len(s) - 70) // 10), 0) for _, s in seqs)
    assert sorted(int(n.split("!")[2]) for n in names if n.split("!")[1] == "8") == list(range(1, 4932, 10))
    assert "piece" in plan(CO.synthetic_reads(df, "id"))


def test_pruning_makes_no_frame_per_island(spark):
    """against rounds of the rule itself."""
    import inspect

    from isoloom.plans import model as M

    r = random.Random(2)
    rows = sorted({("a", r.choice("+-"), s, s + r.randint(0, 30)) for s in r.choices(range(600), k=200)})
    rows = [(*x, r.randint(0, 9)) for x in rows]
    df = spark.createDataFrame(rows, "seq string, strand string, start long, end long, mean_psi long")
    left, kept = rows, []
    meets = lambda a, b: a[1] == b[1] and a[2] <= b[3] and a[3] >= b[2]
    while left:
        top = max(x[4] for x in left)
        won = [x for x in left if x[4] == top]
        kept += won
        left = [x for x in left if x not in won and not any(meets(x, w) for w in won)]
    assert sorted(tuple(x) for x in M.prune_overlaps(df).collect()) == sorted(kept)
    assert "sort_values" not in inspect.getsource(M._prune_locally)


def test_copies_leave_the_chain_as_long(spark, monkeypatch):
    """transcripts and fragments of the same shape add to counts, not to the rows of any table that is kept."""
    from isoloom.operators import relational as R
    from isoloom.plans import pipeline as P

    keep, sizes = R.settled, []

    def counted(df):
        got = keep(df)
        sizes.append(got.count())
        return got

    monkeypatch.setattr(R, "settled", counted)
    exons = [("t1", 101, 200), ("t1", 301, 400), ("t1", 501, 600), ("t2", 101, 200), ("t2", 501, 600), ("t3", 101, 200), ("t3", 311, 390), ("t3", 501, 600)]
    jump = [(181, 200), (301, 320)]
    kept, totals = [], []
    for copies in (1, 3):
        sizes.clear()
        ex = spark.createDataFrame([(f"{t}.{k}", 1, "chrZ", "-", s, e, "protein_coding", "1") for t, s, e in exons for k in range(copies)], "tx string, gene int, seq string, strand string, start long, end long, biotype string, tsl string")
        ref = P.build_reference(ex, ["protein_coding"], "nonsense_mediated_decay")
        fr = spark.createDataFrame([(x, "chrZ", d, b) for x, d, b in [("A", "+", jump), ("A", "-", jump), ("A", "+", [(190, 310)]), ("B", "+", jump)]] * copies, "sample string, seq string, direction string, blocks array<struct<start:bigint,end:bigint>>")
        counts = P.quantify(fr, ref)
        kept.append(list(sizes))
        totals.append(sorted((x.sample, x.neg, x.pos, x.total) for x in counts["junctions"].collect()))
        assert {(x.depth, x.span_left, x.splice_exact) for x in counts["introns"].where("sample = 'A' AND start = 201 AND end = 300").collect()} == {(copies, copies, 2 * copies)}
    assert kept[0] == kept[1]
    assert totals == [[("A", 1, 1, 2), ("B", 0, 1, 1)], [("A", 3, 3, 6), ("B", 0, 3, 3)]]


def test_intron_steps_stand_for_introns(spark):
    """every operator finds the same in distinct steps as in all transcripts' introns."""
    ex = V.exons(spark, SF)
    rows, steps = A.introns(ex).cache(), A.intron_steps(ex, ["F"], "O").cache()
    assert steps.count() < rows.count()
    none = spark.createDataFrame([], "event1a string, event1b string")
    found = (E.skipped_exons, E.mutually_exclusive, lambda x: E.alternative_ends(x, none, True), lambda x: E.alternative_ends(x, none, False), lambda x: E.ranked_transcript(x, ["F"]))
    for f in (*found, lambda x: x.select("locus", "seq", "strand", "start", "end").distinct()):
        a, b = f(rows), f(steps)
        assert a.columns == b.columns and a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()
    by = ["seq", "start", "end", "strand"]
    got = steps.groupBy(*by).agg(F.every("nmd_only").alias("nmd_only"))
    assert A.reference_junctions(rows, "O").exceptAll(got).isEmpty()
