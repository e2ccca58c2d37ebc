"""Identities and hand-sized cases of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from isoloom.functions.locus import parse
from isoloom.operators import histogram as H
from isoloom.operators import intervals as I
from isoloom.operators import quantify as Q
from isoloom.operators import relational as R
from isoloom.operators import sequence as S
from isoloom.operators import shaping as SH
from isoloom.plans.model import prune_overlaps


def make(spark, rows):
    return spark.createDataFrame(rows, "id long, seq string, strand string, start long, end long")


@pytest.fixture(scope="module")
def some(spark):
    r = random.Random(3)
    rows = []
    for k in range(300):
        s = r.randint(1, 5000)
        rows.append((k, r.choice("ab"), r.choice("+-*"), s, s + r.choice([0, 5, 60, 70, 600, 3000])))
    return rows, make(spark, rows).cache()


def brute(rows, test):
    return sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and test(a, b))


@pytest.mark.parametrize("how,test", [("any", lambda a, b: a[3] <= b[4] and a[4] >= b[3]), ("within", lambda a, b: a[3] >= b[3] and a[4] <= b[4]), ("equal", lambda a, b: a[3:] == b[3:])])
def test_overlap_join(some, how, test):
    rows, df = some
    strand = lambda a, b: a[2] == b[2] or "*" in (a[2], b[2])
    got = sorted((r.id, r.b_id) for r in I.overlap_join(df, df, how=how).collect())
    assert got == brute(rows, lambda a, b: test(a, b) and strand(a, b))
    got = sorted((r.id, r.b_id) for r in I.overlap_join(df, df, how=how, ignore_strand=True).collect())
    assert got == brute(rows, test)


@pytest.mark.parametrize("chunk", [50, 1000, 1 << 16])
def test_reduce_is_idempotent_and_chunks_do_not_matter(some, chunk):
    _, df = some
    key = lambda d: sorted((r.seq, r.strand, r.start, r.end) for r in d.collect())
    once = I.reduce_intervals(df, chunk=chunk)
    assert key(once) == key(I.reduce_intervals(df)) == key(I.reduce_intervals(once, chunk=chunk))


def test_coverage_sums_to_lengths(some):
    rows, df = some
    runs = I.coverage_runs(df, chunk=300)
    total = runs.agg(F.sum(F.col("depth") * (F.col("end") - F.col("start") + 1))).first()[0]
    assert total == sum(r[4] - r[3] + 1 for r in rows)


def test_set_algebra_splits_a_table(some):
    _, df = some
    a, b = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    size = lambda d: d.agg(F.sum(F.col("end") - F.col("start") + 1)).first()[0] or 0
    assert size(I.intersect_intervals(a, b)) + size(I.setdiff_intervals(a, b)) == size(I.reduce_intervals(a))


def test_gaps_and_members_fill_the_span(spark):
    df = make(spark, [(1, "a", "+", 10, 20), (1, "a", "+", 15, 30), (1, "a", "+", 31, 40), (1, "a", "+", 50, 60), (2, "a", "+", 5, 5)])
    got = [(r.id, r.start, r.end) for r in I.group_gaps(df, ["id"]).collect()]
    assert got == [(1, 41, 49)]


def test_histogram_rules(spark):
    h = spark.createDataFrame([("r", d, n) for d, n in [(0, 2), (1, 3), (5, 5)]], "k string, depth long, n long")
    values = sorted([0] * 2 + [1] * 3 + [5] * 5)
    got = H.hist_percentiles(h, "k").first()
    for p, v in ((25, got.p25), (50, got.p50), (75, got.p75)):
        rank = 11 * p / 100
        lo = int(rank)
        assert v == pytest.approx(values[lo - 1] + (rank - lo) * (values[min(lo, 9)] - values[lo - 1]))
    assert H.hist_trimmed_mean(h, "k").first().trimmed_mean == sum(values[3:7]) / 4
    assert H.hist_coverage(h, "k").first().coverage == 0.8


def test_update_join_last_and_match_first(spark):
    x = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    y = spark.createDataFrame([(1, "p", 1), (1, "q", 2)], "k int, v string, o int")
    assert sorted(map(tuple, R.update_join(x, y, ["k"], ["v"], ["o"]).collect())) == [(1, "q"), (2, "old")]
    got = R.match_lookup(x.select("k"), y, ["k"], ["v"], ["o"])
    assert sorted(map(tuple, got.collect())) == [(1, "p"), (2, None)]


def test_sequence_functions(spark):
    r = spark.createDataFrame([("ATGTAAGG", "AANTAG")], "a string, b string").select(S.translate_codons(F.col("a")).alias("p"), S.first_stop(F.col("a")).alias("s"), S.translate_codons(F.col("b")).alias("x"), S.reverse_complement(F.col("a")).alias("rc"), S.phase_trim(F.col("a"), F.lit(1)).alias("t")).first()
    assert (r.p, r.s, r.x, r.rc, r.t) == ("M*", 4, "X*", "CCTTACAT", "GTAAGG")


def test_locus_errors(spark):
    df = spark.createDataFrame([("chr1:5-9/+",), ("chr1:7",)], "x string").select(parse(F.col("x")).alias("g")).select("g.*")
    assert sorted(map(tuple, df.collect())) == [("chr1", 5, 9, "+"), ("chr1", 7, 7, "*")]
    with pytest.raises(Exception, match="not a locus"):
        spark.createDataFrame([("chr1:9-5",)], "x string").select(parse(F.col("x"))).collect()


def test_cigar_and_pairs(spark):
    aln = [("single", 0, "c", 10, "5M3I5M10N4M"), ("long", 0x1 | 0x40, "c", 10, "5M"), ("long", 0x1 | 0x10, "c", 30, "5M"), ("short", 0x1 | 0x40, "c", 10, "30M"), ("short", 0x1, "c", 12, "5M"), ("cross", 0x1 | 0x40 | 0x10, "c", 10, "10M5N10M"), ("cross", 0x1, "c", 18, "2M5N15M"), ("chim", 0x1, "c", 1, "5M"), ("chim", 0x1, "d", 1, "5M"), ("gone", 0x4, "c", 1, "5M"), ("bad", 0x1 | 0x40, "c", 10, "3M20N3M"), ("bad", 0x1, "c", 20, "30M")]
    df = spark.createDataFrame(aln, "read_name string, flag int, seq string, pos long, cigar string")
    got = {r.read_name: (r.kind, r.direction, [[(b.start, b.end) for b in x] for x in r.reads]) for r in Q.pair_fragments(df).collect()}
    assert got["single"] == ("single", "+", [[(10, 19), (30, 33)]])
    assert got["long"] == ("long", "+", [[(10, 14)], [(30, 34)]])
    assert got["short"] == ("short", "+", [[(10, 39)]])
    assert got["cross"][0] == "intersect" and got["cross"][2] == [[(10, 19), (25, 39)]]
    assert got["chim"] == ("chimeric", "+", [[]])
    assert got["bad"][0] == "inconsistent" and len(got["bad"][2]) == 2
    assert "gone" not in got


def test_t_distribution():
    assert SH.t_p_value(2.776445, 4) == pytest.approx(0.05, abs=1e-5)
    assert SH.t_p_value(0.0, 7) == pytest.approx(1.0)
    assert SH.t_p_value(-12.7062, 1) == pytest.approx(0.05, abs=1e-5)


def test_bh_matches_direct_computation(spark):
    r = random.Random(5)
    p = [round(r.random() ** 3, 3) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = {x.i: x.p_adj for x in SH.bh_adjust(df, slices=7).collect()}
    order = sorted(range(200), key=lambda k: p[k])
    want, low = {}, 1.0
    for rank in range(200, 0, -1):
        low = min(low, p[order[rank - 1]] * 200 / rank)
        want[order[rank - 1]] = low
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_prune_overlaps_reaches_a_fixpoint(spark):
    loci = spark.createDataFrame([("a", "+", 1, 10, 0.5), ("a", "+", 8, 20, 0.9), ("a", "+", 18, 30, 0.4), ("a", "+", 29, 40, 0.3), ("a", "-", 1, 10, 0.1)], "seq string, strand string, start long, end long, mean_psi double")
    got = sorted((r.strand, r.start) for r in prune_overlaps(loci).collect())
    assert got == [("+", 8), ("+", 29), ("-", 1)]


def test_overlap_join_compares_few_more_pairs_than_it_finds(spark):
    r = random.Random(8)
    rows = []
    for k in range(6000):  # mostly short intervals, some long, a few as long as the sequence
        n = 3_000_000 if k % 1500 == 0 else r.randint(1_000, 60_000) if k % 50 == 0 else r.randint(1, 400)
        s = r.randint(1, 3_000_000)
        rows.append((k, "a", "+", s, s + n))
    df = make(spark, rows)
    pairs = I.overlap_join(df, df).count()
    assert pairs == sum(a[3] <= b[4] and a[4] >= b[3] for a in rows for b in rows)
    seen = I.candidates(df, df)
    assert seen.count() == seen.distinct().count() < 8 * pairs


def test_covered_bases_match_depth_by_base(some):
    rows, df = some
    runs = I.coverage_runs(df)
    for ignore in (False, True):
        got = {r.id: r.total for r in I.covered_bases(runs, df.where("id < 60"), "id", ignore, chunk=500).collect()}
        want = {}
        for a in rows[:60]:
            fits = [b for b in rows if a[1] == b[1] and (ignore or a[2] == b[2] or "*" in (a[2], b[2]))]
            want[a[0]] = sum(max(0, min(a[4], b[4]) - max(a[3], b[3]) + 1) for b in fits)
        assert got == want


def test_every_covered_base_is_in_a_bin(some):
    rows, df = some
    want = {}
    for r in rows:
        for p in range(r[3], r[4] + 1):
            k = (r[1], r[2], (p - 1) // 200)
            want[k] = want.get(k, 0) + 1
    got = {(r.seq, r.strand, r.bin): r.mean_depth for r in I.mean_bins(I.coverage_runs(df), 200).collect()}
    assert {k: v for k, v in got.items() if v} == {k: round(n / 200, 6) for k, n in want.items()}


def test_views_read_whole_tables_and_texts(spark):
    from isoloom.plans import views as V

    sf = "/root/testdata/sf0.001"
    iv = V.intervals(spark, sf)
    assert V.regions(iv).count() == iv.count() == V.load(spark, sf, "lineitem").count()
    base = dict(zip(V.LETTERS, V.AS_BASES))
    want = {r.doc_id: "".join(base.get(c, "") for c in (r.text or "").lower()) for r in V.load(spark, sf, "documents").collect()}
    assert {r.doc_id: r.seq for r in V.sequences(spark, sf).collect()} == want and max(map(len, want.values())) > 300
