"""Kernel operators as queries over the projected views, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import histogram as H
from ..operators import intervals as I
from ..operators import relational as R
from ..operators import sequence as S
from . import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _iv(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    iv = V.intervals(s, d)
    return iv, V.regions(iv)


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.col("row_id").alias("a_id"), F.col("b_row_id").alias("b_id"))


def _overlap_sql(on: str) -> str:
    return f"WITH {V.IV}, {V.RG} SELECT a.row_id AS a_id, b.row_id AS b_id FROM iv a JOIN rg b ON a.seq = b.seq AND {on}"


@query("overlap_any", _overlap_sql("a.strand = b.strand AND a.s <= b.e AND a.e >= b.s"))
def overlap_any(s, d):
    return _pairs(I.overlap_join(*_iv(s, d)))


@query("overlap_within", _overlap_sql("a.strand = b.strand AND a.s >= b.s AND a.e <= b.e"))
def overlap_within(s, d):
    return _pairs(I.overlap_join(*_iv(s, d), how="within"))


@query("overlap_equal", f"WITH {V.IV} SELECT a.row_id AS a_id, b.row_id AS b_id FROM iv a JOIN iv b ON a.seq = b.seq AND a.strand = b.strand AND a.s = b.s AND a.e = b.e")
def overlap_equal(s, d):
    iv, _ = _iv(s, d)
    return _pairs(I.overlap_join(iv, iv, how="equal"))


@query("overlap_unstranded", _overlap_sql("a.s <= b.e AND a.e >= b.s"))
def overlap_unstranded(s, d):
    return _pairs(I.overlap_join(*_iv(s, d), ignore_strand=True))


@query("overlap_count", f"WITH {V.IV}, {V.RG} SELECT b.row_id, count(a.row_id) AS n FROM rg b LEFT JOIN iv a ON a.seq = b.seq AND a.strand = b.strand AND a.s <= b.e AND a.e >= b.s GROUP BY 1")
def overlap_count(s, d):
    iv, rg = _iv(s, d)
    n = I.overlap_join(rg, iv).groupBy("row_id").agg(F.count("*").alias("n"))
    return rg.select("row_id").join(n, "row_id", "left").select("row_id", F.coalesce("n", F.lit(0)).alias("n"))


def _reduce_sql(keys: str, gap: int) -> str:
    return f"""WITH {V.IV}, p AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e, pe NULLS FIRST ROWS UNBOUNDED PRECEDING) AS g FROM p)
SELECT {keys}, min(s) AS "start", max(e) AS "end", count(*) AS n FROM i GROUP BY {keys}, g"""


@query("reduce_stranded", _reduce_sql("seq, strand", 1))
def reduce_stranded(s, d):
    return I.reduce_intervals(V.intervals(s, d))


@query("reduce_unstranded", _reduce_sql("seq", 1))
def reduce_unstranded(s, d):
    return I.reduce_intervals(V.intervals(s, d), ["seq"])


@query("reduce_gap9", _reduce_sql("seq, strand", 9))
def reduce_gap9(s, d):
    return I.reduce_intervals(V.intervals(s, d), min_gap=9)


@query("group_gaps", f'WITH {V.TX}, {V.INTRON} SELECT tx, s AS "start", e AS "end" FROM intron')
def group_gaps(s, d):
    return I.group_gaps(V.exons(s, d), ["tx"])


@query("group_span", f'WITH {V.TX} SELECT tx, min(s) AS "start", max(e) AS "end" FROM tx GROUP BY tx')
def group_span(s, d):
    return I.group_span(V.exons(s, d), ["tx"])


def _sweep_sql(test: str) -> str:
    return f"""WITH {V.IV}, {V.RG}, ev AS (SELECT seq, strand, p, sum(da) AS da, sum(db) AS db FROM
 (SELECT seq, strand, s AS p, 1 AS da, 0 AS db FROM rg UNION ALL SELECT seq, strand, e + 1, -1, 0 FROM rg UNION ALL SELECT seq, strand, s, 0, 1 FROM iv UNION ALL SELECT seq, strand, e + 1, 0, -1 FROM iv) GROUP BY ALL),
c AS (SELECT seq, strand, p AS s, lead(p) OVER w - 1 AS e, sum(da) OVER w AS na, sum(db) OVER w AS nb FROM ev WINDOW w AS (PARTITION BY seq, strand ORDER BY p)),
k AS (SELECT seq, strand, s, e FROM c WHERE e IS NOT NULL AND {test}),
q AS (SELECT *, CASE WHEN s > lag(e) OVER (PARTITION BY seq, strand ORDER BY s) + 1 THEN 1 ELSE 0 END AS f FROM k),
g AS (SELECT *, sum(f) OVER (PARTITION BY seq, strand ORDER BY s) AS i FROM q)
SELECT seq, strand, min(s) AS "start", max(e) AS "end" FROM g GROUP BY seq, strand, i"""


@query("intersect_ranges", _sweep_sql("na > 0 AND nb > 0"))
def intersect_ranges(s, d):
    iv, rg = _iv(s, d)
    return I.intersect_intervals(rg, iv)


@query("setdiff_ranges", _sweep_sql("na > 0 AND nb <= 0"))
def setdiff_ranges(s, d):
    iv, rg = _iv(s, d)
    return I.setdiff_intervals(rg, iv)


@query("flank_ranges", f"""WITH {V.IV} SELECT row_id, seq, strand, CASE WHEN strand = '-' THEN e + 1 ELSE s - 20 END AS "start", CASE WHEN strand = '-' THEN e + 20 ELSE s - 1 END AS "end" FROM iv""")
def flank_ranges(s, d):
    return I.flank(V.intervals(s, d), 20)


RUNS = """ev AS (SELECT seq, strand, p, sum(d) AS d FROM (SELECT seq, strand, s AS p, 1 AS d FROM iv UNION ALL SELECT seq, strand, e + 1, -1 FROM iv) GROUP BY ALL HAVING sum(d) <> 0),
runs AS (SELECT seq, strand, s, e, depth FROM (SELECT seq, strand, p AS s, lead(p) OVER w - 1 AS e, CAST(sum(d) OVER w AS BIGINT) AS depth FROM ev WINDOW w AS (PARTITION BY seq, strand ORDER BY p)) WHERE e IS NOT NULL)"""


@query("coverage_runs", f'WITH {V.IV}, {RUNS} SELECT seq, strand, s AS "start", e AS "end", depth FROM runs')
def coverage_runs(s, d):
    return I.coverage_runs(V.intervals(s, d))


@query("coverage_regions_mean", f"""WITH {V.IV}, {V.RG}, {RUNS}
SELECT rg.row_id, round(coalesce(sum((least(rg.e, r.e) - greatest(rg.s, r.s) + 1) * r.depth), 0) / (min(rg.e) - min(rg.s) + 1), 6) AS mean_depth
FROM rg LEFT JOIN runs r ON rg.seq = r.seq AND rg.strand = r.strand AND rg.s <= r.e AND rg.e >= r.s GROUP BY rg.row_id""")
def coverage_regions_mean(s, d):
    iv, rg = _iv(s, d)
    return I.mean_depth(iv.withColumn("depth", F.lit(1)), rg, "row_id", 6)  # intervals add up to their coverage


@query("coverage_bins", f"""WITH {V.IV}, {RUNS}, t AS (SELECT *, unnest(range((s - 1) // 200, (e - 1) // 200 + 1)) AS bin FROM runs)
SELECT seq, strand, bin, round(sum((least(200 * bin + 200, e) - greatest(200 * bin + 1, s) + 1) * depth) / 200.0, 6) AS mean_depth FROM t GROUP BY 1, 2, 3""")
def coverage_bins(s, d):
    return I.mean_bins(I.coverage_runs(V.intervals(s, d)), 200)


@query("low_coverage_regions", f"""WITH {V.IV}, {RUNS}, k AS (SELECT * FROM runs WHERE depth <= 2),
q AS (SELECT *, CASE WHEN s > lag(e) OVER (PARTITION BY seq, strand ORDER BY s) + 1 THEN 1 ELSE 0 END AS f FROM k), g AS (SELECT *, sum(f) OVER (PARTITION BY seq, strand ORDER BY s) AS i FROM q)
SELECT seq, strand, min(s) AS "start", max(e) AS "end" FROM g GROUP BY seq, strand, i""")
def low_coverage_regions(s, d):
    return I.low_regions(I.coverage_runs(V.intervals(s, d)), 2)


HIST = """met AS (SELECT rg.row_id, depth, sum(least(rg.e, r.e) - greatest(rg.s, r.s) + 1) AS n FROM rg JOIN runs r ON rg.seq = r.seq AND rg.strand = r.strand AND rg.s <= r.e AND rg.e >= r.s GROUP BY 1, 2),
hist AS (SELECT row_id, depth, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM met UNION ALL SELECT rg.row_id, 0, e - s + 1 - coalesce((SELECT sum(n) FROM met WHERE met.row_id = rg.row_id), 0) FROM rg) WHERE n > 0 GROUP BY 1, 2),
cum AS (SELECT *, sum(n) OVER (PARTITION BY row_id ORDER BY depth) AS c, sum(n) OVER (PARTITION BY row_id) AS t, lead(depth) OVER (PARTITION BY row_id ORDER BY depth) AS nx FROM hist)"""
_H = f"WITH {V.IV}, {V.RG}, {RUNS}, {HIST} "


def _hist(s, d) -> DataFrame:
    iv, rg = _iv(s, d)
    return I.region_depths(I.coverage_runs(iv), rg, "row_id")


@query("depth_hist", _H + "SELECT row_id, depth, n FROM hist")
def depth_hist(s, d):
    return _hist(s, d)


@query("hist_mean", _H + "SELECT row_id, round(sum(depth * n) / sum(n), 6) AS mean FROM hist GROUP BY 1")
def hist_mean(s, d):
    return H.hist_mean(_hist(s, d), "row_id").withColumn("mean", F.round("mean", 6))


@query("hist_coverage", _H + "SELECT row_id, round(sum(CASE WHEN depth > 0 THEN n ELSE 0 END) / sum(n), 6) AS coverage FROM hist GROUP BY 1")
def hist_coverage(s, d):
    return H.hist_coverage(_hist(s, d), "row_id").withColumn("coverage", F.round("coverage", 6))


def _percentile_sql(p: int) -> str:
    r = f"((t + 1) * {p} / 100.0)"
    return f"max(CASE WHEN c - n < greatest(floor({r}), 1) AND c >= greatest(floor({r}), 1) THEN depth + ({r} - floor({r})) * CASE WHEN floor({r}) >= 1 AND floor({r}) = c AND nx IS NOT NULL THEN nx - depth ELSE 0 END END)"


@query("hist_percentiles", _H + f"SELECT row_id, {', '.join(f'round(CAST({_percentile_sql(p)} AS DOUBLE), 6) AS p{p}' for p in (25, 50, 75))} FROM cum GROUP BY 1")
def hist_percentiles(s, d):
    got = H.hist_percentiles(_hist(s, d), "row_id")
    return got.select("row_id", *[F.round(F.col(f"p{p}").cast("double"), 6).alias(f"p{p}") for p in (25, 50, 75)])


@query("hist_trimmed_mean", _H + "SELECT row_id, round(sum(depth * greatest(0, least(c, t - k) - greatest(c - n, k))) / max(t - 2 * k), 6) AS trimmed_mean FROM (SELECT *, floor(t * 0.3) AS k FROM cum) GROUP BY 1")
def hist_trimmed_mean(s, d):
    return H.hist_trimmed_mean(_hist(s, d), "row_id").withColumn("trimmed_mean", F.round("trimmed_mean", 6))


# ---- numbering and ordered matches -----------------------------------------------------------------------


def _numbered(s, d) -> DataFrame:
    return R.row_ids(V.exons(s, d), ["tx"], ["start", "end"])


@query("rowid_numbering", f'WITH {V.TX} SELECT tx, s AS "start", e AS "end", CAST(row_number() OVER (PARTITION BY tx ORDER BY s, e) AS INT) AS n FROM tx')
def rowid_numbering(s, d):
    return _numbered(s, d).select("tx", "start", "end", "n")


@query("strand_renumber", f"""WITH {V.TX} SELECT tx, s AS "start", e AS "end", CAST(CASE WHEN strand = '-' THEN count(*) OVER (PARTITION BY tx) + 1 - row_number() OVER (PARTITION BY tx ORDER BY s, e) ELSE row_number() OVER (PARTITION BY tx ORDER BY s, e) END AS INT) AS n FROM tx""")
def strand_renumber(s, d):
    return R.strand_renumber(_numbered(s, d), ["tx"]).select("tx", "start", "end", "n")


_NATION = "WITH o AS (SELECT c_nationkey, o_orderkey, o_orderpriority, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P')"


def _partial_orders(s, d) -> DataFrame:
    o = V.load(s, d, "orders").where("o_orderstatus = 'P'")
    return o.join(V.load(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), o["o_custkey"] == F.col("c_custkey")).select("n_nationkey", "o_orderkey", "o_orderpriority")


@query("update_join_last", "WITH l AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT c_custkey, coalesce(p, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN l ON c_custkey = o_custkey")
def update_join_last(s, d):
    y = V.load(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderkey")
    return R.update_join(V.load(s, d, "customer").select("c_custkey", "c_mktsegment"), y, ["c_custkey"], ["c_mktsegment"], ["o_orderkey"])


@query("match_first", _NATION + ", l AS (SELECT c_nationkey, arg_min(o_orderpriority, o_orderkey) AS p FROM o GROUP BY 1) SELECT n_nationkey, p AS o_orderpriority FROM nation LEFT JOIN l ON n_nationkey = c_nationkey")
def match_first(s, d):
    return R.match_lookup(V.load(s, d, "nation").select("n_nationkey"), _partial_orders(s, d), ["n_nationkey"], ["o_orderpriority"], ["o_orderkey"])


@query("distinct_first", f'WITH {V.TX} SELECT seq, strand, s AS "start", tx, e AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY seq, strand, s ORDER BY e DESC, tx) AS n FROM tx) WHERE n = 1')
def distinct_first(s, d):
    return R.distinct_on(V.exons(s, d), ["seq", "strand", "start"], [F.desc("end"), "tx"]).select("seq", "strand", "start", "tx", "end")


@query("pair_combinations", f"""WITH {V.TX}, x AS (SELECT DISTINCT gene, s, e FROM tx), n AS (SELECT *, row_number() OVER (PARTITION BY gene, s ORDER BY e) AS i FROM x)
SELECT a.gene, a.s AS "start", a.e AS a_end, b.e AS b_end FROM n a JOIN n b ON a.gene = b.gene AND a.s = b.s AND a.i < b.i""")
def pair_combinations(s, d):
    x = V.exons(s, d).select("gene", "start", "end").distinct()
    return R.pair_combinations(x, ["gene", "start"], ["end"], ["end"])


@query("semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join(s, d):
    o = V.load(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return R.semi_join(V.load(s, d, "customer").select("c_custkey", "c_name"), o, ["c_custkey"])


@query("anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join(s, d):
    o = V.load(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return R.anti_join(V.load(s, d, "customer").select("c_custkey", "c_name"), o, ["c_custkey"])


@query("full_outer_keys", f'WITH {V.IV} SELECT DISTINCT seq, strand, s AS "start", e AS "end" FROM iv WHERE s % 3 = 0 OR s % 5 = 0')
def full_outer_keys(s, d):
    iv = V.intervals(s, d)
    return R.full_outer_keys([iv.where("start % 3 = 0"), iv.where("start % 5 = 0")], ["seq", "strand", "start", "end"])


@query("ordered_concat", f"WITH {V.TX} SELECT tx, string_agg(CAST(s AS VARCHAR), '' ORDER BY s, CAST(s AS VARCHAR)) AS joined FROM tx GROUP BY tx")
def ordered_concat(s, d):
    return R.ordered_concat(V.exons(s, d).withColumn("t", F.col("start").cast("string")), ["tx"], "start", "t")


# ---- locus strings ---------------------------------------------------------------------------------------


@query("locus_format", f"WITH {V.IV} SELECT row_id, seq || ':' || s || '-' || e || '/' || strand AS locus FROM iv")
def locus_format(s, d):
    from ..functions.locus import locus

    return V.intervals(s, d).select("row_id", locus(F.col("seq"), F.col("start"), F.col("end"), F.col("strand")).alias("locus"))


@query("locus_parse", f"""WITH {V.IV}, t AS (SELECT row_id, CASE s % 3 WHEN 0 THEN seq || ':' || s || '-' || e || '/' || strand WHEN 1 THEN seq || ':' || s || '-' || e ELSE seq || ':' || s END AS x FROM iv)
SELECT row_id, regexp_extract(x, '^([^:]+):', 1) AS seq, CAST(regexp_extract(x, ':([0-9]+)', 1) AS BIGINT) AS "start", CAST(coalesce(nullif(regexp_extract(x, '-([0-9]+)', 1), ''), regexp_extract(x, ':([0-9]+)', 1)) AS BIGINT) AS "end",
CASE WHEN contains(x, '/') THEN regexp_extract(x, '/(.)$', 1) ELSE '*' END AS strand FROM t""")
def locus_parse(s, d):
    from ..functions.locus import locus, parse

    iv = V.intervals(s, d)
    part = F.concat("seq", F.lit(":"), F.col("start").cast("string"))
    x = F.when(F.col("start") % 3 == 0, locus(F.col("seq"), F.col("start"), F.col("end"), F.col("strand"))).when(F.col("start") % 3 == 1, F.concat(part, F.lit("-"), F.col("end").cast("string"))).otherwise(part)
    return iv.select("row_id", parse(x).alias("g")).select("row_id", "g.*")


# ---- sequences -------------------------------------------------------------------------------------------


@query("revcomp", f"WITH {V.SQ} SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM sq")
def revcomp(s, d):
    return V.sequences(s, d).select("doc_id", S.reverse_complement(F.col("seq")).alias("rc"))


_AA = "array_to_string(list_transform(range(0, length(seq) // 3), lambda i: map_extract_value(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in S.CODONS.items()) + "}, substr(seq, 3 * i + 1, 3))), '')"


@query("translate_codons", f"WITH {V.SQ} SELECT doc_id, {_AA} AS aa FROM sq")
def translate_codons(s, d):
    return V.sequences(s, d).select("doc_id", S.translate_codons(F.col("seq")).alias("aa"))


@query("first_stop", f"WITH {V.SQ} SELECT doc_id, CASE WHEN strpos(aa, '*') > 0 THEN CAST(3 * strpos(aa, '*') - 2 AS INT) END AS stop FROM (SELECT doc_id, {_AA} AS aa FROM sq)")
def first_stop(s, d):
    return V.sequences(s, d).select("doc_id", S.first_stop(F.col("seq")).alias("stop"))


@query("phase_trim", f"WITH {V.SQ}, t AS (SELECT doc_id, substr(seq, CAST((3 - doc_id % 3) % 3 + 1 AS BIGINT)) AS x FROM sq) SELECT doc_id, substr(x, 1, length(x) - length(x) % 3) AS trimmed FROM t")
def phase_trim(s, d):
    return V.sequences(s, d).select("doc_id", S.phase_trim(F.col("seq"), F.col("doc_id") % 3).alias("trimmed"))


@query("splice_motif", f"""WITH {V.SQ}, t AS (SELECT doc_id, seq, length(seq) // 4 + 1 AS s, length(seq) - length(seq) // 4 AS e FROM sq WHERE length(seq) >= 4)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substr(seq, s, 2) || substr(seq, e - 1, 2) ELSE reverse(translate(substr(seq, e - 1, 2), 'ACGT', 'TGCA')) || reverse(translate(substr(seq, s, 2), 'ACGT', 'TGCA')) END AS motif FROM t""")
def splice_motif(s, d):
    """The middle half of each sequence as an intron; sequences without two bases there have none."""
    from ..functions.locus import motif

    quarter = F.floor(F.length("seq") / 4).cast("int")
    strand = F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-")
    q = V.sequences(s, d).where(F.length("seq") >= 4)
    return q.select("doc_id", motif(F.col("seq"), quarter + 1, F.length("seq") - quarter, strand).alias("motif"))
