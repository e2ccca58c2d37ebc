"""Coding sequence, tracks, tests and the overlap fixpoint as queries; some have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.locus import motif
from ..operators import annotation as A
from ..operators import coding as C
from ..operators import collate as CO
from ..operators import intervals as I
from ..operators import sequence as S
from ..operators import testing as T
from ..operators import tracks as TR
from . import model as M
from . import views as V
from .kernel_queries import _AA

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _aa(expr: str) -> str:
    return _AA.replace("length(seq)", f"length({expr})").replace("substr(seq,", f"substr({expr},")


_RC = lambda x: f"reverse(translate({x}, 'ACGT', 'TGCA'))"
_IN = "('GTAG', 'GCAG', 'ATAC', 'ATAG')"


@query("novel_junction_strand", f"""WITH {V.SQ}, m AS (SELECT doc_id, unnest(range(0, length(seq) - 39)) AS k, seq FROM sq WHERE length(seq) >= 40), j AS (SELECT doc_id, k, substr(seq, k + 1, 2) || substr(seq, k + 39, 2) AS x FROM m)
SELECT doc_id, k, CASE WHEN x IN {_IN} THEN '+' ELSE '-' END AS strand, CASE WHEN x IN {_IN} THEN x ELSE {_RC('x')} END AS motif FROM j WHERE x IN {_IN} OR {_RC('x')} IN {_IN}""")
def novel_junction_strand(s, d):
    """Every stretch of 40 bases of each sequence as a junction without a strand."""
    m = S.pieces(V.sequences(s, d), "seq", 128, 167).select("doc_id", "at", "piece", F.explode_outer(F.sequence(F.lit(0), F.least(F.lit(127), F.length("piece") - 40))).alias("k"))
    m = m.select("doc_id", (F.col("at") + F.col("k")).cast("long").alias("k"), motif(F.col("piece"), F.col("k") + 1, F.col("k") + 40, F.lit("+")).alias("x"))
    strand, text = C.novel_strand(F.col("x"))
    return m.select("doc_id", "k", strand.alias("strand"), text.alias("motif")).where("strand IS NOT NULL")


def _quarters(s: SparkSession, d: str) -> DataFrame:
    """Exon, intron, exon, exon: the four quarters of each sequence, the last one with the rest."""
    n = F.floor(F.length("seq") / 4).cast("int")
    part = [F.substring(F.col("seq"), k * n + 1, n if k < 3 else F.length("seq")) for k in range(4)]
    return V.sequences(s, d).select("doc_id", F.array(part[0], part[2], part[3]).alias("parts"), part[1].alias("intron"))


_Q = f"{V.SQ}, qt AS (SELECT doc_id, substr(seq, 1, n) AS q1, substr(seq, n + 1, n) AS q2, substr(seq, 2 * n + 1, n) AS q3, substr(seq, 3 * n + 1) AS q4 FROM (SELECT *, length(seq) // 4 AS n FROM sq))"


def _decay_sql(body: str) -> str:
    """First stop of the body and its distance to the body's end, the last junction."""
    return f"""WITH {_Q}, b AS (SELECT doc_id, {body} AS body FROM qt), t AS (SELECT doc_id, length(body) AS n, strpos({_aa('body')}, '*') AS p FROM b)
SELECT doc_id, CASE WHEN p > 0 THEN CAST(3 * p - 2 AS INT) END AS stop, CASE WHEN p > 0 THEN CAST(n - (3 * p - 2) AS INT) END AS to_junction, coalesce(p > 0 AND n - (3 * p - 2) >= 50, false) AS nmd FROM t"""


@query("nmd_spliced", _decay_sql("q1 || q3"))
def nmd_spliced(s, d):
    got = C.spliced_decay(F.col("parts"))
    return _quarters(s, d).select("doc_id", *[c.alias(k) for k, c in got.items()])


@query("nmd_retained", _decay_sql("q1 || q2 || q3"))
def nmd_retained(s, d):
    got = C.retained_decay(F.col("parts"), F.col("intron"), F.lit(1))
    return _quarters(s, d).select("doc_id", *[c.alias(k) for k, c in got.items()])


_CUT = lambda x: f"substr({x}, 1, length({x}) - length({x}) % 3)"


@query("event_peptides", f"""WITH {_Q}, a AS (SELECT doc_id, substr(q1, CAST((3 - doc_id % 3) % 3 + 1 AS BIGINT)) AS u, q3 AS c, q4 AS w FROM qt),
b AS (SELECT *, length(u) % 3 AS t FROM a), e AS (SELECT *, CASE WHEN t > 0 THEN substr(u, length(u) - t + 1) ELSE '' END || c AS m FROM b), f AS (SELECT *, (3 - length(m) % 3) % 3 AS k FROM e),
g AS (SELECT doc_id, substr(u, 1, length(u) - t) AS x, m || substr(w, 1, k) AS y, substr(w, k + 1) AS z FROM f), h AS (SELECT doc_id, {_CUT('x')} AS x, {_CUT('y')} AS y, {_CUT('z')} AS z FROM g)
SELECT doc_id, {_aa('x')} AS aa_up, {_aa('y')} AS aa_casette, {_aa('z')} AS aa_down, {_aa('x')} || {_aa('y')} || {_aa('z')} AS aa_full FROM h""")
def event_peptides(s, d):
    p = F.col("parts")
    got = C.peptide_segments(p[0], p[1], p[2], F.col("doc_id") % 3)
    return _quarters(s, d).select("doc_id", *[c.alias(k) for k, c in got.items()])


@query("synthetic_reads", f"""WITH {V.SQ}, n AS (SELECT doc_id, seq, CAST(greatest(ceil((length(seq) - 70) / 10.0), 0) AS BIGINT) AS n FROM sq), o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n),
w AS (SELECT doc_id, i, b + i AS r, substr(seq, i * 10 + 1, 70) AS x FROM (SELECT *, unnest(range(0, n)) AS i FROM o)),
m AS (SELECT *, substr(x, 1, 35) || translate(substr(x, 36, 1), 'ACGT', CASE r % 3 WHEN 0 THEN 'GATC' WHEN 1 THEN 'TGCA' ELSE 'CTAG' END) || substr(x, 37) AS y FROM w)
SELECT CASE WHEN r % 2 = 1 THEN '>RR!' ELSE '>RF!' END || doc_id || '!' || (i * 10 + 1) AS read_name, CASE WHEN r % 2 = 1 THEN {_RC('y')} ELSE y END AS read FROM m""")
def synthetic_reads(s, d):
    return C.synthetic_reads(V.sequences(s, d), "doc_id")


def _loci(s, d) -> DataFrame:
    return V.intervals(s, d).groupBy("seq", "strand", "start", "end").agg(F.count("*").alias("n")).withColumn("mean_psi", (F.col("start") * 31 + F.col("end") * 17) % 101)


@query("prune_overlap_round1", f"""WITH {V.IV}, l AS (SELECT seq, strand, s, e, (s * 31 + e * 17) % 101 AS psi FROM iv GROUP BY ALL),
p AS (SELECT *, max(e) OVER (PARTITION BY seq, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM l),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seq, strand ORDER BY s, e, pe NULLS FIRST ROWS UNBOUNDED PRECEDING) AS i FROM p)
SELECT seq, strand, s AS "start", e AS "end", psi = max(psi) OVER (PARTITION BY seq, strand, i) AS win FROM g""")
def prune_overlap_round1(s, d):
    return M.prune_round(_loci(s, d)).select("seq", "strand", "start", "end", "win")


@query("prune_overlap_fixpoint")
def prune_overlap_fixpoint(s, d):
    return M.prune_overlaps(_loci(s, d)).select("seq", "strand", "start", "end", "mean_psi")


@query("linear_contrast")
def linear_contrast(s, d):
    return T.linear_contrast(V.assays(s, d), "included", "A", "B")


@query("beta_binomial_test")
def beta_binomial_test(s, d):
    return T.beta_binomial_test(V.assays(s, d), "A", "B")


@query("condition_track", f"""WITH {V.AS} SELECT event_type, condition, count(*) AS n, round(avg(included / depth), 6) AS mean, round(stddev_samp(included / depth), 6) AS sd FROM asy GROUP BY 1, 2""")
def condition_track(s, d):
    rows = V.assays(s, d).withColumn("value", F.col("included") / F.col("depth"))
    got = TR.condition_track(rows, ["event_type", "condition"])
    return got.select("event_type", "condition", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("t_track")
def t_track(s, d):
    return TR.t_track(V.assays(s, d).withColumn("value", F.col("included") / F.col("depth")), ["event_type"], "A", "B")


@query("transcript_layout")
def transcript_layout(s, d):
    return TR.transcript_layout(V.exons(s, d).groupBy("seq", "tx").agg(F.min("start").alias("start"), F.max("end").alias("end")))


@query("negative_binomial_test")
def negative_binomial_test(s, d):
    return T.negative_binomial_test(V.assays(s, d), "included", "A", "B")


@query("terminus_flags", f"WITH {V.TX}, {V.INTRON} SELECT locus, max(n) = 1 AS always_first, max(n_all - n + 1) = 1 AS always_last FROM loc GROUP BY 1")
def terminus_flags(s, d):
    return CO.terminus(A.introns(V.exons(s, d)))


@query("row_metadata", f"""WITH {V.TX}, {V.INTRON}, t AS (SELECT locus, max(n) = 1 AS f, max(n_all - n + 1) = 1 AS l FROM loc GROUP BY 1), ev AS (SELECT DISTINCT tx AS event_id, CASE tx % 2 WHEN 0 THEN 'AFE' ELSE 'SE' END AS event_type, min(locus) AS event1a, max(locus) AS event1b FROM loc GROUP BY 1, 2),
sm AS (SELECT o_orderkey AS event_id, o_custkey % 2 = 0 AS ic, o_custkey % 3 = 0 AS inmd, o_custkey % 5 = 0 AS enmd FROM orders)
SELECT event_id, event_type, ic AS inc_coding, CASE WHEN inmd AND NOT enmd THEN 1 WHEN enmd AND NOT inmd THEN -1 ELSE 0 END AS nmd_direction, CASE WHEN event_type <> 'SE' THEN a.f AND b.f END AS always_first, CASE WHEN event_type <> 'SE' THEN a.l AND b.l END AS always_last
FROM ev JOIN sm USING (event_id) JOIN t a ON a.locus = event1a JOIN t b ON b.locus = event1b""")
def row_metadata(s, d):
    loc = A.introns(V.exons(s, d))
    ev = loc.groupBy(F.col("tx").alias("event_id")).agg(F.min("locus").alias("event1a"), F.max("locus").alias("event1b")).withColumn("event_type", F.when(F.col("event_id") % 2 == 0, "AFE").otherwise("SE"))
    o = V.load(s, d, "orders")
    side = lambda iso, n, c: o.select(F.col("o_orderkey").alias("event_id"), F.lit(iso).alias("isoform"), (F.col("o_custkey") % c == 0).alias("coding"), (F.col("o_custkey") % n == 0).alias("nmd"), F.lit("1").alias("tsl"))
    got = CO.row_metadata(ev, side("A", 3, 2).unionByName(side("B", 5, 7)), loc)
    return got.select("event_id", "event_type", "inc_coding", "nmd_direction", "always_first", "always_last")
