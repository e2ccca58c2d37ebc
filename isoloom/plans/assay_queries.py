"""Collation, filters and shaping as queries over the assay view, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collate as C
from ..operators import filters as FL
from ..operators import relational as R
from ..operators import shaping as S
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


def _as(s: SparkSession, d: str) -> DataFrame:
    return V.assays(s, d)


W = f"WITH {V.AS}"

# ---- junctions per sample --------------------------------------------------------------------------------

SJ = f"""{V.FR}, sj AS (SELECT 'S' || CAST(s1 % 4 AS VARCHAR) AS sample, seq, e1 + 1 AS s, s2 - 1 AS e, strand, count(*) AS "count", CAST((e1 // 100) % 7 AS VARCHAR) AS jg_up, CAST((s2 // 100) % 7 AS VARCHAR) AS jg_down FROM fr WHERE s2 > e1 + 1 GROUP BY ALL)"""
SIDES = 'sd AS (SELECT *, sum("count") OVER (PARTITION BY sample, seq, strand, s) AS sl, sum("count") OVER (PARTITION BY sample, seq, strand, e) AS sr FROM sj)'


def _sj(s, d) -> DataFrame:
    fr = V.fragments(s, d).where("s2 > e1 + 1")
    isl = lambda c: (F.floor(F.col(c) / 100) % 7).cast("string")
    return fr.groupBy(F.concat(F.lit("S"), (F.col("s1") % 4).cast("string")).alias("sample"), "seq", (F.col("e1") + 1).alias("start"), (F.col("s2") - 1).alias("end"), "strand", isl("e1").alias("jg_up"), isl("s2").alias("jg_down")).agg(F.count("*").alias("count"))


@query("junction_union", f'WITH {SJ} SELECT DISTINCT seq, s AS "start", e AS "end", strand FROM sj')
def junction_union(s, d):
    return C.junction_union(_sj(s, d))


@query("splice_left_right", f'WITH {SJ}, {SIDES} SELECT sample, seq, strand, s AS "start", e AS "end", CAST(sl AS BIGINT) AS sl, CAST(sr AS BIGINT) AS sr FROM sd')
def splice_left_right(s, d):
    return C.splice_sides(_sj(s, d)).select("sample", "seq", "strand", "start", "end", "sl", "sr")


OVER = """tu AS (SELECT sample, seq, strand, jg_up, sum("count") AS t FROM sd WHERE jg_up <> jg_down GROUP BY ALL), td AS (SELECT sample, seq, strand, jg_down, sum("count") AS t FROM sd WHERE jg_up <> jg_down GROUP BY ALL),
oi AS (SELECT a.sample, a.seq, a.strand, a.s, a.e, sum(b."count") AS t FROM sd a JOIN sd b ON a.sample = b.sample AND a.seq = b.seq AND a.strand = b.strand AND a.s <= b.e AND a.e >= b.s WHERE a.jg_up = a.jg_down GROUP BY ALL),
x AS (SELECT sd.*, CASE WHEN sd.jg_up <> sd.jg_down THEN coalesce(tu.t, 0) ELSE 0 END AS u, CASE WHEN sd.jg_up <> sd.jg_down THEN coalesce(td.t, 0) ELSE 0 END AS w, coalesce(oi.t, 0) AS i FROM sd
 LEFT JOIN tu ON sd.sample = tu.sample AND sd.seq = tu.seq AND sd.strand = tu.strand AND sd.jg_up = tu.jg_up LEFT JOIN td ON sd.sample = td.sample AND sd.seq = td.seq AND sd.strand = td.strand AND sd.jg_down = td.jg_down LEFT JOIN oi ON sd.sample = oi.sample AND sd.seq = oi.seq AND sd.strand = oi.strand AND sd.s = oi.s AND sd.e = oi.e),
so AS (SELECT *, greatest(CASE WHEN strand = '-' THEN w ELSE u END, i, sl) AS so_l, greatest(CASE WHEN strand = '-' THEN u ELSE w END, i, sr) AS so_r FROM x)"""


@query("splice_over", f'WITH {SJ}, {SIDES}, {OVER} SELECT sample, seq, strand, s AS "start", e AS "end", CAST(so_l AS BIGINT) AS so_l, CAST(so_r AS BIGINT) AS so_r FROM so')
def splice_over(s, d):
    return C.splice_over(_sj(s, d)).select("sample", "seq", "strand", "start", "end", "so_l", "so_r")


@query("junction_psi", f'WITH {SJ}, {SIDES}, {OVER} SELECT sample, seq, strand, s AS "start", e AS "end", round("count" / greatest(so_l, so_r), 6) AS psi FROM so')
def junction_psi(s, d):
    return C.splice_over(_sj(s, d)).select("sample", "seq", "strand", "start", "end", F.round(C.junction_psi(F.col("count"), F.col("so_l"), F.col("so_r")), 6).alias("psi"))


# ---- assays ----------------------------------------------------------------------------------------------


@query("assays", f"{W} SELECT event_id, sample, event_type, condition, included, excluded, depth, coverage, min_depth, up_inc, down_inc, up_exc, down_exc FROM asy")
def assays(s, d):
    return _as(s, d)


@query("intron_stats", f"""{W} SELECT event_id, sample, greatest(up_exc, down_exc) AS splice_over_max, round(CASE WHEN included >= 1 THEN included / (included + greatest(up_exc, down_exc)) WHEN included > 0 AND coverage + greatest(up_exc, down_exc) > 0 THEN coverage / (coverage + greatest(up_exc, down_exc)) ELSE 0 END, 6) AS ir_over_ratio, included + greatest(up_exc, down_exc) AS total_depth FROM asy""")
def intron_stats(s, d):
    got = C.intron_stats(F.col("included"), F.col("coverage"), F.col("up_exc"), F.col("down_exc"))
    return _as(s, d).select("event_id", "sample", got["splice_over_max"].alias("splice_over_max"), F.round(got["ir_over_ratio"], 6).alias("ir_over_ratio"), got["total_depth"].alias("total_depth"))


EV = """ev AS (SELECT p_partkey AS event_id, list_extract(['IR', 'MXE', 'SE', 'AFE', 'ALE', 'A5SS', 'A3SS', 'RI'], CAST(p_partkey % 8 + 1 AS INT)) AS event_type, CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '+' END AS strand,
  p_partkey % 300 AS l1, (p_partkey * 7) % 300 AS l2, (p_partkey * 13) % 300 AS l3, (p_partkey * 29) % 300 AS l4 FROM part),
ct AS (SELECT 'S' || CAST(l_suppkey % 6 AS VARCHAR) AS sample, l_partkey % 307 AS locus, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL),
it AS (SELECT 'S' || CAST(l_suppkey % 6 AS VARCHAR) AS sample, l_partkey % 311 AS locus, CASE WHEN l_partkey % 311 % 2 = 0 THEN '-' ELSE '+' END AS strand, sum(l_quantity) AS depth, count(*) AS lf, CAST(sum(l_linenumber) AS BIGINT) AS rg FROM lineitem WHERE l_linenumber < 3 GROUP BY 1, 2, 3),
sm AS (SELECT DISTINCT sample FROM ct),
ec AS (SELECT event_id, event_type, sm.sample, CASE WHEN event_type = 'RI' THEN coalesce(it.depth, 0) ELSE coalesce(a.n, 0) END AS n1a,
  CASE WHEN event_type = 'RI' THEN coalesce(CASE WHEN it.strand = '-' THEN rg ELSE lf END, 0) ELSE coalesce(b.n, 0) END AS n2a, coalesce(c.n, 0) AS n1b,
  CASE WHEN event_type = 'RI' THEN coalesce(CASE WHEN it.strand = '-' THEN lf ELSE rg END, 0) ELSE coalesce(d.n, 0) END AS n2b FROM ev CROSS JOIN sm
 LEFT JOIN ct a ON a.sample = sm.sample AND a.locus = l1 LEFT JOIN ct b ON b.sample = sm.sample AND b.locus = l2 LEFT JOIN ct c ON c.sample = sm.sample AND c.locus = l3 LEFT JOIN ct d ON d.sample = sm.sample AND d.locus = l4
 LEFT JOIN it ON it.sample = sm.sample AND it.locus = l1)"""


def _sample(c: str) -> F.Column:
    return F.concat(F.lit("S"), (F.col(c) % 6).cast("string"))


def _ev(s, d) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in V.EVENT_TYPES]), (k % 8 + 1).cast("int"))
    part = V.load(s, d, "part")
    # each event becomes a row per sample, so tasks take fewer of its bytes
    return part.repartition(R.tasks(part, each=R.TASK_BYTES // 4), "p_partkey").select(k.alias("event_id"), kind.alias("event_type"), F.when(k % 3 == 0, "-").otherwise("+").alias("strand"), *[(k * m % 300).alias(f"event{p}") for p, m in (("1a", 1), ("2a", 7), ("1b", 13), ("2b", 29))])


def _introns(s, d) -> DataFrame:
    li = V.load(s, d, "lineitem").where("l_linenumber < 3")
    locus = F.col("l_partkey") % 311
    return li.groupBy(_sample("l_suppkey").alias("sample"), locus.alias("locus"), F.when(locus % 2 == 0, "-").otherwise("+").alias("strand")).agg(F.sum("l_quantity").alias("depth"), F.count("*").alias("left"), F.sum("l_linenumber").alias("right"))


def _ec(s, d) -> DataFrame:
    ct = V.load(s, d, "lineitem").where("l_linenumber > 2").groupBy(_sample("l_suppkey").alias("sample"), (F.col("l_partkey") % 307).alias("locus")).agg(F.count("*").alias("count"))
    return C.event_counts(_ev(s, d), ct, _introns(s, d))


@query("event_counts", f"WITH {EV} SELECT * FROM ec")
def event_counts(s, d):
    return _ec(s, d)


PARTIC = """pa AS (SELECT event_id, event_type, sample, CASE WHEN event_type IN ('MXE', 'SE', 'ALE', 'A3SS', 'RI') THEN n1a + n1b ELSE 0 END AS up, CASE WHEN event_type = 'MXE' THEN n2a + n2b WHEN event_type = 'SE' THEN n2a + n1b WHEN event_type IN ('AFE', 'A5SS', 'RI') THEN n1a + n1b ELSE 0 END AS down FROM ec)"""


@query("event_participation", f"WITH {EV}, {PARTIC} SELECT event_id, sample, up, down FROM pa")
def event_participation(s, d):
    up, down = C.participation(*[F.col(c) for c in ("event_type", "n1a", "n2a", "n1b", "n2b")])
    return _ec(s, d).select("event_id", "sample", up.alias("up"), down.alias("down"))


_JG = "jg AS (SELECT event_id, event_type, strand, CASE WHEN event_type <> 'AFE' THEN CAST(event_id % 9 AS VARCHAR) END AS jg_up, CASE WHEN event_type <> 'ALE' THEN CAST((event_id * 5) % 9 AS VARCHAR) END AS jg_down FROM ev)"
TOTALS = f"""{_JG}, fu AS (SELECT sample, jg_up, arg_min(so_l, (seq, s, e, strand)) AS l, arg_min(so_r, (seq, s, e, strand)) AS r FROM so GROUP BY 1, 2), fd AS (SELECT sample, jg_down, arg_min(so_l, (seq, s, e, strand)) AS l, arg_min(so_r, (seq, s, e, strand)) AS r FROM so GROUP BY 1, 2),
tt AS (SELECT event_id, event_type, q.sample, CAST(coalesce(CASE WHEN jg.strand = '-' THEN fu.r ELSE fu.l END, 0) AS BIGINT) AS total_up, CAST(coalesce(CASE WHEN jg.strand = '-' THEN fd.l ELSE fd.r END, 0) AS BIGINT) AS total_down
 FROM jg CROSS JOIN (SELECT DISTINCT sample FROM so) q LEFT JOIN fu ON fu.sample = q.sample AND fu.jg_up = jg.jg_up LEFT JOIN fd ON fd.sample = q.sample AND fd.jg_down = jg.jg_down)"""


def _totals(s, d) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    ev = _ev(s, d).select("event_id", "strand", F.when(kind != "AFE", (k % 9).cast("string")).alias("jg_up"), F.when(kind != "ALE", (k * 5 % 9).cast("string")).alias("jg_down"))
    return C.island_totals(ev, R.settled(C.splice_over(R.settled(_sj(s, d)))))  # a row per junction and sample


@query("island_totals", f"WITH {SJ}, {SIDES}, {OVER}, {EV}, {TOTALS} SELECT event_id, sample, total_up, total_down FROM tt")
def island_totals(s, d):
    return _totals(s, d)


@query("event_coverage", f"""WITH {SJ}, {SIDES}, {OVER}, {EV}, {PARTIC}, {TOTALS}, cv AS (SELECT pa.event_id, pa.event_type, pa.sample, CASE WHEN total_up > 0 THEN up / total_up ELSE 0 END AS u, CASE WHEN total_down > 0 THEN down / total_down ELSE 0 END AS w, total_up, total_down FROM pa JOIN tt ON pa.event_id = tt.event_id AND pa.sample = tt.sample)
SELECT event_id, sample, round(CASE WHEN event_type IN ('MXE', 'SE', 'RI') THEN least(u, w) WHEN event_type IN ('ALE', 'A3SS') THEN u WHEN event_type IN ('AFE', 'A5SS') THEN w END, 6) AS coverage,
 CASE WHEN event_type IN ('MXE', 'SE') THEN CASE WHEN u < w THEN total_up ELSE total_down END WHEN event_type IN ('ALE', 'A3SS', 'RI') THEN total_up WHEN event_type IN ('AFE', 'A5SS') THEN total_down END AS min_depth FROM cv""")
def event_coverage(s, d):
    c = F.col
    up, down = C.participation(*[c(x) for x in ("event_type", "n1a", "n2a", "n1b", "n2b")])
    got = C.event_coverage(c("event_type"), up, down, c("total_up"), c("total_down"))
    return _ec(s, d).join(_totals(s, d), ["event_id", "sample"]).select("event_id", "sample", F.round(got["coverage"], 6).alias("coverage"), got["min_depth"].alias("min_depth"))


@query("event_assays", f"""WITH {EV} SELECT event_id, sample, CASE WHEN event_type IN ('MXE', 'SE') THEN (n1a + n2a) / 2.0 WHEN event_type IN ('IR', 'RI') THEN CAST(n2a AS DOUBLE) ELSE CAST(n1a AS DOUBLE) END AS included, CASE WHEN event_type = 'MXE' THEN (n1b + n2b) / 2.0 WHEN event_type = 'IR' THEN CAST(n2b AS DOUBLE) ELSE CAST(n1b AS DOUBLE) END AS excluded FROM ec""")
def event_assays(s, d):
    c = F.col
    return _ec(s, d).select("event_id", "sample", C.included(c("event_type"), c("n1a"), c("n2a"), c("n2a")).alias("included"), C.excluded(c("event_type"), c("n1b"), c("n2b"), c("n2b")).alias("excluded"))


@query("event_depth", f"""WITH {SJ}, {SIDES}, {OVER}, {EV}, {TOTALS}, tm AS (SELECT sample, locus, CASE WHEN locus % 4 = 1 THEN 0 ELSE depth END AS total FROM it),
pp AS (SELECT event_id, unnest([true, false, false, false, false]) AS whole, unnest([(event_id * 17) % 600, l1, l2, l3, l4]) AS locus FROM ev),
mt AS (SELECT event_id, sample, max(CASE WHEN whole THEN total END) AS r, max(CASE WHEN NOT whole THEN total END) AS p FROM pp JOIN tm USING (locus) GROUP BY 1, 2)
SELECT tt.event_id, tt.sample, coalesce(r, CASE WHEN coalesce(p, 0) > 0 THEN p ELSE greatest(total_up, total_down) END) AS event_depth FROM tt LEFT JOIN mt ON tt.event_id = mt.event_id AND tt.sample = mt.sample""")
def event_depth(s, d):
    ev = _ev(s, d).withColumn("region", F.col("event_id") * 17 % 600)
    introns = _introns(s, d).select("sample", "locus", F.when(F.col("locus") % 4 == 1, 0.0).otherwise(F.col("depth")).alias("total_depth"))
    return C.event_depths(ev, introns, _totals(s, d))


@query("nmd_direction", "SELECT p_partkey AS event_id, CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN 1 WHEN p_size % 3 = 0 AND p_size % 2 <> 0 THEN -1 ELSE 0 END AS nmd_direction FROM part")
def nmd_direction(s, d):
    p = V.load(s, d, "part")
    return p.select(F.col("p_partkey").alias("event_id"), C.nmd_direction(F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0).alias("nmd_direction"))


@query("sample_qc", f"""{W}, q AS (SELECT sample, sum(included) AS n, sum(excluded) AS x, count(*) AS c FROM asy GROUP BY 1)
SELECT sample, n AS depth, n > 0 AS paired, round(x / n, 6) AS mean_frag_size, round(c / n, 6) AS splice, round(x / (x + c), 6) AS unanno_jn FROM q""")
def sample_qc(s, d):
    g = _as(s, d).groupBy("sample").agg(F.sum("included").alias("pairs"), F.sum("excluded").alias("nucleotides"), F.sum("excluded").alias("unannotated"), F.count("*").cast("double").alias("annotated"))
    rows = g.select("sample", F.explode(F.create_map(*[x for c in ("pairs", "nucleotides", "unannotated", "annotated") for x in (F.lit(c), F.col(c))])).alias("name", "value"))
    r6 = lambda c: F.round(c, 6).alias(c)
    return C.sample_qc(rows).select("sample", "depth", "paired", r6("mean_frag_size"), r6("splice"), r6("unanno_jn"))


@query("isoform_summary", f"WITH {V.TX} SELECT gene AS event_id, CASE WHEN tx % 2 = 0 THEN 'A' ELSE 'B' END AS isoform, min(tsl) AS tsl, bool_or(biotype = 'F') AS coding, bool_and(biotype = 'O') AS nmd FROM tx GROUP BY 1, 2")
def isoform_summary(s, d):
    tx = V.exons(s, d)
    return C.isoform_summary(tx.select(F.col("gene").alias("event_id"), F.when(F.col("tx") % 2 == 0, "A").otherwise("B").alias("isoform"), "tsl", (F.col("biotype") == "F").alias("coding"), (F.col("biotype") == "O").alias("decay")))


# ---- model -----------------------------------------------------------------------------------------------


@query("subset_events", f"{W} SELECT event_id, sample, depth FROM asy WHERE event_type IN ('SE', 'RI') AND sample IN ('S0', 'S3')")
def subset_events(s, d):
    from .model import EventModel

    return EventModel(_as(s, d)).subset(types=["SE", "RI"], samples=["S0", "S3"]).assay.select("event_id", "sample", "depth")


@query("cbind_samples", f"{W} SELECT event_id, sample, depth FROM asy WHERE sample IN ('S0', 'S1', 'S4')")
def cbind_samples(s, d):
    from .model import EventModel

    m = EventModel(_as(s, d))
    return m.subset(samples=["S0", "S1"]).cbind(m.subset(samples=["S4"])).assay.select("event_id", "sample", "depth")


@query("rbind_events", f"{W} SELECT event_id, sample, depth FROM asy WHERE event_type IN ('SE', 'MXE')")
def rbind_events(s, d):
    from .model import EventModel

    m = EventModel(_as(s, d))
    return m.subset(types=["SE"]).rbind(m.subset(types=["MXE"])).assay.select("event_id", "sample", "depth")


# ---- filters ---------------------------------------------------------------------------------------------


def _sql_filter(test: str, pc: float, types: tuple[str, ...]) -> str:
    kinds = ", ".join(f"'{t}'" for t in types)
    return f"{W} SELECT event_id, NOT event_type IN ({kinds}) OR avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END) * 100 >= {pc} AS passed FROM asy GROUP BY event_id, event_type"


@query("filter_depth", _sql_filter("depth >= 100", 80, FL.TYPES))
def filter_depth(s, d):
    return FL.data_filter(_as(s, d), FL.EventFilter("Depth", 80, 100))


@query("filter_depth_by_condition", f"""{W}, c AS (SELECT event_id, condition, avg(CASE WHEN depth >= 100 THEN 1.0 ELSE 0.0 END) * 100 >= 60 AS ok FROM asy GROUP BY 1, 2) SELECT event_id, count(*) FILTER (ok) >= least(1, count(*)) AS passed FROM c GROUP BY 1""")
def filter_depth_by_condition(s, d):
    return FL.data_filter(_as(s, d), FL.EventFilter("Depth", 60, 100, by_condition=True, min_cond=1))


@query("filter_coverage", _sql_filter("min_depth < 20 OR coverage >= 0.6", 80, ("MXE", "SE", "RI")))
def filter_coverage(s, d):
    return FL.data_filter(_as(s, d), FL.EventFilter("Coverage", 80, 60, min_depth=20, types=("MXE", "SE", "RI")))


def _near(a: str, b: str, most: float) -> str:
    return f"greatest({a} + 1.0, {b} + 1.0) < {2.0**most} * least({a} + 1.0, {b} + 1.0)"


def _consistent(low: float, most: float) -> str:
    inc, exc = (" AND ".join(_near(f"{side}_{k}", whole, most) for side in ("up", "down")) for k, whole in (("inc", "included"), ("exc", "excluded")))
    return f"min_depth < {low} OR ((event_type NOT IN ('IR', 'MXE', 'SE', 'RI') OR ({inc})) AND (event_type <> 'MXE' OR ({exc})))"


_CONSISTENT = _consistent(10, 2)


@query("filter_consistency", _sql_filter(_CONSISTENT, 60, ("MXE", "SE", "RI")))
def filter_consistency(s, d):
    return FL.data_filter(_as(s, d), FL.EventFilter("Consistency", 60, maximum=2, min_depth=10, types=("MXE", "SE", "RI")))


ANN = """ann AS (SELECT p_partkey AS event_id, list_extract(['IR', 'MXE', 'SE', 'AFE', 'ALE', 'A5SS', 'A3SS', 'RI'], CAST(p_partkey % 8 + 1 AS INT)) AS event_type, p_size % 2 = 0 AS ic, p_size % 3 = 0 AS ec, p_size % 5 = 0 AS inm, p_size % 7 = 0 AS enm, p_size % 4 = 0 AS fst, p_size % 6 = 0 AS lst FROM part)"""


def _ann(s, d) -> DataFrame:
    z, k = F.col("p_size"), F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in V.EVENT_TYPES]), (k % 8 + 1).cast("int"))
    return V.load(s, d, "part").select(k.alias("event_id"), kind.alias("event_type"), (z % 2 == 0).alias("inc_coding"), (z % 3 == 0).alias("exc_coding"), (z % 5 == 0).alias("inc_nmd"), (z % 7 == 0).alias("exc_nmd"), (z % 4 == 0).alias("always_first"), (z % 6 == 0).alias("always_last"))


@query("filter_annotation", f"""WITH {ANN} SELECT event_id, CASE WHEN event_type = 'IR' THEN ic ELSE ic OR ec END AS coding, inm <> enm AS nmd, CASE event_type WHEN 'AFE' THEN fst WHEN 'ALE' THEN lst ELSE true END AS terminus FROM ann""")
def filter_annotation(s, d):
    ann = _ann(s, d)
    out = ann.select("event_id")
    for kind, name in (("Protein_Coding", "coding"), ("NMD", "nmd"), ("Terminus", "terminus")):
        out = out.join(FL.annotation_filter(ann, FL.EventFilter(kind)).withColumnRenamed("passed", name), "event_id")
    return out


_APART = "(p_size * 10 > p_size * 3 + 90 OR p_size * 3 + 50 > p_size * 10 + 40)"


def _casettes(s, d) -> DataFrame:
    z = F.col("p_size")
    return V.load(s, d, "part").select(F.col("p_partkey").alias("event_id"), (z * 10).alias("a_start"), (z * 10 + 40).alias("a_end"), (z * 3 + 50).alias("b_start"), (z * 3 + 90).alias("b_end"))


@query("filter_exclusive_mxe", f"SELECT p_partkey AS event_id, {_APART} AS passed FROM part")
def filter_exclusive_mxe(s, d):
    return FL.exclusive_mxe(_casettes(s, d))


_PASS = lambda test, pc, types: f"(event_type NOT IN ({', '.join(repr(t) for t in types)}) OR avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END) * 100 >= {pc})"
_CONS1 = _consistent(20, 1)


@query("filter_default_all", f"""{W}, {ANN}, k AS (SELECT event_id FROM asy GROUP BY event_id, event_type HAVING {_PASS('depth >= 20', 80, FL.TYPES)} AND {_PASS('min_depth < 5 OR coverage >= 0.9', 80, ('IR', 'RI'))} AND {_PASS('min_depth < 20 OR coverage >= 0.6', 80, ('MXE', 'SE', 'AFE', 'ALE', 'A3SS', 'A5SS'))} AND {_PASS(_CONS1, 80, ('MXE', 'SE', 'RI'))})
SELECT k.event_id FROM k JOIN ann USING (event_id) JOIN part ON p_partkey = k.event_id WHERE CASE event_type WHEN 'AFE' THEN fst WHEN 'ALE' THEN lst ELSE true END AND (event_type <> 'MXE' OR {_APART})""")
def filter_default_all(s, d):
    return FL.apply_filters(_as(s, d), FL.default_filters(), _ann(s, d), _casettes(s, d))


# ---- shaping ---------------------------------------------------------------------------------------------

SAMPLES = [f"S{k}" for k in range(6)]
_PSI = f"""{W}, p AS (SELECT *, CASE WHEN included + excluded >= 60 THEN included / (included + excluded) END AS p FROM asy), k AS (SELECT event_id FROM p GROUP BY 1 HAVING count(*) - count(p) < 0.4 * count(*)), q AS (SELECT p.* FROM p JOIN k USING (event_id))"""
_WIDE = lambda v: ", ".join(f"max(CASE WHEN sample = '{x}' THEN {v} END) AS {x}" for x in SAMPLES)
_LOGIT = "CASE WHEN p <= 0 THEN -5 WHEN p >= 1 THEN 5 ELSE greatest(-5, least(5, ln(p / (1 - p)))) END"


def _matrix(s, d, method: str) -> DataFrame:
    rows = S.psi_rows(_as(s, d), method, depth_threshold=60, na_max=0.4)
    return S.to_matrix(rows.withColumn("value", F.round("value", 6)), SAMPLES)


@query("psi_matrix", f"{_PSI} SELECT event_id, {_WIDE('round(p, 6)')} FROM q GROUP BY 1")
def psi_matrix(s, d):
    return _matrix(s, d, "PSI")


@query("logit_matrix", f"{_PSI} SELECT event_id, {_WIDE(f'CASE WHEN p IS NOT NULL THEN round({_LOGIT}, 6) END')} FROM q GROUP BY 1")
def logit_matrix(s, d):
    return _matrix(s, d, "logit")


@query("zscore_matrix", f"{_PSI}, z AS (SELECT *, coalesce((p - avg(p) OVER w) / nullif(stddev_samp(p) OVER w, 0), 0) AS z FROM q WINDOW w AS (PARTITION BY event_id)) SELECT event_id, {_WIDE('round(z, 6)')} FROM z GROUP BY 1")
def zscore_matrix(s, d):
    return _matrix(s, d, "Z-score")


@query("psi_diagonal", f"""{W}, p AS (SELECT *, CASE WHEN included + excluded >= 10 THEN included / (included + excluded) END AS p FROM asy), l AS (SELECT *, CASE WHEN p IS NOT NULL THEN {_LOGIT} END AS l FROM p)
SELECT event_id, round(1 / (1 + exp(-avg(CASE WHEN condition = 'A' THEN l END))), 6) AS nom, round(1 / (1 + exp(-avg(CASE WHEN condition = 'B' THEN l END))), 6) AS denom FROM l GROUP BY 1""")
def psi_diagonal(s, d):
    return S.diagonal(_as(s, d), "A", "B").select("event_id", F.round("nom", 6).alias("nom"), F.round("denom", 6).alias("denom"))


@query("bh_adjust", """WITH p AS (SELECT p_partkey AS event_id, (p_partkey * 7919 % 10007 + 1) / 10008.0 AS p FROM part), r AS (SELECT *, p * count(*) OVER () / rank_last AS q FROM (SELECT *, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS rank_last FROM p))
SELECT event_id, round(least(1.0, min(q) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS p_adj FROM r""")
def bh_adjust(s, d):
    p = V.load(s, d, "part").select(F.col("p_partkey").alias("event_id"), ((F.col("p_partkey") * 7919 % 10007 + 1) / F.lit(10008.0)).alias("p"))
    return S.bh_adjust(p).select("event_id", F.round("p_adj", 6).alias("p_adj"))


@query("two_sample_t", f"""{W}, g AS (SELECT event_id, count(*) FILTER (condition = 'A') AS n1, count(*) FILTER (condition = 'B') AS n2, avg(depth) FILTER (condition = 'A') AS m1, avg(depth) FILTER (condition = 'B') AS m2, var_samp(depth) FILTER (condition = 'A') AS v1, var_samp(depth) FILTER (condition = 'B') AS v2 FROM asy GROUP BY 1)
SELECT event_id, round((m1 - m2) / nullif(sqrt((((n1 - 1) * coalesce(v1, 0) + (n2 - 1) * coalesce(v2, 0)) / nullif(n1 + n2 - 2, 0)) * (1.0 / nullif(n1, 0) + 1.0 / nullif(n2, 0))), 0), 5) AS t, n1 + n2 - 2 AS df FROM g""")
def two_sample_t(s, d):
    return S.two_sample_t(_as(s, d), "depth", "A", "B").select("event_id", F.round("t", 5).alias("t"), "df")
