"""Reference tables, junction and read classes, tracks and result tables as queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotation as A
from ..operators import events as E
from ..operators import quantify as Q
from ..operators import relational as R
from ..operators import testing as T
from ..operators import tracks as TR
from . import annotation_queries as AQ
from . import quantify_queries as QQ
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


# ---- reference tables ------------------------------------------------------------------------------------

#: Measured introns under the transcript of the best support level, with the flags of both passes.
_NAMED = f"""{AQ.BASE}, {AQ.SITE}, one AS (SELECT * FROM (SELECT *, tx || '_Intron' || n AS intron_id, row_number() OVER (PARTITION BY locus ORDER BY tsl, tx) AS o FROM loc) WHERE o = 1),
mb AS ({AQ.SQL['measurable_blocks']}), aon AS ({AQ.SQL['anti_over_near']}),
kn AS (SELECT locus, EXISTS (SELECT 1 FROM tx WHERE tx.seq = site.seq AND tx.strand = site.strand AND tx.s <= site.s AND tx.e >= site.e) AS kd, EXISTS (SELECT 1 FROM tx WHERE tx.seq = site.seq AND tx.s <= site.s AND tx.e >= site.e) AS ku FROM site),
nm AS (SELECT one.*, num_blocks, inclbases, exclbases, kd, ku, anti_over, anti_near, '/' || gene || '/' || intron_id || '/' || strand || '/' || num_blocks || '/' || (s - 1) || '/' || e || '/' || inclbases || '/' || exclbases || '/' AS mid
 FROM one JOIN mb ON mb.locus = one.locus JOIN aon ON aon.locus = one.locus JOIN kn ON kn.locus = one.locus)"""


def _names(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    tx = V.exons(s, d)
    intron = R.settled(A.introns(tx))
    one = R.distinct_on(intron, ["locus"], ["tsl", "tx"]).join(A.measurable_blocks(intron, tx), "locus")
    own = A.intron_names(one.join(A.known_exon(intron, tx), "locus"), True)
    any_ = one.join(A.known_exon(intron, tx, stranded=False), "locus").join(A.anti_over_near(intron, A.genes(tx)), "locus")
    return tx, intron, own, A.intron_names(any_, False)


@query("intron_names", f"""{_NAMED} SELECT locus, 'dir' || mid || CASE WHEN kd THEN 'known-exon' ELSE 'clean' END AS dir_name,
 'nd' || mid || CASE WHEN ku OR anti_over OR anti_near THEN concat_ws('+', CASE WHEN ku THEN 'known-exon' END, CASE WHEN anti_over THEN 'anti-over' END, CASE WHEN anti_near THEN 'anti-near' END) ELSE 'clean' END AS nd_name FROM nm""")
def intron_names(s, d):
    _, _, own, any_ = _names(s, d)
    return own.select("locus", F.col("name").alias("dir_name")).join(any_.select("locus", F.col("name").alias("nd_name")), "locus")


_PARTS = """zn AS (SELECT seq, strand, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seq, strand ORDER BY s, e, pe NULLS FIRST ROWS UNBOUNDED PRECEDING) AS g FROM
 (SELECT seq, strand, s - 5 AS s, e + 5 AS e, max(e + 5) OVER (PARTITION BY seq, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM tx)) GROUP BY seq, strand, g),
st AS (SELECT locus, seq, strand, s + 5 AS s, e - 5 AS e FROM site WHERE s + 5 <= e - 5), ct AS (SELECT st.locus, zn.s, zn.e FROM st JOIN zn ON st.seq = zn.seq AND st.strand = zn.strand AND st.s <= zn.e AND st.e >= zn.s),
bd AS (SELECT locus, s AS a, 0 AS k FROM st UNION ALL SELECT locus, e + 1, 0 FROM ct), en AS (SELECT locus, e AS b FROM st UNION ALL SELECT locus, s - 1 FROM ct),
pr AS (SELECT x.locus, a, b FROM (SELECT locus, a, row_number() OVER (PARTITION BY locus ORDER BY a, k) AS r FROM (SELECT locus, a, CASE WHEN k = 0 THEN 0 END AS k FROM bd)) x JOIN (SELECT locus, b, row_number() OVER (PARTITION BY locus ORDER BY b) AS r FROM en) y ON x.locus = y.locus AND x.r = y.r WHERE a <= b)"""


@query("measured_parts", f"""{AQ.BASE}, {AQ.SITE}, {_PARTS} SELECT pr.locus, seq, strand, string_agg(a || '-' || b, ',' ORDER BY a) AS parts FROM pr JOIN site ON site.locus = pr.locus GROUP BY 1, 2, 3""")
def measured_parts(s, d):
    tx = V.exons(s, d)
    got = A.measured_parts(A.introns(tx), tx)
    return got.select("locus", "seq", "strand", F.array_join(F.transform("blocks", lambda b: F.concat_ws("-", b["start"], b["end"])), ",").alias("parts"))


@query("ref_cover", f"""{_NAMED}, {_PARTS}, ps AS (SELECT locus, min(a) AS a, max(b) AS b, count(*) AS n FROM pr GROUP BY 1)
SELECT seq, ps.a AS "start", ps.b AS "end", name, strand, n AS parts FROM (SELECT locus, seq, strand, 'dir' || mid || CASE WHEN kd THEN 'known-exon' ELSE 'clean' END AS name FROM nm UNION ALL
 SELECT locus, seq, strand, 'nd' || mid || CASE WHEN ku OR anti_over OR anti_near THEN concat_ws('+', CASE WHEN ku THEN 'known-exon' END, CASE WHEN anti_over THEN 'anti-over' END, CASE WHEN anti_near THEN 'anti-near' END) ELSE 'clean' END FROM nm) u JOIN ps ON ps.locus = u.locus""")
def ref_cover(s, d):
    tx, intron, own, any_ = _names(s, d)
    parts = R.settled(A.measured_parts(intron, tx)).select("locus", "blocks")
    got = A.cover_table(own.join(parts, "locus"), any_.join(parts, "locus"))
    return got.select("seq", "start", "end", "name", "strand", F.size("blocks").cast("long").alias("parts"))


def _roi_sql() -> str:
    return f"""SELECT 'rRNA/' || seq || '/' || (s - 1) || '/' || e || '/' || strand || '/' || tx || '/rRNA' || biotype || '/' || gene || '/G' || gene AS name, seq, s AS "start", e AS "end"
 FROM (SELECT tx, gene, seq, strand, biotype, min(s) AS s, max(e) AS e FROM tx GROUP BY ALL) WHERE biotype = 'P' UNION ALL SELECT 'NonPolyA', seq, min(s), max(e) FROM tx WHERE tsl = '5' GROUP BY seq, gene
 UNION ALL SELECT 'Intergenic/' || seq, seq, "start", "end" FROM ({AQ.SQL['roi_intergenic']})"""


@query("roi_table", f"WITH {V.TX} {_roi_sql()}")
def roi_table(s, d):
    """Transcripts of class P stand for ribosomal ones, exons of support level 5 for regions without polyadenylation."""
    tx = V.exons(s, d)
    span = tx.groupBy("tx", "gene", "seq", "strand", "biotype").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    kind = F.when(F.col("biotype") == "P", "rRNAP").otherwise(F.col("biotype"))
    low = tx.where("tsl = '5'").groupBy("seq", "gene").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return A.roi_table(span.withColumns({"biotype": kind, "gene_name": F.concat(F.lit("G"), F.col("gene").cast("string"))}), AQ.roi_intergenic(s, d), low)


@query("chromosome_table", f"WITH {V.TX}, l AS (SELECT seq, CAST(max(e) AS BIGINT) AS length FROM tx GROUP BY 1) SELECT seq, length, coalesce(alias, '') AS alias FROM l LEFT JOIN (SELECT 'chr' || n_nationkey AS name, n_name AS alias FROM nation WHERE n_nationkey > 1) a ON a.name = l.seq")
def chromosome_table(s, d):
    names = V.load(s, d, "nation").where("n_nationkey > 1").select(F.concat(F.lit("chr"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("alias"))
    return A.chromosome_table(V.exons(s, d).groupBy("seq").agg(F.max("end").cast("long").alias("length")), names)


#: Row types by support level, so that the view stands for rows of an annotation.
_TYPES = {"1": "exon", "2": "CDS", "3": "start_codon", "4": "gene", "5": "transcript"}


@query("view_reference", f"""WITH {V.TX}, g AS (SELECT *, CASE tsl {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items())} END AS type FROM tx)
SELECT seq, s AS "start", e AS "end", strand, type, tx FROM g WHERE type NOT IN ('gene', 'transcript')""")
def view_reference(s, d):
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv]), F.col("tsl"))
    return A.view_reference(V.exons(s, d).withColumn("type", kind))


@query("transcript_attributes", f"""{AQ.BASE}, t AS (SELECT o_orderkey AS tx, split_part(o_orderpriority, ' ', 1) AS l FROM orders WHERE o_orderkey % 3 > 0),
p AS (SELECT l_orderkey AS tx, max('P' || l_suppkey) AS protein_id FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1)
SELECT loc.tx, locus, coalesce(l, 'NA') AS transcript_support_level, protein_id, loc.seq || 'C' AS ccds_id FROM loc LEFT JOIN t ON t.tx = loc.tx LEFT JOIN p ON p.tx = loc.tx""")
def transcript_attributes(s, d):
    """Two thirds of the transcripts have a level of two words, those with an even line a protein."""
    tx, li = V.exons(s, d), V.load(s, d, "lineitem")
    level = V.load(s, d, "orders").select(F.col("o_orderkey").alias("tx"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("transcript_support_level"))
    protein = li.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("tx"), F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("protein_id"))
    got = A.with_transcript_attributes(A.introns(tx), level, protein, tx.select("tx", F.concat("seq", F.lit("C")).alias("ccds_id")))
    return got.select("tx", "locus", "transcript_support_level", "protein_id", "ccds_id")


# ---- junctions and reads ---------------------------------------------------------------------------------

_REF2 = f"""rj AS (SELECT seq, s, e, bit_or(CASE WHEN strand = '-' THEN 1 ELSE 2 END + CASE WHEN nmd THEN 4 ELSE 0 END) AS flag FROM (SELECT seq, s, e, strand, bool_and(biotype = 'O') AS nmd FROM loc GROUP BY ALL) GROUP BY 1, 2, 3),
jr AS (SELECT coalesce(jn.seq, rj.seq) AS seq, coalesce(jn.s, rj.s) AS s, coalesce(jn.e, rj.e) AS e, coalesce(flag, 0) AS flag, coalesce(total, 0) AS total, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM jn FULL JOIN rj ON jn.seq = rj.seq AND jn.s = rj.s AND jn.e = rj.e)"""
_JR = f"WITH {V.TX}, {V.INTRON}, {V.FR}, {QQ.JUNC}, {_REF2}"


def _report(s: SparkSession, d: str) -> DataFrame:
    return Q.junction_report(Q.junction_counts(QQ._frags(s, d)), A.reference_junctions(A.introns(V.exons(s, d)), "O"))


@query("junction_report", f"""{_JR} SELECT seq, s AS "start", e AS "end", CASE WHEN flag & 1 <> 0 THEN '-' WHEN flag & 2 <> 0 THEN '+' ELSE '.' END AS strand, total, pos, neg, flag <> 0 AS annotated, flag & 4 <> 0 AS nmd FROM jr""")
def junction_report(s, d):
    return _report(s, d)


@query("junction_qc", f"{_JR} SELECT CAST(coalesce(sum(total) FILTER (flag <> 0), 0) AS BIGINT) AS annotated, CAST(coalesce(sum(total) FILTER (flag = 0), 0) AS BIGINT) AS unannotated, CAST(coalesce(sum(total) FILTER (flag & 4 <> 0), 0) AS BIGINT) AS nmd FROM jr")
def junction_qc(s, d):
    return Q.junction_qc(_report(s, d))


_NAME = "CASE seq WHEN 'chr1' THEN 'MT' WHEN 'chr2' THEN 'ERCC-1' ELSE seq END"


@query("read_classes", f"""WITH {V.TX}, {V.FR}, ri AS ({_roi_sql()}), h AS (SELECT ri.name, ri.seq, ri."start", ri."end", count(fr.seq) AS n FROM ri LEFT JOIN fr ON fr.seq = ri.seq AND least(s1, s2) >= ri."start" AND greatest(e1, e2) <= ri."end" GROUP BY ALL)
SELECT CAST(coalesce(sum(n) FILTER (name LIKE 'Intergenic%'), 0) AS BIGINT) AS intergenic, CAST(coalesce(sum(n) FILTER (name LIKE 'rRNA%'), 0) AS BIGINT) AS rrna, CAST(coalesce(sum(n) FILTER (name LIKE 'NonPolyA%'), 0) AS BIGINT) AS non_polya,
 (SELECT count(*) FROM fr WHERE seq = 'chr1') AS mitochondrial, (SELECT count(*) FROM fr WHERE seq = 'chr2') AS ercc FROM h""")
def read_classes(s, d):
    fr = QQ._frags(s, d)
    roi = R.settled(roi_table(s, d).distinct())  # a row per region
    counted = Q.roi_counts(fr, roi.withColumn("name", F.concat_ws("@", "name", "seq", "start", "end")))
    named = F.when(F.col("seq") == "chr1", "MT").when(F.col("seq") == "chr2", "ERCC-1").otherwise(F.col("seq"))
    return Q.read_classes(counted, Q.chrom_counts(fr.withColumn("seq", named)))


# ---- tests and tracks ------------------------------------------------------------------------------------


@query("testable_events", f"""{_NAMED} SELECT locus FROM nm WHERE NOT ku AND NOT anti_over""")
def testable_events(s, d):
    """The measured introns that the default pre-filter leaves."""
    return T.testable(_names(s, d)[3].withColumn("event_name", F.col("name"))).select("locus")


@query("result_table", f"""WITH {V.AS}, p AS (SELECT *, CASE WHEN included + excluded >= 10 THEN included / (included + excluded) END AS psi FROM asy),
l AS (SELECT *, CASE WHEN psi IS NULL THEN NULL WHEN psi <= 0 THEN -5 WHEN psi >= 1 THEN 5 ELSE greatest(-5, least(5, ln(psi / (1 - psi)))) END AS lg FROM p)
SELECT r.event_id, 'E' || r.event_id AS event_name, r.event_type, 'chr' || (r.event_id % 7) AS region, CAST(r.event_id % 3 - 1 AS INT) AS nmd_direction, round(1 / (1 + exp(-avg(lg) FILTER (condition = 'A'))), 6) AS avg_psi_A, round(1 / (1 + exp(-avg(lg) FILTER (condition = 'B'))), 6) AS avg_psi_B, r.score
FROM (SELECT event_id, event_type, sum(depth) AS score FROM asy GROUP BY 1, 2) r JOIN l ON l.event_id = r.event_id GROUP BY ALL""")
def result_table(s, d):
    assay = V.assays(s, d)
    e = F.col("event_id")
    about = assay.select("event_id", "event_type").distinct().select("event_id", "event_type", F.concat(F.lit("E"), e.cast("string")).alias("event_name"), F.concat(F.lit("chr"), (e % 7).cast("string")).alias("region"), (e % 3 - 1).cast("int").alias("nmd_direction"))
    got = T.with_results(assay.groupBy("event_id").agg(F.sum("depth").alias("score")), about, assay, "A", "B")
    return got.withColumns({c: F.round(c, 6) for c in ("avg_psi_A", "avg_psi_B")})


#: The region of the tracks, and the width and number of its bins.
_VIEW = ("chr1", 2001, 80_000)
_WIDTH = TR.bin_width(*_VIEW[1:])
_BINS = -(-(_VIEW[2] - _VIEW[1] + 2) // _WIDTH) - 1


@query("sample_tracks", f"""WITH {V.FR}, b AS (SELECT 'S' || (e2 % 6) AS sample, seq, s1 AS s, e1 AS e FROM fr UNION ALL SELECT 'S' || (e2 % 6), seq, s2, e2 FROM fr),
p AS (SELECT sample, unnest(range(greatest(s, {_VIEW[1]}), least(e, {_VIEW[2]}) + 1)) AS x FROM b WHERE seq = '{_VIEW[0]}' AND s <= {_VIEW[2]} AND e >= {_VIEW[1]}),
g AS (SELECT i - {_VIEW[1]} + 1 AS i, (i - {_VIEW[1]}) * {_BINS} // {_VIEW[2] - _VIEW[1] + 1} + 1 AS bin FROM (SELECT unnest(range({_VIEW[1]}, {_VIEW[2] + 1})) AS i)),
w AS (SELECT bin, count(*) AS n, avg(i) + {_VIEW[1]} - 1 AS position FROM g GROUP BY 1), d AS (SELECT sample, (x - {_VIEW[1]}) * {_BINS} // {_VIEW[2] - _VIEW[1] + 1} + 1 AS bin, count(*) AS c FROM p GROUP BY 1, 2)
SELECT k.sample, w.bin, w.position, round(coalesce(c, 0) / n, 6) AS depth FROM (SELECT DISTINCT sample FROM p) k CROSS JOIN w LEFT JOIN d ON d.sample = k.sample AND d.bin = w.bin""")
def sample_tracks(s, d):
    from ..operators import intervals as I

    fr = QQ._frags(s, d).withColumn("sample", F.concat(F.lit("S"), (F.get("blocks", 1)["end"] % 6).cast("string")))
    runs = I.coverage_runs(fr.select(F.concat_ws("|", "sample", "seq").alias("seq"), F.lit("*").alias("strand"), F.explode("blocks").alias("b")).select("seq", "strand", "b.*"))
    runs = runs.select(F.substring_index("seq", "|", 1).alias("sample"), F.substring_index("seq", "|", -1).alias("seq"), "start", "end", "depth")
    return TR.sample_tracks(runs, *_VIEW).withColumn("depth", F.round("depth", 6))


@query("event_highlight", f"""{AQ.BASE}, se AS (SELECT *, event1a || ' ' || event2a || ' ' || event1b AS event_id FROM ({AQ.SQL['event_se']})),
pt AS (SELECT event_id, 1 AS isoform, event1a AS locus FROM se UNION SELECT event_id, 1, event2a FROM se UNION SELECT event_id, 2, event1b FROM se),
mt AS (SELECT DISTINCT event_id, isoform, tx, loc.locus, s, e FROM pt JOIN loc ON loc.locus = pt.locus), wh AS (SELECT event_id, isoform, tx FROM mt GROUP BY ALL HAVING count(DISTINCT locus) = 3 - isoform)
SELECT DISTINCT event_id, isoform, tx, 'intron' AS type, s AS "start", e AS "end" FROM mt UNION ALL
SELECT DISTINCT wh.event_id, wh.isoform, wh.tx, 'exon', tx.s, tx.e FROM wh JOIN mt ON mt.event_id = wh.event_id AND mt.isoform = wh.isoform AND mt.tx = wh.tx JOIN tx ON tx.tx = wh.tx AND (tx.s IN (mt.s - 1, mt.e + 1) OR tx.e IN (mt.s - 1, mt.e + 1))""")
def event_highlight(s, d):
    tx = V.exons(s, d)
    intron = A.introns(tx)
    se = E.skipped_exons(intron).select(F.concat_ws(" ", "event1a", "event2a", "event1b").alias("event_id"), F.lit("SE").alias("event_type"), "event1a", "event2a", "event1b", F.lit(None).cast("string").alias("event2b"))
    return TR.event_highlight(se, intron, tx)
