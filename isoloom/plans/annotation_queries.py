"""Annotation and splice-event operators as queries over the exon view, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotation as A
from ..operators import events as E
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


GENES = 'genes AS (SELECT gene, seq, strand, min(s) AS s, max(e) AS e FROM tx GROUP BY ALL)'


def _merged(source: str, keys: str, name: str, gap: int = 1) -> str:
    """A table of merged intervals (keys, s, e) of a table with s and e."""
    return f"""{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e, pe NULLS FIRST ROWS UNBOUNDED PRECEDING) AS g FROM
 (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {source})) GROUP BY {keys}, g)"""


GROUPS = f"""{_merged('genes', 'seq, strand', 'gsp')}, gno AS (SELECT *, row_number() OVER (ORDER BY seq, s, strand) AS gene_group FROM gsp),
gg AS (SELECT gene, genes.seq, genes.strand, gene_group FROM genes JOIN gno ON genes.seq = gno.seq AND genes.strand = gno.strand AND genes.s >= gno.s AND genes.e <= gno.e)"""
ISLANDS = f"""exg AS (SELECT tx.seq, tx.strand, gene_group, tx.s, tx.e, biotype FROM tx JOIN gg ON tx.gene = gg.gene),
spn AS (SELECT gene_group, seq, strand, min(s) AS s, max(e) AS e FROM exg WHERE biotype <> 'P' GROUP BY ALL),
exk AS (SELECT * FROM exg WHERE biotype <> 'P' UNION ALL SELECT * FROM exg WHERE biotype = 'P' AND NOT EXISTS (SELECT 1 FROM spn WHERE spn.seq = exg.seq AND spn.strand = exg.strand AND spn.s <= exg.e AND spn.e >= exg.s)),
{_merged('exk', 'seq, strand, gene_group', 'isl0')},
isl AS (SELECT *, CASE WHEN strand = '-' THEN count(*) OVER (PARTITION BY gene_group) + 1 - row_number() OVER (PARTITION BY gene_group ORDER BY s) ELSE row_number() OVER (PARTITION BY gene_group ORDER BY s) END AS exon_group FROM isl0)"""
SITE = "site AS (SELECT DISTINCT locus, seq, strand, s, e FROM loc)"
FLANK = """lft AS (SELECT site.locus, arg_max(gene_group || '_' || exon_group, (gene_group, isl.s)) AS k FROM site JOIN isl ON site.seq = isl.seq AND site.strand = isl.strand AND site.s - 1 <= isl.e AND site.s >= isl.s GROUP BY 1),
rgt AS (SELECT site.locus, arg_max(gene_group || '_' || exon_group, (gene_group, isl.s)) AS k FROM site JOIN isl ON site.seq = isl.seq AND site.strand = isl.strand AND site.e <= isl.e AND site.e + 1 >= isl.s GROUP BY 1),
fl AS (SELECT site.locus, CASE WHEN strand = '-' THEN rgt.k ELSE lft.k END AS up, CASE WHEN strand = '-' THEN lft.k ELSE rgt.k END AS down FROM site LEFT JOIN lft ON site.locus = lft.locus LEFT JOIN rgt ON site.locus = rgt.locus)"""
BASE = f"WITH {V.TX}, {V.INTRON}"
FULL = f"{BASE}, {GENES}, {GROUPS}, {ISLANDS}, {SITE}, {FLANK}"


#: The class of the view's exons that stands for retained-intron transcripts.
RETAINED = "P"


def _tx(s: SparkSession, d: str) -> DataFrame:
    return V.exons(s, d)


@query("gene_groups", f"WITH {V.TX}, {GENES}, {GROUPS} SELECT gene, seq, strand, CAST(gene_group AS BIGINT) AS gene_group FROM gg")
def gene_groups(s, d):
    return A.gene_groups(_tx(s, d))


@query("exon_islands", f'WITH {V.TX}, {GENES}, {GROUPS}, {ISLANDS} SELECT seq, strand, CAST(gene_group AS BIGINT) AS gene_group, s AS "start", e AS "end", exon_group FROM isl')
def exon_islands(s, d):
    return A.exon_islands(_tx(s, d), RETAINED)


@query("candidate_introns", f'{BASE} SELECT DISTINCT seq, s AS "start", e AS "end", strand, locus FROM loc')
def candidate_introns(s, d):
    return A.introns(_tx(s, d)).select("seq", "start", "end", "strand", "locus").distinct()


@query("intron_numbers", f"{BASE} SELECT tx, locus, n, tx || '_Intron' || n AS intron_id FROM loc")
def intron_numbers(s, d):
    return A.introns(_tx(s, d)).select("tx", "locus", "n", "intron_id")


@query("best_introns", f"{BASE} SELECT locus, tx FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY CASE biotype WHEN 'F' THEN 1 ELSE 2 END, tsl, tx) AS r FROM loc WHERE biotype IN ('F', 'O')) WHERE r = 1")
def best_introns(s, d):
    return A.best_introns(A.introns(_tx(s, d)), ["F", "O"]).select("locus", "tx")


def _flanks(s, d) -> tuple[DataFrame, DataFrame]:
    tx = _tx(s, d)
    intron = A.introns(tx)
    return intron, A.flanking_islands(intron, A.exon_islands(tx, RETAINED))


@query("flanking_islands", f"{FULL} SELECT locus, up, down FROM fl")
def flanking_islands(s, d):
    return _flanks(s, d)[1]


_GAPS = """gap0 AS (SELECT gene_group, seq, strand, e + 1 AS s, lead(s) OVER (PARTITION BY gene_group ORDER BY s) - 1 AS e FROM isl),
gap AS (SELECT *, CASE WHEN strand = '-' THEN count(*) OVER (PARTITION BY gene_group) + 1 - row_number() OVER (PARTITION BY gene_group ORDER BY s) ELSE row_number() OVER (PARTITION BY gene_group ORDER BY s) END AS num FROM gap0 WHERE e >= s)"""


@query("island_gaps", f'{FULL}, {_GAPS} SELECT seq, strand, gene_group, s AS "start", e AS "end", CAST(num AS INT) AS intron_number FROM gap')
def island_gaps(s, d):
    return A.island_gaps(A.exon_islands(_tx(s, d), RETAINED))


@query("island_rescue", f"""{FULL}, {_GAPS}, pb AS (SELECT locus, strand, seq, s - 1 AS s, s AS e, strand = '+' AS ups FROM site UNION ALL SELECT locus, strand, seq, e, e + 1, strand = '-' FROM site),
rs AS (SELECT locus, ups, arg_max(gene_group || '_' || (num + CASE WHEN ups THEN 0 ELSE 1 END), (gene_group, gap.s)) AS k FROM pb JOIN gap ON pb.seq = gap.seq AND pb.strand = gap.strand AND pb.s <= gap.e AND pb.e >= gap.s GROUP BY 1, 2)
SELECT fl.locus, coalesce(up, a.k) AS up, coalesce(down, b.k) AS down FROM fl LEFT JOIN rs a ON a.locus = fl.locus AND a.ups LEFT JOIN rs b ON b.locus = fl.locus AND NOT b.ups""")
def island_rescue(s, d):
    tx = _tx(s, d)
    intron, islands = A.introns(tx), A.exon_islands(tx, RETAINED)
    return A.rescue_islands(A.flanking_islands(intron, islands), intron, islands)


def _omni(s, d) -> DataFrame:
    """Regions of any strand that cannot be measured: two blocks in each gene's stretch."""
    li = V.load(s, d, "lineitem")
    gene = F.col("l_suppkey") % 40
    at = 2000 * gene + 37 * (F.col("l_partkey") % 50)
    return li.select(F.concat(F.lit("chr"), (gene % 4).cast("string")).alias("seq"), at.alias("start"), (at + 3).alias("end"))


_OMNI = f"""omni0 AS (SELECT 'chr' || CAST(l_suppkey % 40 % 4 AS VARCHAR) AS seq, 2000 * (l_suppkey % 40) + 37 * (l_partkey % 50) AS s, 2000 * (l_suppkey % 40) + 37 * (l_partkey % 50) + 3 AS e FROM lineitem), {_merged('omni0', 'seq', 'omni', 9)}"""


@query("unusable_regions", f'WITH {_OMNI} SELECT seq, s AS "start", e AS "end" FROM omni')
def unusable_regions(s, d):
    return A.unusable_regions(_omni(s, d))


@query("introns_outside_regions", f"""{BASE}, {SITE}, om2 AS (SELECT seq, s - 40 AS s, e + 40 AS e FROM omni0), {_OMNI}, {_merged('om2', 'seq', 'wide', 9)}
SELECT DISTINCT locus FROM site WHERE NOT EXISTS (SELECT 1 FROM wide WHERE wide.seq = site.seq AND wide.s <= site.s AND wide.e >= site.e)""".replace(f"om2 AS (SELECT seq, s - 40 AS s, e + 40 AS e FROM omni0), {_OMNI},", f"{_OMNI}, om2 AS (SELECT seq, s - 10 AS s, e + 10 AS e FROM omni0 WHERE s > 20000),"))
def introns_outside_regions(s, d):
    wide = _omni(s, d).where("start > 20000").select("seq", (F.col("start") - 10).alias("start"), (F.col("end") + 10).alias("end"))
    return A.outside_regions(A.introns(_tx(s, d)), A.unusable_regions(wide)).select("locus").distinct()


@query("excluded_zones", f"""{BASE}, {_OMNI}, zn0 AS (SELECT seq, strand, s - 5 AS s, e + 5 AS e FROM tx UNION ALL SELECT seq, unnest(['+', '-']), s, e FROM omni), {_merged('zn0', 'seq, strand', 'zn')} SELECT seq, strand, s AS "start", e AS "end" FROM zn""")
def excluded_zones(s, d):
    return A.excluded_zones(_tx(s, d), regions=A.unusable_regions(_omni(s, d)))


@query("known_exon_flags", f"{BASE}, {SITE} SELECT locus, EXISTS (SELECT 1 FROM tx WHERE tx.seq = site.seq AND tx.strand = site.strand AND tx.s <= site.s AND tx.e >= site.e) AS known FROM site")
def known_exon_flags(s, d):
    tx = _tx(s, d)
    return A.known_exon(A.introns(tx), tx)


_OVER = "EXISTS (SELECT 1 FROM genes g WHERE g.seq = site.seq AND g.strand <> site.strand AND {} <= site.e AND {} >= site.s)"


@query("anti_over_near", f"""{BASE}, {GENES}, {SITE} SELECT locus, {_OVER.format('g.s', 'g.e')} AS anti_over,
 (EXISTS (SELECT 1 FROM genes g WHERE g.seq = site.seq AND g.strand <> site.strand AND ((site.strand = '-' AND g.e + 1 <= site.e AND g.e + 5000 >= site.s) OR (site.strand = '+' AND g.s - 5000 <= site.e AND g.s - 1 >= site.s)))
 OR EXISTS (SELECT 1 FROM genes g WHERE g.seq = site.seq AND g.strand <> site.strand AND ((site.strand = '-' AND g.s - 1000 <= site.e AND g.s - 1 >= site.s) OR (site.strand = '+' AND g.e + 1 <= site.e AND g.e + 1000 >= site.s)))) AS anti_near FROM site""")
def anti_over_near(s, d):
    tx = _tx(s, d)
    return A.anti_over_near(A.introns(tx), A.genes(tx))


@query("measurable_blocks", f"""{BASE}, st AS (SELECT DISTINCT locus, seq, strand, s + 5 AS s, e - 5 AS e FROM loc WHERE e - s + 1 > 50),
zn AS (SELECT seq, strand, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seq, strand ORDER BY s, e, pe NULLS FIRST ROWS UNBOUNDED PRECEDING) AS g FROM
 (SELECT seq, strand, s - 5 AS s, e + 5 AS e, max(e + 5) OVER (PARTITION BY seq, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM tx)) GROUP BY seq, strand, g),
c AS (SELECT st.locus, min(st.s) AS s, min(st.e) AS e, coalesce(sum(CASE WHEN zn.s IS NOT NULL THEN least(st.e, zn.e) - greatest(st.s, zn.s) + 1 END), 0) AS x, count(zn.s) AS k, min(CASE WHEN zn.s IS NOT NULL THEN greatest(st.s, zn.s) END) AS f, max(CASE WHEN zn.s IS NOT NULL THEN least(st.e, zn.e) END) AS l
 FROM st LEFT JOIN zn ON st.seq = zn.seq AND st.strand = zn.strand AND st.s <= zn.e AND st.e >= zn.s GROUP BY 1)
SELECT locus, k + 1 - coalesce(CAST(f = s AS INT), 0) - coalesce(CAST(l = e AS INT), 0) AS num_blocks, CAST(e - s + 1 - x AS BIGINT) AS inclbases, CAST(x AS BIGINT) AS exclbases FROM c WHERE x / (e - s + 1) < 0.3""")
def measurable_blocks(s, d):
    tx = _tx(s, d)
    return A.measurable_blocks(A.introns(tx), tx)


@query("span_points", f"{BASE} SELECT DISTINCT seq, strand, s - 1 AS pos FROM loc UNION SELECT DISTINCT seq, strand, e FROM loc")
def span_points(s, d):
    return A.span_points(A.introns(_tx(s, d)))


@query("ref_junctions", f"""{BASE} SELECT seq, s AS "start", e AS "end", strand, bool_and(biotype = 'O') AS nmd_only FROM loc GROUP BY 1, 2, 3, 4""")
def ref_junctions(s, d):
    return A.reference_junctions(A.introns(_tx(s, d)), "O")


@query("roi_intergenic", f"""WITH {V.TX}, {GENES}, z AS (SELECT seq, s - 200 AS s, e + 200 AS e, max(e + 200) OVER (PARTITION BY seq ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM genes),
m AS (SELECT seq, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY s, e, pe NULLS FIRST ROWS UNBOUNDED PRECEDING) AS g FROM z) GROUP BY seq, g),
b AS (SELECT seq, e + 1 AS s, lead(s) OVER (PARTITION BY seq ORDER BY s) - 1 AS e FROM m), h AS (SELECT seq, 1 AS s, min(s) - 1 AS e FROM m GROUP BY seq)
SELECT seq, greatest(s, 1) AS "start", least(coalesce(e, 100000), 100000) AS "end" FROM (SELECT * FROM b UNION ALL SELECT * FROM h) WHERE greatest(s, 1) <= least(coalesce(e, 100000), 100000)""")
def roi_intergenic(s, d):
    g = A.genes(_tx(s, d))
    lengths = g.select("seq").distinct().withColumn("length", F.lit(100_000).cast("long"))
    return A.intergenic(g, lengths, 200, 10)


# ---- events ----------------------------------------------------------------------------------------------

SKIP = """sk AS (SELECT *, CASE WHEN nl IS NOT NULL THEN seq || ':' || least(s, ns) || '-' || greatest(e, ne) || '/' || strand END AS skip FROM
 (SELECT *, lead(locus) OVER w AS nl, lead(s) OVER w AS ns, lead(e) OVER w AS ne FROM loc WINDOW w AS (PARTITION BY tx ORDER BY n)))"""


@query("skip_coords", f"{BASE}, {SKIP} SELECT tx, locus, skip FROM sk")
def skip_coords(s, d):
    return E.skip_coords(A.introns(_tx(s, d))).select("tx", "locus", "skip")


@query("event_se", f"{BASE}, {SKIP} SELECT DISTINCT locus AS event1a, nl AS event2a, skip AS event1b FROM sk WHERE skip IN (SELECT locus FROM loc)")
def event_se(s, d):
    return E.skipped_exons(A.introns(_tx(s, d)))


@query("event_mxe", f"""{BASE}, {SKIP}, u AS (SELECT DISTINCT skip, locus, nl, CASE WHEN strand = '-' THEN e ELSE s END AS o1, CASE WHEN strand = '-' THEN -s ELSE e END AS o2 FROM sk WHERE skip IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY skip ORDER BY o1, o2, locus, nl) AS i FROM u)
SELECT a.skip, a.locus AS event1a, a.nl AS event2a, b.locus AS event1b, b.nl AS event2b FROM r a JOIN r b ON a.skip = b.skip AND a.i < b.i AND a.locus <> b.locus AND a.nl <> b.nl""")
def event_mxe(s, d):
    return E.mutually_exclusive(A.introns(_tx(s, d)))


def _pair_sql(source: str, acceptor: bool) -> str:
    at = ("e", "s") if acceptor else ("s", "e")
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY seq, strand, fx ORDER BY e - s, locus) AS i FROM (SELECT *, CASE WHEN strand = '+' THEN {at[0]} ELSE {at[1]} END AS fx FROM {source})),
p AS (SELECT a.locus AS event1a, b.locus AS event1b, a.up AS au, b.up AS bu, a.down AS ad, b.down AS bd FROM r a JOIN r b ON a.seq = b.seq AND a.strand = b.strand AND a.fx = b.fx AND a.i < b.i)"""


def _ss(acceptor: bool) -> str:
    return f"{FULL}, q AS (SELECT site.*, up, down FROM site JOIN fl ON site.locus = fl.locus WHERE up IS NOT NULL AND down IS NOT NULL), {_pair_sql('q', acceptor)} SELECT event1a, event1b FROM p WHERE au = bu AND ad = bd"


def _end(first: bool) -> str:
    test = "n = 1" if first else "n = n_all"
    return f"""WITH ss AS ({_ss(first)}), ends AS ({BASE}, q AS (SELECT DISTINCT seq, strand, s, e, locus, 0 AS up, 0 AS down FROM loc WHERE {test}), {_pair_sql('q', first)} SELECT event1a, event1b FROM p)
SELECT * FROM ends EXCEPT SELECT * FROM ss"""


@query("event_a5ss", _ss(True))
def event_a5ss(s, d):
    return E.alternative_sites(*_flanks(s, d), acceptor=True)


@query("event_a3ss", _ss(False))
def event_a3ss(s, d):
    return E.alternative_sites(*_flanks(s, d), acceptor=False)


@query("event_afe", _end(True))
def event_afe(s, d):
    intron, fl = _flanks(s, d)
    return E.alternative_ends(intron, E.alternative_sites(intron, fl, True), first=True)


@query("event_ale", _end(False))
def event_ale(s, d):
    intron, fl = _flanks(s, d)
    return E.alternative_ends(intron, E.alternative_sites(intron, fl, False), first=False)


@query("event_ri", f"{BASE}, {SITE} SELECT DISTINCT site.locus, tx.s AS exon_start, tx.e AS exon_end FROM site JOIN tx ON tx.seq = site.seq AND tx.strand = site.strand AND tx.s <= site.s AND tx.e >= site.e")
def event_ri(s, d):
    tx = _tx(s, d)
    return E.retained(A.introns(tx), tx)


_RANK = "rk AS (SELECT locus, tx, n FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY tsl, CASE WHEN biotype = 'F' THEN 0 ELSE 1 END, tx) AS r FROM loc) WHERE r = 1)"


@query("event_rank_transcript", f"{BASE}, {_RANK} SELECT locus, tx, n FROM rk")
def event_rank_transcript(s, d):
    return E.ranked_transcript(A.introns(_tx(s, d)), ["F"])


@query("event_names", f"""{BASE}, {SKIP}, {_RANK}, se AS (SELECT DISTINCT locus AS event1a, nl AS event2a, skip AS event1b FROM sk WHERE skip IN (SELECT locus FROM loc))
SELECT event1a, event2a, event1b, 'SE:' || a.tx || '-exon' || (a.n + 1) || ';' || b.tx || '-int' || b.n AS event_name FROM se JOIN rk a ON event1a = a.locus JOIN rk b ON event1b = b.locus""")
def event_names(s, d):
    intron = A.introns(_tx(s, d))
    rank = E.ranked_transcript(intron, ["F"])
    side = lambda x, on: rank.select(F.col("locus").alias(on), F.col("tx").alias(f"tx_{x}"), F.col("n").alias(f"n_{x}"))
    ev = E.skipped_exons(intron).join(side("a", "event1a"), "event1a").join(side("b", "event1b"), "event1b")
    return E.event_names(ev, "SE").select("event1a", "event2a", "event1b", "event_name")
