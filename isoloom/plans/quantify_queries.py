"""Quantification operators as queries over the fragment view, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import histogram as H
from ..operators import intervals as I
from ..operators import quantify as Q
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


def _frags(s: SparkSession, d: str) -> DataFrame:
    fr = V.fragments(s, d)
    block = lambda k: F.struct(F.col(f"s{k}").alias("start"), F.col(f"e{k}").alias("end"))
    return fr.select("row_id", "seq", "strand", "direction", F.array(block(1), block(2)).alias("blocks"))


JUNC = "jn AS (SELECT seq, e1 + 1 AS s, s2 - 1 AS e, count(*) FILTER (direction = '-') AS neg, count(*) FILTER (direction = '+') AS pos, count(*) AS total FROM fr WHERE e1 - s1 >= 4 AND e2 - s2 >= 4 AND s2 > e1 + 1 GROUP BY ALL)"
REF = "ref AS (SELECT DISTINCT seq, e1 + 1 AS s, s2 - 1 AS e, strand FROM fr)"
_W = f"WITH {V.FR}, {JUNC}"


def _ref(fr: DataFrame) -> DataFrame:
    b = F.col("blocks")
    return fr.select("seq", (F.get(b, 0)["end"] + 1).alias("start"), (F.get(b, 1)["start"] - 1).alias("end"), "strand").distinct()


@query("junction_counts", f'{_W} SELECT seq, s AS "start", e AS "end", neg, pos, total FROM jn')
def junction_counts(s, d):
    return Q.junction_counts(_frags(s, d))


@query("junction_left_right", f"{_W} SELECT 'left' AS side, seq, s AS at, CAST(sum(total) AS BIGINT) AS total FROM jn GROUP BY 2, 3 UNION ALL SELECT 'right', seq, e, CAST(sum(total) AS BIGINT) FROM jn GROUP BY 2, 3")
def junction_left_right(s, d):
    return Q.junction_sides(Q.junction_counts(_frags(s, d)))


BLK = "blk AS (SELECT seq, direction, s1 AS bs, e1 AS be FROM fr UNION ALL SELECT seq, direction, s2, e2 FROM fr)"


@query("span_counts", f"""{_W}, {BLK}, pt AS (SELECT DISTINCT seq, s - 4 AS pos FROM jn UNION SELECT DISTINCT seq, e + 6 FROM jn)
SELECT pt.seq, pos, count(*) FILTER (direction = '-') AS neg, count(*) FILTER (direction = '+') AS plus FROM pt LEFT JOIN blk ON pt.seq = blk.seq AND be - bs + 1 > 9 AND pos >= bs + 4 AND pos <= be - 1 GROUP BY 1, 2""")
def span_counts(s, d):
    fr = _frags(s, d)
    j = Q.junction_counts(fr)
    pts = j.select("seq", (F.col("start") - 4).alias("pos")).unionByName(j.select("seq", (F.col("end") + 6).alias("pos")))
    return Q.span_counts(fr, pts)


ROI = "roi AS (SELECT 'roi' || g AS name, 'chr' || CAST(g % 4 AS VARCHAR) AS seq, 2000 * g + 100 AS s, 2000 * g + 390 AS e FROM (SELECT unnest(range(0, 40)) AS g))"


@query("roi_counts", f"""{_W}, {ROI} SELECT name, count(*) FILTER (direction = '-') AS neg, count(*) FILTER (direction = '+') AS plus FROM roi LEFT JOIN fr ON roi.seq = fr.seq AND fr.s1 >= roi.s AND fr.e2 <= roi.e GROUP BY 1""")
def roi_counts(s, d):
    g = s.range(40).withColumnRenamed("id", "g")
    roi = g.select(F.concat(F.lit("roi"), F.col("g").cast("string")).alias("name"), F.concat(F.lit("chr"), (F.col("g") % 4).cast("string")).alias("seq"), (2000 * F.col("g") + 100).alias("start"), (2000 * F.col("g") + 390).alias("end"))
    return Q.roi_counts(_frags(s, d), roi)


@query("chrom_counts", f"WITH {V.FR} SELECT seq, count(*) FILTER (direction = '-') AS neg, count(*) FILTER (direction = '+') AS plus, count(*) AS total FROM fr GROUP BY 1")
def chrom_counts(s, d):
    return Q.chrom_counts(_frags(s, d))


DIRECTION = """st AS (SELECT seq, s, e, min(CASE WHEN strand = '-' THEN 0 ELSE 1 END) AS plus FROM ref GROUP BY ALL),
ln AS (SELECT jn.*, st.plus, CASE WHEN neg > 4 * pos THEN 0 WHEN pos > 4 * neg THEN 1 END AS lean FROM jn LEFT JOIN st USING (seq, s, e) WHERE neg + pos > 8),
ag AS (SELECT count(*) FILTER (lean = plus) AS same, count(*) FILTER (lean <> plus) AS opposed, count(*) FILTER (lean IS NULL) AS "none", count(*) FILTER (lean IS NOT NULL AND plus IS NOT NULL) AS known, count(plus) AS annotated FROM ln),
sc AS (SELECT *, CAST(floor(10000 * known / (annotated + 1)) AS BIGINT) AS score FROM ag)"""


@query("directionality", f"""{_W}, {REF}, {DIRECTION} SELECT *, CASE WHEN score >= 9000 AND same > 100 * opposed THEN 1 WHEN score >= 9000 AND opposed > 100 * same THEN -1 ELSE 0 END AS strand FROM sc""")
def directionality(s, d):
    fr = _frags(s, d)
    return Q.directionality(Q.junction_counts(fr), _ref(fr))


DEPTH = f"""{BLK}, ev AS (SELECT seq, p, sum(d) AS d FROM (SELECT seq, bs AS p, 1 AS d FROM blk UNION ALL SELECT seq, be + 1, -1 FROM blk) GROUP BY ALL HAVING sum(d) <> 0),
runs AS (SELECT seq, s, e, depth FROM (SELECT seq, p AS s, lead(p) OVER w - 1 AS e, CAST(sum(d) OVER w AS BIGINT) AS depth FROM ev WINDOW w AS (PARTITION BY seq ORDER BY p)) WHERE e IS NOT NULL),
it AS (SELECT seq || ':' || s || '-' || e AS id, seq, s, e, total FROM jn),
met AS (SELECT id, depth, sum(least(it.e, r.e) - greatest(it.s, r.s) + 1) AS n FROM it JOIN runs r ON it.seq = r.seq AND it.s <= r.e AND it.e >= r.s GROUP BY 1, 2),
hist AS (SELECT id, depth, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM met UNION ALL SELECT it.id, 0, e - s + 1 - coalesce((SELECT sum(n) FROM met WHERE met.id = it.id), 0) FROM it) WHERE n > 0 GROUP BY 1, 2),
cum AS (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY depth) AS c, floor(sum(n) OVER (PARTITION BY id) * 0.3) AS k, sum(n) OVER (PARTITION BY id) AS t FROM hist),
dp AS (SELECT id, sum(depth * greatest(0, least(c, t - k) - greatest(c - n, k))) / max(t - 2 * k) AS depth, sum(CASE WHEN depth > 0 THEN n ELSE 0 END) / sum(n) AS coverage FROM cum GROUP BY 1),
lr AS (SELECT id, seq, s, e, total AS exact, sum(total) OVER (PARTITION BY seq, s) AS l, sum(total) OVER (PARTITION BY seq, e) AS r FROM it)"""


def _measured(s, d) -> DataFrame:
    """(id, depth, coverage, exact, l, r): each observed junction's span measured as an intron."""
    fr = _frags(s, d)
    j = Q.junction_counts(fr)
    j = j.withColumn("id", F.concat(F.col("seq"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))
    blocks = fr.select("seq", F.explode("blocks").alias("b")).select("seq", F.lit("*").alias("strand"), "b.*")
    h = I.region_depths(I.coverage_runs(blocks), j.withColumn("strand", F.lit("*")), "id")
    stats = H.hist_trimmed_mean(h, "id").join(H.hist_coverage(h, "id"), "id")
    left = j.groupBy("seq", "start").agg(F.sum("total").alias("l"))
    right = j.groupBy("seq", "end").agg(F.sum("total").alias("r"))
    sides = j.join(left, ["seq", "start"]).join(right, ["seq", "end"]).select("id", F.col("total").alias("exact"), "l", "r")
    return stats.join(sides, "id").withColumnRenamed("trimmed_mean", "depth")


@query("intron_depth", f"{_W}, {DEPTH} SELECT id, round(depth, 6) AS depth, round(coverage, 6) AS coverage, exact, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r FROM dp JOIN lr USING (id)")
def intron_depth(s, d):
    return _measured(s, d).select("id", F.round("depth", 6).alias("depth"), F.round("coverage", 6).alias("coverage"), "exact", "l", "r")


@query("ir_ratio", f"""{_W}, {DEPTH} SELECT id, round(CASE WHEN depth = 0 AND greatest(l, r) = 0 THEN 0 WHEN depth < 1 THEN coverage / (coverage + greatest(l, r)) ELSE depth / (depth + greatest(l, r)) END, 6) AS ir_ratio FROM dp JOIN lr USING (id)""")
def ir_ratio(s, d):
    c = F.col
    return _measured(s, d).select("id", F.round(Q.ir_ratio(c("depth"), c("coverage"), c("l"), c("r")), 6).alias("ir_ratio"))


SPANS = """pts AS (SELECT DISTINCT seq, s - 1 AS pos FROM jn UNION SELECT DISTINCT seq, e FROM jn),
sp AS (SELECT pts.seq, pos, count(blk.seq) AS n FROM pts LEFT JOIN blk ON pts.seq = blk.seq AND be - bs + 1 > 9 AND pos >= bs + 4 AND pos <= be - 1 GROUP BY 1, 2),
ms AS (SELECT dp.id, depth, coverage, exact, l, r, a.n AS sl, b.n AS sr FROM dp JOIN lr USING (id) JOIN sp a ON a.seq = lr.seq AND a.pos = lr.s - 1 JOIN sp b ON b.seq = lr.seq AND b.pos = lr.e)"""
_WARN = """CASE WHEN exact + depth < 10 THEN 'LowCover' WHEN exact < 4 THEN 'LowSplicing' WHEN exact * 1.33333333 < greatest(l, r) THEN 'MinorIsoform'
 WHEN (greatest(sl, sr) > depth + 2 AND greatest(sl, sr) > depth * 1.5) OR (least(sl, sr) + 2 < depth AND least(sl, sr) * 1.5 < depth) THEN 'NonUniformIntronCover' ELSE '-' END"""


def _report(s, d) -> DataFrame:
    """Each observed junction's span measured as an intron."""
    fr = _frags(s, d)
    j = Q.junction_counts(fr)
    return Q.measure_introns(fr, j.select(F.concat(F.col("seq"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("id"), "seq", "start", "end"))


@query("ir_warnings", f"{_W}, {DEPTH}, {SPANS} SELECT id, {_WARN} AS warning FROM ms")
def ir_warnings(s, d):
    return _report(s, d).select("id", "warning")


@query("ir_warnings_uneven", f"{_W}, {DEPTH}, {SPANS}, u AS (SELECT id, depth, 1000 AS exact, 1000 AS l, 1000 AS r, sl, sr FROM ms) SELECT id, {_WARN} AS warning FROM u")
def ir_warnings_uneven(s, d):
    """The same for introns that are spliced often, where only the unevenness of coverage decides."""
    c, many = F.col, F.lit(1000)
    return _report(s, d).select("id", Q.ir_warning(c("depth"), many, many, many, c("span_left"), c("span_right")).alias("warning"))


_EDGE = lambda name, lo, hi: f"""{name}m AS (SELECT it.id, depth, sum(least({hi}, r.e) - greatest({lo}, r.s) + 1) AS n FROM it JOIN runs r ON it.seq = r.seq AND {lo} <= r.e AND {hi} >= r.s GROUP BY 1, 2),
{name}h AS (SELECT id, depth, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM {name}m UNION ALL SELECT it.id, 0, 50 - coalesce((SELECT sum(n) FROM {name}m WHERE {name}m.id = it.id), 0) FROM it) WHERE n > 0 GROUP BY 1, 2),
{name}c AS (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY depth) AS c FROM {name}h), {name} AS (SELECT id, sum(depth * greatest(0, least(c, 35) - greatest(c - n, 15))) / 20.0 AS v FROM {name}c GROUP BY 1)"""  # noqa: E731


@query("intron_report", f"""{_W}, {DEPTH}, {SPANS}, {_EDGE('f50', 'it.s + 5', 'it.s + 54')}, {_EDGE('l50', 'it.e - 54', 'it.e - 5')}
SELECT ms.id, round(depth, 6) AS depth, round(coverage, 6) AS coverage, sl AS span_left, sr AS span_right, round(f50.v, 6) AS first50, round(l50.v, 6) AS last50, CAST(l AS BIGINT) AS splice_left, CAST(r AS BIGINT) AS splice_right, exact AS splice_exact FROM ms JOIN f50 USING (id) JOIN l50 USING (id)""")
def intron_report(s, d):
    r = lambda c: F.round(c, 6).alias(c)
    return _report(s, d).select("id", r("depth"), r("coverage"), "span_left", "span_right", r("first50"), r("last50"), "splice_left", "splice_right", "splice_exact")


@query("ir_burden", f"""{_W}, {DEPTH}, k AS (SELECT depth, CASE exact % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'anti-near+known-exon' ELSE 'anti-over' END AS kind FROM dp JOIN lr USING (id))
SELECT round(sum(CASE WHEN kind = 'clean' THEN depth END), 4) AS clean, round(sum(CASE WHEN contains(kind, 'known-exon') THEN depth END), 4) AS known_exon, round(sum(CASE WHEN kind = 'anti-over' THEN depth END), 4) AS anti_sense FROM k""")
def ir_burden(s, d):
    n = F.col("exact") % 3
    got = Q.burden(_measured(s, d), F.when(n == 0, "clean").when(n == 1, "anti-near+known-exon").otherwise("anti-over"))
    return got.select(*[F.round(c, 4).alias(c) for c in got.columns])


@query("qc_summary", f"""{_W} SELECT (SELECT count(*) FROM fr) AS fragments, (SELECT CAST(sum(e1 - s1 + 1 + e2 - s2 + 1) AS BIGINT) FROM fr) AS nucleotides, (SELECT count(*) FROM jn) AS junctions, (SELECT CAST(sum(total) AS BIGINT) FROM jn) AS junction_reads""")
def qc_summary(s, d):
    fr = _frags(s, d)
    j = Q.junction_counts(fr).agg(F.count("*").alias("junctions"), F.sum("total").alias("junction_reads"))
    n = fr.agg(F.count("*").alias("fragments"), F.sum(F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b["end"] - b["start"] + 1)).alias("nucleotides"))
    both = n.unionByName(j, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
