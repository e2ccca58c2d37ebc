"""The composed steps as queries; the events' SQL is the union of the SQL of the single types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quantify as Q
from ..operators import relational as R
from . import annotation_queries as AQ
from . import pipeline as P
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


def reference(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return P.build_reference(V.exons(s, d), ["F"], "O", AQ.RETAINED)


def samples(s: SparkSession, d: str) -> DataFrame:
    """Fragments of six samples, equal ones once."""
    fr = V.fragments(s, d)
    block = lambda k: F.struct(F.col(f"s{k}").alias("start"), F.col(f"e{k}").alias("end"))
    return R.settled(Q.equal_fragments(fr.select(F.concat(F.lit("S"), (F.col("e2") % 6).cast("string")).alias("sample"), "seq", "direction", F.array(block(1), block(2)).alias("blocks"))))


def conditions(frags: DataFrame) -> DataFrame:
    return frags.select("sample").distinct().withColumn("condition", F.when(F.col("sample") < "S3", "A").otherwise("B"))


def _all_sql() -> str:
    of = lambda kind, e2a, e2b, region: f"SELECT '{kind}' AS event_type, event1a, {e2a} AS event2a, event1b, {e2b} AS event2b, {region} AS region FROM ({{}})"
    rescued = AQ.SQL["island_rescue"]
    flanked = lambda q: q.replace("FROM site JOIN fl ON site.locus = fl.locus", f"FROM site JOIN ({rescued}) fl ON site.locus = fl.locus")
    plain = AQ.SQL["measurable_blocks"].replace(" FROM tx)) GROUP BY seq, strand, g)", " FROM tx WHERE biotype <> 'P')) GROUP BY seq, strand, g)")
    ri = f"SELECT DISTINCT locus AS event1a, locus AS event1b FROM ({AQ.SQL['event_ri']}) WHERE locus IN (SELECT locus FROM ({plain}))"
    parts = [
        of("MXE", "event2a", "event2b", "skip").format(AQ.SQL["event_mxe"]), of("SE", "event2a", "NULL", "event1b").format(AQ.SQL["event_se"]),
        *[of(k, "NULL", "NULL", "event1b").format(flanked(AQ.SQL[f"event_{k.lower()}"])) for k in ("AFE", "ALE", "A5SS", "A3SS")], of("RI", "NULL", "NULL", "event1a").format(ri),
    ]
    return " UNION ALL ".join(parts)


@query("build_events", _all_sql())
def build_events(s, d):
    return reference(s, d)["events"].select("event_type", *P.PARTS, "region")


@query("event_islands", f"""SELECT event_type, event1a, event2a, event1b, event2b, CASE WHEN event_type IN ('MXE', 'SE', 'ALE', 'A3SS', 'RI') THEN a.up END AS jg_up,
 CASE WHEN event_type = 'MXE' THEN b.down WHEN event_type IN ('SE', 'AFE', 'A5SS', 'RI') THEN a.down END AS jg_down FROM ({_all_sql()}) ev LEFT JOIN ({AQ.SQL['island_rescue']}) a ON a.locus = ev.event1a LEFT JOIN ({AQ.SQL['island_rescue']}) b ON b.locus = ev.event2a""")
def event_islands(s, d):
    return reference(s, d)["events"].select("event_type", *P.PARTS, "jg_up", "jg_down")


@query("collated_assays")
def collated_assays(s, d):
    """Every event and measured intron in every sample, from exons and fragments."""
    ref, frags = reference(s, d), samples(s, d)
    return P.collate(ref, P.quantify(frags, ref), conditions(frags))


@query("model_filtered")
def model_filtered(s, d):
    """The collated rows that pass the filters on depth, coverage, consistency and exclusive exons."""
    from ..operators.filters import default_filters

    ref, frags = reference(s, d), samples(s, d)
    cond = conditions(frags)
    model = P.make_model(ref, P.collate(ref, P.quantify(frags, ref), cond), cond)
    return model.filtered([f for f in default_filters() if f.kind != "Terminus"]).assay
