"""Deterministic views over the driver's tables, each as a DataFrame and as the same formula in ANSI SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R

#: Letters a to z mapped onto bases.
LETTERS, AS_BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
#: Event types in their stored order.
EVENT_TYPES = ("IR", "MXE", "SE", "AFE", "ALE", "A5SS", "A3SS", "RI")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row_key() -> F.Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))


ROW_KEY_SQL = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IV: (row_id, seq, strand, start, end) from lineitem."""
    li = load(spark, sf_dir, "lineitem")
    start = 10 * F.col("l_orderkey") + F.col("l_linenumber")
    return li.select(
        _row_key().alias("row_id"),
        F.concat("l_returnflag", "l_linestatus").alias("seq"),
        F.when(F.col("l_suppkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        start.alias("start"),
        (start + F.col("l_quantity").cast("long") - 1).alias("end"),
    )


IV = f"""iv AS (SELECT {ROW_KEY_SQL} AS row_id, l_returnflag || l_linestatus AS seq, CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
  10 * l_orderkey + l_linenumber AS s, 10 * l_orderkey + l_linenumber + CAST(l_quantity AS BIGINT) - 1 AS e FROM lineitem)"""


def regions(iv: DataFrame) -> DataFrame:
    """The intervals moved on by 5 and widened: a second table."""
    return iv.select("row_id", "seq", "strand", (F.col("start") + 5).alias("start"), (F.col("end") + 25).alias("end"))


RG = "rg AS (SELECT row_id, seq, strand, s + 5 AS s, e + 25 AS e FROM iv)"


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX: one exon per (l_orderkey, l_linenumber) with its gene, transcript, biotype and support level.

    Rows are dealt by transcript once, over as many tasks as the tables need; numbering, gaps and skips by transcript
    need no further shuffle.
    """
    li, o = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    n = R.tasks(li, o)
    li = li.repartition(n, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min(1000 * F.col("l_partkey") + F.col("l_suppkey")).alias("k"))
    o = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").repartition(n, "o_orderkey")
    t = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    gene = F.col("o_custkey") % 40
    start = 2000 * gene + 100 * F.col("l_linenumber") + 10 * (F.floor(F.col("k") / 1000) % 3)
    return t.select(
        F.col("o_orderkey").alias("tx"), gene.alias("gene"), F.concat(F.lit("chr"), (gene % 4).cast("string")).alias("seq"),
        F.when(gene % 3 == 0, "-").otherwise("+").alias("strand"), start.cast("long").alias("start"), (start + 20 + 10 * (F.col("k") % 2)).cast("long").alias("end"),
        F.col("o_orderstatus").alias("biotype"), F.substring("o_orderpriority", 1, 1).alias("tsl"),
    )


TX = """tx AS (SELECT o_orderkey AS tx, o_custkey % 40 AS gene, 'chr' || CAST(o_custkey % 40 % 4 AS VARCHAR) AS seq, CASE WHEN o_custkey % 40 % 3 = 0 THEN '-' ELSE '+' END AS strand,
  CAST(2000 * (o_custkey % 40) + 100 * l_linenumber + 10 * ((k // 1000) % 3) AS BIGINT) AS s,
  CAST(2000 * (o_custkey % 40) + 100 * l_linenumber + 10 * ((k // 1000) % 3) + 20 + 10 * (k % 2) AS BIGINT) AS e, o_orderstatus AS biotype, substr(o_orderpriority, 1, 1) AS tsl
  FROM (SELECT l_orderkey, l_linenumber, min(1000 * l_partkey + l_suppkey) AS k FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey)"""

INTRON = """intron AS (SELECT tx, gene, seq, strand, biotype, tsl, pe + 1 AS s, s - 1 AS e FROM
  (SELECT *, max(e) OVER (PARTITION BY tx ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM tx) WHERE s > pe + 1),
num AS (SELECT *, CASE WHEN strand = '-' THEN n_all + 1 - fwd ELSE fwd END AS n FROM
  (SELECT *, row_number() OVER (PARTITION BY tx ORDER BY s, e) AS fwd, count(*) OVER (PARTITION BY tx) AS n_all FROM intron)),
loc AS (SELECT *, seq || ':' || s || '-' || e || '/' || strand AS locus FROM num)"""


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FR: two-block fragments (seq, strand, direction, s1, e1, s2, e2) around exon slots; junction = e1+1..s2-1."""
    li = load(spark, sf_dir, "lineitem")
    gene = F.col("l_suppkey") % 40
    base = 2000 * gene + 100 * F.col("l_linenumber")
    e1 = base + 30 + 10 * (F.col("l_partkey") % 3)
    q = F.col("l_quantity").cast("long")
    s2 = base + 100 + 10 * (q % 2)
    plus = gene % 3 != 0
    kept = F.col("l_discount") > 0.01
    return li.select(
        _row_key().alias("row_id"), F.concat(F.lit("chr"), (gene % 4).cast("string")).alias("seq"),
        F.when(plus == kept, "+").otherwise("-").alias("direction"), F.when(plus, "+").otherwise("-").alias("strand"),
        (e1 - q % 12).alias("s1"), e1.alias("e1"), s2.alias("s2"), (s2 + F.col("l_partkey") % 12).alias("e2"),
    )


FR = f"""fr AS (SELECT {ROW_KEY_SQL} AS row_id, 'chr' || CAST(l_suppkey % 40 % 4 AS VARCHAR) AS seq,
  CASE WHEN (l_suppkey % 40 % 3 <> 0) = (l_discount > 0.01) THEN '+' ELSE '-' END AS direction, CASE WHEN l_suppkey % 40 % 3 <> 0 THEN '+' ELSE '-' END AS strand,
  2000 * (l_suppkey % 40) + 100 * l_linenumber + 30 + 10 * (l_partkey % 3) - CAST(l_quantity AS BIGINT) % 12 AS s1,
  2000 * (l_suppkey % 40) + 100 * l_linenumber + 30 + 10 * (l_partkey % 3) AS e1,
  2000 * (l_suppkey % 40) + 100 * l_linenumber + 100 + 10 * (CAST(l_quantity AS BIGINT) % 2) AS s2,
  2000 * (l_suppkey % 40) + 100 * l_linenumber + 100 + 10 * (CAST(l_quantity AS BIGINT) % 2) + l_partkey % 12 AS e2 FROM lineitem)"""


def assays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AS: a row per event and sample with the five assays and the four ragged counts."""
    li = load(spark, sf_dir, "lineitem")
    ln, q = F.col("l_linenumber").cast("double"), F.col("l_quantity")
    even, odd = F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") % 2 == 1
    got = li.groupBy(F.col("l_partkey").alias("event_id"), (F.col("l_suppkey") % 6).alias("k")).agg(
        F.sum(q).alias("included"), F.sum(ln).alias("excluded"),
        F.coalesce(F.sum(F.when(even, q)), F.lit(0.0)).alias("up_inc"), F.coalesce(F.sum(F.when(odd, q)), F.lit(0.0)).alias("down_inc"),
        F.coalesce(F.sum(F.when(even, ln)), F.lit(0.0)).alias("up_exc"), F.coalesce(F.sum(F.when(odd, ln)), F.lit(0.0)).alias("down_exc"),
        (F.count("*") / 8.0).alias("c"),
    )
    kind = F.element_at(F.array(*[F.lit(t) for t in EVENT_TYPES]), (F.col("event_id") % 8 + 1).cast("int"))
    return got.select(
        "event_id", kind.alias("event_type"), F.concat(F.lit("S"), F.col("k").cast("string")).alias("sample"), F.when(F.col("k") < 3, "A").otherwise("B").alias("condition"),
        "included", "excluded", (F.col("included") + F.col("excluded")).alias("depth"), F.least(F.col("c"), F.lit(1.0)).alias("coverage"),
        F.least("included", "excluded").alias("min_depth"), "up_inc", "down_inc", "up_exc", "down_exc",
    )


AS = f"""asy AS (SELECT event_id, list_extract({list(EVENT_TYPES)}, CAST(event_id % 8 + 1 AS INT)) AS event_type, 'S' || CAST(k AS VARCHAR) AS sample, CASE WHEN k < 3 THEN 'A' ELSE 'B' END AS condition,
  included, excluded, included + excluded AS depth, least(c, 1.0) AS coverage, least(included, excluded) AS min_depth, up_inc, down_inc, up_exc, down_exc FROM
  (SELECT l_partkey AS event_id, l_suppkey % 6 AS k, sum(l_quantity) AS included, sum(CAST(l_linenumber AS DOUBLE)) AS excluded,
    coalesce(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END), 0) AS up_inc, coalesce(sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END), 0) AS down_inc,
    coalesce(sum(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS DOUBLE) END), 0) AS up_exc, coalesce(sum(CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_linenumber AS DOUBLE) END), 0) AS down_exc,
    count(*) / 8.0 AS c FROM lineitem GROUP BY 1, 2))"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQ: (doc_id, seq): all letters of a document mapped onto bases; a null text has none."""
    s = F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", ""), LETTERS, AS_BASES)
    return load(spark, sf_dir, "documents").select("doc_id", s.alias("seq"))


SQ = f"sq AS (SELECT doc_id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{LETTERS}', '{AS_BASES}') AS seq FROM documents)"
