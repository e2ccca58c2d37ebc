"""Table operators whose rule is an order: which match wins, which row stays, who is numbered how."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept under the session's checkpoint folder, so that plans which use it often stay small and
    a lost executor does not repeat it. Where the session names no folder (as in tests) a temporary one is set."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="isoloom-"))
    return df.checkpoint()


#: Bytes of a table's files whose rows one task takes where they are dealt by a key.
TASK_BYTES = 4 << 20
#: Rows of a side that is broadcast.
BROADCAST_ROWS = 500_000


def tasks(*tables: DataFrame, each: int = TASK_BYTES) -> int:
    """Tasks over which tables read from files are dealt: as many as their bytes need, so that no task's share grows."""
    size = max(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables)
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-size // each))


def small(df: DataFrame) -> DataFrame:
    """df settled, and broadcast if it has few rows."""
    df = settled(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def row_ids(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], name: str = "n") -> DataFrame:
    """1, 2, ... in the given order inside each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def strand_renumber(df: DataFrame, key: Sequence[str], name: str = "n") -> DataFrame:
    """Numbers run backwards on the minus strand."""
    last = F.max(name).over(Window.partitionBy(*key))
    return df.withColumn(name, F.when(F.col("strand") == "-", last + 1 - F.col(name)).otherwise(F.col(name)))


def _one(y: DataFrame, on: Sequence[str], cols: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    pick = F.max_by if last else F.min_by
    return y.groupBy(*on).agg(pick(F.struct(*cols), F.struct(*order)).alias("__m"))


def update_join(x: DataFrame, y: DataFrame, on: Sequence[str], cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """x with cols overwritten by y's where it matches: the last match in ``order`` wins, others keep their value.

    Columns that x lacks are added, null where nothing matches.
    """
    got = x.join(_one(y, on, cols, order, last=True), list(on), "left")
    for c in cols:
        new = F.col(f"__m.{c}")
        got = got.withColumn(c, F.when(F.col("__m").isNotNull(), new).otherwise(F.col(c)) if c in x.columns else new)
    return got.drop("__m")


def match_lookup(x: DataFrame, y: DataFrame, on: Sequence[str], cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """x with cols of the first match of y; no row of x is repeated."""
    got = x.join(_one(y, on, cols, order, last=False), list(on), "left")
    return got.select(*x.columns, *[F.col(f"__m.{c}").alias(c) for c in cols])


def distinct_on(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    return row_ids(df, key, order, "__n").where("__n = 1").drop("__n")


def pair_combinations(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], cols: Sequence[str]) -> DataFrame:
    """All pairs a before b of each key, as columns a_... and b_...; keys are splice sites, so groups are small."""
    n = row_ids(df, key, order, "__n")
    a = n.select(*key, F.col("__n").alias("__a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = n.select(*key, F.col("__n").alias("__b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    return a.join(b, list(key)).where("__a < __b").drop("__a", "__b")


def full_outer_keys(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Every key that any table has."""
    out = tables[0].select(*keys)
    for t in tables[1:]:
        out = out.unionByName(t.select(*keys))
    return out.distinct()


def semi_join(x: DataFrame, y: DataFrame, on: Sequence[str]) -> DataFrame:
    return x.join(y.select(*on), list(on), "left_semi")


def anti_join(x: DataFrame, y: DataFrame, on: Sequence[str]) -> DataFrame:
    return x.join(y.select(*on), list(on), "left_anti")


def ordered_concat(df: DataFrame, key: Sequence[str], order: str, text: str, sep: str = "", name: str = "joined") -> DataFrame:
    """Texts of each key joined in order; equal order values are joined by text."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*key).agg(F.array_join(F.transform(rows, lambda x: x["t"]), sep).alias(name))
