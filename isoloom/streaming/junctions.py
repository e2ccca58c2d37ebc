"""Junction counts from a stream of fragment files: counts are sums, so batches merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def merge_counts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's counts under ``path``; a batch that runs twice overwrites its own folder.

    stream: (seq, direction, blocks). Read the totals with ``totals``.
    """
    from ..operators.quantify import junction_counts

    def put(batch: DataFrame, number: int) -> None:
        junction_counts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("seq", "start", "end").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"), F.sum("total").alias("total"))
