"""What the corpus operators share: table access, words, hold-out rows, scratch tables."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six code points.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def held_out(doc_id: Column) -> Column:
    """True on the fifth of rows whose labels no model may learn from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to clash with no column of df."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def label_of(labels: DataFrame, column: str, cap: int, only: int | None = None) -> DataFrame:
    """(doc_id, label): at most ``cap`` rows of one label each, chosen by a hash of the id; of the label ``only``, if given.

    Held-out rows and null ids or labels never enter; an id labelled twice takes its smaller label.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(column).cast("int").alias("label"))
    return (
        (one if only is None else one.where(F.col("label") == only))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(cap)
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one only where the session names none."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="isoloom-"))
        path = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder, deleted when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/isoloom-{tag}-{uuid.uuid4().hex}"

    def forget() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already
            pass

    atexit.register(forget)
    return path


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path on it."""
    if folder.startswith("file:/") and not folder.startswith("file:///"):
        folder = "file:///" + folder[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def put(folder: str, name: str, data: bytes) -> str:
    """Writes a file into a shared folder; its path. Names are fresh for every attempt, so a repeated task harms nothing."""
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}", compression=None) as f:
        f.write(data)
    return f"{folder}/{name}"


def got(path: str) -> bytes:
    """Content of a file in a shared folder."""
    system, where = opened(path)
    with system.open_input_stream(where, compression=None) as f:
        return f.read()


def give_back() -> None:
    """Returns freed memory to the system: workers are kept for the next stage and would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function over a partition's batches, that gives memory back when the partition ends."""

    def over(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return over


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder once and read from there."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
