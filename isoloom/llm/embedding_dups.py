"""Embedding near-duplicates: small-world graphs per shard, every shard queried, links verified.

Vectors that are equal within a label form a class; its smallest vec_id stands for it. Each label's classes are
dealt into shards of about ``SHARD`` by a hash. A task per shard writes two files to the shared folder: the shard's
graph, and its vectors with their class numbers. Then every pair of shards of a label is cut into tasks that open
one's graph and the other's vectors by path and ask the graph for ``QUERIES`` of them at a time, so no vector travels through a shuffle
more than once and a lost executor costs the pairs that it held.

A query's beam doubles while its worst hit still links. A graph is audited when it is built: for a seeded sample of its
nodes the shard is scanned, and the first beam doubles until ``AUDIT`` of their links (each node itself among them) are
found. Each pair of shards audits itself again, with sampled queries and with some of those that did find links; if
fewer than ``AUDIT`` of the scanned links were found, the beam doubles for all its queries. A beam as large as a
thirty-second of the shard gives way to a scan, which costs less, so this ends. Hits are verified by cosine in double precision. Links are counted where
they are found and emitted as a spanning forest per task; components give the groups.

No class, label or link list of the corpus reaches the driver; a label that holds a third of all rows is spread
over its pairs of shards.

Cases: null labels, null or zero vectors and null or non-finite components link with nothing and never meet in a task;
so do vectors of different lengths; a null vec_id links with nothing and keeps a null component; rows that repeat a
vec_id are vectors of their own (equal ones link); cosine 0.93 exactly links; an empty table gives no rows; only
vec_id, embedding and label are read, components in double precision.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import got, put, scratch, stored, table
from .graph import components, local_roots
from .hnsw import Graph

LEAST, SHARD = 0.93, 16_384
#: First beam, share of the links that audits ask for, and queries in a sample.
BEAM, AUDIT, AUDITED = 24, 0.995, 64
#: A beam of a WIDE-th of a shard costs more than a scan of it.
WIDE = 32
#: Queries of a task, and tasks, at most.
QUERIES, TASKS = 2_048, 20_000
#: float32 similarities this far below the limit are still verified.
SLACK = 1e-4


def usable(vec_id: Column, embedding: Column, label: Column) -> Column:
    fine = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vec_id.isNotNull() & label.isNotNull() & embedding.isNotNull() & fine & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return (v / np.abs(v).max(1, keepdims=True)) / np.linalg.norm(v / np.abs(v).max(1, keepdims=True), axis=1, keepdims=True)


def linked(graph: Graph, unit: np.ndarray, queries: np.ndarray, least: float = LEAST, beam: int = BEAM, audit: float = AUDIT) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) index pairs of cosine >= least; unit holds the shard's vectors in double precision."""
    q32 = queries.astype(np.float32)
    n = len(unit)

    def verified(q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.empty(len(q), bool)
        for at in range(0, len(q), 1 << 16):
            s = slice(at, at + (1 << 16))
            ok[s] = np.einsum("ij,ij->i", queries[q[s]], unit[node[s]]) >= least
        return q[ok], node[ok]

    def scan(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = [np.nonzero(q32[rows[at : at + 256]] @ graph.x.T >= least - SLACK) for at in range(0, len(rows), 256)]
        q = np.concatenate([np.empty(0, int), *(rows[at * 256 + a] for at, (a, _) in enumerate(out))])
        return verified(q, graph.order[np.concatenate([np.empty(0, int), *(b for _, b in out)])])

    def hits(start: int) -> tuple[np.ndarray, np.ndarray]:
        rows, width, out = np.arange(len(queries)), min(start, n), []
        while len(rows):
            if WIDE * width >= n:
                out.append(scan(rows))
                break
            wide = np.zeros(len(rows), bool)
            step = max(16, min(512, (1 << 20) // width))
            for at in range(0, len(rows), step):
                r = rows[at : at + step]
                ids, sims = graph.search(q32[r], width)
                good = (sims >= least - SLACK) & (ids >= 0)
                more = good[:, -1]
                wide[at : at + step] = more
                i, j = np.nonzero(good & ~more[:, None])
                out.append(verified(r[i], graph.order[ids[i, j]]))
            rows, width = rows[wide], 2 * width
        return np.concatenate([np.empty(0, int), *(a for a, _ in out)]), np.concatenate([np.empty(0, int), *(b for _, b in out)])

    rng = np.random.default_rng(len(queries))
    some = rng.permutation(len(queries))[:AUDITED]
    q, node = hits(beam)
    linking = np.unique(q)
    sample = np.union1d(some, rng.permutation(linking)[:AUDITED])
    truth = set(zip(*(x.tolist() for x in scan(sample))))
    while True:
        near = np.isin(q, sample)
        found = len(truth & set(zip(q[near].tolist(), node[near].tolist())))
        if found >= audit * len(truth) or WIDE * beam >= n:
            return q, node
        beam *= 2
        q, node = hits(beam)


def first_beam(graph: Graph, unit: np.ndarray) -> int:
    """The beam with which a sample of a shard's own vectors finds enough of its links, itself among them."""
    beam, sample = BEAM, np.random.default_rng(len(unit)).permutation(len(unit))[:AUDITED]
    q32 = unit[sample].astype(np.float32)
    near = [set(np.flatnonzero(s)) for s in q32 @ graph.x.T >= LEAST]
    total = sum(map(len, near))
    while WIDE * beam < len(unit):
        ids, sims = graph.search(q32, beam)
        if sum(len(t & set(i[s >= LEAST].tolist())) if len(t) <= beam else len(t) for t, i, s in zip(near, ids, sims)) >= AUDIT * total:
            break
        beam *= 2
    return beam


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def groups(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    fine = usable(F.col("vec_id"), F.col("embedding"), F.col("label"))
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = rows.where(fine).select("vec_id", "label", "embedding", *[F.xxhash64(F.lit(s), "label", "embedding").alias(f"k{s}") for s in (1, 2)])
    # equal vectors: the embedding travels once per partition and class
    classes = rows.groupBy("k1", "k2").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    # two classes may share a repeated vec_id; a number of their own tells them apart
    classes = classes.withColumn("dim", F.size("embedding")).withColumn("node", F.xxhash64("k1", "k2"))
    classes = stored(classes, "vector-classes")
    plan = classes.groupBy("label", "dim").agg(F.count("*").alias("m")).withColumn("shards", F.ceil(F.col("m") / shard).cast("int"))
    many = plan.agg(F.coalesce(F.sum("shards"), F.lit(0)), F.coalesce(F.sum(F.col("shards") * F.ceil(F.col("m") / QUERIES)), F.lit(0))).first()
    name, folder = ["label", "dim", "shard"], scratch(spark, "shards")
    dealt = classes.join(plan.drop("m"), ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node", F.lit(1)), F.col("shards")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").reset_index(drop=True)
        unit = _unit(np.stack(pdf["embedding"].to_numpy()))
        graph, own, g = Graph(unit), uuid.uuid4().hex, pdf.iloc[0]
        vectors = _packed(unit=unit, node=pdf["node"].to_numpy(np.int64), copies=pdf["copies"].to_numpy(np.int64))
        return pd.DataFrame({"label": [g["label"]], "dim": [g["dim"]], "shard": [g["shard"]], "size": [len(unit)], "beam": [first_beam(graph, unit)], "graph": [put(folder, f"{own}.graph", graph.dumps())], "vectors": [put(folder, f"{own}.vectors", vectors)]})

    made = dealt.select(*name, "node", "copies", "embedding").repartition(max(1, min(int(many[0]), TASKS)), *name).groupBy(*name).applyInPandas(build, "label long, dim int, shard int, size int, beam int, graph string, vectors string")
    made = stored(made, "shard-files")  # a row per shard

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[str, Graph, dict] | None = None
        for pdf in batches:
            for g in pdf.itertuples(index=False):
                if held is None or held[0] != g.graph:
                    held = g.graph, Graph.loads(got(g.graph)), dict(np.load(io.BytesIO(got(g.vectors))))
                asked = np.load(io.BytesIO(got(g.asked)))
                part = slice(g.block * QUERIES, (g.block + 1) * QUERIES)
                nodes, copies, own = held[2]["node"], held[2]["copies"], asked["node"][part]
                q, node = linked(held[1], held[2]["unit"], asked["unit"][part], beam=g.beam)
                other = own[q] != nodes[node]
                q, node = q[other], node[other]
                links = np.bincount(q, weights=copies[node], minlength=len(own)).astype(np.int64)
                # one numbering for queries and nodes: a class may be both
                every, at = np.unique(np.concatenate([own, nodes]), return_inverse=True)
                root = local_roots(len(every), at[: len(own)][q], at[len(own) :][node])
                tied = np.flatnonzero(root != np.arange(len(every)))
                yield pd.DataFrame({"a": own[links > 0], "b": own[links > 0], "links": links[links > 0]})
                yield pd.DataFrame({"a": every[tied], "b": every[root[tied]], "links": np.zeros(len(tied), np.int64)})

    blocks = F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / QUERIES).cast("int") - 1))
    pairs = made.drop("size").join(made.select("label", "dim", F.col("vectors").alias("asked"), blocks.alias("block")), ["label", "dim"])  # paths only
    tasks = pairs.repartition(max(1, min(int(many[1]), TASKS)), *name, "asked", "block").sortWithinPartitions("graph", "asked")
    found = tasks.select("graph", "vectors", "beam", "asked", "block").mapInPandas(ask, "a long, b long, links long")
    found = stored(found, "vector-links")
    comp = components(found.select("a", "b"), "vector-groups")
    first = comp.join(classes.select("node", "class_id"), "node").groupBy("root").agg(F.min("class_id").alias("component"))
    comp = comp.join(first, "root").select("node", "component")
    links = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    known = classes.select("node", "k1", "k2", "class_id", "copies").join(links, "node", "left").join(comp, "node", "left")
    known = known.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "class_id").alias("component"))
    out = rows.select("vec_id", "k1", "k2").join(known, ["k1", "k2"])
    out = out.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id")).unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "embeddings"))
