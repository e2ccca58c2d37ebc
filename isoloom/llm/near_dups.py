"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its five-word shingles (64-bit hashes; fewer words make one shingle of them all).
1. Documents with equal sets form a class; its smallest doc_id stands for it from here on.
2. Representatives whose MinHash values (125 of 16 bits) agree in one of 25 bands of five are candidates.
   Their values are compared 25 at a time; with a uniform prior, a pair whose posterior probability of a
   Jaccard similarity of at least 0.8 falls below ``TOLERANCE`` is dropped. A pair is looked at in the first
   band that it shares only. What is left of a bucket is emitted as a spanning forest, never as all pairs.
3. Components of these edges are the only places where links can be. Inside each, all pairs are verified on
   the exact sets, and links are counted where they are found: a row per document and block, not per pair.
4. Components of the verified links are the groups.

Large buckets and components are cut into blocks of bounded size, and each pair of blocks is a task's
business of its own, so a group that holds a third of all rows is spread over the cluster. A pair of
similarity 0.8 exactly shares a band with probability 0.99995, more similar ones with higher; a pair missed
by the bands is still verified if both documents are in one component.

Cases: null and empty texts have no shingles and link with nothing; rows with a null doc_id link with nothing
and stay, a row each without a component; rows that repeat a doc_id are one document, and if their texts differ the set with the smallest hash
speaks for it; ties (similarity 0.8 exactly) link; an empty table gives no rows; only doc_id and text are read (``keep_one`` passes the other columns through).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, free_name, freeing, stored, table
from .graph import components, local_roots

WORDS, BANDS, ROWS = 5, 25, 5
HASHES = BANDS * ROWS
#: The similarity that links, as a fraction.
OVER, UNDER = 4, 5
TOLERANCE = 1e-4
STEP = 25
BLOCK, EXACT_BLOCK = 1024, 512
#: Rows of (id, component) that may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MIX = [np.uint64(int(x) | 1) for x in _rng.integers(1 << 40, 1 << 63, WORDS)]
_A = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, as far as the longest text so far needs."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = out
    return _powers[0], _powers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    inside = np.empty(len(b) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[b], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _power(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * power[: len(b)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    if not text:
        return np.empty(0, np.uint64)
    w = word_hashes(text.encode("utf-8", "surrogatepass"))
    n = len(w)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < WORDS:
        h = np.zeros(1, np.uint64)
        for k in range(n):
            h += w[k : k + 1] * _MIX[k]
        return _mixed(h + np.uint64(n))
    h = w[: n - WORDS + 1] * _MIX[0]
    for k in range(1, WORDS):
        h += w[k : n - WORDS + 1 + k] * _MIX[k]
    return np.unique(_mixed(h))


def set_hash(s: np.ndarray, salt: int = 0) -> int:
    return int(_mixed(s ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64))


def signature(s: np.ndarray) -> np.ndarray:
    """16-bit MinHash values."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(low, (x[None, at : at + 2048] * _A + _B).min(axis=1), out=low)
    return (low ^ (low >> np.uint32(16))).astype(np.uint16)


def least_matches(steps: list[int], tolerance: float = TOLERANCE, over: int = OVER, under: int = UNDER) -> list[int]:
    """For each number n of values compared, the fewest matches with which P(similarity >= t) >= tolerance.

    After m of n matches the posterior is Beta(m + 1, n - m + 1), and P(s >= t) = P(Binomial(n + 1, t) <= m).
    """
    t, out = over / under, []
    for n in steps:
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


_STEPS = list(range(STEP, HASHES + 1, STEP))
_LEAST = least_matches(_STEPS)


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray | int) -> np.ndarray:
    """Mask of index pairs that pass every Bayesian test and share no band before ``band``."""
    live, hits = np.arange(len(a)), np.zeros(len(a), np.int64)
    for at, least in zip(range(0, HASHES, STEP), _LEAST):
        hits = hits + (sig[a[live], at : at + STEP] == sig[b[live], at : at + STEP]).sum(1)
        ok = hits >= least
        live, hits = live[ok], hits[ok]
    same = (sig[a[live]] == sig[b[live]]).reshape(-1, BANDS, ROWS).all(2)
    first = same.argmax(1)
    out = np.zeros(len(a), bool)
    out[live[first == (band[live] if isinstance(band, np.ndarray) else band)]] = True
    return out


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables that hold whole groups; rows come sorted by the first ``keys`` columns. A group may span batches."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(i)) for i in range(keys)]
        # row where the last group of the batch begins
        changed = np.zeros(b.num_rows, bool)
        for c in cols:
            changed[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(changed)
        cut = int(at[-1]) if len(at) else 0
        if held:
            last = held[-1]
            fresh = any(last.column(i)[last.num_rows - 1].as_py() != b.column(i)[0].as_py() for i in range(keys))
            if fresh:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held, size = [], 0
        held.append(b.slice(cut))
        size += b.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _starts(t: pa.Table, keys: int) -> np.ndarray:
    changed = np.ones(t.num_rows, bool)
    changed[1:] = False
    for i in range(keys):
        c = t.column(i).to_numpy()
        changed[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(changed)


def _pairs_in(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, group) row pairs a < b inside each group, vectorised over groups of one size."""
    out_a, out_b, out_g = [], [], []
    for m in np.unique(sizes):
        if m < 2:
            continue
        g = np.flatnonzero(sizes == m)
        i, j = np.triu_indices(m, 1)
        out_a.append((starts[g][:, None] + i[None, :]).ravel())
        out_b.append((starts[g][:, None] + j[None, :]).ravel())
        out_g.append(np.repeat(g, len(i)))
    if not out_a:
        z = np.empty(0, np.int64)
        return z, z, z
    return np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_g)


def blocked(rows: DataFrame, key: str, count: str, id_: str, block: int) -> DataFrame:
    """Adds i, j (the pair of blocks a row goes to) and side (its own block); one pair for groups that fit."""
    n = F.ceil(F.col(count) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(id_, key), n).cast("int")
    rows = rows.withColumn("side", own).withColumn("__n", n)
    pair = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    small = rows.where("__n = 1").withColumns({"i": F.lit(0), "j": F.lit(0)})
    large = rows.where("__n > 1").withColumn("o", pair).withColumns({"i": F.least("side", "o"), "j": F.greatest("side", "o")}).drop("o")
    return small.unionByName(large).drop("__n")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (hash of the set), n (its size) and sig for each row with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, n, sig = [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py())
                n.append(len(s))
                k1.append(set_hash(s))
                k2.append(set_hash(s, 0x5851F42D4C957F2D))
                sig.append(signature(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.binary())], names=["doc_id", "k1", "k2", "n", "sig"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(freeing(run), "doc_id long, k1 long, k2 long, n int, sig binary")


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bk, i, j, band, side, class_id, sig), sorted by bk, i, j -> spanning forests of what survives."""
    for t in sorted_groups(batches, 3):
        starts = _starts(t, 3)
        sizes = np.diff(np.r_[starts, t.num_rows])
        ids, band, side = (t.column(c).to_numpy() for c in ("class_id", "band", "side"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        i_, j_ = t.column("i").to_numpy(), t.column("j").to_numpy()
        found_a, found_b = [], []
        small = sizes <= 64
        a, b, _ = _pairs_in(starts[small], sizes[small])
        for at in range(0, len(a), 1 << 17):
            x, y = a[at : at + (1 << 17)], b[at : at + (1 << 17)]
            keep = (i_[x] == j_[x]) | (side[x] != side[y])
            x, y = x[keep], y[keep]
            ok = surviving(sig, x, y, band[x])
            found_a.append(x[ok])
            found_b.append(y[ok])
        for s, m in zip(starts[~small], sizes[~small]):
            one = np.arange(s, s + m)
            left, right = (one, one) if i_[s] == j_[s] else (one[side[s : s + m] == i_[s]], one[side[s : s + m] == j_[s]])
            for at in range(0, len(left), 128):
                x = np.repeat(left[at : at + 128], len(right))
                y = np.tile(right, len(left[at : at + 128]))
                if i_[s] == j_[s]:
                    up = x < y
                    x, y = x[up], y[up]
                ok = surviving(sig, x, y, int(band[s]))
                found_a.append(x[ok])
                found_b.append(y[ok])
        a, b = np.concatenate([np.empty(0, np.int64), *found_a]), np.concatenate([np.empty(0, np.int64), *found_b])
        root = local_roots(t.num_rows, a, b)
        tied = np.flatnonzero(root != np.arange(t.num_rows))
        if len(tied):
            yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[root[tied]])], names=["a", "b"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all pairwise intersections, by products of slices of the incidence matrix."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    value, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[at] > 1
    owner, at = owner[keep], at[keep]
    _, at = np.unique(at, return_inverse=True)
    out = np.zeros((m, m), np.float64)
    width = max(1, (4 << 20) // max(m, 1))
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    last = int(at[-1]) + 1 if len(at) else 0
    for lo in range(0, last, width):
        s, e = np.searchsorted(at, [lo, lo + width])
        x = np.zeros((m, min(width, last - lo)), np.float32)
        x[owner[s:e], at[s:e] - lo] = 1
        out += x @ x.T
    return np.rint(out).astype(np.int64)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, i, j, side, class_id, copies, set), sorted by root, i, j -> (a, b, links): counts and forests."""
    for t in sorted_groups(batches, 3):
        starts = _starts(t, 3)
        sizes = np.diff(np.r_[starts, t.num_rows])
        ids, copies, side = (t.column(c).to_numpy() for c in ("class_id", "copies", "side"))
        i_, j_ = t.column("i").to_numpy(), t.column("j").to_numpy()
        raw = t.column("set")
        out_a, out_b, out_n = [], [], []
        for s, m in zip(starts, sizes):
            if m < 2:
                continue
            sets = [np.frombuffer(raw[int(k)].as_py(), np.uint64) for k in range(s, s + m)]
            n = np.array([len(x) for x in sets])
            both = shared_counts(sets)
            linked = UNDER * both >= OVER * (n[:, None] + n[None, :] - both)
            np.fill_diagonal(linked, False)
            if i_[s] != j_[s]:
                linked &= side[s : s + m][:, None] != side[s : s + m][None, :]
            count = linked @ copies[s : s + m]
            a, b = np.nonzero(np.triu(linked))
            root = local_roots(m, a, b)
            for k in np.flatnonzero(count):
                out_a.append(ids[s + k])
                out_b.append(ids[s + root[k]])
                out_n.append(count[k])
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_n, pa.int64())], names=["a", "b", "links"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
        got = [shingles(t.as_py()) for t in b.column("text")]
        rest = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array([set_hash(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], names=[*rest, "k1", "set"])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_links (documents of similarity 0.8 or more), component_id (smallest doc_id of its group), kept."""
    feats = stored(features(docs), "shingle-features")
    repeated = feats.count() > feats.select("doc_id").distinct().count()
    if repeated:
        feats = stored(feats.groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n", "sig")).alias("f")).select("doc_id", "f.*"), "one-per-id")
    classes = feats.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "sig")).alias("first"), F.count("*").alias("copies"))
    reps = stored(classes.select("k1", "k2", "n", F.col("first.doc_id").alias("class_id"), "copies", F.col("first.sig").alias("sig")), "classes")

    width = 2 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", k * width + 1, width)) for k in range(BANDS)])
    rows = reps.select("class_id", F.posexplode(bands).alias("band", "bk"))
    full = rows.groupBy("bk").agg(F.count("*").alias("m")).where("m > 1")
    members = rows.join(full, "bk").join(reps.select("class_id", "sig"), "class_id")
    tasks = blocked(members, "bk", "m", "class_id", BLOCK).select("bk", "i", "j", "band", "side", "class_id", "sig")
    edges = tasks.repartition("bk", "i", "j").sortWithinPartitions("bk", "i", "j").mapInArrow(freeing(_bucket_edges), "a long, b long")
    near = components(edges, "candidates")

    size = near.groupBy("root").agg(F.count("*").alias("m"))
    near = stored(near.join(size, "root"), "near").join(reps.select(F.col("class_id").alias("node"), "copies", "k1"), "node")
    near = stored(near, "near-classes")
    ids = _small(near.select(F.col("node").alias("doc_id"), "root", "m", "copies", F.col("k1").alias("own")), near.count())
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id")
    sets = texts.withColumnRenamed("doc_id", "class_id").mapInArrow(freeing(_sets), "class_id long, root long, m long, copies long, own long, k1 long, set binary")
    if repeated:
        sets = sets.where("own = k1").dropDuplicates(["class_id"])
    tasks = blocked(sets, "root", "m", "class_id", EXACT_BLOCK).select("root", "i", "j", "side", "class_id", "copies", "set")
    found = stored(tasks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(freeing(_verified), "a long, b long, links long"), "links")

    comp = components(found.select("a", "b"), "groups")
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    known = reps.select("k1", "k2", "n", "class_id", "copies")
    known = known.join(links.withColumnRenamed("a", "class_id"), "class_id", "left").join(comp.withColumnRenamed("node", "class_id"), "class_id", "left")
    known = known.where("copies > 1 OR links IS NOT NULL").select("k1", "k2", "n", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "class_id").alias("root"))
    out = feats.select("doc_id", "k1", "k2", "n").join(known, ["k1", "k2", "n"], "left")
    out = out.select("doc_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    alone = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group (its smallest doc_id); all columns stay."""
    found = stored(groups(docs).where("doc_id IS NOT NULL").select("doc_id", "kept"), "kept")
    gone = found.where("NOT kept").select("doc_id")
    left = docs.join(_small(gone, gone.count()), "doc_id", "left_anti").select(*columns(docs))
    again = stored(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    n = again.count()
    if not n:
        return left
    # only rows whose id repeats are dealt by id
    once = left.join(_small(again, n), "doc_id", "left_anti").select(*columns(docs))
    twice = left.join(_small(again, n), "doc_id", "left_semi").select(*columns(docs))
    rank = free_name(docs, "rank")
    first = twice.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where(F.col(rank) == 1)
    return once.unionByName(first.select(*columns(docs)))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
