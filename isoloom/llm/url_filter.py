"""URL filters: a cascade of Bloom filters that is exact over the corpus's own keys.

Listed keys are rules (host suffix + path prefix) with their verdicts, and blocked domains. A url's candidate
keys are its host's suffixes joined with the path prefixes of the lengths that the rules have. Level 0 encodes
the listed keys; level 1 the keys among all candidates of the whole corpus that pass level 0 without being
listed; level 2 the listed keys that pass level 1; and so on until nothing passes wrongly. A key is listed if
the first level that rejects it has an odd number (or none does and the count of levels is odd). The answer is
exact for every key of the corpus it was built over, and judging a url joins nothing.

Level 0 spends enough bits that about as many corpus keys pass wrongly as there are listed keys, so all levels
together grow with the list and the logarithm of the key universe; the size is checked before it is broadcast.

Cases: a null url, or one without ``://``, has empty host and path, fits nothing and is allowed; an empty host
has no candidates; repeated rows are judged alike, one result row each; no listed keys make a cascade that
holds nothing; only page_id and url are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: The rules of the contract, (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Domains that are blocked where no rule fits, with their subdomains.
NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
DOMAINS = [f"{n}.example.{t}" for n in NAMES for t in ("com", "net", "org")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_FILTER_BYTES, MAX_LEVELS = 64 << 20, 40
SEEDS = (1, 2)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.greatest(F.length(rest), F.lit(1))), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def suffixes(host: Column) -> Column:
    """The host and its parents, longest first; none for an empty host."""
    parts = F.split(host, r"\.")
    every = F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys a rule may have, the longest first (between equals the longer host)."""
    each = F.transform(
        suffixes(host),
        lambda s: F.transform(
            F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length(path)),
            lambda n: F.struct((F.length(s) + n).alias("n"), F.length(s).alias("h"), F.concat(s, F.substring(path, F.lit(1), n)).alias("key")),
        ),
    )
    return F.transform(F.sort_array(F.array_distinct(F.flatten(each)), asc=False), lambda x: x["key"])


def hashed(key: Column) -> Column:
    return F.struct(*[F.xxhash64(key, F.lit(s)).alias(f"h{s}") for s in SEEDS])


@dataclass
class Level:
    bits: np.ndarray  # uint64 words
    size: int
    probes: int

    def passes(self, h1: np.ndarray, h2: np.ndarray, number: int) -> np.ndarray:
        ok = np.ones(len(h1), bool)
        for p in places(h1, h2, number, self.size, self.probes):
            ok &= (self.bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return ok


def places(h1: np.ndarray, h2: np.ndarray, number: int, size: int, probes: int) -> Iterator[np.ndarray]:
    """Bit positions; each level mixes the two hashes anew."""
    with np.errstate(over="ignore"):
        a = (h1 ^ np.uint64(0x9E3779B97F4A7C15 * (number + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        b = (h2 + np.uint64(number)) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        a, b = a ^ (a >> np.uint64(29)), b ^ (b >> np.uint64(31))
        for i in range(probes):
            yield (a + np.uint64(i) * b) % np.uint64(size)


def _unsigned(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)


@dataclass
class Cascade:
    levels: list[Level]

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), len(self.levels) % 2 == 1)
        live = np.arange(len(h1))
        for k, level in enumerate(self.levels):
            ok = level.passes(h1[live], h2[live], k)
            out[live[~ok]] = k % 2 == 1
            live = live[ok]
        return out

    def bytes(self) -> int:
        return sum(x.bits.nbytes for x in self.levels)


def _level(keys: DataFrame, n: int, number: int, rate: float) -> Level:
    """A filter over n distinct (h1, h2) rows: positions are merged by OR before they reach the driver."""
    bits_per_key = max(1.44 * math.log2(1 / rate), 2.0)
    size = max(64, -(-int(n * bits_per_key) // 64) * 64)
    probes = max(1, round(size / max(n, 1) * math.log(2))) if n else 1
    probes = min(probes, 24)
    if size // 8 > MAX_FILTER_BYTES:
        raise ValueError(f"a level of {size // 8} bytes is more than {MAX_FILTER_BYTES}: split the list")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = _unsigned(b.column(0)), _unsigned(b.column(1))
            at = np.concatenate([*places(h1, h2, number, size, probes), np.empty(0, np.uint64)])
            w, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(w), np.uint64)
            np.bitwise_or.at(value, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), pa.array(value.view(np.int64))], names=["w", "v"])

    bits = np.zeros(size // 64, np.uint64)
    for r in keys.select("h1", "h2").mapInArrow(words, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toLocalIterator():
        bits[r["w"]] = np.int64(r["v"]).view(np.uint64)
    return Level(bits, size, probes)


def _passing(keys: DataFrame, cascade_level: Level, number: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(cascade_level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = shared.value.passes(_unsigned(b.column(0)), _unsigned(b.column(1)), number)
            yield b.filter(pa.array(ok))

    return keys.select("h1", "h2").mapInArrow(run, "h1 long, h2 long")


def build(listed: DataFrame, universe: DataFrame, universe_rows: int) -> Cascade:
    """listed, universe: (h1, h2) rows; the universe may repeat keys. Both are read again for each early level."""
    listed = stored(listed.distinct(), "listed")
    n = listed.count()
    levels: list[Level] = []
    if not n:
        return Cascade(levels)
    inside, outside = (listed, n), (universe, None)
    rate = min(0.5, max(n / max(universe_rows, 1), 1e-9) * math.sqrt(0.5))
    for number in range(MAX_LEVELS):
        mine, other = (inside, outside) if number % 2 == 0 else (outside, inside)
        level = _level(mine[0], mine[1], number, rate if number == 0 else 0.5)
        levels.append(level)
        if sum(x.bits.nbytes for x in levels) > MAX_FILTER_BYTES:
            raise ValueError(f"the cascade is more than {MAX_FILTER_BYTES} bytes: split the list")
        wrong = _passing(other[0], level, number)
        if number == 0:  # what passes is about as small as the list; only here may it hold listed keys
            wrong = wrong.distinct().join(listed, ["h1", "h2"], "left_anti")
        wrong = stored(wrong, f"level{number}")
        m = wrong.count()
        if not m:
            break
        if number % 2 == 0:
            outside = (wrong, m)
        else:
            inside = (wrong, m)
    else:
        raise ValueError("the cascade did not end: two keys share both hashes")
    return Cascade(levels)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, domains: list[str] = DOMAINS) -> DataFrame:
    """page_id, host, path, rule, verdict, domain (the blocked domain that fits, else null)."""
    spark = pages.sparkSession
    lengths = sorted({len(p) for _, p, _ in rules})
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    base = base.withColumn("keys", candidates(F.col("host"), F.col("path"), lengths)).withColumn("doms", suffixes(F.col("host")))
    tagged = lambda tag, keys: F.transform(keys, lambda k: F.concat(F.lit(tag), k))
    base = base.withColumn("hs", F.transform(F.concat(tagged("rule ", F.col("keys")), tagged("allow ", F.col("keys")), tagged("domain ", F.col("doms"))), hashed))
    names = [f"rule {h}{p}" for h, p, _ in rules] + [f"allow {h}{p}" for h, p, v in rules if v == "allow"] + [f"domain {d}" for d in domains]
    listed = spark.createDataFrame([(k,) for k in names], "k string").select(hashed(F.col("k")).alias("h")).select("h.*")
    every = base.select(F.explode("hs").alias("h")).select("h.*")
    cascade = build(listed, every, base.select(F.sum(F.size("hs"))).first()[0] or 0)
    shared = spark.sparkContext.broadcast(cascade)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = b.column(b.schema.get_field_index("hs"))
            flat = hs.flatten()
            ok = shared.value.holds(_unsigned(flat.field(0)), _unsigned(flat.field(1)))
            ends = np.cumsum(np.r_[0, hs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)])
            rule, verdict, domain = [], [], []
            for i, (keys, doms) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist())):
                got = ok[ends[i] : ends[i + 1]]
                n = len(keys)
                k = next((j for j in range(n) if got[j]), None)
                d = next((j for j in range(len(doms)) if got[2 * n + j]), None)
                rule.append(None if k is None else keys[k])
                domain.append(None if d is None else doms[d])
                verdict.append(("allow" if got[n + k] else "block") if k is not None else "block" if d is not None else "allow")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(domain, pa.string())], names=["page_id", "host", "path", "rule", "verdict", "domain"])

    return base.select("page_id", "host", "path", "keys", "doms", "hs").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, domain string")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _fits(host: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}'))"


ORACLE = f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, coalesce(rest, '') AS rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM a),
c AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_fits(h)} AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))} END AS rule,
  CASE {" ".join(f"WHEN {_fits(d)} THEN '{d}'" for d in DOMAINS)} END AS domain FROM c)
SELECT page_id, host, path, rule,
  CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in RULES)} WHEN domain IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, domain
FROM d
"""
