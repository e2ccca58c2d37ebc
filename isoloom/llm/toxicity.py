"""Toxicity by compression distance: two trained zstandard dictionaries and calibrated lengths.

A window is one word of the lower-cased running text with the blanks around it, without outer punctuation. A run of
more than ``LONG`` code points without a blank gives its parts between punctuation, and what is longer still gives
windows of ``SLIDE`` code points every half of that, so that any text is compared whole whatever its script.

The labelled documents (at most ``SAMPLE``) are split by a hash of their text. From two thirds of them come the
training samples: the toxic text is every window that toxic documents hold beyond chance, as often as they hold it,
the ordinary text the most frequent other windows. ``zstandard.train_dictionary`` makes a dictionary of each, and both
are loaded with their own entropy tables. Each window is compressed with both; a cell is how many bytes fewer the
toxic dictionary needs than the ordinary one, and how short it makes the window. The last third, which neither dictionary saw,
calibrates: what a cell is worth is its log odds of lying in toxic documents, made monotone in the bytes saved, and a
logistic curve over the best and the summed worth of a document's windows gives its score.

Counts of windows are taken on executors; the driver gets at most ``WINDOWS`` windows of each kind, a row per cell and
two numbers per calibration document. Every window of every whole text is scored.

Cases: a null or empty text holds no window and gets the score that the curve gives to no evidence; repeated
rows are scored alike, one result row each; a window that repeats in a document counts once; without labels of both
kinds the score is the share of label 1 (0 without any); an empty table gives no rows. Only doc_id and text are read,
so other columns may have any name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, label_of, stored, table

#: Labelled documents that the model is fitted on, and windows of each kind that dictionaries are trained on, at most.
SAMPLE, WINDOWS = 6_000, 20_000
TOXIC_BYTES, ORDINARY_BYTES, LEVEL = 65_536, 110_000, 3
#: Length of the segments that training looks for, and copies of a window that enter it at most.
SEGMENT, COPIES = 100, 2
#: Windows a worker remembers; what does not fit is compressed again.
REMEMBERED = 800_000
PUNCTUATION = " .,;:!?\"'()[]{}#*$%&|<>-_=+~`/\\"
#: Ends every window and both dictionaries: it compresses to the same few bytes everywhere, so that short windows are
#: never stored raw, and zstandard starts no match in a block's last bytes, which then are the tail's.
TAIL = bytes(range(128, 144))
LONG, SLIDE = 64, 24
PARTS = re.compile(r"[\W_]+")
#: Bytes saved beyond these are counted as these; a window that takes ``NEEDED`` bytes (the tail's among them) or more
#: was not shortened.
MOST_DIFFERENCE, MOST_SAVED, NEEDED = 8, 12, 24
#: Smallest window count of a cell in toxic documents, and least log odds, that make it evidence.
LEAST_SEEN, LEAST_ODDS = 3, 1.5


def windows(text: str) -> set[str]:
    """The different windows of a whole text."""
    out = {w.strip(PUNCTUATION) for w in set(text.lower().split())}
    out.discard("")
    for w in [w for w in out if len(w) > LONG]:
        out.remove(w)
        for p in PARTS.split(w):
            if len(p) > LONG:
                out.update(p[at : at + SLIDE] for at in range(0, len(p) - SLIDE // 2, SLIDE // 2))
            elif p:
                out.add(p)
    return out


def _plain(w: str) -> bytes:
    return f" {w} ".encode("utf-8", "surrogatepass")


def trained(counts: list[tuple[str, int]], size: int) -> bytes:
    """A zstandard dictionary trained on windows, each as often as it was counted; empty if there is too little text.

    Training fills half of the room at most and keeps few segments of a small text, so training windows that it left
    out follow behind its own content (the most frequent last) while there is room; its entropy tables stay.
    """
    samples = [_plain(w) for w, n in counts for _ in range(min(n, COPIES))]
    part = max(1024, min(size, sum(len(_plain(w)) for w, _ in counts)) // 2)
    try:
        made = zstandard.train_dictionary(part, samples, k=SEGMENT, d=8, level=LEVEL).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""
    if not made:
        return b""
    rest, room = [], size - len(made)
    for w, _ in reversed(counts):
        if room >= len(p := _plain(w)) and p not in made:
            rest.append(p)
            room -= len(p)
    return made + b"".join(reversed(rest))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    content = dictionary + TAIL
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=64, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


def _lengths(c: zstandard.ZstdCompressor, many: list[bytes]) -> np.ndarray:
    if not many:
        return np.empty(0, int)
    out = c.multi_compress_to_buffer(many)
    return np.fromiter((len(out[i]) for i in range(len(out))), int, len(out))


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    worth: dict[tuple[int, int], float]
    curve: tuple[float, float, float]

    def __post_init__(self):
        self._seen: dict[str, float] = {}
        self._pair = None

    def __getstate__(self):
        return (self.toxic, self.ordinary, self.worth, self.curve)

    def __setstate__(self, state):
        self.toxic, self.ordinary, self.worth, self.curve = state
        self.__post_init__()

    def cells(self, many: list[str]) -> list[tuple[int, int]]:
        """(bytes less than with the ordinary dictionary, bytes less than ``NEEDED``) of each window, by the toxic one."""
        if not self.toxic or not self.ordinary or not many:
            return [(0, 0)] * len(many)
        if self._pair is None:
            self._pair = _compressor(self.toxic), _compressor(self.ordinary)
        raw = [_plain(w) + TAIL for w in many]
        t, o = (_lengths(c, raw) for c in self._pair)
        difference, saved = np.clip(o - t, 0, MOST_DIFFERENCE), np.clip(NEEDED - t, 0, MOST_SAVED)
        return list(zip(difference.tolist(), saved.tolist()))

    def evidence(self, texts: Iterable[str | None]) -> list[tuple[float, float]]:
        """(best, logarithm of one plus the summed) worth of all windows of each text."""
        sets = [windows(t or "") for t in texts]
        new = list({w for s in sets for w in s if w not in self._seen})
        fresh = dict(zip(new, (self.worth.get(c, 0.0) for c in self.cells(new))))
        if len(self._seen) + len(fresh) <= REMEMBERED:
            self._seen.update(fresh)
            get = self._seen.__getitem__
        else:
            seen = self._seen
            get = lambda w: fresh[w] if w in fresh else seen[w]
        out = []
        for s in sets:
            v = [x for x in map(get, s) if x]
            out.append((max(v, default=0.0), math.log1p(sum(v))))
        return out

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        got = np.array(self.evidence(texts), dtype=float).reshape(-1, 2)
        a, b, c = self.curve
        return 1.0 / (1.0 + np.exp(-(a + b * got[:, 0] + c * got[:, 1])))


def beyond_chance(hit: dict[str, int], every: dict[str, int], n1: int, n0: int, many: int) -> list[tuple[str, int]]:
    """Windows that toxic documents hold beyond chance (one false one of ``many`` expected), with how many hold them,
    the most frequent last: nearest to the window that is compressed."""
    share, out = n1 / (n1 + n0), []
    for w, a in hit.items():
        n = every[w]
        if a < 3 or a <= n * share:
            continue
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share)) for k in range(a, min(n, a + 60) + 1))
        if tail * many < 1:
            out.append((w, a))
    return sorted(out, key=lambda x: (x[1], x[0]))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w, one = np.zeros(x.shape[1] + 1), np.column_stack([np.ones(len(x)), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        h = (one * (p * (1 - p))[:, None]).T @ one + np.eye(len(w)) * 1e-2
        w += np.linalg.solve(h, one.T @ (y - p) - 1e-2 * w)
    return w


def without_evidence(n1: int, n0: int) -> Model:
    prior = min(max(n1 / (n1 + n0) if n1 + n0 else 0.0, 1e-6), 1 - 1e-6)
    return Model(b"", b"", {}, (math.log(prior / (1 - prior)), 0.0, 0.0))


def calibrated(toxic: dict[tuple[int, int], int], ordinary: dict[tuple[int, int], int], m1: int, m0: int) -> dict[tuple[int, int], float]:
    """Worth of the cells from the documents of each label that hold them, out of m1 and m0 unseen ones.

    A cell takes in those that save at least as much on both counts where it is seen too seldom itself, and is worth no
    less than any cell that saves no more."""
    worth: dict[tuple[int, int], float] = {}
    for d in range(1, MOST_DIFFERENCE + 1):
        for s in range(1, MOST_SAVED + 1):
            a, b = toxic.get((d, s), 0), ordinary.get((d, s), 0)
            if a + b < LEAST_SEEN:
                a = sum(n for (x, y), n in toxic.items() if x >= d and y >= s)
                b = sum(n for (x, y), n in ordinary.items() if x >= d and y >= s)
            odds = math.log((a + 0.5) / (m1 + 1)) - math.log((b + 0.5) / (m0 + 1)) if a >= LEAST_SEEN else 0.0
            best = max(odds, worth.get((d - 1, s), 0.0), worth.get((d, s - 1), 0.0))
            if best >= LEAST_ODDS:
                worth[d, s] = min(best, 6.0)
    return worth


def finished(model: Model, evidence: list[tuple[float, float]], labels: list[int]) -> Model:
    """The model with its curve."""
    if len(set(labels)) < 2:
        return model
    model.curve = tuple(float(v) for v in _logistic(np.array(evidence, float), np.array(labels, float)))
    model.__post_init__()
    return model


def for_dictionaries(text: str) -> bool:
    """Whether a document trains the dictionaries; the others calibrate."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % 3 != 0


def learn(rows: list[tuple[str | None, int]]) -> Model:
    """The model of (text, label) rows in memory."""
    rows = sorted({(t or "", int(y)) for t, y in rows})
    part = [[(windows(t), y) for t, y in rows if for_dictionaries(t)], [(t, y) for t, y in rows if not for_dictionaries(t)]]
    n = [sum(1 for _, y in part[0] if y == k) for k in (0, 1)]
    if not min(n):
        return without_evidence(sum(y for _, y in rows), sum(1 - y for _, y in rows))
    hit, every = Counter(), Counter()
    for s, y in part[0]:
        every.update(s)
        if y:
            hit.update(s)
    model = dictionaries(hit, every, {w: n - hit[w] for w, n in every.items()}, n[1], n[0], len(hit))
    held = [Counter(), Counter()]
    for t, y in part[1]:
        held[y].update(set(model.cells(list(windows(t)))))
    m = [sum(1 for _, y in part[1] if y == k) for k in (0, 1)]
    model.worth = calibrated(held[1], held[0], m[1], m[0])
    return finished(model, model.evidence([t for t, _ in part[1]]), [y for _, y in part[1]])


def dictionaries(hit: dict[str, int], every: dict[str, int], miss: dict[str, int], n1: int, n0: int, many: int) -> Model:
    """Both dictionaries from counts of documents that hold a window: toxic ones, all, and ordinary ones."""
    chosen = beyond_chance(hit, every, n1, n0, many)
    names = {w for w, _ in chosen}
    frequent = sorted(((w, n) for w, n in miss.items() if w not in names and n), key=lambda x: (-x[1], x[0]))[:WINDOWS]
    return Model(trained(chosen, TOXIC_BYTES), trained(frequent[::-1], ORDINARY_BYTES), {}, without_evidence(n1, n0).curve)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The same from tables; texts stay on executors."""
    chosen = F.broadcast(label_of(labels, "toxic", sample))  # at most ``sample`` ids
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "label").distinct()
    rows = stored(rows, "labelled")

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"]):
                if for_dictionaries(text):
                    w = ["", *windows(text)]  # the empty one counts documents
                    yield pd.DataFrame({"w": w, "y": label})

    counts = rows.mapInPandas(held, "w string, y int").groupBy("w").agg(F.sum("y").alias("hit"), F.count("*").alias("n"))
    counts = stored(counts, "windows")
    total = counts.where("w = ''").first()
    n1, n0 = (int(total["hit"]), int(total["n"] - total["hit"])) if total else (0, 0)
    if not n1 or not n0:
        both = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
        return without_evidence(int(both[0]), int(both[1] - both[0]))
    counts = counts.where("w <> ''")
    many = counts.where("hit > 0").count()
    share = n1 / (n1 + n0)
    often = counts.where((F.col("hit") >= 3) & (F.col("hit") > F.col("n") * share)).orderBy(F.desc("hit"), "w").limit(WINDOWS).collect()
    plain = counts.where("n > hit").withColumn("miss", F.col("n") - F.col("hit")).orderBy(F.desc("miss"), "w").limit(2 * WINDOWS).collect()
    model = dictionaries({r["w"]: r["hit"] for r in often}, {r["w"]: r["n"] for r in often}, {r["w"]: r["miss"] for r in plain}, n1, n0, many)
    first = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries: under 100 kB

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = first.value
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"]):
                if not for_dictionaries(text):
                    c = sorted(set(model.cells(list(windows(text)))) | {(-1, -1)})  # which counts documents
                    yield pd.DataFrame({"d": [x for x, _ in c], "s": [x for _, x in c], "y": label})

    cells = rows.mapInPandas(measured, "d int, s int, y int").groupBy("d", "s", "y").agg(F.count("*").alias("n")).collect()
    held_by = [{(r["d"], r["s"]): r["n"] for r in cells if r["y"] == k} for k in (0, 1)]
    m = [held_by[k].pop((-1, -1), 0) for k in (0, 1)]
    model.worth = calibrated(held_by[1], held_by[0], m[1], m[0])
    second = docs.sparkSession.sparkContext.broadcast(model)

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = second.value
        for pdf in batches:
            pdf = pdf[[not for_dictionaries(t) for t in pdf["text"]]]
            got = np.array(model.evidence(pdf["text"]), float).reshape(-1, 2)
            yield pd.DataFrame({"best": got[:, 0], "all": got[:, 1], "y": pdf["label"].to_numpy()})

    got = sorted(tuple(r) for r in rows.mapInPandas(weighed, "best double, all double, y int").collect())  # at most ``sample`` rows of numbers
    return finished(model, [x[:2] for x in got], [x[2] for x in got])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries and a table of cells: under 100 kB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            for at in range(0, max(len(pdf), 1), 256):
                part = pdf.iloc[at : at + 256]
                s = model.scores([t if isinstance(t, str) else "" for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": s})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    got = rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
