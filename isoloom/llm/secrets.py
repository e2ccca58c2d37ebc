"""Secret scans: fixed base patterns and probabilistic automata inferred from labelled credentials.

Labelled credentials are the values that the base patterns find in the corpus itself (at most ``PER_FORMAT`` different
ones of each kind, chosen by a hash over all documents) and, for formats that the corpus may lack, seeded examples of
publicly described ones (``published``). Ordinary tokens are those of at most ``ORDINARY_DOCS`` documents outside the
base spans, with seeded paths, dates and identifiers beside them.

The automata: all examples of a format form a prefix tree whose states hold counts of how often a class of characters
follows; states whose outgoing and final shares agree within a Hoeffding bound at level ``ALPHA`` are merged, shallow
ones first, so that loops stand for repetition. What is left is a deterministic probabilistic automaton per format, and
one for ordinary tokens. A candidate starts at any place of a run of token characters where a format may begin and ends
at the run's end or before one of ``+/_.=-``; it is a secret if a format accepts it, its length lies between half the
shortest and twice the longest example, and it beats the ordinary automaton by ``MARGIN`` nats a character. The longest
one from a place is taken, of the likeliest format, and the scan goes on behind it, so a run may hold several secrets.
A span inside a base span adds nothing and is left out.

Cases: a null or empty text has no spans and counts of 0; repeated rows are scanned alike, one result row each;
texts of any length are scanned whole; a corpus without credentials leaves the published formats, an empty table gives
no rows; only doc_id and text are read (``redact`` keeps the other columns, whatever their names).
"""

from __future__ import annotations

import hashlib
import math
import re
import string
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freeing, give_back, stored, table

# The base patterns; the least lengths are part of the last two.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("passw", "secret", "token", "api")
LEAST_VALUE = 6

#: Code points of the shortest candidate, as of the shortest value of the base patterns.
LEAST_TOKEN, SEPARATORS = LEAST_VALUE, "+/_.=-"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
ALPHA, MARGIN, SEED = 0.05, 0.6, 20
#: Examples of a format, documents that give ordinary tokens, and such tokens, at most; fewer examples than ``FEW`` make
#: no automaton.
PER_FORMAT, ORDINARY_DOCS, ORDINARY_TOKENS, FEW = 300, 400, 2_400, 12
BASE_KINDS = ("assign", "access", "hex")


# ---- labelled credentials -------------------------------------------------------------------------------


def published(seed: int = SEED, each: int = PER_FORMAT) -> dict[str, list[str]]:
    """Seeded examples by format; ``ordinary`` holds what is no credential."""
    r = np.random.default_rng(seed)
    pick = lambda letters, n: "".join(r.choice(list(letters), n))
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    mixed = low + up + dig
    made = {
        "github": lambda: r.choice(["ghp_", "gho_", "ghs_"]) + pick(mixed, 36),
        "slack": lambda: r.choice(["xoxb-", "xoxp-"]) + pick(dig, 12) + "-" + pick(dig, 12) + "-" + pick(mixed, 24),
        "stripe": lambda: r.choice(["sk_live_", "rk_live_", "sk_test_"]) + pick(mixed, 24),
        "google": lambda: "AIza" + pick(mixed + "-_", 35),
        "jwt": lambda: "eyJ" + pick(mixed, 33) + ".eyJ" + pick(mixed, 60) + "." + pick(mixed + "-_", 43),
    }
    letters = "etaoinshrdlucmfwypvbgk"
    word = lambda lo, hi: pick(letters, int(r.integers(lo, hi)))
    plain = [
        lambda: word(8, 24),
        lambda: word(8, 24).capitalize() + ".",
        lambda: word(8, 24).upper(),
        lambda: "/".join(word(2, 8) for _ in range(r.integers(3, 6))),
        lambda: "_".join(word(2, 8) for _ in range(r.integers(3, 6))),
        lambda: "-".join(word(2, 8) for _ in range(r.integers(3, 6))),
        lambda: pick(dig, r.integers(6, 20)),
        lambda: ".".join(word(2, 10) for _ in range(r.integers(3, 5))),
        lambda: pick("-=_./+", 1) * int(r.integers(6, 60)),
        lambda: f"20{r.integers(10, 30)}-{r.integers(10, 13)}-{r.integers(10, 29)}/{word(4, 12)}.html",
        lambda: ".".join(str(int(r.integers(1, 255))) for _ in range(4)),
        lambda: f"{word(3, 9)}{r.integers(0, 99)}.{word(3, 9)}.com",
    ]
    out = {k: [str(f()) for _ in range(each)] for k, f in made.items()}
    out["ordinary"] = [plain[k % len(plain)]() for k in range(4 * each)]
    return out


def values(text: str) -> list[tuple[str, str]]:
    """(kind, value) of the base patterns in a text: what an assignment names, whole access keys and hexadecimal runs."""
    out = []
    for s, k, e in base_spans(text):
        out.append((BASE_KINDS[k], ASSIGN.match(text, s).group(2) if k == 0 else text[s:e]))
    return out


def ordinary_tokens(text: str) -> list[str]:
    """Candidates of a text that touch no base span."""
    spans = base_spans(text)
    return [m.group() for m in CANDIDATE.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e in spans)]


def labelled(docs: DataFrame) -> dict[str, list[str]]:
    """Examples by format, from the corpus and as published. Whole texts stay on executors."""
    hint = F.lower("text").rlike("passw|secret|token|api") | F.col("text").rlike("AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = {v for t in pdf["text"] for v in values(t)}
            yield pd.DataFrame(sorted(got), columns=["kind", "value"])

    every = stored(rows.where(hint).select("text").mapInPandas(freeing(found), "kind string, value string").distinct(), "credentials")
    out: dict[str, list[str]] = {}
    for kind in BASE_KINDS:
        got = every.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(PER_FORMAT).collect()
        if len(got) >= FEW:
            out[f"like_{kind}"] = sorted(r["value"] for r in got)
    ids = rows.where("doc_id IS NOT NULL AND length(text) > 0").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(ORDINARY_DOCS)

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"value": sorted({x for t in pdf["text"] if isinstance(t, str) for x in ordinary_tokens(t)})}, dtype=object)

    tokens = rows.join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInPandas(plain, "value string").distinct().orderBy(F.xxhash64("value"), "value").limit(ORDINARY_TOKENS).collect()
    made = published()
    ordinary = made.pop("ordinary") + sorted(r["value"] for r in tokens)
    return out | made | {"ordinary": ordinary}


# ---- automata --------------------------------------------------------------------------------------------


def _classes() -> dict[str, int]:
    """Character -> symbol: one class each for upper and lower case letters and digits after a format's prefix."""
    return {c: (0 if c in string.ascii_lowercase else 1 if c in string.ascii_uppercase else 2 if c in string.digits else 3 + "+/_.=-".index(c)) for c in string.ascii_letters + string.digits + "+/_.=-"}


@dataclass
class Automaton:
    """Deterministic and probabilistic: moves[state][character] = (state, log p); ends[state] = log p of ending."""

    moves: list[dict[str, tuple[int, float]]]
    ends: list[float]
    floor: float
    shortest: int = 0
    longest: int = 1 << 30

    def log_likelihood(self, token: str) -> tuple[float, bool]:
        """Sum of the log probabilities, and whether every move exists and the last state may end."""
        at, total, whole, moves, floor = 0, 0.0, True, self.moves, self.floor
        for c in token:
            step = moves[at].get(c)
            if step is None:
                total += floor
                whole = False
                continue
            at = step[0]
            total += step[1]
        return total + self.ends[at], whole and self.ends[at] > self.floor


def infer(samples: list[str], alpha: float = ALPHA) -> Automaton:
    """State merging over the prefix tree of the samples (red and blue states, breadth first)."""
    kind = _classes()
    # a leading character that most samples agree on stays itself; others become their class
    heads = [{s[i] for s in samples if i < len(s)} for i in range(8)]
    fixed = next((i for i, h in enumerate(heads) if len(h) > 4), len(heads))
    sym = lambda i, c: ("=", c) if i < fixed else ("~", kind.get(c, 9))
    go: list[dict] = [{}]
    num, end = [0], [0]
    for s in samples:
        at = 0
        num[0] += 1
        for i, c in enumerate(s):
            k = sym(i, c)
            if k not in go[at]:
                go[at][k] = [len(go), 0]
                go.append({})
                num.append(0)
                end.append(0)
            go[at][k][1] += 1
            at = go[at][k][0]
            num[at] += 1
        end[at] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1, n1, f2, n2):
        return n1 and n2 and abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a, b):
        todo, met = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if (a, b) in met:
                continue
            met.add((a, b))
            if differ(end[a], num[a], end[b], num[b]):
                return False
            for k in {*go[a], *go[b]}:
                x, y = go[a].get(k), go[b].get(k)
                if differ(x[1] if x else 0, num[a], y[1] if y else 0, num[b]):
                    return False
                if x and y and x[0] != y[0]:
                    todo.append((x[0], y[0]))
        return True

    def fold(a, b):
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            num[a] += num[b]
            end[a] += end[b]
            for k, (to, n) in go[b].items():
                if k in go[a]:
                    go[a][k][1] += n
                    todo.append((go[a][k][0], to))
                else:
                    go[a][k] = [to, n]

    red, blue = [0], []
    while True:
        blue = [(r, k) for r in red for k in go[r] if go[r][k][0] not in red]
        if not blue:
            break
        r, k = max(blue, key=lambda x: go[x[0]][x[1]][1])
        b = go[r][k][0]
        # states inside the fixed head never merge: they spell the prefix
        home = next((q for q in red if not any(s[0] == "=" for s in [*go[q], *go[b]]) and compatible(q, b)), None)
        if home is None:
            red.append(b)
        else:
            go[r][k][0] = home
            fold(home, b)
    place = {q: i for i, q in enumerate(red)}
    # the letters of a class that a format uses, all of the class where there is too little to tell
    shown = {c for s in samples for c in s[fixed:]}
    if sum(map(len, samples)) >= 1000:
        kind = {c: k for c, k in kind.items() if c in shown}
    size = {c: sum(1 for x in kind.values() if x == c) for c in set(kind.values())}
    floor = math.log(1e-4)
    moves, ends = [], []
    for q in red:
        total = num[q] + 1.0
        out: dict[str, tuple[int, float]] = {}
        for (how, c), (to, n) in go[q].items():
            for ch in [c] if how == "=" else [x for x, v in kind.items() if v == c]:
                p = n / total / (1 if how == "=" else size[c])
                if ch not in out or out[ch][1] < math.log(p):
                    out[ch] = (place[to], math.log(p))
        moves.append(out)
        ends.append(math.log(end[q] / total) if end[q] else floor)
    lengths = [len(s) for s in samples]
    return Automaton(moves, ends, floor, max(LEAST_TOKEN, min(lengths) // 2), 2 * max(lengths))


@lru_cache(maxsize=2)
def automata(seed: int = SEED) -> dict[str, Automaton]:
    """Those of the published formats alone."""
    return {k: infer(v) for k, v in published(seed).items()}


def fit(docs: DataFrame) -> dict[str, Automaton]:
    """The automata of a corpus: a few hundred examples a format, so a few hundred states in all."""
    return learn(labelled(docs))


def learn(examples: dict[str, list[str]]) -> dict[str, Automaton]:
    """An automaton for each format. The corpus's ordinary tokens may hold credentials without a keyword; those that a
    format claims against the published ordinary tokens alone teach the ordinary automaton nothing."""
    grammars = {k: infer(v) for k, v in examples.items() if k != "ordinary"}
    first = Scanner(grammars | {"ordinary": automata()["ordinary"]})
    return grammars | {"ordinary": infer([t for t in examples["ordinary"] if not first.grammar_spans(t)])}


def best_format(token: str, grammars: dict[str, Automaton]) -> str | None:
    """The format with the greatest likelihood, if it accepts the token and beats ordinary text."""
    plain = grammars["ordinary"].log_likelihood(token)[0]
    best, top = None, plain + MARGIN * len(token)
    for name, a in grammars.items():
        if name == "ordinary":
            continue
        got, whole = a.log_likelihood(token)
        if whole and got > top:
            best, top = name, got
    return best


# ---- scanning --------------------------------------------------------------------------------------------


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and non-overlapping for each kind, in order."""
    out = []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    small = text.lower()
    if any(h in small for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    return sorted(out)


def heads(grammars: dict[str, Automaton], n: int = LEAST_TOKEN) -> re.Pattern:
    """Finds every place where the first n characters may begin a format."""
    out = []
    for name, a in sorted(grammars.items()):
        at, sets = {0}, []
        for _ in range(n if name != "ordinary" else 0):
            sets.append("".join(sorted({re.escape(c) for q in at for c in a.moves[q]})))
            at = {to for q in at for to, _ in a.moves[q].values()}
        if sets and all(sets):
            out.append("".join(f"[{x}]" for x in sets))
    return re.compile(f"(?=(?:{'|'.join(out)}))")


class Scanner:
    """Remembers tokens that are no secret; bounded."""

    REMEMBERED = 100_000

    def __init__(self, grammars: dict[str, Automaton] | None = None):
        self.grammars = grammars or automata()
        self.formats = sorted(k for k in self.grammars if k != "ordinary")
        self.heads = heads(self.grammars)
        self.plain: set[str] = set()

    def longest(self, token: str, start: int, dead: set[tuple[str, int, int]]) -> tuple[int, str] | None:
        """(end, format) of the longest secret that begins at start; dead: (format, place, state) that lead to no end."""
        ends: list[tuple[int, float, str]] = []
        for name in self.formats:
            a = self.grammars[name]
            at, total, passed, found = 0, 0.0, [], False
            for k in range(start, len(token)):
                step = a.moves[at].get(token[k])
                if step is None or (name, k, step[0]) in dead:
                    break
                at = step[0]
                total += step[1]
                passed.append((name, k, at))
                if a.ends[at] > a.floor and (k + 1 == len(token) or token[k + 1] in SEPARATORS):
                    found = True
                    if a.shortest <= k + 1 - start <= a.longest:
                        ends.append((k + 1, total + a.ends[at], name))
            if not found:
                dead.update(passed)
        if not ends:
            return None
        plain, floor = self.grammars["ordinary"], self.grammars["ordinary"].floor
        at, total, beat = 0, 0.0, {}
        for k in range(start, max(ends)[0]):
            step = plain.moves[at].get(token[k])
            at, p = step if step else (at, floor)
            total += p
            beat[k + 1] = total + plain.ends[at] + MARGIN * (k + 1 - start)
        ends = [x for x in ends if x[1] > beat[x[0]]]
        if not ends:
            return None
        end, _, name = max(ends)
        return end, name

    def grammar_spans(self, text: str) -> list[tuple[int, str, int]]:
        out = []
        for m in CANDIDATE.finditer(text):
            token = m.group().rstrip(".=-/")
            if token in self.plain:
                continue
            at, any_, dead = 0, False, set()
            for h in self.heads.finditer(token):
                if h.start() >= at and len(token) - h.start() >= LEAST_TOKEN and (got := self.longest(token, h.start(), dead)):
                    at, any_ = got[0], True
                    out.append((m.start() + h.start(), got[1], m.start() + at))
            if not any_ and len(self.plain) < self.REMEMBERED:
                self.plain.add(token)
        return out

    def spans(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(base spans, all spans) as (kind, start, end); kinds in the order assign, access, hex, then formats."""
        text = text or ""
        base = base_spans(text)
        order = {k: i for i, k in enumerate([*BASE_KINDS, *self.formats])}
        every = sorted(base + [(s, order[k], e) for s, k, e in self.grammar_spans(text) if not any(x <= s and e <= y for x, _, y in base)])
        names = list(order)
        return [(names[k], s, e) for s, k, e in base], [(names[k], s, e) for s, k, e in every]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def mask(text: str, spans: list[tuple[str, int, int]], by: str = "<SECRET>") -> str:
    """The text with each run of overlapping spans replaced once."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], by]
        at = max(at, e)
    return "".join([*out, text[at:]])


_SCANNERS: dict[str, Scanner] = {}


def _scanner(name: str, grammars) -> Scanner:
    """One per worker and fit; older ones are let go."""
    if name not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[name] = Scanner(grammars.value)
    return _SCANNERS[name]


def scan(docs: DataFrame, grammars: dict[str, Automaton]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end) of each document."""
    shared, name = docs.sparkSession.sparkContext.broadcast(grammars), uuid.uuid4().hex  # some hundred states

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = _scanner(name, shared)
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                base, every = scanner.spans(t if isinstance(t, str) else "")
                n = [sum(1 for k, _, _ in base if k == kind) for kind in BASE_KINDS]
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(freeing(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, grammars: dict[str, Automaton]) -> DataFrame:
    """All columns of docs, each secret in text replaced, n_chars counted anew; a text without secrets stays."""
    shared, name = docs.sparkSession.sparkContext.broadcast(grammars), uuid.uuid4().hex

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        scanner = _scanner(name, shared)
        give_back()
        return pd.Series([mask(t, found) if isinstance(t, str) and (found := scanner.spans(t)[1]) else t for t in texts], dtype=object)

    out = docs.withColumn("text", masked(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
