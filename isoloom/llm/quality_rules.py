"""Quality rules: base limits and a decision list learned by sequential covering.

Rules for rejecting are grown one conjunction at a time on two thirds of a bounded sample of labelled
statistics, pruned on the other third, and emitted as one ordered Spark CASE expression. Only the sample's
numbers (at most ``SAMPLE`` rows) reach the driver; every text is judged by built-in column functions.

Cases: a null or empty text has no words and fails the base limits; repeated rows are judged alike, one
result row each; no usable labels give an empty list, which keeps what the base limits keep; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import label_of, table
from .text_stats import with_stats

#: Labelled rows that the list is fitted on, at most.
SAMPLE = 12_000
MIN_WORDS, REPEAT_SHARE = 20, 30
#: A rule stays if, on rows it was not grown on, this share of what it rejects is labelled bad.
PRECISION = 0.8
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 3, 40

#: Ratios that conditions test; each is null-free and 0 for an empty text.
FEATURES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "word_length": ("word_chars", "n_words"),
}


def feature(name: str) -> Column:
    over, under = FEATURES[name]
    return F.col(over).cast("double") / F.greatest(F.col(under), F.lit(1)).cast("double")


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def on(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.cut if self.above else x[self.name] <= self.cut

    def column(self) -> Column:
        return feature(self.name) >= self.cut if self.above else feature(self.name) <= self.cut


@dataclass
class DecisionList:
    """Ordered conjunctions that reject; what none of them fits is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self) -> Column:
        """1 on the first rule that fits and so on; 0 if none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            test = rule[0].column()
            for c in rule[1:]:
                test = test & c.column()
            out = F.when(test, k) if out is None else out.when(test, k)
        return F.lit(0) if out is None else out.otherwise(0)


def _covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.on(x)
    return hit


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule, hit = [], np.ones(len(bad), bool)
    for _ in range(MAX_CONDITIONS):
        p0, n0 = (bad & hit).sum(), (~bad & hit).sum()
        if not n0 or not p0:
            break
        best, gain = None, 1e-9
        for name, v in x.items():
            for cut in np.unique(np.quantile(v[hit & bad], np.linspace(0, 1, CUTS))):
                for above in (True, False):
                    c = Condition(name, above, float(cut))
                    h = hit & c.on(x)
                    p, n = (bad & h).sum(), (~bad & h).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = c, g
        if best is None:
            break
        rule.append(best)
        hit &= best.on(x)
    return rule


def _prune(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[list[Condition], float, int]:
    """The prefix with the best (p - n) / (p + n) on rows that growing did not see."""
    best, worth, share, seen = rule, -2.0, 0.0, 0
    for k in range(len(rule), 0, -1):
        hit = _covers(rule[:k], x, len(bad))
        p, n = int((bad & hit).sum()), int((~bad & hit).sum())
        if p + n and (v := (p - n) / (p + n + 2)) >= worth:
            best, worth, share, seen = rule[:k], v, p / (p + n), p + n
    return best, share, seen


def learn(rows: list, seed: int = 7) -> DecisionList:
    """Sequential covering over rows with the statistics and ``label`` (0: bad)."""
    if not rows:
        return DecisionList()
    value = {k: np.array([float(r[k]) for r in rows]) for k in {c for pair in FEATURES.values() for c in pair}}
    x = {k: value[a] / np.maximum(value[b], 1.0) for k, (a, b) in FEATURES.items()}
    bad = np.array([r["label"] == 0 for r in rows])
    fold = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left, out = np.ones(len(bad), bool), DecisionList()
    for _ in range(MAX_RULES):
        g, p = left & fold, left & ~fold
        if (bad & g).sum() < 5:
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g])
        if not rule:
            break
        rule, share, seen = _prune(rule, {k: v[p] for k, v in x.items()}, bad[p])
        if share < PRECISION or seen < 3:
            break
        out.rules.append(rule)
        left &= ~_covers(rule, x, len(bad))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    chosen = F.broadcast(label_of(labels, "quality", sample))
    stats = with_stats(docs.select("doc_id", "text").join(chosen.select("doc_id"), "doc_id", "left_semi")).join(chosen, "doc_id").where(F.col("n_words") > 0)
    names = sorted({c for pair in FEATURES.values() for c in pair})
    return learn(stats.orderBy(F.xxhash64("doc_id"), "doc_id").select("label", *names).limit(2 * sample).collect())


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Statistics, base_failed, rule (number of the rule that rejects, else 0) and kept for each document."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    return with_stats(docs).withColumn("base_failed", failed).withColumn("rule", rules.verdict()).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
