"""Statistics of a text as built-in column expressions: no Python runs for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, words

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8


def _dropped(text: Column, letters: str) -> Column:
    """How many characters of the text are among ``letters``."""
    return F.length(text) - F.length(F.translate(text, letters, ""))


def repeated_words(w: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words covered by windows that occur twice or more in the text, the first occurrence included.

    Windows are compared by 64-bit hashes of their words. Only texts that have an equal pair of hashes
    pay for sorting (hash, position); the others stop at a set-size comparison.
    """

    def covered(h: Column) -> Column:
        at = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))

        def positions(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)) | ((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])))
            return F.sort_array(F.transform(twice, lambda x: x["p"]))

        def span(p: Column) -> Column:
            step = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
            return F.aggregate(step, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(F.sort_array(at), positions), span))

    def hashes(one: Column) -> Column:
        starts = F.slice(one, 1, F.greatest(F.size(one) - (window - 1), F.lit(0)))
        return F.transform(starts, lambda _, i: F.xxhash64(F.slice(one, i + 1, window)))

    return let(let(F.transform(w, lambda x: F.xxhash64(x)), hashes), covered)


def with_stats(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id and the statistics of each whole text; a null text counts as an empty one.

    With ``whole``, ``row`` holds all columns of docs as a struct, whatever their names.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as the quality rules define them, and
    n_upper, n_marks, n_digits, n_lines, n_distinct (different words) besides.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    base = docs.select(F.col("doc_id"), t.alias("t"), *row).withColumn("w", words(F.col("t")))
    t, w = F.col("t"), F.col("w")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    out = [
        F.col("doc_id"),
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        _dropped(t, SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"), F.size(x).cast("long").alias("n"))).alias("l"),
        repeated_words(w).cast("long").alias("n_repeat_words"),
        _dropped(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        _dropped(t, "!?").cast("long").alias("n_marks"),
        _dropped(t, "0123456789").cast("long").alias("n_digits"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
    ]
    got = base.select(*out, *(["row"] if whole else []))
    return got.select(*(["row"] if whole else []), "doc_id", "n_words", "word_chars", "n_symbols", F.col("l.d").alias("n_dup_lines"), "n_repeat_words", "n_upper", "n_marks", "n_digits", F.col("l.n").alias("n_lines"), "n_distinct")
