"""Event filters over long assay rows (event_id, event_type, sample, condition, included, ... down_exc)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.locus import parse

#: Event types, and where each assay of the consistency test applies.
TYPES = ("IR", "MXE", "SE", "A3SS", "A5SS", "AFE", "ALE", "RI")
DATA = ("Depth", "Coverage", "Consistency")
ANNOTATION = ("Protein_Coding", "NMD", "TSL", "Terminus", "ExclusiveMXE")
WITH_INCLUDED, WITH_EXCLUDED = ("IR", "MXE", "SE", "RI"), ("MXE",)


@dataclass(frozen=True)
class EventFilter:
    """One filter; values out of range are clamped and unknown event types dropped."""

    kind: str = "Depth"
    pc_true: float = 100
    minimum: float = 20
    maximum: float = 1
    min_depth: float = 5
    by_condition: bool = False
    min_cond: int = -1
    types: tuple[str, ...] = TYPES

    def __post_init__(self):
        if self.kind not in DATA + ANNOTATION:
            raise ValueError(f"unknown filter: {self.kind}")
        for name, value in (("pc_true", min(100, max(0, self.pc_true))), ("minimum", max(0, self.minimum)), ("maximum", max(0, self.maximum)), ("min_depth", max(0, self.min_depth)), ("types", tuple(t for t in self.types if t in TYPES))):
            object.__setattr__(self, name, value)


def default_filters(legacy: bool = False) -> list[EventFilter]:
    out = [
        EventFilter("Depth", 80, 20),
        EventFilter("Coverage", 80, 90, min_depth=5, types=("IR", "RI")),
        EventFilter("Coverage", 80, 60, min_depth=20, types=("MXE", "SE", "AFE", "ALE", "A3SS", "A5SS")),
        EventFilter("Consistency", 80, maximum=2 if legacy else 1, min_depth=20, types=("MXE", "SE", "RI")),
    ]
    return out if legacy else [*out, EventFilter("Terminus"), EventFilter("ExclusiveMXE")]


def _row_passes(f: EventFilter) -> Column:
    c = F.col
    if f.kind == "Depth":
        return c("depth") >= f.minimum
    low = c("min_depth") < f.min_depth
    if f.kind == "Coverage":
        return low | (c("coverage") >= f.minimum / 100)
    # |log2(x + 1) - log2(y + 1)| < maximum, without logarithms, so that exact powers of two compare exactly
    near = lambda part, whole: F.greatest(c(part) + 1.0, c(whole) + 1.0) < 2.0**f.maximum * F.least(c(part) + 1.0, c(whole) + 1.0)
    inc = ~c("event_type").isin(*WITH_INCLUDED) | (near("up_inc", "included") & near("down_inc", "included"))
    exc = ~c("event_type").isin(*WITH_EXCLUDED) | (near("up_exc", "excluded") & near("down_exc", "excluded"))
    return low | (inc & exc)


def data_filter(assay: DataFrame, f: EventFilter) -> DataFrame:
    """(event_id, passed): enough samples pass, over all or in enough conditions (-1: in all)."""
    ok = F.avg(_row_passes(f).cast("double")) * 100 >= f.pc_true
    bypass = ~F.col("event_type").isin(*f.types) if f.types else F.lit(True)
    if not f.by_condition:
        got = assay.groupBy("event_id", "event_type").agg(ok.alias("passed"))
        return got.select("event_id", (bypass | F.col("passed")).alias("passed"))
    got = assay.groupBy("event_id", "event_type", "condition").agg(ok.alias("ok")).groupBy("event_id", "event_type").agg(F.count_if("ok").alias("k"), F.count("*").alias("n"))
    need = F.col("n") if f.min_cond < 0 else F.least(F.lit(f.min_cond), F.col("n"))
    return got.select("event_id", (bypass | (F.col("k") >= need)).alias("passed"))


def annotation_filter(rows: DataFrame, f: EventFilter) -> DataFrame:
    """(event_id, passed) from event rows with inc_/exc_ coding, nmd, tsl flags and terminus flags."""
    c, yes = F.col, lambda x: F.coalesce(F.col(x), F.lit(False))
    level = lambda x: F.coalesce(c(x).try_cast("int") <= int(f.minimum), F.lit(False))
    test = {
        "Protein_Coding": lambda: F.when(c("event_type") == "IR", yes("inc_coding")).otherwise(yes("inc_coding") | yes("exc_coding")),
        "NMD": lambda: F.coalesce(c("inc_nmd") != c("exc_nmd"), F.lit(False)),
        "TSL": lambda: level("inc_tsl") & level("exc_tsl"),
        "Terminus": lambda: F.when(c("event_type") == "AFE", yes("always_first")).when(c("event_type") == "ALE", yes("always_last")).otherwise(True),
    }[f.kind]()
    bypass = ~c("event_type").isin(*f.types) if f.types else F.lit(True)
    return rows.select("event_id", (bypass | test).alias("passed"))


def exclusive_mxe(mxe: DataFrame) -> DataFrame:
    """(event_id, passed): the two middle exons do not overlap. Columns a_start, a_end, b_start, b_end, strand."""
    return mxe.select("event_id", ((F.col("a_start") > F.col("b_end")) | (F.col("b_start") > F.col("a_end"))).alias("passed"))


def casette_exons(mxe: DataFrame) -> DataFrame:
    """(event_id, a_start, a_end, b_start, b_end): the exons between the two introns of each isoform of MXE events."""
    g = {n: parse(F.col(f"event{n}")) for n in ("1a", "2a", "1b", "2b")}
    between = lambda x, y: (F.least(g[x]["end"], g[y]["end"]) + 1, F.greatest(g[x]["start"], g[y]["start"]) - 1)
    a, b = between("1a", "2a"), between("1b", "2b")
    return mxe.select("event_id", a[0].alias("a_start"), a[1].alias("a_end"), b[0].alias("b_start"), b[1].alias("b_end"))


def apply_filters(assay: DataFrame, filters: Iterable[EventFilter], annotation: DataFrame | None = None, casettes: DataFrame | None = None) -> DataFrame:
    """event_id of the events that pass every filter; the assay is grouped once for all filters on whole samples.

    Filters on annotation need its table, ExclusiveMXE the middle exons of the MXE events (``casette_exons``); a filter
    without its table raises. Events that the table lacks pass ExclusiveMXE if they are of another type.
    """
    filters = list(filters)
    plain = [f for f in filters if f.kind in DATA and not f.by_condition]
    keys = assay.select("event_id", "event_type").distinct()
    if plain:
        keys = assay.groupBy("event_id", "event_type").agg(*[F.avg(_row_passes(f).cast("double")).alias(f"f{k}") for k, f in enumerate(plain)])
        tests = [(~F.col("event_type").isin(*f.types) if f.types else F.lit(True)) | (F.col(f"f{k}") * 100 >= f.pc_true) for k, f in enumerate(plain)]
        keys = keys.where(reduce(lambda a, b: a & b, tests))
    out = keys.select("event_id", "event_type")
    for f in filters:
        if f in plain:
            continue
        if f.kind == "ExclusiveMXE":
            if casettes is None:
                raise ValueError("the filter ExclusiveMXE needs the middle exons of the MXE events")
            if "MXE" in f.types:
                met = out.join(exclusive_mxe(casettes), "event_id", "left")
                out = met.where((F.col("event_type") != "MXE") | F.coalesce("passed", F.lit(False))).drop("passed")
            continue
        if f.kind in DATA:
            got = data_filter(assay, f)
        elif annotation is None:
            raise ValueError(f"the filter {f.kind} needs the events' annotation")
        else:
            got = annotation_filter(annotation, f)
        out = out.join(got.where("passed").select("event_id"), "event_id", "left_semi")
    return out.select("event_id")
