"""All queries of the analytics part and their SQL."""

from __future__ import annotations

from importlib import import_module

PARTS = ("kernel_queries", "annotation_queries", "quantify_queries", "assay_queries", "extra_queries", "pipeline_queries", "reference_queries")


def queries() -> dict:
    return {k: v for part in PARTS for k, v in import_module(f".{part}", __package__).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in import_module(f".{part}", __package__).SQL.items()}
