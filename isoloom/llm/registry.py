"""The queries of this folder and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module that holds a function of that name.
MODULES = {
    "op1_toxicity": "toxicity",
    "op2_url_filter": "url_filter",
    "op3_quality_rules": "quality_rules",
    "op4_token_files": "token_files",
    "op5_bpe_lexicon": "bpe_lexicon",
    "op6_mixing": "mixing",
    "op7_secret_scans": "secrets",
    "op8_quality_classifier": "quality_pu",
    "op9_embedding_dups": "embedding_dups",
    "op10_ngram_jaccard_join": "near_dups",
}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from .url_filter import ORACLE

    return {"op2_url_filter": ORACLE}
