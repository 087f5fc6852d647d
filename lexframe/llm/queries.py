"""Loads the operators; their queries and SQL."""
from __future__ import annotations

from . import (bpe, collocations, embed_dedup, exact_dedup, fill_middle, line_dedup, ngram_join, packing,  # noqa: F401
               quality_model, quality_rules, suffix_dedup, toxicity, warc)
from .registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
