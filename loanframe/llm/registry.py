"""Queries of this package and their SQL."""

from __future__ import annotations

from loanframe.llm import (
    alignment,
    hard_negatives,
    html_extract,
    license_scan,
    line_dedup,
    mixing,
    ngram_join,
    order_minhash,
    passage_dedup,
    pii,
    segmentation,
    toxicity,
    vector_dedup,
)

PARTS = (
    mixing, passage_dedup, segmentation, line_dedup, vector_dedup, license_scan, toxicity, ngram_join, html_extract,
    order_minhash, alignment, pii, hard_negatives,
)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
