"""The queries and SQL of every operator here."""

from __future__ import annotations

from . import bpe, chat, exact_dedup, kdtree, lm_scoring, packing, pii, simhash, toxicity, urls

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (bpe, packing, exact_dedup, simhash, urls, chat, kdtree, toxicity, pii, lm_scoring):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
