"""Registered queries, one module per family; each has QUERIES (name -> function) and SQL (name -> oracle)."""

from __future__ import annotations

from . import answers, checks, claims, contracts, evaluation, grounding, labels, levels, matching, objects, pages, predictions, records, relevance, retrieval, slots, standardizing, texts

_MODULES = (retrieval, texts, labels, records, evaluation, grounding, pages, matching, answers, claims, contracts, predictions, slots, objects, standardizing, checks, relevance, levels)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in _MODULES for k, q in m.SQL.items()}
ENTRY = QUERIES["bm25_topk"]
