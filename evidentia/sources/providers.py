"""What comes from outside: document fetchers, parsers, rerankers and answer models, behind one interface.

Each has an offline default without any network. A provider maps a batch of texts to a batch of results; results are
kept by content, so a row is never asked twice.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Scorer(Protocol):
    def __call__(self, queries: list[str], documents: list[str]) -> list[float]: ...


def token_f1_scorer(queries: list[str], documents: list[str]) -> list[float]:
    """Offline reranker: F1 of token sets."""
    import re

    out = []
    for q, d in zip(queries, documents, strict=True):
        a, b = set(re.findall(r"[a-z0-9]+", q.lower())), set(re.findall(r"[a-z0-9]+", d.lower()))
        out.append(2.0 * len(a & b) / (len(a) + len(b)) if a and b else 0.0)
    return out


def first_sentence_answer(prompts: list[str]) -> list[str]:
    """Offline answer model: the first line of evidence as JSON."""
    return [json.dumps({"answer": {"freeform": {"text": p.strip().split("\n")[-1][:200]}}}) for p in prompts]


#: Providers by kind and name.
REGISTRY: dict[str, dict[str, Callable]] = {"scorer": {"token_f1": token_f1_scorer}, "answer": {"first_sentence": first_sentence_answer}, "parser": {}, "fetcher": {}}


def register(kind: str, name: str, provider: Callable) -> None:
    REGISTRY[kind][name.strip().lower().replace("-", "_")] = provider


def provider(kind: str, name: str) -> Callable:
    key = name.strip().lower().replace("-", "_")
    if key not in REGISTRY[kind]:
        raise ValueError(f"no {kind} named {name}; there are {sorted(REGISTRY[kind])}")
    return REGISTRY[kind][key]


def score_pairs(pairs: DataFrame, scorer: Scorer, *, query: str = "query", document: str = "document", cache: DataFrame | None = None, template: str = "v1") -> DataFrame:
    """pairs with pair_key and score. Equal pairs are asked once; those in cache (pair_key, score) not at all."""
    keyed = pairs.withColumn("pair_key", F.sha2(F.concat_ws("\x1f", F.lit(template), F.coalesce(query, F.lit("")), F.coalesce(document, F.lit(""))), 256))
    todo = keyed.select("pair_key", F.col(query).alias("q"), F.col(document).alias("d")).dropDuplicates(["pair_key"])
    if cache is not None:
        todo = todo.join(cache, "pair_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"pair_key": b["pair_key"], "score": scorer(b["q"].fillna("").tolist(), b["d"].fillna("").tolist())})

    scored = todo.mapInPandas(run, "pair_key string, score double")
    if cache is not None:
        scored = scored.unionByName(cache.select("pair_key", "score"))
    return keyed.join(scored, "pair_key", "left")


def fetch_status(body: bytes | None, content_type: str | None) -> tuple[bool, str]:
    """Whether a fetched body is a PDF, by type or first bytes, and its SHA-256."""
    ok = bool(body) and ("application/pdf" in (content_type or "").lower() or body[:4] == b"%PDF")
    return ok, hashlib.sha256(body or b"").hexdigest()
