"""Tolerant JSON extraction, value alignment and fuzzy titles: what needs a scan of the text, as Arrow-batched functions."""

from __future__ import annotations

import json
import re
import unicodedata
from difflib import SequenceMatcher
from html import unescape

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

_OPENERS = {"{": "}", "[": "]"}


def balanced_object(text: str | None) -> str | None:
    """The first balanced JSON object in a text (fences and prose around it are passed over); null if there is none."""
    s, at = text or "", 0
    while (at := s.find("{", at)) >= 0:
        depth, quoted, skip = 0, False, False
        for k in range(at, len(s)):
            c = s[k]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    try:
                        return json.dumps(json.loads(s[at : k + 1]), sort_keys=True, ensure_ascii=False)
                    except ValueError:
                        break
        at += 1
    return None


def repaired_object(text: str | None, most: int = 2) -> str | None:
    """Like balanced_object, adding up to `most` closing brackets that are only missing at the end; closers that don't match are refused."""
    if (found := balanced_object(text)) is not None:
        return found
    start = (text or "").find("{")
    s = (text or "")[start:].strip() if start >= 0 else ""
    stack, quoted, skip = [], False, False
    for c in s:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in _OPENERS:
            stack.append(_OPENERS[c])
        elif c in _OPENERS.values():
            if not stack or c != stack.pop():
                return None
    if quoted or not 1 <= len(stack) <= most:
        return None
    try:
        found = json.loads(s + "".join(reversed(stack)))
    except ValueError:
        return None
    return json.dumps(found, sort_keys=True, ensure_ascii=False) if isinstance(found, dict) else None


# Greek letters by name.
_GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "θ": "theta", "λ": "lambda", "μ": "mu", "π": "pi", "σ": "sigma", "ω": "omega"}


def title_key(text: str | None) -> str:
    """Lower case without tags; entities, LaTeX accents and commands decoded, Greek letters by name, accents folded; letters and digits with single spaces."""
    low = re.sub(r"<[^>]+>", " ", unescape(text or "").lower())
    low = re.sub(r"\\[\"'`^~=.]\{?([a-z])\}?", r"\1", low)
    low = re.sub(r"\\([a-z]+)", r" \1 ", low)
    low = "".join(f" {_GREEK[c]} " if c in _GREEK else c for c in low)
    folded = unicodedata.normalize("NFKD", low).encode("ascii", "ignore").decode()
    return " ".join(re.findall(r"[a-z0-9]+", folded))


@pandas_udf(StringType())
def json_object(text: pd.Series) -> pd.Series:
    return text.map(balanced_object)


@pandas_udf(StringType())
def json_object_repaired(text: pd.Series) -> pd.Series:
    return text.map(repaired_object)


@pandas_udf(StringType())
def normalized_title(text: pd.Series) -> pd.Series:
    return text.map(title_key)


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters of two titles in longest matching blocks."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])
