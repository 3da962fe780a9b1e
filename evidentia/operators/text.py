"""Tokenizers and text normalisers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def counted(words: Column) -> Column:
    """Each different word of an array, sorted, with how often it is there, as structs of term and n: what grouping exploded words gives, within the row."""
    bound = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731 - value is made once, however often f names it
    ends = lambda s: F.filter(F.transform(s, lambda x, i: F.struct(x.alias("term"), (i + 1).alias("end"))), lambda e: ~e["term"].eqNullSafe(F.get(s, e["end"])))
    runs = lambda e: F.transform(e, lambda x, i: F.struct(x["term"].alias("term"), (x["end"] - F.when(i > 0, F.get(e, i - 1)["end"]).otherwise(0)).cast("long").alias("n")))
    return bound(bound(F.sort_array(words), ends), runs)
