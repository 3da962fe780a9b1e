"""Tables: pipe text and spanned cells to columns and rows, and answers fitted to a schema."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_TABLE = StructType([StructField("columns", ArrayType(StringType())), StructField("rows", ArrayType(ArrayType(StringType())))])


def spread(cells: list[str], width: int) -> list[str]:
    """cells stretched over width columns as evenly as whole columns allow, the later ones wider."""
    if len(cells) >= width:
        return cells[:width]
    out: list[str] = []
    for k, cell in enumerate(cells):
        out += [cell] * max(1, (width - len(out)) // (len(cells) - k))
    return (out + [""] * width)[:width]


def parse_pipe_table(text: str | None) -> dict | None:
    """Columns and rows of the pipe table in a text; header rows are those before the first row with a number. None without rows."""
    rows = []
    for line in (text or "").splitlines():
        line = line.strip()
        if line.count("|") < 2:
            continue
        cells = [re.sub(r"\s+", " ", c).strip() for c in re.sub(r"^\||\|$", "", line).split("|")]
        if len(cells) >= 2 and not all(re.fullmatch(r":?-{2,}:?", c.replace(" ", "")) for c in cells):
            rows.append(cells)
    if not rows:
        return None
    sizes = [len(r) for r in rows]
    width = max(set(sizes), key=lambda n: (sizes.count(n), n))
    first = next((k for k, r in enumerate(rows) if any(re.search(r"\d", c) for c in r[1:])), 1)
    heads = [spread(r if k == 0 or len(r) != width - 1 else ["", *r], width) for k, r in enumerate(rows[: max(1, first)])]
    names = [" / ".join(dict.fromkeys(h[k] for h in heads if h[k])) or f"column_{k + 1}" for k in range(width)]
    return {"columns": names, "rows": [(r + [""] * width)[:width] for r in rows[max(1, first) :]]}


@pandas_udf(_TABLE)
def pipe_table(text: pd.Series) -> pd.DataFrame:
    found = [parse_pipe_table(t) or {"columns": None, "rows": None} for t in text]
    return pd.DataFrame({"columns": [f["columns"] for f in found], "rows": [f["rows"] for f in found]})


def span_grid(cells: DataFrame, by: str) -> DataFrame:
    """by, row, column, text, header: every place that spanned cells (row0, row1, col0, col1, text, header; ends excluded) cover; of overlapping ones the last by `line`."""
    row = F.explode(F.sequence("row0", F.col("row1") - 1))
    places = cells.where("row1 > row0 and col1 > col0").withColumn("row", row).withColumn("column", F.explode(F.sequence("col0", F.col("col1") - 1)))
    return places.groupBy(by, "row", "column").agg(F.max(F.struct("line", "text", "header")).alias("_c")).select(by, "row", "column", "_c.text", "_c.header")


def match_columns(keys: DataFrame, schema: DataFrame, by: str) -> DataFrame:
    """by, key, name: the schema column each key means: the same letters and digits, else the one that shares most words, if one alone does."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0), lambda w: F.length(w) >= 2))
    pairs = keys.select(by, "key").distinct().join(schema.select(by, "name").distinct(), by)
    pairs = pairs.withColumn("score", F.when(bare(F.col("key")) == bare(F.col("name")), 1_000_000).otherwise(F.size(F.array_intersect(words(F.col("key")), words(F.col("name"))))))
    best = pairs.groupBy(by, "key").agg(F.max("score").alias("best"))
    tied = pairs.join(best, [by, "key"]).where("score = best and best > 0").groupBy(by, "key").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    return tied.where("n = 1").select(by, "key", "name")
