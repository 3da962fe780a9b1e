r"""Chat formatting with relational expressions only.

A conversation becomes `<s>`, then per block of adjacent turns of one role `<|role|>ROLE<|text|>TEXT<|sep|>TEXT...</s>`.
Control strings inside roles and texts (the template's own, and the `[INST]` family of other templates) get a backslash
after their first character, one more if they already have some; taking one away restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: `<` or `[`, any backslashes, and the rest of a control string.
_CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"
_MARKS = r"<s>|</s>|<\|role\|>|<\|text\|>|<\|sep\|>"
LOSS_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_conversations(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask.

    loss_mask has a boolean per stretch between two marks of the formatted text (see `segments`): whether the model
    learns from it. Turns are sorted by turn (null first), then role and text; repeated rows stay. Null roles and texts
    are empty. Rows with a null conv_id are one conversation. Other columns are ignored. A conversation is one string,
    built by one task and linear in its length.
    """
    clean = turns.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"))
    rows = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    new = lambda i: (i == 0) | (F.get("turns", i - 1)["role"] != F.get("turns", i)["role"])
    rows = rows.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), new))
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("turns"))
    block = lambda i, k: F.struct(F.get("turns", i)["role"].alias("role"), F.transform(F.slice("turns", i + 1, end(k) - i), lambda t: t["text"]).alias("texts"))
    rows = rows.withColumn("blocks", F.transform("starts", block))
    shown = F.transform("blocks", lambda b: F.concat(F.lit("<|role|>"), escape(b["role"]), F.lit("<|text|>"), F.array_join(F.transform(b["texts"], escape), "<|sep|>"), F.lit("</s>")))
    mask = F.flatten(F.transform("blocks", lambda b: F.concat(F.array(F.lit(False)), F.transform(b["texts"], lambda _: b["role"].isin(*loss_roles)), F.array(F.lit(False)))))
    return rows.select("conv_id", F.concat(F.lit("<s>"), F.array_join(shown, "")).alias("formatted"), F.concat(F.array(F.lit(False), F.lit(False)), mask).alias("loss_mask"))


def segments(formatted: Column) -> Column:
    """The stretches between marks, still escaped: two empty ones, then per block its role, its texts and an empty one."""
    return F.split(formatted, _MARKS)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role, text."""
    blocks = F.filter(F.split(F.substring(formatted, 4, 2**31 - 1), "</s>"), lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.split(b, r"<\|role\|>|<\|text\|>|<\|sep\|>"))
    return F.flatten(F.transform(parts, lambda p: F.transform(F.slice(p, 3, F.size(p)), lambda x: F.struct(unescape(F.get(p, F.lit(1))).alias("role"), unescape(x).alias("text")))))


def read_loss(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    pairs = F.arrays_zip(segments(formatted).alias("s"), loss_mask.alias("m"))
    return F.transform(F.filter(pairs, lambda p: p["m"]), lambda p: unescape(p["s"]))


def digests(formatted: DataFrame) -> DataFrame:
    """What conversations hold, read back from format_conversations()."""
    rows = formatted.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", F.array_join(read_loss(F.col("formatted"), F.col("loss_mask")), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
