"""Checks of what a prompt carries against what was selected: a two-sided, null-safe difference that fails the read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fields of a record that its packet must carry unchanged.
FIELDS = ("paper_id", "page", "source_type", "label", "locator", "text", "section_id", "section_title", "section_type", "section_path", "reading_order", "document_order")


def _shown(column: Column) -> Column:
    """A value of any type as a comparable text; null stays null."""
    return F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"})


def audit_findings(selected: DataFrame, packets: DataFrame, attachments: DataFrame, *, by: str = "query_id") -> DataFrame:
    """by, ref, problem: what differs between selected records, packet records (both with evidence_ref and FIELDS) and attached images (image_ref, exists).

    missing ref, repeated ref, not in packets, not selected, field <name>; selected records name images in image_ref: image not attached,
    image not declared, image missing. Null equals null and nothing else.
    """
    ref = F.coalesce(F.col("evidence_ref").cast("string"), F.lit(""))
    count = lambda df, side: df.groupBy(by, ref.alias("ref")).agg(F.count("*").alias("_n")).select(by, "ref", F.when(F.col("ref") == "", f"{side}: missing ref").when(F.col("_n") > 1, f"{side}: repeated ref").alias("problem")).where("problem IS NOT NULL")
    out = count(selected, "selected").unionByName(count(packets, "packet"))
    fields = F.map_from_arrays(F.array(*[F.lit(f) for f in FIELDS]), F.array(*[_shown(F.col(f)) for f in FIELDS]))
    own = lambda df, name: df.where(ref != "").groupBy(by, ref.alias("ref")).agg(F.first(fields).alias(name))
    both = own(selected, "_a").join(own(packets, "_b"), [by, "ref"], "full")
    differ = F.filter(F.array(*[F.when(~F.col("_a")[f].eqNullSafe(F.col("_b")[f]), F.lit(f"field {f}")) for f in FIELDS]), lambda x: x.isNotNull())
    said = F.when(F.col("_b").isNull(), F.array(F.lit("not in packets"))).when(F.col("_a").isNull(), F.array(F.lit("not selected"))).otherwise(differ)
    out = out.unionByName(both.select(by, "ref", F.explode(said).alias("problem")))
    declared = selected.where(F.coalesce("image_ref", F.lit("")) != "").select(by, F.col("image_ref").alias("ref")).distinct().withColumn("_d", F.lit(True))
    attached = attachments.groupBy(by, F.coalesce("image_ref", F.lit("")).alias("ref")).agg(F.min(F.coalesce("exists", F.lit(False))).alias("_e"))
    images = declared.join(attached, [by, "ref"], "full")
    problem = F.when(F.col("_e").isNull(), "image not attached").when(F.col("_d").isNull(), "image not declared").when(~F.col("_e"), "image missing")
    return out.unionByName(images.select(by, "ref", problem.alias("problem")).where("problem IS NOT NULL"))


def audited(selected: DataFrame, packets: DataFrame, attachments: DataFrame, *, by: str = "query_id") -> DataFrame:
    """by, n_selected, n_records, n_images of questions whose prompt carries what was selected; reading it fails at a question where anything differs."""
    n = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name))
    found = audit_findings(selected, packets, attachments, by=by).groupBy(by).agg(F.min(F.concat_ws(" ", F.lit("prompt audit:"), F.col(by).cast("string"), "ref", "problem")).alias("_said"))
    rows = n(selected, "n_selected").join(n(packets, "n_records"), by, "full").join(n(attachments, "n_images"), by, "full").join(found, by, "full")
    passed = F.when(F.col("_said").isNotNull(), F.raise_error(F.col("_said"))).otherwise(F.coalesce("n_selected", F.lit(0)))
    return rows.select(by, passed.cast("long").alias("n_selected"), F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_images", F.lit(0)).alias("n_images"))
