"""Drafting history: snapshots of entities from three shapes of source, as one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexbolt.functions.text import amendment_target, first_text
from lexbolt.operators.integrity import asserted

COLUMNS = ["snapshot_id", "stage", "content_type", "number", "title", "text", "amends_kind", "amends_number", "amends_suffix", "amends_paragraph", "amends_paragraph_suffix", "amends_target"]
#: The kinds of content, in their order, and what one of each is called.
KINDS = {"articles": "article", "recitals": "recital", "annexes": "annex", "amendments": "amendment"}


def snapshot_id(stage: Column, kind: Column, number: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.concat(F.lit("snap_"), stage, F.lit("_"), F.coalesce(F.try_element_at(names, kind), kind), F.lit("_"), number)


def from_entities(rows: DataFrame, stage: str, kind: str) -> DataFrame:
    """Snapshots from a row an entity (number, title, body_text, body_md): the text is the
    first body that isn't empty."""
    number = F.col("number").cast("string")
    return rows.select(snapshot_id(F.lit(stage), F.lit(kind), number).alias("snapshot_id"), F.lit(stage).alias("stage"), F.lit(kind).alias("content_type"), number.alias("number"), "title", first_text(F.col("body_text"), F.col("body_md"), F.lit("")).alias("text"))


def from_versions(blobs: DataFrame, column: str = "by_version") -> DataFrame:
    """Snapshots from nested maps stage -> kind -> number -> JSON, where the innermost is an
    object with title and text, or the text itself."""
    flat = blobs.select(F.explode(column).alias("stage", "kinds")).select("stage", F.explode("kinds").alias("content_type", "numbers")).select("stage", "content_type", F.explode("numbers").alias("number", "json"))
    is_object = F.ltrim("json").startswith("{")
    part = lambda name: F.get_json_object("json", f"$.{name}")
    scalar = F.when(F.ltrim("json").startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), "json", F.lit("}")), "$.v")).otherwise(F.col("json"))
    text = F.when(is_object, F.coalesce(part("text"), F.lit(""))).otherwise(scalar)
    return flat.select(snapshot_id(F.col("stage"), F.col("content_type"), F.col("number")).alias("snapshot_id"), "stage", "content_type", "number", F.when(is_object, part("title")).alias("title"), text.alias("text"))


def from_amendments(rows: DataFrame, stage: str, lang: str) -> DataFrame:
    """Snapshots from amendments (number, target, new_text), with what each of them changes."""
    number, kind = F.col("number").cast("string"), F.lit("amendments")
    aimed = amendment_target(F.col("target"), F.lit(lang))
    rows = rows.withColumn("aim", aimed)
    return rows.select(
        snapshot_id(F.lit(stage), kind, number).alias("snapshot_id"), F.lit(stage).alias("stage"), kind.alias("content_type"), number.alias("number"), F.col("target").alias("title"), F.coalesce("new_text", F.lit("")).alias("text"),
        F.col("aim.kind").alias("amends_kind"), F.col("aim.number").alias("amends_number"), F.col("aim.suffix").alias("amends_suffix"), F.col("aim.paragraph").alias("amends_paragraph"), F.col("aim.paragraph_suffix").alias("amends_paragraph_suffix"), F.col("target").alias("amends_target"),
    )


def snapshots(*parts: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """All parts as one table; columns that one lacks are null. A stage that isn't among
    `stages` and a kind that isn't known end the job."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    for c in COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    known = F.col("content_type").isin(list(KINDS))
    if stages:
        known &= F.col("stage").isin(stages)
    return asserted(out.select(*COLUMNS), known, "a snapshot of a stage or kind that isn't known")


def kinds_of_amendments(rows: DataFrame) -> DataFrame:
    """amends_kind, n."""
    return rows.where("content_type = 'amendments'").groupBy("amends_kind").agg(F.count("*").alias("n"))
