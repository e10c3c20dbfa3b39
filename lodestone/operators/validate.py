"""Cross-validation of parser findings with model findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scoring import finding_score, level_score
from lodestone.functions.text import identifier_tokens
from lodestone.operators.ordered import last_value_first_place


def last_narratives(narratives: DataFrame) -> DataFrame:
    """narratives(file_path, seq, mentions array) -> the last one of each file that mentions anything."""
    some = narratives.where(F.size("mentions") > 0)
    return some.groupBy("file_path").agg(F.max_by("mentions", "seq").alias("mentions"))


def cross_validate(entities: DataFrame, narratives: DataFrame) -> DataFrame:
    """entities(file_path, name, seq, ...) with matched, confidence, source.

    An entity is matched if all words of its name are words of one mention of its file. Only
    the file is a join key; the words are compared inside the row, so no pairs are expanded.
    """
    e = last_value_first_place(entities, ["file_path", "name"])
    words = F.transform(F.col("mentions"), identifier_tokens)
    joined = e.join(last_narratives(narratives).withColumn("_said", words).drop("mentions"), "file_path", "left")
    mine = identifier_tokens(F.col("name"))
    hit = (F.size(mine) > 0) & F.exists("_said", lambda m: F.size(F.array_except(mine, m)) == 0)
    joined = joined.withColumn("matched", F.coalesce(hit, F.lit(False))).drop("_said")
    s = finding_score(F.lit(True), F.col("matched"), F.lit("high"))
    return joined.withColumn("_s", s).select(*e.columns, "matched", F.col("_s.value").alias("confidence"), F.col("_s.source").alias("source"))


def rule_entities(rules: DataFrame) -> DataFrame:
    """Business rules as entities that only a model found: (file_path, name, seq, entity_type, confidence, source)."""
    return rules.where(F.col("confidence") != "low").select(
        "file_path", F.col("rule_text").alias("name"), "seq", F.lit("business_rule").alias("entity_type"),
        level_score(F.col("confidence")).alias("confidence"), F.lit("llm").alias("source"),
    )


def validation_counts(validated: DataFrame, llm_only: DataFrame, narratives: DataFrame) -> DataFrame:
    """One row: ast_only, cross_validated, llm_only, conflict."""
    a = validated.agg(F.count_if(~F.col("matched")).alias("ast_only"), F.count_if("matched").alias("cross_validated"), F.count(F.lit(1)).alias("_static"))
    b, c = llm_only.agg(F.count(F.lit(1)).alias("llm_only")), narratives.agg(F.count(F.lit(1)).alias("_said"))
    # Three one-row tables.
    one = a.crossJoin(b).crossJoin(c)
    return one.withColumn("conflict", (F.col("cross_validated") == 0) & (F.col("_static") > 0) & (F.col("_said") > 0)).drop("_static", "_said")
