"""What the query surface returns: texts about symbols, prompts, listings, JSON envelopes.

Each works on all projects (or symbols) at once, one row each, so that a caller filters on
its key and Parquet partitions do the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordered import joined_lines

CITATION = "array<struct<file_path: string, function_name: string, line_start: int, line_end: int, confidence: double>>"
MISSING = "Section not available."

#: Prompts: title, then (heading, section) in order.
PROMPTS = {
    "explain_repo": ("# Project Briefing", [("Executive Overview", "executive_overview"), ("Architecture", "system_overview"), ("Key Features", "features")]),
    "review_code": ("# Code Review Context", [("System Overview", "system_overview"), ("Security Considerations", "security_considerations")]),
    "write_tests": ("# Test Specification", [("User Stories", "user_stories")]),
    "fix_bug": ("# Bug Fix Context", [("System Overview", "system_overview"), ("Data Models", "data_models")]),
    "migration_plan": ("# Migration Context", [("System Overview", "system_overview"), ("Integration Points", "integrations")]),
}


def explain_symbols(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(project_id, file_path, name, text): where a symbol is, who calls it, what it calls.

    relations(project_id, source_file, source_symbol, target_file, target_symbol).
    """
    on = ["project_id", "file_path", "name"]
    at = joined_lines(entities, on, F.format_string("  - %s (%s) lines %d-%d", "name", "entity_type", "start_line", "end_line"), ["start_line", "entity_type", "end_line"])
    side = lambda a, b: joined_lines(
        relations.select("project_id", F.col(f"{a}_file").alias("file_path"), F.col(f"{a}_symbol").alias("name"), F.concat_ws(":", f"{b}_file", f"{b}_symbol").alias("other")).distinct(),
        on, F.concat(F.lit("  - "), F.col("other")), ["other"],
    )
    callers = side("target", "source").select(*on, F.concat(F.lit("Callers:\n"), F.col("text")).alias("callers"))
    callees = side("source", "target").select(*on, F.concat(F.lit("Callees:\n"), F.col("text")).alias("callees"))
    j = at.join(callers, on, "left").join(callees, on, "left")
    head = F.concat(F.lit("Entities at "), F.col("file_path"), F.lit(":"))
    return j.select(*on, F.concat_ws("\n", head, "text", "callers", "callees").alias("text"))


def prompt(sections: DataFrame, projects: DataFrame, name: str) -> DataFrame:
    """(project_id, text) of one prompt; sections that a project lacks are named as missing."""
    title, parts = PROMPTS[name]
    out = projects.select("project_id").distinct()
    texts: list[Column] = [F.lit(title)]
    for i, (heading, section) in enumerate(parts):
        s = sections.where(F.col("section_name") == section).select("project_id", F.col("content").alias(f"s{i}"))
        out = out.join(s, "project_id", "left")
        texts.append(F.concat(F.lit(f"## {heading}\n"), F.coalesce(f"s{i}", F.lit(MISSING))))
    return out.select("project_id", F.concat_ws("\n\n", *texts).alias("text"))


def overview_json(entities: DataFrame, sections: DataFrame, vectors: DataFrame) -> DataFrame:
    """(project_id, json): how much was found, with previews of 200 characters."""
    e = entities.groupBy("project_id").agg(F.count(F.lit(1)).alias("entities"))
    d = sections.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("section_name", F.substring("content", 1, 200).alias("preview")))).alias("documents"))
    v = vectors.groupBy("project_id").agg(F.count(F.lit(1)).alias("vectors"))
    j = e.join(d, "project_id", "full").join(v, "project_id", "full").na.fill(0, ["entities", "vectors"])
    return j.select("project_id", F.to_json(F.struct("entities", "vectors", "documents")).alias("json"))


def encode_citations(citations: Column) -> Column:
    """Citations as JSON text; none at all is null."""
    return F.when(F.size(citations) > 0, F.to_json(citations))


def decode_citations(text: Column) -> Column:
    """Citations of JSON text; null, empty or broken text has none, a missing confidence is 0."""
    c = F.from_json(text, CITATION)
    fill = lambda x: x.withField("confidence", F.coalesce(x["confidence"], F.lit(0.0)))
    return F.coalesce(F.transform(F.filter(c, lambda x: x["file_path"].isNotNull()), fill), F.array().cast(CITATION))


def newest_first(rows: DataFrame, at: str = "created_at") -> DataFrame:
    return rows.orderBy(F.desc(at))
