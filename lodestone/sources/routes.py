"""What is served from the stored tables: a model rebuilt from them, sections made anew, exports, message history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import section_title
from lodestone.operators import model, report
from lodestone.sources.export import export
from lodestone.sources.store import Store


def stored_model(store: Store, projects: list[str] | None = None) -> report.Model:
    """The graph's entities as stored, by name, under their place's id; what is not stored is empty."""
    e = store.read("code_entities")
    e = e.where(F.col("project_id").isin(projects)) if projects is not None else e
    entities = e.select(
        "project_id", F.struct("name", "id").alias("seq"), model.entity_id(F.col("file_path"), F.col("name")).alias("id"), "name", "entity_type", "file_path", "start_line", "end_line",
        "language", "signature", F.lit(None).cast("string").alias("description"), F.lit(0.9).alias("confidence"),
    )
    none = lambda cols: store.spark.createDataFrame([], f"project_id string, seq struct<name: string, id: string>, {cols}")
    return report.Model(
        entities=entities,
        edges=none("id string, source_id string, target_id string, relationship_type string"),
        purposes=none("file_path string, statement string, confidence double"),
        rules=none("rule_text string, rule_type string, confidence double"),
        risks=none("title string, severity string, risk_type string, file_path string, line int, confidence double"),
        workflows=none("name string, steps array<struct<order: int, entity_id: string, description: string>>, confidence double"),
        projects=entities.select("project_id").distinct(),
    )


def regenerate(store: Store, project: str, section: str) -> DataFrame:
    """Make one section of a project anew from what is stored, keep it, and return its row.

    An unknown section, or a project without entities, raises and changes nothing.
    """
    if section not in report.SECTIONS:
        raise ValueError(f"unknown section {section}; known: {', '.join(report.SECTIONS)}")
    m = stored_model(store, [project])
    if not m.entities.limit(1).count():
        raise LookupError(f"{project} has no entities; analyse it first")
    rows = report.sections(m, [section]).select(
        F.concat_ws(":", "project_id", "section_name").alias("id"), "project_id", "section_name", "content", "confidence",
        F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"),
    )
    store.upsert_sections(rows)
    return section_of(store, project, section)


def section_of(store: Store, project: str, section: str) -> DataFrame:
    return store.scan("documents", project).where(F.col("section_name") == section)


def export_project(store: Store, project: str, kind: str, now: Column) -> DataFrame:
    """A project's stored sections in one document: markdown, json or html."""
    rows = store.scan("documents", project).withColumn("title", section_title(F.col("section_name")))
    return export(rows.select("project_id", "section_name", "title", "content", "confidence"), kind, now)


def history(store: Store, conversation: str, most: int | None = None) -> DataFrame:
    """A conversation's messages from the oldest on; with most, the newest so many."""
    rows = store.scan("messages", conversation)
    if most is not None:
        rows = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(most)
    return rows.orderBy("created_at", "id")
