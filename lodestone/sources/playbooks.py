"""Playbooks: YAML files as a table of steps, whose values are held against what is allowed."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns whose values are given, with these.
ALLOWED = {
    "tool": [
        "query_codebase", "get_specification", "list_features", "get_data_model", "explain_symbol", "get_call_graph", "get_user_stories", "get_api_endpoints",
        "search_code_entities", "get_security_findings",
    ],
    "prompt": ["fix_bug", "write_tests", "review_code", "explain_repo", "migration_plan"],
}
STEPS = "name string, title string, prompt string, step int, tool string, description string"


def _parsed(text: str, name: str) -> list[dict]:
    """A row for each step of a file; the playbook's own values stand in every row."""
    import yaml

    book = yaml.safe_load(text) or {}
    head = {"name": name, "title": book.get("title"), "prompt": book.get("mcp_prompt", book.get("prompt"))}
    steps = book.get("steps") or [{}]
    return [head | {"step": i + 1, "tool": s.get("tool"), "description": s.get("description")} for i, s in enumerate(steps)]


def problem(df: DataFrame) -> Column:
    """The first column of a step whose value is not allowed, in words; null if all are. A book without steps has one with no tool."""
    wrong = [F.when(~F.coalesce(F.col(c).isin(ALLOWED[c]), F.lit(False)), F.concat(df["name"], F.lit(f": unknown {c} "), F.coalesce(F.col(c), F.lit("")))) for c in ("prompt", "tool")]
    return F.coalesce(*wrong)


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """Every step of every playbook of a folder, by name, with its problem. Files are a handful, parsed where they are read."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.yaml").select("value", F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.yaml$", 1).alias("file"))
    parse = F.udf(lambda text, name: [tuple(r[c] for c in ("name", "title", "prompt", "step", "tool", "description")) for r in _parsed(text, name)], f"array<struct<{STEPS.replace(' ', ': ').replace(',: ', ', ')}>>")
    out = files.select(F.inline(parse("value", "file"))).orderBy("name", "step")
    return out.withColumn("problem", problem(out))


def playbooks(spark: SparkSession, folder: str) -> DataFrame:
    """All steps of a folder's playbooks; one that is not allowed raises when it is read."""
    out = steps(spark, folder)
    return out.where(F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("boolean")).otherwise(F.lit(True))).drop("problem")


def load_playbook(folder: str, name: str) -> list[tuple]:
    """The steps of one playbook; a value that is not allowed raises."""
    file = Path(folder, f"{name}.yaml")
    if file.parent != Path(folder) or ".." in name:
        raise ValueError(f"bad playbook name: {name}")
    rows = _parsed(file.read_text(encoding="utf-8"), name)
    for column in ("prompt", "tool"):
        for bad in {str(r[column]) for r in rows} - set(ALLOWED[column]):
            raise ValueError(f"{name}: unknown {column} {bad}")
    return [tuple(r.values()) for r in rows]
