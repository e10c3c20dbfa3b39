"""Sections as Markdown, JSON and HTML documents, one per project."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import fixed as K

CITATION = "array<struct<file_path: string, function_name: string, line_start: int, line_end: int, confidence: double>>"


def _ordered(sections: DataFrame, *cols) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, K.SECTION_TITLES)), F.col("section_name"))
    return sections.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.struct(*cols).alias("x")))).alias("s"))


def to_markdown(sections: DataFrame, generated: Column) -> DataFrame:
    """(project_id, text): front matter, table of contents, anchors, contents."""
    anchor = lambda x: F.replace(x["section_name"], F.lit("_"), F.lit("-"))
    g = _ordered(sections, "section_name", "title", "content")
    toc = F.transform("s", lambda v, i: F.concat((i + 1).cast("string"), F.lit(". ["), v["x"]["title"], F.lit("](#"), anchor(v["x"]), F.lit(")")))
    body = F.flatten(F.transform("s", lambda v: F.array(F.concat(F.lit('<a id="'), anchor(v["x"]), F.lit('"></a>\n')), v["x"]["content"], F.lit(""))))
    head = F.array(F.lit("---"), F.concat(F.lit("project: "), F.col("project_id")), F.concat(F.lit("generated: "), generated), F.concat(F.lit("sections: "), F.size("s").cast("string")), F.lit("---\n"), F.lit("# Table of Contents\n"))
    return g.select("project_id", F.array_join(F.concat(head, toc, F.array(F.lit("")), body), "\n").alias("text"))


def to_json(sections: DataFrame, generated: Column) -> DataFrame:
    """(project_id, text): one JSON object; sections(…, citations) flattened."""
    cites = F.col("citations") if "citations" in sections.columns else F.from_json(F.lit("[]"), CITATION)
    g = _ordered(sections, "title", "section_name", "content", "confidence", F.size(cites).alias("citation_count"), cites.alias("citations"))
    body = F.struct("project_id", generated.alias("generated_at"), F.size("s").alias("section_count"), F.transform("s", lambda v: v["x"]).alias("sections"))
    return g.select("project_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("text"))


def markdown_to_html(text: Column) -> Column:
    """Escaped, then fences, tables, headings, bold, code, links and bullets, line by line."""
    t = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    t = F.regexp_replace(t, r"(?s)```(\w*)\n(.*?)\n?```", '<pre><code class="$1">$2</code></pre>')
    t = F.regexp_replace(t, r"(?m)^\|(?:\s*:?-{3,}:?\s*\|)+\s*$\n?", "")
    cells = F.regexp_replace(t, r"(?m)^\| (.*) \|$", "<tr><td>$1</td></tr>")
    t = cells
    for _ in range(12):  # so many columns beyond the first
        t = F.regexp_replace(t, r"(?m)^(<tr>.*?) \| (.*</tr>)$", "$1</td><td>$2")
    t = F.regexp_replace(t, r"(?m)((?:^<tr>.*</tr>$\n?)+)", "<table>\n$1</table>\n")
    for n in (6, 5, 4, 3, 2, 1):
        t = F.regexp_replace(t, rf"(?m)^{'#' * n} (.+)$", f"<h{n}>$1</h{n}>")
    t = F.regexp_replace(t, r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    t = F.regexp_replace(t, r"`([^`\n]+)`", "<code>$1</code>")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>')
    t = F.regexp_replace(t, r"(?m)^- (.+)$", "<li>$1</li>")
    return F.regexp_replace(t, r"(?m)((?:^<li>.*</li>$\n?)+)", "<ul>\n$1</ul>\n")


def to_html(sections: DataFrame, generated: Column) -> DataFrame:
    g = _ordered(sections, "title", "content")
    parts = F.transform("s", lambda v: F.concat(F.lit("<section>\n"), markdown_to_html(v["x"]["content"]), F.lit("\n</section>")))
    page = F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), F.col("project_id"), F.lit("</title></head>\n<body>\n<p>"), generated, F.lit("</p>\n"), F.array_join(parts, "\n"), F.lit("\n</body></html>\n"))
    return g.select("project_id", page.alias("text"))


FORMATS = {"markdown": (to_markdown, "md"), "json": (to_json, "json"), "html": (to_html, "html")}


def export(sections: DataFrame, kind: str, generated: Column) -> DataFrame:
    """(project_id, text) in one of the formats; an unknown one raises."""
    if kind not in FORMATS:
        raise ValueError(f"unknown export format: {kind}")
    return FORMATS[kind][0](sections, generated)


def write_layout(sections: DataFrame, project: str, folder: str, kind: str, generated: str) -> None:
    """One project's files for reading: sections/NN-name, all in one, metadata.json. At most thirteen rows come to the driver."""
    mine = sections.where(F.col("project_id") == project)
    whole = export(mine, kind, F.lit(generated)).first()
    out, end = Path(folder), FORMATS[kind][1]
    (out / "sections").mkdir(parents=True, exist_ok=True)
    order = list(K.SECTION_TITLES)
    rows = sorted(mine.limit(len(order)).collect(), key=lambda r: order.index(r["section_name"]))
    for i, r in enumerate(rows, 1):
        (out / "sections" / f"{i:02d}-{r['section_name']}.{end}").write_text(r["content"], encoding="utf-8")
    (out / f"documentation.{end}").write_text(whole["text"] if whole else "", encoding="utf-8")
    meta = {"project_id": project, "generated_at": generated, "sections": [{"name": r["section_name"], "confidence": r["confidence"]} for r in rows]}
    (out / "metadata.json").write_text(json.dumps(meta, indent=2), encoding="utf-8")


def request_log(rows: DataFrame) -> DataFrame:
    """rows(ts, kind, query, ...) as JSON lines, the query cut to 200 characters."""
    return rows.withColumn("query", F.substring("query", 1, 200)).select(F.to_json(F.struct(*rows.columns)).alias("value"))
