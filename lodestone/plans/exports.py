"""Queries of the store and export operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import fixed as K
from lodestone.functions.text import section_title
from lodestone.operators import report
from lodestone.plans.registry import query
from lodestone.plans.standins import table
from lodestone.sources import export, store

_NAMES = list(K.SECTION_TITLES)
_TITLE = "CASE section_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.SECTION_TITLES.items()) + " END"
_SECTIONS = f"""
s AS (SELECT source AS project_id, {_NAMES}[doc_id % 13 + 1] AS section_name, doc_id, text FROM documents),
x AS (SELECT project_id, section_name, arg_min(text, doc_id) AS content, min(doc_id) AS k FROM s GROUP BY project_id, section_name),
y AS (SELECT *, {_TITLE} AS title, list_position({_NAMES}, section_name) AS place, 0.5::DOUBLE AS confidence FROM x)"""


def _sections(spark, sf):
    """Sources as projects, their first documents as sections."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % 13 + 1).cast("int"))
    d = table(spark, sf, "documents").select(F.col("source").alias("project_id"), name.alias("section_name"), "doc_id", "text")
    s = d.groupBy("project_id", "section_name").agg(F.min_by("text", "doc_id").alias("content"))
    return s.withColumn("title", section_title(F.col("section_name"))).withColumn("confidence", F.lit(0.5))


@query(f"""
WITH {_SECTIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY place) AS i FROM y)
SELECT project_id, sha256('---' || chr(10) || 'project: ' || project_id || chr(10) || 'generated: now' || chr(10) || 'sections: ' || count(*) || chr(10) || '---' || chr(10) || chr(10) || '# Table of Contents' || chr(10) || chr(10)
  || string_agg(i || '. [' || title || '](#' || replace(section_name, '_', '-') || ')', chr(10) ORDER BY i) || chr(10) || chr(10)
  || string_agg('<a id="' || replace(section_name, '_', '-') || '"></a>' || chr(10) || chr(10) || content || chr(10), chr(10) ORDER BY i)) AS text_sha
FROM n GROUP BY project_id
""")
def export_markdown(spark, sf):
    """SK7, X28: front matter, contents and sections as one Markdown text."""
    return export.export(_sections(spark, sf), "markdown", F.lit("now")).select("project_id", F.sha2("text", 256).alias("text_sha"))


@query(f"""
WITH {_SECTIONS} SELECT project_id, count(*) AS sections, string_agg(section_name || ':' || title || ':' || sha256(content), '|' ORDER BY place) AS listed FROM y GROUP BY project_id
""")
def export_json(spark, sf):
    """SK8: the JSON export, read back."""
    t = export.export(_sections(spark, sf), "json", F.lit("now"))
    kind = "project_id string, section_count bigint, sections array<struct<title: string, section_name: string, content: string, citation_count: int>>"
    v = t.select(F.from_json("text", kind).alias("v")).select("v.*")
    one = F.transform("sections", lambda s: F.concat_ws(":", s["section_name"], s["title"], F.sha2(s["content"], 256)))
    return v.select("project_id", F.col("section_count").alias("sections"), F.array_join(one, "|").alias("listed"))


@query(f"""
WITH {_SECTIONS} SELECT project_id, sum(length(content) + length(title))::BIGINT AS chars, count(*) AS sections FROM y GROUP BY project_id
""")
def export_html(spark, sf):
    """SK9: the HTML export; its text without tags and escapes is as long as the sections' plain prose."""
    s = _sections(spark, sf)
    html = s.withColumn("h", export.markdown_to_html(F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.regexp_replace("content", r"[^\p{L}\n ]", "x"))))
    plain = F.regexp_replace("h", "<[^>]*>", "")
    return html.groupBy("project_id").agg(F.sum(F.char_length(plain) - 2).cast("long").alias("chars"), F.count(F.lit(1)).alias("sections"))


@query("""
WITH o AS (SELECT source AS project_id, lang AS section_name, 'o' || min(doc_id) AS id, arg_min(text, doc_id) AS content FROM documents GROUP BY ALL),
n AS (SELECT d.source AS project_id, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE d.lang END AS section_name, 'n' || max(d.doc_id) AS id, arg_max(d.text, d.doc_id) AS content FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL)
SELECT coalesce(o.project_id, n.project_id) AS project_id, coalesce(o.section_name, n.section_name) AS section_name, coalesce(o.id, n.id) AS id, sha256(coalesce(n.content, o.content)) AS content_sha
FROM o FULL JOIN n ON n.project_id = o.project_id AND n.section_name = o.section_name
""")
def upsert_sections(spark, sf):
    """SK4, SK1: sections are updated where they exist and added where not; the id of the first one stays."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    at = F.lit("2024-01-01").cast("timestamp")
    full = lambda g: g.withColumn("confidence", F.lit(None).cast("double")).withColumn("created_at", at).withColumn("updated_at", at)
    cols = ["id", "project_id", "section_name", "content", "confidence", "created_at", "updated_at"]
    old = d.groupBy(F.col("source").alias("project_id"), F.col("lang").alias("section_name")).agg(F.concat(F.lit("o"), F.min("doc_id").cast("string")).alias("id"), F.min_by("text", "doc_id").alias("content"))
    new = d.join(lab, "doc_id").withColumn("section_name", F.when(F.col("toxic") == 1, "toxic").otherwise(F.col("lang")))
    new = new.groupBy(F.col("source").alias("project_id"), "section_name").agg(F.concat(F.lit("n"), F.max("doc_id").cast("string")).alias("id"), F.max_by("text", "doc_id").alias("content"))
    m = store.merge_sections(full(old).select(cols), full(new).select(cols), ["project_id", "section_name"])
    return m.select("project_id", "section_name", "id", F.sha2("content", 256).alias("content_sha"))


@query("""
WITH n AS (SELECT source AS project_id, sha256(text) AS chunk_hash, min('c' || lpad(doc_id::VARCHAR, 12, '0')) AS id FROM documents GROUP BY ALL),
o AS (SELECT d.source AS project_id, sha256(d.text) AS chunk_hash, min('a' || d.doc_id) AS id FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL)
SELECT project_id, coalesce(o.id, n.id) AS id, chunk_hash FROM n FULL JOIN o USING (project_id, chunk_hash)
""")
def merge_checkpoints(spark, sf):
    """SK5, A12: a stored checkpoint stays; of several new ones with a key the first is added."""
    d = table(spark, sf, "documents").select(F.col("source").alias("project_id"), F.sha2("text", 256).alias("chunk_hash"), "doc_id")
    new = d.select("project_id", "chunk_hash", F.concat(F.lit("c"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("id"))
    old = d.join(table(spark, sf, "labels"), "doc_id").groupBy("project_id", "chunk_hash").agg(F.min(F.concat(F.lit("a"), F.col("doc_id").cast("string"))).alias("id"))
    return store.merge_checkpoints(old, new.select(old.columns)).select("project_id", "id", "chunk_hash")


@query(f"""
WITH t AS (SELECT doc_id, {_NAMES}[doc_id % 13 + 1] AS section_name, left(text, 200) AS e FROM documents)
SELECT doc_id::VARCHAR AS project_id, {_TITLE} AS title, length('# ' || {_TITLE} || chr(10) || chr(10) || '*This section could not be generated. Error: ' || e || '*' || chr(10))::INTEGER AS n FROM t
""")
def degraded_sections(spark, sf):
    """Stubs of sections that failed, the error cut to 200 characters."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % 13 + 1).cast("int"))
    f = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("project_id"), name.alias("section_name"), F.col("text").alias("error"))
    return report.degraded(f).select("project_id", "title", F.char_length("content").alias("n"))
