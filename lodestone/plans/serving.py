"""Queries of the serving operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import report, serve
from lodestone.operators.model import persisted_edges
from lodestone.plans.exports import _SECTIONS, _sections
from lodestone.plans.registry import query
from lodestone.plans.standins import EDGES, ENTITIES, MODEL, edges, entities, model, table


@query(f"""
WITH {ENTITIES}, {EDGES},
r AS (SELECT DISTINCT s.file_path AS sf, s.name AS sn, t.file_path AS tf, t.name AS tn FROM edges e JOIN entities s ON s.id = e.source_id JOIN entities t ON t.id = e.target_id),
u AS (SELECT DISTINCT file_path, name, entity_type, start_line, end_line FROM entities),
a AS (SELECT file_path, name, string_agg('  - ' || name || ' (' || entity_type || ') lines ' || start_line || '-' || end_line, chr(10) ORDER BY start_line, entity_type, end_line) AS t FROM u GROUP BY ALL),
c AS (SELECT tf, tn, 'Callers:' || chr(10) || string_agg('  - ' || sf || ':' || sn, chr(10) ORDER BY sf || ':' || sn) AS t FROM r GROUP BY ALL),
d AS (SELECT sf, sn, 'Callees:' || chr(10) || string_agg('  - ' || tf || ':' || tn, chr(10) ORDER BY tf || ':' || tn) AS t FROM r GROUP BY ALL)
SELECT a.file_path, a.name, sha256(concat_ws(chr(10), 'Entities at ' || a.file_path || ':', a.t, c.t, d.t)) AS text_sha
FROM a LEFT JOIN c ON c.tf = a.file_path AND c.tn = a.name LEFT JOIN d ON d.sf = a.file_path AND d.sn = a.name
""")
def explain_symbols(spark, sf):
    """A symbol with its callers and callees."""
    e, r = entities(spark, sf), persisted_edges(edges(spark, sf), entities(spark, sf))
    e = e.select(F.lit("p").alias("project_id"), "file_path", "name", "entity_type", "start_line", "end_line").distinct()
    return serve.explain_symbols(e, r.withColumn("project_id", F.lit("p"))).select("file_path", "name", F.sha2("text", 256).alias("text_sha"))


@query(f"""
WITH {_SECTIONS}, p AS (SELECT DISTINCT project_id FROM y)
SELECT p.project_id, sha256('# Project Briefing' || chr(10) || chr(10) || '## Executive Overview' || chr(10) || coalesce(a.content, 'Section not available.') || chr(10) || chr(10)
  || '## Architecture' || chr(10) || coalesce(b.content, 'Section not available.') || chr(10) || chr(10) || '## Key Features' || chr(10) || coalesce(c.content, 'Section not available.')) AS text_sha
FROM p LEFT JOIN y a ON a.project_id = p.project_id AND a.section_name = 'executive_overview' LEFT JOIN y b ON b.project_id = p.project_id AND b.section_name = 'system_overview'
LEFT JOIN y c ON c.project_id = p.project_id AND c.section_name = 'features'
""")
def prompt_assembly(spark, sf):
    """A prompt of three sections per project."""
    s = _sections(spark, sf)
    return serve.prompt(s, s, "explain_repo").select("project_id", F.sha2("text", 256).alias("text_sha"))


@query(f"""
WITH {ENTITIES}, k AS (SELECT DISTINCT source AS project_id FROM documents), {_SECTIONS.strip()},
e AS (SELECT 'src' || (seq % 20) AS project_id, count(*) AS n FROM entities GROUP BY ALL), v AS (SELECT 'src' || label AS project_id, count(*) AS n FROM embeddings GROUP BY ALL),
d AS (SELECT project_id, count(*) AS n, sum(length(left(content, 200))) AS chars FROM y GROUP BY project_id)
SELECT project_id, coalesce(e.n, 0) AS entities, coalesce(v.n, 0) AS vectors, coalesce(d.n, 0) AS documents, coalesce(d.chars, 0)::BIGINT AS preview_chars
FROM e FULL JOIN d USING (project_id) FULL JOIN v USING (project_id)
""")
def intelligence_overview(spark, sf):
    """The JSON envelope of a project, read back."""
    e = entities(spark, sf).select(F.concat(F.lit("src"), (F.col("seq") % 20).cast("string")).alias("project_id"))
    v = table(spark, sf, "embeddings").select(F.concat(F.lit("src"), F.col("label").cast("string")).alias("project_id"))
    j = serve.overview_json(e, _sections(spark, sf), v)
    x = j.select("project_id", F.from_json("json", "entities bigint, vectors bigint, documents array<struct<section_name: string, preview: string>>").alias("x"))
    chars = F.aggregate("x.documents", F.lit(0).cast("bigint"), lambda a, d: a + F.char_length(d["preview"]))
    return x.select("project_id", "x.entities", "x.vectors", F.coalesce(F.array_size("x.documents"), F.lit(0)).cast("long").alias("documents"), F.coalesce(chars, F.lit(0)).alias("preview_chars"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount FROM lineitem)
SELECT l_orderkey, count(*) AS n, round(sum(CASE WHEN l_discount > 0.05 THEN l_discount ELSE 0 END), 9) AS confidence, min('f' || l_partkey) AS first FROM c GROUP BY l_orderkey
""")
def citation_codec(spark, sf):
    """Citations of a message to JSON and back; a missing confidence is 0."""
    c = F.struct(F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("file_path"), F.lit(None).cast("string").alias("function_name"), F.col("l_linenumber").cast("int").alias("line_start"),
                 F.col("l_quantity").cast("int").alias("line_end"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("confidence"))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(serve.encode_citations(F.collect_list(c)).alias("j"))
    d = g.withColumn("c", serve.decode_citations(F.col("j")))
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x["confidence"])
    return d.select("l_orderkey", F.size("c").cast("long").alias("n"), F.round(total, 9).alias("confidence"), F.array_min(F.transform("c", lambda x: x["file_path"])).alias("first"))


@query(f"""
WITH {MODEL}
SELECT p.project_id, least(30, (SELECT count(*) FROM entities e WHERE e.project_id = p.project_id)) AS entities, least(15, (SELECT count(*) FROM purposes e WHERE e.project_id = p.project_id)) AS purposes,
  least(20, (SELECT count(*) FROM rules e WHERE e.project_id = p.project_id)) AS rules, least(10, (SELECT count(*) FROM risks e WHERE e.project_id = p.project_id)) AS risks,
  least(20, (SELECT count(*) FROM edges e WHERE e.project_id = p.project_id)) AS relationships, least(5, (SELECT count(*) FROM workflows e WHERE e.project_id = p.project_id)) AS workflows,
  (SELECT arg_min(name, seq) FROM entities e WHERE e.project_id = p.project_id) AS first
FROM projects p
""")
def section_contexts(spark, sf):
    """CB1-CB13, T7, A13, X32: the capped facts of each project as JSON, read back."""
    part = "array<struct<name: string>>"
    c = report.contexts(model(spark, sf)).select("project_id", F.from_json("context", ", ".join(f"{k} {part}" for k in report.K_CONTEXT)).alias("c"))
    return c.select("project_id", *(F.coalesce(F.array_size(f"c.{k}"), F.lit(0)).cast("long").alias(k) for k in report.K_CONTEXT), F.col("c.entities")[0]["name"].alias("first"))


@query(f"""
WITH {ENTITIES}
SELECT project_id, count(*) FILTER (contains(name, 'ring') OR contains(name, 'gear')) > 0 AS has_ring, list_sort(list(DISTINCT name) FILTER (contains(name, 'bolt'))) AS bolts FROM entities GROUP BY project_id
""")
def keyword_flags(spark, sf):
    """Words in names, any and all."""
    from lodestone.functions.text import any_word

    e = entities(spark, sf)
    bolts = F.array_sort(F.collect_set(F.when(any_word(F.col("name"), ["bolt"]), F.col("name"))))
    return e.groupBy("project_id").agg(F.bool_or(any_word(F.lower("name"), ["ring", "gear"])).alias("has_ring"), F.when(F.size(bolts) > 0, bolts).alias("bolts"))
