"""Queries of the model, graph and retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import fixed as K
from lodestone.operators import graph, model, report, retrieve, validate
from lodestone.operators.ordered import last_value_first_place, top_per
from lodestone.plans.registry import query
from lodestone.plans.standins import EDGES, ENTITIES, MODEL, edges, entities, table

KEYWORDS = "red Widget the bolt of"


@query(f"""
WITH {ENTITIES}, k AS (SELECT unnest(['red', 'widget', 'bolt']) AS w, unnest([0, 1, 2]) AS p)
SELECT id, name, min(p)::INTEGER AS keyword_pos FROM entities JOIN k ON contains(lower(name), w) GROUP BY id, name, seq ORDER BY keyword_pos, seq LIMIT 10
""")
def entity_keyword_search(spark, sf):
    """The first ten entities that a question's words name, by word and then by place."""
    return retrieve.keyword_top(entities(spark, sf), KEYWORDS).select("id", "name", "keyword_pos")


@query(f"""
WITH {ENTITIES}, w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS q FROM part),
k AS (SELECT q, q AS word, 0 AS pos FROM w UNION ALL SELECT q, substr(q, 2, 2), 1 FROM w UNION ALL SELECT q, 'zz' || q, 2 FROM w),
h AS (SELECT q, id, name, min(pos) AS pos, any_value(seq) AS seq FROM k JOIN entities ON contains(lower(name), lower(word)) AND word <> '' GROUP BY q, id, name),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY pos, seq, id) AS rank FROM h)
SELECT q AS query, id, name, pos::INTEGER AS keyword_pos, rank::INTEGER AS rank FROM r WHERE rank <= 10
""")
def keyword_index_search(spark, sf):
    """F1, J9, T2 by a stored index: the first ten names for every word of the parts' names, by the word and by two letters of it."""
    from lodestone.operators import names
    from lodestone.runtime import Scratch

    path = Scratch(spark, "names").path("index")
    names.build(entities(spark, sf), path, keep=["seq"])
    w = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("query")).distinct()
    words = F.array(F.col("query"), F.substring("query", 2, 2), F.concat(F.lit("zz"), "query"))
    queries = w.select("query", F.posexplode(words).alias("pos", "word"))
    return names.search(spark, path, queries, tie="seq").select("query", "id", "name", "keyword_pos", "rank")


@query(f"""
WITH {ENTITIES}
SELECT project_id, count(*) FILTER (name LIKE '%ring%') AS hits, count(*) FILTER (entity_type = 'class') AS classes, count(*) FILTER (file_path = 'small/5.py') AS in_file,
       count(*) FILTER (entity_type = 'endpoint' AND contains(name, 'gear') AND contains(upper(signature), 'GEAR')) AS endpoints
FROM entities GROUP BY project_id
""")
def entity_filters(spark, sf):
    """F1 (wildcards), F2, F3, F9, F10: entity look-ups by project."""
    e = entities(spark, sf)
    api = (F.col("entity_type") == "endpoint") & F.contains("name", F.lit("gear")) & F.contains(F.upper("signature"), F.lit("GEAR"))
    return e.groupBy("project_id").agg(F.count_if(F.col("name").ilike("%ring%")).alias("hits"), F.count_if(F.col("entity_type") == "class").alias("classes"), F.count_if(F.col("file_path") == "small/5.py").alias("in_file"), F.count_if(api).alias("endpoints"))


@query("""
WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id = 0),
d AS (SELECT vec_id, list_reduce(list_transform(list_zip(embedding, q.v), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])), lambda a, b: a + b) AS distance FROM embeddings, q)
SELECT vec_id, round(distance, 9) AS distance FROM d WHERE distance < 1.5 ORDER BY d.distance, vec_id LIMIT 10
""")
def vector_topk_l2(spark, sf):
    """The ten nearest vectors under the distance bound."""
    e = table(spark, sf, "embeddings")
    q = [float(x) for x in e.where("vec_id = 0").first()["embedding"]]
    return retrieve.vector_top_k(e, q, vec="embedding", tie="vec_id").select("vec_id", F.round("distance", 9).alias("distance"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (
  SELECT q.vec_id AS query, c.vec_id AS id, list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b) AS distance
  FROM v q JOIN v c ON q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d WHERE distance < 1.5)
SELECT query, id, round(distance, 9) AS distance, rank::INTEGER AS rank FROM r WHERE rank <= 10
""")
def vector_index_search(spark, sf):
    """SC10, T1, R1 by a stored index: the ten nearest vectors under the bound for every row whose id is divisible by 50."""
    from lodestone.operators import vectors
    from lodestone.runtime import Scratch

    e, path = table(spark, sf, "embeddings"), Scratch(spark, "vectors").path("index")
    vectors.build(e, path, id_col="vec_id", vec="embedding")
    found = vectors.search(spark, path, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")))
    return found.withColumn("distance", F.round("distance", 9))


def _ranked(spark, sf):
    """Two rankings of the vectors of a label: by first and by second component."""
    from pyspark.sql.window import Window as W

    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))
    rank = lambda c: F.row_number().over(W.partitionBy("label").orderBy(F.desc(c), "vec_id")) - 1
    return e.select("label", "vec_id", rank("a").alias("ra"), rank("b").alias("rb"))


@query("""
WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) - 1 AS ra, row_number() OVER (PARTITION BY label ORDER BY embedding[2] DESC, vec_id) - 1 AS rb FROM embeddings),
l AS (SELECT vec_id, 0 AS l, ra AS r FROM r WHERE label = 3 AND ra < 10 UNION ALL SELECT vec_id, 1, rb FROM r WHERE label = 3 AND rb < 10),
s AS (SELECT vec_id, sum(1.0::DOUBLE / (60 + r)) AS score, min(l * 1000 + r) AS f FROM l GROUP BY vec_id)
SELECT vec_id AS item, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 15) DESC, f)::INTEGER AS place FROM s
""")
def rrf_fusion(spark, sf):
    """Reciprocal rank fusion of two ten-best lists, ties to what was seen first."""
    r = _ranked(spark, sf).where("label = 3")
    lists = r.where("ra < 10").select(F.lit(0).alias("list_no"), F.col("ra").alias("rank"), F.col("vec_id").alias("item"))
    lists = lists.unionByName(r.where("rb < 10").select(F.lit(1).alias("list_no"), F.col("rb").alias("rank"), F.col("vec_id").alias("item")))
    return retrieve.rrf(lists).select("item", F.round("score", 9).alias("score"), "place")


def _hybrid_tables(spark, sf):
    """Parts as entities whose vector is that of the same number."""
    e = entities(spark, sf).select("seq", "id", "name", "file_path", "start_line", F.col("project_id"))
    v = e.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), F.col("embedding").alias("vector")), "seq").select("seq", "file_path", "start_line", "vector")
    return e, v


@query(f"""
WITH {ENTITIES},
q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id = 0),
dv AS (SELECT e.seq, e.file_path || ':' || e.start_line AS item, list_reduce(list_transform(list_zip(m.embedding, q.v), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])), lambda a, b: a + b) AS d
       FROM embeddings m JOIN entities e ON e.seq = m.vec_id, q),
v AS (SELECT item, row_number() OVER (ORDER BY d, seq) - 1 AS r FROM dv WHERE d < 1.5 ORDER BY d, seq LIMIT 10),
k AS (SELECT unnest(['red', 'widget', 'bolt']) AS w, unnest([0, 1, 2]) AS p),
kk AS (SELECT e.id, e.seq, e.file_path || ':' || e.start_line AS item, min(p) AS p FROM entities e JOIN k ON contains(lower(e.name), w) GROUP BY ALL),
h AS (SELECT *, row_number() OVER (ORDER BY p, seq) - 1 AS r FROM kk ORDER BY p, seq LIMIT 10),
l AS (SELECT 0 AS l, r, item FROM v UNION ALL SELECT 1, r, item FROM h),
s AS (SELECT item, sum(1.0::DOUBLE / (60 + r)) AS score, min(l * 1000 + r) AS f FROM l GROUP BY item),
f AS (SELECT h.id, s.score, row_number() OVER (ORDER BY round(s.score, 15) DESC, s.f) AS place FROM s JOIN (SELECT item, max_by(id, r) AS id FROM h GROUP BY item) h USING (item)),
a AS (SELECT id, score, place FROM f UNION ALL SELECT id, NULL, 1000000 + r FROM h WHERE id NOT IN (SELECT id FROM f))
SELECT id, round(score, 9) AS score, row_number() OVER (ORDER BY place)::INTEGER AS place FROM a
""")
def hybrid_retrieve(spark, sf):
    """Vector and keyword lists fused, hits that are no entity dropped, filled up with keyword hits."""
    e, v = _hybrid_tables(spark, sf)
    q = [float(x) for x in table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]]
    return retrieve.hybrid(e, v, KEYWORDS, q).select("id", F.round("score", 9).alias("score"), "place")


_TITLES = ", ".join(f"'{t}'" for t in K.SECTION_TITLES)


@query(f"""
WITH s AS (SELECT doc_id, [{_TITLES}][doc_id % 13 + 1] AS section_name, text FROM documents)
SELECT doc_id, section_name, list_position([{_TITLES}], section_name)::BIGINT AS place FROM s WHERE contains(lower(text), 'licensed') OR contains(lower(text), 'the ') OR contains(lower(text), 'über')
""")
def section_keyword_match(spark, sf):
    """Sections that hold any word, in the fixed order of sections."""
    name = F.element_at(F.array(*map(F.lit, K.SECTION_TITLES)), (F.col("doc_id") % 13 + 1).cast("int"))
    s = table(spark, sf, "documents").select("doc_id", name.alias("section_name"), F.col("text").alias("content"))
    return retrieve.sections_with(s, ["Licensed", "the ", "über"]).select("doc_id", "section_name", F.col("place").cast("long").alias("place"))


@query("""
WITH RECURSIVE d AS (
  SELECT source, (doc_id % 3)::INTEGER AS part, doc_id AS place, CASE WHEN doc_id % 3 = 2 THEN '### ' || lang ELSE '- ' || doc_id END || chr(10) AS head,
         CASE doc_id % 3 WHEN 0 THEN substr(text, 1, 400) WHEN 1 THEN '' ELSE text END AS body
  FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY part, place, head, body) AS i FROM d),
f AS (
  SELECT source, 0::BIGINT AS i, 12000::BIGINT AS room, []::INTEGER[] AS closed, -1 AS shown, '' AS text FROM (SELECT DISTINCT source FROM d)
  UNION ALL
  SELECT source, i, CASE WHEN shut THEN room WHEN part = 2 THEN room - length(head) - length(cut) - 1 WHEN fits THEN room - length(head || body) ELSE room END,
         CASE WHEN shut OR (CASE WHEN part = 2 THEN room - length(head) - length(cut) - 1 > 0 ELSE fits END) THEN closed ELSE list_append(closed, part) END,
         part, text || CASE WHEN shut THEN '' ELSE title || CASE WHEN part = 2 THEN head || cut || chr(10) WHEN fits THEN head || body ELSE '' END END
  FROM (
    SELECT f.source, o.i, f.room, f.closed, f.text, o.part, o.head, o.body, list_contains(f.closed, o.part) AS shut, length(o.head || o.body) <= f.room AS fits,
           CASE WHEN o.part = f.shown THEN '' ELSE ['## Semantic Matches', chr(10) || '## Code Entities', chr(10) || '## Documentation Sections'][o.part + 1] || chr(10) END AS title,
           CASE WHEN length(o.head || o.body) > f.room THEN substr(o.body, 1, greatest(0, f.room - length(o.head) - 4)) || chr(10) || '...' ELSE o.body END AS cut
    FROM f JOIN o ON o.source IS NOT DISTINCT FROM f.source AND o.i = f.i + 1))
SELECT source, max_by(text, i) AS text FROM f GROUP BY source
""")
def context_packing(spark, sf):
    """Per source a context text of about 12 000 characters, packed as a fold."""
    d = table(spark, sf, "documents")
    part = (F.col("doc_id") % 3).cast("int")
    head = F.when(part == 2, F.concat(F.lit("### "), F.col("lang"), F.lit("\n"))).otherwise(F.concat(F.lit("- "), F.col("doc_id").cast("string"), F.lit("\n")))
    body = F.when(part == 0, F.substring("text", 1, K.SNIPPET_CHARS)).when(part == 1, F.lit("")).otherwise(F.col("text"))
    return retrieve.pack(d.select("source", part.alias("part"), F.col("doc_id").alias("place"), head.alias("head"), body.alias("body")), "source")


@query(f"""
WITH {ENTITIES},
said AS (SELECT p_partkey AS seq, lower(p_type) || '/' || p_size || '.py' AS file_path, regexp_split_to_array(p_name, ' ') AS words FROM part),
last AS (SELECT file_path, max_by(words, seq) AS words FROM said GROUP BY file_path),
e AS (SELECT file_path, name, max_by(id, seq) AS id, min(seq) AS seq FROM entities GROUP BY file_path, name)
SELECT e.id, e.seq, e.file_path, e.name, coalesce(list_has_all(l.words, string_split(e.name, '_')), false) AS matched,
       CASE WHEN coalesce(list_has_all(l.words, string_split(e.name, '_')), false) THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END AS confidence
FROM e LEFT JOIN last l ON l.file_path = e.file_path
""")
def cross_validate(spark, sf):
    """Entities whose words the file's last narrative names."""
    said = table(spark, sf, "part").select(F.concat(F.lower("p_type"), F.lit("/"), F.col("p_size").cast("string"), F.lit(".py")).alias("file_path"), F.col("p_partkey").alias("seq"), F.array("p_name").alias("mentions"))
    e = entities(spark, sf).select("file_path", "name", "seq", "id")
    return validate.cross_validate(e, said).select("id", "seq", "file_path", "name", "matched", "confidence")


def _calls(spark, sf):
    """Order lines as call sites: the file is that of the part, the line its number, the callee the supplier's part's name."""
    e = entities(spark, sf)
    files = e.select(F.col("seq").alias("l_partkey"), F.col("file_path").alias("caller_file"))
    names = e.select(F.col("seq").alias("l_suppkey"), F.col("name").alias("callee"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    c = li.join(files, "l_partkey").join(names, "l_suppkey")
    return c.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_partkey", "caller_file", (F.col("l_linenumber") * 7).alias("caller_line"), "callee", F.when(F.col("l_returnflag") == "A", "red").alias("receiver"))


_CALLS = """
calls AS (
  SELECT l_orderkey * 10 + l_linenumber AS seq, l_partkey, e.file_path AS caller_file, l_linenumber * 7 AS caller_line, n.name AS callee, CASE WHEN l_returnflag = 'A' THEN 'red' END AS receiver
  FROM lineitem l JOIN entities e ON e.seq = l.l_partkey JOIN entities n ON n.seq = l.l_suppkey)"""


@query(f"""
WITH {ENTITIES}, {_CALLS},
s AS (SELECT DISTINCT caller_file, caller_line FROM calls)
SELECT s.caller_file, s.caller_line::INTEGER AS caller_line,
       arg_min(e.id, (CASE WHEN s.caller_line BETWEEN e.start_line AND e.end_line THEN 0 ELSE 1 END) * 1000000000 + e.seq) AS caller_id
FROM s LEFT JOIN entities e ON e.file_path = s.caller_file GROUP BY ALL
""")
def caller_range_join(spark, sf):
    """The first entity of a file whose lines hold the call, else the file's first."""
    return model.resolve_callers(_calls(spark, sf).select("caller_file", F.col("caller_line").cast("int").alias("caller_line")).distinct(), entities(spark, sf))


@query(f"""
WITH {ENTITIES}, {_CALLS},
c AS (SELECT DISTINCT caller_file, callee, receiver FROM calls),
anywhere AS (SELECT name, arg_min(id, seq) AS id FROM entities GROUP BY name),
here AS (SELECT name, file_path, arg_min(id, seq) AS id FROM entities GROUP BY name, file_path)
SELECT c.caller_file, c.callee, c.receiver, coalesce(a.id, h.id, b.id) AS callee_id
FROM c LEFT JOIN anywhere a ON a.name = c.receiver || '.' || c.callee LEFT JOIN here h ON h.name = c.callee AND h.file_path = c.caller_file LEFT JOIN anywhere b ON b.name = c.callee
""")
def callee_priority_join(spark, sf):
    """Callee by receiver, then in the file, then anywhere."""
    return model.resolve_callees(_calls(spark, sf).select("caller_file", "callee", "receiver").distinct(), entities(spark, sf))


@query(f"""
WITH {ENTITIES}, i AS (SELECT DISTINCT lower(p_type) || '/' || (p_size + 10) || '.py' AS source_file, 'mod.' || p_brand AS target FROM part),
f AS (SELECT file_path, arg_min(id, seq) AS id FROM entities GROUP BY file_path)
SELECT 'import:' || coalesce(f.id, source_file) || ':' || target AS id, coalesce(f.id, source_file) AS source_id, target AS target_id
FROM i LEFT JOIN f ON f.file_path = i.source_file
""")
def import_sources(spark, sf):
    """An import starts at its file's first entity, or at the file."""
    i = table(spark, sf, "part").select(F.concat(F.lower("p_type"), F.lit("/"), (F.col("p_size") + 10).cast("string"), F.lit(".py")).alias("source_file"), F.concat(F.lit("mod."), F.col("p_brand")).alias("target")).distinct()
    return model.import_edges(i.withColumn("seq", F.lit(0)), entities(spark, sf)).select("id", "source_id", "target_id")


@query("""
WITH t AS (SELECT * FROM (VALUES ('region', 'db.sql::table:region'), ('nation', 'db.sql::table:nation'), ('customer', 'db.sql::table:customer')) v(name, id)),
r AS (
  SELECT 'nation' || n_nationkey AS "table", 'region' AS target FROM nation
  UNION ALL SELECT 'customer' || c_custkey, 'nation' FROM customer UNION ALL SELECT 'orders' || o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'customer' ELSE 'lost' END FROM orders)
SELECT 'schema_ref:f.sql::table:' || r."table" || ':' || coalesce(t.id, 'f.sql::table:' || r.target) AS id, 'f.sql::table:' || r."table" AS source_id, coalesce(t.id, 'f.sql::table:' || r.target) AS target_id
FROM r LEFT JOIN t ON t.name = r.target
""")
def fk_edges(spark, sf):
    """Foreign keys as edges; an unknown target gets an id in the source's file."""
    t = spark.createDataFrame([(n, f"db.sql::table:{n}", i) for i, n in enumerate(("region", "nation", "customer"))], "name string, id string, seq int")
    one = lambda name, key, target: table(spark, sf, name).select(F.concat(F.lit(name), F.col(key).cast("string")).alias("table"), target.alias("target"))
    r = one("nation", "n_nationkey", F.lit("region")).unionByName(one("customer", "c_custkey", F.lit("nation")))
    r = r.unionByName(one("orders", "o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "customer").otherwise("lost")))
    return model.reference_edges(r.withColumn("file_path", F.lit("f.sql")).withColumn("kind", F.lit("one_to_many")).withColumn("seq", F.lit(0)), t).select("id", "source_id", "target_id")


@query(f"""
WITH {ENTITIES}, {EDGES}, k AS (SELECT * FROM entities WHERE entity_type <> 'table')
SELECT s.file_path AS source_file, s.name AS source_symbol, coalesce(t.file_path, e.target_id) AS target_file, coalesce(t.name, e.target_id) AS target_symbol, e.relationship_type
FROM edges e JOIN k s ON s.id = e.source_id LEFT JOIN k t ON t.id = e.target_id
""")
def edge_persist(spark, sf):
    """Edges as stored rows; here tables are no entities, so that some ends are unknown."""
    return model.persisted_edges(edges(spark, sf), entities(spark, sf).where("entity_type <> 'table'")).drop("seq")


def _bfs(here: str, there: str) -> str:
    return f"""
WITH RECURSIVE {ENTITIES}, {EDGES}, h AS (SELECT DISTINCT {here} AS a, {there} AS b FROM edges WHERE relationship_type = 'calls'),
s AS (SELECT unnest(['part::5', 'part::17', 'part::{'{'}x{'}'}']) AS start),
w(start, node, d) AS (SELECT start, b, 1 FROM s JOIN h ON h.a = s.start UNION SELECT w.start, h.b, w.d + 1 FROM w JOIN h ON h.a = w.node WHERE w.d < 3)
SELECT start, node, min(d)::INTEGER AS distance FROM w GROUP BY start, node""".replace("{x}", "33")


def _starts(spark):
    return spark.createDataFrame([("part::5",), ("part::17",), ("part::33",)], "start string")


@query(_bfs("source_id", "target_id"))
def khop_callees(spark, sf):
    """What three entities call within three hops, with the nearest distance."""
    return graph.neighbourhood(edges(spark, sf), _starts(spark), 3)


@query(_bfs("target_id", "source_id"))
def khop_callers(spark, sf):
    """What calls them within three hops."""
    return graph.neighbourhood(edges(spark, sf), _starts(spark), 3, callers=True)


@query(f"WITH {ENTITIES}, {EDGES} SELECT DISTINCT id, source_id, target_id FROM edges WHERE source_id IN ('part::5', 'part::17', 'part::33') OR target_id IN ('part::5', 'part::17', 'part::33')")
def edges_for_node(spark, sf):
    """Edges that leave or reach a node, each once."""
    return graph.edges_of(edges(spark, sf), _starts(spark).withColumnRenamed("start", "node")).select("id", "source_id", "target_id")


@query(f"WITH {MODEL} SELECT entity_id, n + 1 AS steps, sha256(steps) AS text_sha FROM workflows")
def workflow_inference(spark, sf):
    """Functions that call two or more entities, with ordered steps."""
    w = model.workflows(entities(spark, sf), edges(spark, sf))
    line = F.transform("steps", lambda s: F.concat(F.lit("- Step "), s["order"].cast("string"), F.lit(": `"), s["entity_id"], F.lit("` — "), s["description"], F.lit("\n")))
    return w.select("entity_id", F.size("steps").cast("long").alias("steps"), F.sha2(F.array_join(line, "\n"), 256).alias("text_sha"))


@query(f"""
WITH {ENTITIES}, {EDGES}, i AS (SELECT target_id, source_id, row_number() OVER (PARTITION BY target_id ORDER BY seq) AS r, count(*) OVER (PARTITION BY target_id) AS n FROM edges WHERE relationship_type = 'imports')
SELECT target_id, n AS importers, string_agg('`' || source_id || '`', ', ' ORDER BY r) FILTER (r <= 3) || CASE WHEN n > 3 THEN '...' ELSE '' END AS used_by FROM i GROUP BY target_id, n
""")
def importers_per_module(spark, sf):
    """How many import a module, and the first three."""
    return report.importers(edges(spark, sf), []).drop("first")


@query(f"""
WITH {ENTITIES}, d AS (
  SELECT * FROM entities t WHERE entity_type = 'table' UNION ALL
  SELECT * FROM entities c WHERE entity_type = 'class' AND NOT EXISTS (SELECT 1 FROM entities t WHERE t.entity_type = 'table' AND t.project_id = c.project_id AND t.name = c.name AND t.file_path = c.file_path))
SELECT project_id, id, entity_type FROM d
""")
def data_models_anti(spark, sf):
    """Tables, and classes that are not also a table."""
    from lodestone.plans.standins import model as whole

    return report.data_entities(whole(spark, sf)).select("project_id", "id", "entity_type")


@query(f"""
WITH {ENTITIES}
SELECT file_path, count(*) AS entities, count(DISTINCT project_id) AS projects, list_sort(list(DISTINCT name)) AS names FROM entities GROUP BY file_path
""")
def module_tree(spark, sf):
    """A4, A5: entities of each file."""
    return entities(spark, sf).groupBy("file_path").agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("project_id").alias("projects"), F.array_sort(F.collect_set("name")).alias("names"))


@query(f"""
WITH {MODEL}
SELECT p.project_id, (SELECT count(*) FROM entities e WHERE e.project_id = p.project_id) AS entities, (SELECT count(DISTINCT file_path) FROM entities e WHERE e.project_id = p.project_id) AS files,
       (SELECT count(DISTINCT language) FROM entities e WHERE e.project_id = p.project_id) AS languages, (SELECT count(*) FROM rules e WHERE e.project_id = p.project_id) AS rules,
       (SELECT count(*) FROM workflows e WHERE e.project_id = p.project_id) AS workflows
FROM projects p
""")
def at_a_glance(spark, sf):
    """A3: the counts of a project."""
    from lodestone.plans.standins import model as whole

    return report.at_a_glance(whole(spark, sf))


@query(f"""
WITH {ENTITIES}, r AS (SELECT *, row_number() OVER (PARTITION BY file_path, name ORDER BY seq) AS a, row_number() OVER (PARTITION BY file_path, name ORDER BY seq DESC) AS z FROM entities)
SELECT l.file_path, l.name, f.seq, l.id, l.entity_type FROM r l JOIN r f ON f.file_path = l.file_path AND f.name = l.name AND f.a = 1 WHERE l.z = 1
""")
def upsert_last_value(spark, sf):
    """Of a repeated key the last value at the first place."""
    return last_value_first_place(entities(spark, sf).select("file_path", "name", "seq", "id", "entity_type"), ["file_path", "name"])


@query(f"""
WITH {ENTITIES}, r AS (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY seq) AS r FROM entities)
SELECT project_id, id FROM r WHERE r <= 30
""")
def context_caps(spark, sf):
    """The first thirty entities of each project."""
    return top_per(entities(spark, sf), ["project_id"], [F.col("seq")], K.CONTEXT_CAPS["entities"]).select("project_id", "id")
