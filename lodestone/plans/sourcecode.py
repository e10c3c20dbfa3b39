"""Queries of the extraction operators over a small source tree and over files made from the part table.

The rows of the tree are derived by hand; those of the generated files follow from the table in SQL, without parsing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import language_of
from lodestone.operators import extract, ingest
from lodestone.plans.fixture import FILES, TEMPLATES
from lodestone.plans.registry import query


def generated(spark: SparkSession, sf: str) -> DataFrame:
    """A file for every part."""
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size")
    filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("%K"), F.concat(F.lit("K"), F.col("p_partkey").cast("string"))), F.lit("%S"), F.concat(F.lit("S"), F.col("p_size").cast("string")))
    kind = F.col("p_partkey") % len(TEMPLATES)
    path, content = (F.array(*(filled(t[i]) for t in TEMPLATES)) for i in (0, 1))
    return part.select(F.get(path, kind.cast("int")).alias("path"), F.get(content, kind.cast("int")).alias("content"))


def files(spark: SparkSession, sf: str | None = None) -> DataFrame:
    tree = spark.createDataFrame(sorted(FILES.items()), "path string, content string")
    return (tree.unionByName(generated(spark, sf)) if sf else tree).withColumn("language", language_of(F.col("path")))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Files as one chunk each."""
    return files(spark, sf).select(F.col("path").alias("file_path"), "language", F.lit(1).alias("start_line"), "content", F.xxhash64("path").alias("seq"))


#: In the generated files K and S are followed by a part's key and size.
GEN = "WITH p AS (SELECT p_partkey % 8 AS m, 'K' || p_partkey AS k, 'S' || p_size AS s FROM part) "


@query(GEN + """
SELECT * FROM (VALUES
 ('get_user', 'function', 'app/main.py', 11, 13, 'python', 'get_user(user_id: int, q: str = "x") -> dict', 'Return a user.', ''), ('items', 'function', 'app/main.py', 17, 18, 'python', 'items()', NULL, ''),
 ('helper', 'function', 'app/main.py', 21, 23, 'python', 'helper(text)', NULL, ''), ('User', 'class', 'app/models.py', 4, 8, 'python', NULL, NULL, ''), ('Plain', 'class', 'app/models.py', 11, 16, 'python', NULL, NULL, 'run,stop'),
 ('load', 'function', 'app/service.py', 1, 2, 'python', 'load(key)', NULL, ''), ('fetch', 'function', 'app/service.py', 5, 6, 'python', 'fetch(key)', NULL, ''),
 ('add', 'function', 'web/server.js', 5, 5, 'javascript', 'add(x, y)', 'Adds numbers', ''), ('Cart', 'class', 'web/server.js', 6, 7, 'javascript', NULL, NULL, ''),
 ('Shape', 'interface', 'web/types.ts', 1, 3, 'typescript', NULL, NULL, ''), ('Base', 'class', 'web/types.ts', 4, 5, 'typescript', NULL, NULL, ''),
 ('Main', 'class', 'src/Main.java', 3, 4, 'java', NULL, NULL, ''), ('Runner', 'interface', 'src/Main.java', 5, 6, 'java', NULL, NULL, ''),
 ('Run', 'function', 'src/main.go', 6, 8, 'go', 'Run(a int)', NULL, ''), ('Srv', 'class', 'src/main.go', 9, 10, 'go', NULL, NULL, ''),
 ('make', 'function', 'src/lib.rs', 2, 4, 'rust', 'make(x: i32)', NULL, ''), ('Draw', 'interface', 'src/lib.rs', 5, 6, 'rust', NULL, NULL, ''), ('Dot', 'class', 'src/lib.rs', 7, 8, 'rust', NULL, NULL, ''),
 ('main', 'function', 'src/a.c', 3, 5, 'c', 'main(void)', NULL, '')
) v(name, entity_type, file_path, start_line, end_line, language, signature, docstring, children)
UNION ALL SELECT 'f' || k, 'function', 'gen/' || k || '.py', 10, 12, 'python', 'f' || k || '(x, y=(1, 2))', NULL, '' FROM p WHERE m = 0
UNION ALL SELECT 'M' || k, 'class', 'gen/' || k || '.py', 14, 19, 'python', NULL, NULL, '' FROM p WHERE m = 0
UNION ALL SELECT 'f' || k, 'function', 'gen/' || k || '.ts', 6, 11, 'typescript', 'f' || k || '(' || chr(10) || '  x: number,' || chr(10) || '  y = "}"' || chr(10) || ')', 'Adds ' || k || '.', '' FROM p WHERE m = 1
UNION ALL SELECT 'C' || k, 'class', 'gen/' || k || '.ts', 12, 15, 'typescript', NULL, NULL, 'run,stop' FROM p WHERE m = 1
UNION ALL SELECT 'C' || k, 'class', 'gen/' || k || '.java', 6, 12, 'java', NULL, 'Part ' || k || '.', 'run' FROM p WHERE m = 3
UNION ALL SELECT 'L' || k, 'class', 'gen/' || k || '.java', 13, 13, 'java', NULL, NULL, '' FROM p WHERE m = 3
UNION ALL SELECT 'Run' || k, 'function', 'gen/' || k || '.go', 8, 12, 'go', 'Run' || k || '(' || chr(10) || chr(9) || 'a int,' || chr(10) || ')', NULL, '' FROM p WHERE m = 4
UNION ALL SELECT 'T' || k, 'class', 'gen/' || k || '.go', 13, 15, 'go', NULL, NULL, '' FROM p WHERE m = 4
UNION ALL SELECT 'I' || k, 'interface', 'gen/' || k || '.go', 16, 18, 'go', NULL, NULL, '' FROM p WHERE m = 4
UNION ALL SELECT 'P' || k, 'class', 'gen/' || k || '.rs', 6, 9, 'rust', NULL, NULL, '' FROM p WHERE m = 5
UNION ALL SELECT 'P' || k, 'class', 'gen/' || k || '.rs', 10, 14, 'rust', NULL, NULL, 'draw' || k FROM p WHERE m = 5
UNION ALL SELECT 'go' || k, 'function', 'gen/' || k || '.rs', 15, 17, 'rust', 'go' || k || '(x: T)', NULL, '' FROM p WHERE m = 5
UNION ALL SELECT 'add' || k, 'function', 'gen/' || k || '.c', 5, 10, 'c', 'add' || k || '(int a,' || chr(10) || '      int b)', NULL, '' FROM p WHERE m = 6
UNION ALL SELECT 's' || k, 'class', 'gen/' || k || '.c', 11, 13, 'c', NULL, NULL, '' FROM p WHERE m = 6
UNION ALL SELECT 'n' || k, 'class', 'gen/' || k || '.cpp', 3, 5, 'cpp', NULL, NULL, 'f' || k FROM p WHERE m = 7
UNION ALL SELECT 'C' || k, 'class', 'gen/' || k || '.cpp', 6, 10, 'cpp', NULL, NULL, 'get' || k FROM p WHERE m = 7
UNION ALL SELECT 'put' || k, 'function', 'gen/' || k || '.cpp', 11, 13, 'cpp', 'put' || k || '(int a)', NULL, '' FROM p WHERE m = 7
""")
def extract_entities(spark, sf):
    """Top-level declarations over any number of lines; a file that does not parse gives none."""
    return extract.entities(chunks(spark, sf)).select("name", "entity_type", "file_path", "start_line", "end_line", "language", "signature", "docstring", F.array_join("children", ",").alias("children"))


@query(GEN + """
SELECT * FROM (VALUES
 ('app/main.py', 7, 'Api', NULL, 'direct', 'low'), ('app/main.py', 10, 'get', 'app', 'direct', 'low'), ('app/main.py', 13, 'load', 'svc', 'direct', 'high'), ('app/main.py', 16, 'route', 'app', 'direct', 'low'),
 ('app/main.py', 18, 'helper', NULL, 'direct', 'high'), ('app/main.py', 18, 'dumps', 'json', 'direct', 'low'), ('app/main.py', 22, 'print', NULL, 'direct', 'low'), ('app/main.py', 23, 'join', 'os.path', 'direct', 'low'),
 ('app/models.py', 6, 'Column', NULL, 'direct', 'low'), ('app/models.py', 7, 'mapped_column', NULL, 'direct', 'low'), ('app/models.py', 8, 'relationship', NULL, 'direct', 'low'), ('app/models.py', 13, 'User', NULL, 'direct', 'high'), ('app/models.py', 16, 'run', 'self', 'direct', 'low'),
 ('app/service.py', 2, 'fetch', NULL, 'direct', 'high'), ('web/server.js', 1, 'require', NULL, 'direct', 'low'), ('web/server.js', 3, 'post', 'router', 'direct', 'low'), ('web/server.js', 5, 'sum', NULL, 'direct', 'low'), ('web/server.js', 8, 'Cart', NULL, 'constructor', 'high'),
 ('src/main.go', 7, 'Println', 'fmt', 'direct', 'low'), ('src/a.c', 4, 'run', NULL, 'direct', 'low')
) v(caller_file, caller_line, callee, receiver, call_type, confidence)
UNION ALL SELECT 'gen/' || k || '.py', l, c, r, 'direct', 'low' FROM p, (VALUES (7, 'get', 'app'), (11, 'g', NULL), (12, 'h', 'obj'), (15, 'Column', NULL), (16, 'Column', NULL), (17, 'String', NULL)) v(l, c0, r),
  LATERAL (SELECT c0 || CASE c0 WHEN 'g' THEN s WHEN 'h' THEN k ELSE '' END AS c) WHERE m = 0
UNION ALL SELECT 'gen/' || k || '.ts', l, c, r, t, 'low' FROM p, (VALUES (10, 'g', NULL, 'direct'), (10, 'replace', 'y', 'direct'), (13, 'E', NULL, 'constructor'), (16, 'post', 'router', 'direct')) v(l, c0, r, t),
  LATERAL (SELECT c0 || CASE c0 WHEN 'g' THEN s WHEN 'E' THEN k ELSE '' END AS c) WHERE m = 1
UNION ALL SELECT 'gen/' || k || '.java', 10, 'help' || s, NULL, 'direct', 'low' FROM p WHERE m = 3
UNION ALL SELECT 'gen/' || k || '.go', 11, 'g' || s, NULL, 'direct', 'low' FROM p WHERE m = 4
UNION ALL SELECT 'gen/' || k || '.rs', 12, 'g' || s, NULL, 'direct', 'low' FROM p WHERE m = 5
UNION ALL SELECT 'gen/' || k || '.rs', 16, 'h' || k, 'x', 'direct', 'low' FROM p WHERE m = 5
UNION ALL SELECT 'gen/' || k || '.c', 9, 'g' || s, NULL, 'direct', 'low' FROM p WHERE m = 6
UNION ALL SELECT 'gen/' || k || '.cpp', 4, 'g' || s, NULL, 'direct', 'low' FROM p WHERE m = 7
UNION ALL SELECT 'gen/' || k || '.cpp', 9, 'h' || k, NULL, 'direct', 'low' FROM p WHERE m = 7
""")
def extract_calls(spark, sf):
    """Call sites with receiver, and whether the callee is known."""
    c = chunks(spark, sf)
    return extract.calls(c, extract.entities(c)).select("caller_file", "caller_line", "callee", "receiver", "call_type", "confidence")


@query(GEN + """
SELECT * FROM (VALUES
 ('app/main.py', 'os', 'module', ''), ('app/main.py', 'fastapi', 'symbol', 'FastAPI,Depends'), ('app/main.py', 'app.db', 'wildcard', '*'), ('app/main.py', 'app.service', 'module', ''), ('app/main.py', 'json', 'module', ''),
 ('app/models.py', 'sqlalchemy', 'symbol', 'Column'), ('web/server.js', 'express', 'module', ''), ('web/server.js', './util', 'symbol', 'a,b'), ('web/types.ts', 'lib/x', 'module', ''),
 ('src/Main.java', 'java.util.List', 'symbol', ''), ('src/Main.java', 'org.junit.Assert', 'wildcard', ''), ('src/main.go', 'fmt', 'module', ''), ('src/main.go', 'net/http', 'module', ''),
 ('src/lib.rs', 'std::collections::HashMap', 'module', ''), ('src/a.c', 'stdio.h', 'module', ''), ('src/a.c', 'a.h', 'module', '')
) v(source_file, target, import_type, symbols)
UNION ALL SELECT 'gen/' || k || '.py', 'pkg' || s, 'symbol', 'a' || k || ',b' || k FROM p WHERE m = 0
UNION ALL SELECT 'gen/' || k || '.py', 'os' || k || '.path', 'module', '' FROM p WHERE m = 0
UNION ALL SELECT 'gen/' || k || '.ts', './mod' || s, 'symbol', 'a' || k || ',b' || k FROM p WHERE m = 1
UNION ALL SELECT 'gen/' || k || '.java', 'java.util.Lib' || s, 'symbol', '' FROM p WHERE m = 3
UNION ALL SELECT 'gen/' || k || '.java', 'org.junit.T' || k, 'wildcard', '' FROM p WHERE m = 3
UNION ALL SELECT 'gen/' || k || '.go', 'net/' || k, 'module', '' FROM p WHERE m = 4
UNION ALL SELECT 'gen/' || k || '.go', 'os', 'module', '' FROM p WHERE m = 4
UNION ALL SELECT 'gen/' || k || '.rs', 'std::', 'module', '' FROM p WHERE m = 5
UNION ALL SELECT 'gen/' || k || '.rs', 'crate::k' || k || '::', 'module', '' FROM p WHERE m = 5
UNION ALL SELECT 'gen/' || k || '.c', 'a' || s || '.h', 'module', '' FROM p WHERE m = 6
UNION ALL SELECT 'gen/' || k || '.c', 'k' || k || '.h', 'module', '' FROM p WHERE m = 6
UNION ALL SELECT 'gen/' || k || '.cpp', 'vector', 'module', '' FROM p WHERE m = 7
UNION ALL SELECT 'gen/' || k || '.cpp', 'k' || k || '.hpp', 'module', '' FROM p WHERE m = 7
""")
def extract_imports(spark, sf):
    """Imports of each language, over any number of lines."""
    return extract.imports(chunks(spark, sf)).select("source_file", "target", "import_type", F.array_join("symbols", ",").alias("symbols"))


@query(GEN + """
SELECT * FROM (VALUES
 ('users', 2, 'id INTEGER true true;email VARCHAR(255) false false unique;age INT true false default:0', ''),
 ('posts', 7, 'id INTEGER true false;price DECIMAL(10, true false;user_id INTEGER true false', 'users user_id')
) v(name, start_line, columns, links)
UNION ALL SELECT 't' || k, 2, 'id BIGINT false true;note VARCHAR(' || s || ') true false unique,default:''x);y'';other INT true false', 't' || s || ' other' FROM p WHERE m = 2
""")
def extract_sql_ddl(spark, sf):
    """Tables with their columns and foreign keys. A column's nullability is what its own text says."""
    t = extract.sql_tables(chunks(spark, sf))
    cols = F.transform("attributes", lambda a: F.concat_ws(" ", a["name"], a["data_type"], a["nullable"].cast("string"), a["primary_key"].cast("string"), F.when(F.size(a["constraints"]) > 0, F.array_join(a["constraints"], ","))))
    links = F.transform("relationships", lambda r: F.concat_ws(" ", r["target_entity"], r["foreign_key"]))
    return t.select("name", "start_line", F.array_join(cols, ";").alias("columns"), F.array_join(links, ";").alias("links"))


@query(GEN + """
SELECT 'User' AS name, 4 AS start_line, 'id Integer true true;email String false false' AS columns, 'Post' AS links
UNION ALL SELECT 'M' || k, 14, 'id Integer true true;ref String false false', '' FROM p WHERE m = 0
""")
def extract_orm(spark, sf):
    """Mapped classes with columns and relations."""
    t = extract.orm_models(chunks(spark, sf))
    cols = F.transform("attributes", lambda a: F.concat_ws(" ", a["name"], a["data_type"], a["nullable"].cast("string"), a["primary_key"].cast("string")))
    return t.select("name", "start_line", F.array_join(cols, ";").alias("columns"), F.array_join(F.transform("relationships", lambda r: r["target_entity"]), ";").alias("links"))


@query(GEN + """
SELECT * FROM (VALUES ('GET', '/users/{user_id}', 'app/main.py', 'get_user', 10, 'user_id'), ('GET', '/items/:id', 'app/main.py', 'items', 16, 'id'), ('POST', '/items/:id', 'app/main.py', 'items', 16, 'id'),
 ('POST', '/orders/:id', 'web/server.js', 'anonymous', 3, 'id')) v(method, path, handler_file, handler_function, handler_line, parameters)
UNION ALL SELECT 'GET', '/p/' || k || '/{item}', 'gen/' || k || '.py', 'f' || k, 7, 'item' FROM p WHERE m = 0
UNION ALL SELECT 'POST', '/q/' || k || '/:id', 'gen/' || k || '.ts', 'anonymous', 16, 'id' FROM p WHERE m = 1
""")
def extract_endpoints(spark, sf):
    """Routes, one row per method."""
    return extract.endpoints(chunks(spark, sf)).select("method", "path", "handler_file", "handler_function", "handler_line", F.array_join("parameters", ",").alias("parameters"))


@query(GEN + """
SELECT * FROM (VALUES ('app/main.py', 'block', 1, 9, NULL), ('app/main.py', 'function', 10, 13, 'get_user'), ('app/main.py', 'function', 16, 18, 'items'), ('app/main.py', 'function', 21, 23, 'helper'),
 ('app/models.py', 'block', 1, 3, NULL), ('app/models.py', 'class', 4, 8, 'User'), ('app/models.py', 'class', 11, 15, 'Plain'), ('app/models.py', 'class', 16, 16, 'Plain'), ('app/service.py', 'function', 1, 2, 'load'), ('app/service.py', 'function', 5, 6, 'fetch'),
 ('app/broken.py', 'block', 1, 3, NULL), ('db/schema.sql', 'block', 1, 14, NULL),
 ('web/server.js', 'block', 1, 4, NULL), ('web/server.js', 'function', 5, 5, 'add'), ('web/server.js', 'class', 6, 7, 'Cart'), ('web/types.ts', 'interface', 1, 3, 'Shape'), ('web/types.ts', 'class', 4, 5, 'Base'),
 ('src/Main.java', 'block', 1, 2, NULL), ('src/Main.java', 'class', 3, 4, 'Main'), ('src/Main.java', 'interface', 5, 6, 'Runner'), ('src/main.go', 'block', 1, 5, NULL), ('src/main.go', 'function', 6, 8, 'Run'), ('src/main.go', 'class', 9, 10, 'Srv'),
 ('src/lib.rs', 'block', 1, 1, NULL), ('src/lib.rs', 'function', 2, 4, 'make'), ('src/lib.rs', 'interface', 5, 6, 'Draw'), ('src/lib.rs', 'class', 7, 8, 'Dot'), ('src/a.c', 'block', 1, 2, NULL), ('src/a.c', 'function', 3, 5, 'main')
) v(file_path, chunk_type, start_line, end_line, symbol_name)
UNION ALL SELECT 'gen/' || k || '.py', t, a, b, CASE t WHEN 'function' THEN 'f' || k WHEN 'class' THEN 'M' || k END FROM p, (VALUES ('block', 1, 6), ('function', 7, 11), ('function', 12, 12), ('class', 14, 18), ('class', 19, 19)) v(t, a, b) WHERE m = 0
UNION ALL SELECT 'gen/' || k || '.ts', t, a, b, CASE t WHEN 'function' THEN 'f' || k WHEN 'class' THEN 'C' || k END FROM p, (VALUES ('block', 1, 5), ('function', 6, 10), ('function', 11, 11), ('class', 12, 15)) v(t, a, b) WHERE m = 1
UNION ALL SELECT 'gen/' || k || '.sql', 'block', 1, 9, NULL FROM p WHERE m = 2
UNION ALL SELECT 'gen/' || k || '.java', t, a, b, CASE WHEN t = 'block' THEN NULL WHEN a < 13 THEN 'C' || k ELSE 'L' || k END FROM p, (VALUES ('block', 1, 5), ('class', 6, 10), ('class', 11, 12), ('class', 13, 13)) v(t, a, b) WHERE m = 3
UNION ALL SELECT 'gen/' || k || '.go', t, a, b, n || k FROM p, (VALUES ('block', 1, 7, NULL), ('function', 8, 12, 'Run'), ('class', 13, 15, 'T'), ('interface', 16, 18, 'I')) v(t, a, b, n) WHERE m = 4
UNION ALL SELECT 'gen/' || k || '.rs', t, a, b, n || k FROM p, (VALUES ('block', 1, 5, NULL), ('class', 6, 9, 'P'), ('class', 10, 14, 'P'), ('function', 15, 17, 'go')) v(t, a, b, n) WHERE m = 5
UNION ALL SELECT 'gen/' || k || '.c', t, a, b, n || k FROM p, (VALUES ('block', 1, 4, NULL), ('function', 5, 9, 'add'), ('function', 10, 10, 'add'), ('class', 11, 13, 's')) v(t, a, b, n) WHERE m = 6
UNION ALL SELECT 'gen/' || k || '.cpp', t, a, b, n || k FROM p, (VALUES ('block', 1, 2, NULL), ('class', 3, 5, 'n'), ('class', 6, 10, 'C'), ('function', 11, 13, 'put')) v(t, a, b, n) WHERE m = 7
""")
def declaration_chunks(spark, sf):
    """Chunks by declaration, those over five lines cut."""
    return extract.declaration_chunks(files(spark, sf), frame=5).select("file_path", "chunk_type", "start_line", "end_line", "symbol_name")


@query(GEN + """
SELECT language, sum(file_count)::BIGINT AS file_count, sum(line_count)::BIGINT AS line_count FROM (
 SELECT * FROM (VALUES ('python', 4, 47), ('sql', 1, 13), ('javascript', 1, 8), ('typescript', 1, 6), ('java', 1, 6), ('go', 1, 10), ('rust', 1, 8), ('c', 1, 5)) v(language, file_count, line_count)
 UNION ALL SELECT language, count(*), sum(lines) FROM p JOIN (VALUES (0, 'python', 19), (1, 'typescript', 16), (2, 'sql', 8), (3, 'java', 13), (4, 'go', 18), (5, 'rust', 17), (6, 'c', 14), (7, 'cpp', 13)) t(m, language, lines) USING (m) GROUP BY language
) GROUP BY language
""")
def tree_languages(spark, sf):
    """Languages of a source tree."""
    return ingest.language_stats(files(spark, sf)).select("language", "file_count", "line_count")
