"""Queries of the text, ingestion and quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import scoring, text
from lodestone.functions import fixed as K
from lodestone.operators import ingest
from lodestone.plans.registry import query
from lodestone.plans.standins import table

_STOP = ", ".join(f"'{w}'" for w in K.STOP_WORDS)


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query("""
SELECT lang AS language, count(*) AS file_count,
       sum(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS line_count,
       list_sort(list(DISTINCT source)) AS sources
FROM documents GROUP BY lang
""")
def language_stats(spark, sf):
    """Files, lines and distinct suffixes by language."""
    d = _docs(spark, sf).withColumn("lines", text.line_count(F.col("text")))
    return d.groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("file_count"), F.sum("lines").alias("line_count"), F.array_sort(F.collect_set("source")).alias("sources"))


@query("""
SELECT doc_id, length(text) // 4 AS tokens, contains(text, chr(9)) AS has_tab, left(text, 32000) = text AS whole
FROM documents WHERE length(text) // 4 >= 10
""")
def binary_and_size_filter(spark, sf):
    """What is worth embedding."""
    t = F.col("text")
    return _docs(spark, sf).where(text.estimate_tokens(t) >= 10).select("doc_id", text.estimate_tokens(t).alias("tokens"), F.contains(t, F.lit("\t")).alias("has_tab"), (F.left(t, F.lit(32000)) == t).alias("whole"))


@query(r"""
WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents WHERE coalesce(text, '') <> ''),
f AS (SELECT doc_id, l, len(l) AS n, unnest(range(0, greatest(ceil((len(l) - 50) / 20.0), 0)::BIGINT + 1)) AS ordinal FROM l)
SELECT doc_id, ordinal, ordinal * 20 + 1 AS start_line, least(ordinal * 20 + 50, n) AS end_line,
       sha256(array_to_string(l[ordinal * 20 + 1 : ordinal * 20 + 50], chr(10))) AS content_sha
FROM f
""")
def line_chunks_overlap(spark, sf):
    """Overlapping line frames of 50 lines, 30 of them shared."""
    f = ingest.line_frames(_docs(spark, sf), max_tokens=1000, overlap=30, key="doc_id", text="text")
    return f.select("doc_id", "ordinal", "start_line", "end_line", F.sha2("content", 256).alias("content_sha"))


def _turn_chunks(spark, sf):
    """Turns as chunks, conversations as files: a turn is as long as it has lines."""
    c = table(spark, sf, "conversations").withColumn("n", text.line_count(F.col("text")))
    return c.select(F.col("conv_id").alias("file_path"), F.lit("chat").alias("language"), F.col("turn").alias("seq"), (F.col("turn") * 100 + 1).cast("int").alias("start_line"),
                    (F.col("turn") * 100 + F.col("n")).cast("int").alias("end_line"), F.col("role").alias("chunk_type"), F.col("role").alias("symbol_name"), F.col("text").alias("content"))


@query("""
WITH RECURSIVE c AS (
  SELECT conv_id, turn * 100 + 1 AS a, turn * 100 + (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END) AS b,
         role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i
  FROM conversations),
f AS (
  SELECT conv_id, i, 0 AS ordinal, a, b, role AS kind, role AS name, text AS content FROM c WHERE i = 1
  UNION ALL
  SELECT c.conv_id, c.i, CASE WHEN m THEN f.ordinal ELSE f.ordinal + 1 END, CASE WHEN m THEN f.a ELSE c.a END, c.b,
         CASE WHEN m THEN 'block' ELSE c.role END, CASE WHEN m THEN f.name ELSE c.role END, CASE WHEN m THEN f.content || chr(10) || c.text ELSE c.text END
  FROM (SELECT f.*, f.b - f.a + 1 < 3 AS short FROM f) f JOIN (SELECT c.*, c.b - c.a + 1 < 3 AS tiny FROM c) c ON c.conv_id = f.conv_id AND c.i = f.i + 1,
       LATERAL (SELECT short AND tiny AS m))
SELECT conv_id, ordinal::INTEGER AS ordinal, max_by(a, i)::INTEGER AS start_line, max_by(b, i)::INTEGER AS end_line, max_by(kind, i) AS chunk_type, max_by(name, i) AS symbol_name, sha256(max_by(content, i)) AS content_sha
FROM f GROUP BY conv_id, ordinal
""")
def small_chunk_merge(spark, sf):
    """Neighbours that are both short become one block, as a left fold."""
    m = ingest.merge_small(_turn_chunks(spark, sf), min_lines=3)
    return m.select(F.col("file_path").alias("conv_id"), "ordinal", "start_line", "end_line", "chunk_type", "symbol_name", F.sha2("content", 256).alias("content_sha"))


@query("""
WITH RECURSIVE c AS (
  SELECT conv_id, turn * 100 + 1 AS a, turn * 100 + (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END) AS b,
         length(text) - length(replace(text, chr(10), '')) + 1 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i
  FROM conversations),
f AS (
  SELECT conv_id, i, 0 AS ordinal, a, b, 1 AS k, a AS pa, b AS pb, n FROM c WHERE i = 1
  UNION ALL
  SELECT c.conv_id, c.i, CASE WHEN m THEN f.ordinal ELSE f.ordinal + 1 END, CASE WHEN m THEN f.a ELSE c.a END, c.b, CASE WHEN m THEN f.k + f.n ELSE 1 END, c.a, c.b, c.n
  FROM f JOIN c ON c.conv_id = f.conv_id AND c.i = f.i + 1, LATERAL (SELECT f.b - f.a + 1 < 3 AND c.b - c.a + 1 < 3 AS m)),
t AS (SELECT conv_id, ordinal, max(k + n - 1) AS n FROM f GROUP BY ALL),
q AS (SELECT conv_id, ordinal, n, unnest([1, (n + 1) // 2, n]) AS first, unnest([n, n, n]) AS last, unnest([0, 1, 2]) AS cite FROM t),
r AS (
  SELECT q.*, f.pa, greatest(f.pa, least(f.pb, f.pa + greatest(first, f.k) - f.k)) AS x, greatest(f.pa, least(f.pb, f.pa + least(last, f.k + f.n - 1) - f.k)) AS y
  FROM q JOIN f ON f.conv_id = q.conv_id AND f.ordinal = q.ordinal AND f.k <= last AND f.k + f.n - 1 >= first)
SELECT conv_id, ordinal::INTEGER AS ordinal, cite::INTEGER AS cite, string_agg(x || '-' || y, ',' ORDER BY pa) AS runs FROM r GROUP BY conv_id, ordinal, cite
""")
def merged_citations(spark, sf):
    """Citations of lines of a merged chunk's content as lines of the file: the whole, the second half, the last line."""
    m = ingest.merge_small(_turn_chunks(spark, sf), min_lines=3)
    n = F.size(F.split("content", "\n"))
    ranges = F.array(F.struct(F.lit(1).alias("first"), n.alias("last")), F.struct(F.floor((n + 1) / 2).cast("int").alias("first"), n.alias("last")), F.struct(n.alias("first"), n.alias("last")))
    m = m.select(F.col("file_path").alias("conv_id"), "ordinal", "parts", F.posexplode(ranges).alias("cite", "q"))
    runs = F.transform(ingest.file_lines(F.col("parts"), F.col("q.first"), F.col("q.last")), lambda r: F.concat_ws("-", r["start_line"].cast("string"), r["end_line"].cast("string")))
    return m.select("conv_id", "ordinal", "cite", F.array_join(runs, ",").alias("runs"))


@query("""
WITH RECURSIVE d AS (SELECT source, doc_id, length(text) // 4 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f AS (
  SELECT source, doc_id, t, i, t AS s, 0 AS batch FROM d WHERE i = 1
  UNION ALL
  SELECT d.source, d.doc_id, d.t, d.i, CASE WHEN f.s + d.t > 5000 THEN d.t ELSE f.s + d.t END, CASE WHEN f.s + d.t > 5000 THEN f.batch + 1 ELSE f.batch END
  FROM f JOIN d ON d.source = f.source AND d.i = f.i + 1)
SELECT source, doc_id, t AS tokens, batch::INTEGER AS batch FROM f
""")
def token_batches(spark, sf):
    """Batches under a token budget, by a fold per source."""
    return ingest.token_batches(_docs(spark, sf), group="source", seq="doc_id", text="text", most=5000)


@query("""
WITH c AS (SELECT doc_id, sha256(source || chr(0) || '1' || chr(0) || n_chars::VARCHAR || chr(0) || text) AS chunk_hash FROM documents),
k AS (SELECT DISTINCT sha256(d.source || chr(0) || '1' || chr(0) || d.n_chars::VARCHAR || chr(0) || d.text) AS chunk_hash
      FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, c.chunk_hash, k.chunk_hash IS NOT NULL AS hit FROM c LEFT JOIN k ON c.chunk_hash = k.chunk_hash
""")
def chunk_hash_resume(spark, sf):
    """X13, J15, SK16: chunks whose result is stored, found by their hash; labelled documents are the stored ones."""
    d = _docs(spark, sf).select("doc_id", F.col("source").alias("file_path"), F.lit(1).alias("start_line"), F.col("n_chars").alias("end_line"), F.col("text").alias("content"))
    d = ingest.with_chunk_hash(d).select("doc_id", "chunk_hash")
    stored = d.join(table(spark, sf, "labels").select("doc_id", F.to_json(F.struct("quality", "toxic")).alias("result_json")), "doc_id")
    hits, misses = ingest.split_by_checkpoint(d, stored, ["chunk_hash"])
    return hits.select("doc_id", "chunk_hash", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", "chunk_hash", F.lit(False).alias("hit")))


@query(r"""
WITH q AS (SELECT p_partkey AS k, p_name || p_type || '_' || p_size AS name FROM part UNION ALL SELECT 1000000000 + c_custkey, c_name FROM customer),
p AS (SELECT k, regexp_replace(name, '[A-Z]([^A-Za-z])', '\1', 'g') AS name FROM q),
t AS (SELECT k, list_distinct(list_transform(list_filter(regexp_extract_all(name, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: length(x) >= 2), lambda x: lower(x))) AS t FROM p)
SELECT k, list_sort(t) AS tokens FROM t
""")
def identifier_tokens(spark, sf):
    """Words of identifiers. A run of capitals before anything but a capital or the end loses its last letter; the SQL drops that first."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", "p_type", F.lit("_"), F.col("p_size").cast("string")).alias("name"))
    c = table(spark, sf, "customer").select((F.col("c_custkey") + 1000000000).alias("k"), F.col("c_name").alias("name"))
    return p.unionByName(c).select("k", F.array_sort(text.identifier_tokens(F.col("name"))).alias("tokens"))


@query(f"""
SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10)), '[ \\t\\n]+'), lambda x: length(x) > 2 AND lower(x) NOT IN ({_STOP})) AS words
FROM conversations
""")
def keyword_extract(spark, sf):
    """The words of a question that search for something."""
    return table(spark, sf, "conversations").select("conv_id", "turn", text.keywords(F.col("text")).alias("words"))


_GATE = r"""
WITH s AS (SELECT doc_id, text, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body,
             regexp_replace(regexp_replace(text, '```[\s\S]*?```', '', 'g'), '`[^`]+`', '', 'g') AS plain,
             list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: length(p) > 50) AS ps
           FROM documents),
c AS (SELECT doc_id, length(body) < 200 AS short,
        NOT (contains(lower(text), '## licensed') OR contains(lower(text), '### licensed')) AS missing,
        len(list_filter(regexp_extract_all(plain, '\[([A-Z][A-Z0-9_\s]{2,30})\]', 1), lambda x: regexp_matches(x, 'TODO|TBD|INSERT|YOUR|EXAMPLE|PLACEHOLDER') OR x IN
          ('PROJECT NAME', 'PROJECT_NAME', 'MODULE NAME', 'MODULE_NAME', 'FUNCTION NAME', 'FUNCTION_NAME', 'CLASS NAME', 'CLASS_NAME', 'FILE PATH', 'FILE_PATH', 'DESCRIPTION', 'DETAILS'))) AS marks,
        len(ps) - len(list_distinct(ps)) AS repeated
      FROM s)
SELECT doc_id, NOT short AND marks = 0 AS passed, (4 - short::INT - missing::INT - (marks > 0)::INT - (repeated > 0)::INT) / 4.0 AS score, marks::INTEGER AS placeholders, repeated::INTEGER AS repeated
FROM c
"""


@query(_GATE.replace("/ 4.0 AS score", "/ 4.0::DOUBLE AS score"))
def section_gate(spark, sf):
    """The quality gate over every document as a section."""
    g = scoring.gate(F.col("text"), 200, ["Licensed"])
    return _docs(spark, sf).select("doc_id", g.alias("g")).select("doc_id", "g.passed", "g.score", F.size("g.placeholders").alias("placeholders"), F.col("g.repeated").alias("repeated"))


@query("""
WITH x AS (SELECT d.doc_id, d.source, CASE WHEN l.quality IS NULL THEN 0.0 ELSE 0.5 + 0.1 * l.quality + 0.2 * (1 - l.toxic) END AS c FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT source, coalesce(avg(CASE WHEN c > 0 THEN c::DOUBLE END), 0.0::DOUBLE) AS avg_confidence, count(*) FILTER (c > 0 AND c < 0.6) AS low,
       count(*) FILTER (greatest(0.1, least(0.95, c * 0.75)) = 0.1) AS floored
FROM x GROUP BY source
""")
def confidence_report(spark, sf):
    """Mean confidence by source, how many are low, how many the clamp lifts."""
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    c = F.when(F.col("quality").isNull(), 0.0).otherwise(0.5 + 0.1 * F.col("quality") + 0.2 * (1 - F.col("toxic")))
    x = _docs(spark, sf).select("doc_id", "source", "text").join(lab, "doc_id", "left").withColumn("c", c)
    marked = scoring.low_confidence_mark(F.lit("x"), F.col("c")) != "x"
    return x.groupBy("source").agg(F.coalesce(F.avg(F.when(F.col("c") > 0, F.col("c"))), F.lit(0.0)).alias("avg_confidence"), F.count_if(marked & (F.col("c") > 0)).alias("low"),
                                   F.count_if(scoring.clamp_confidence(F.col("c"), F.lit(0.75)) == 0.1).alias("floored"))


@query("""
WITH f AS (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS n FROM documents),
c AS (SELECT l_orderkey, l_linenumber, l_partkey AS doc_id, l_linenumber - 1 AS a, l_linenumber + l_quantity::INT % 9 - 2 AS b, l_discount FROM lineitem)
SELECT c.l_orderkey, c.l_linenumber, c.doc_id, c.a AS line_start, c.b AS line_end,
       CASE WHEN f.n IS NULL THEN 'file not found' WHEN c.a < 1 THEN 'start below 1' WHEN c.b < c.a THEN 'end before start' WHEN c.b > f.n THEN 'end past the file' END AS problem,
       c.doc_id || ':' || c.a || '-' || c.b || ' (confidence: ' || printf('%.2f', c.l_discount) || ')' AS citation
FROM c LEFT JOIN f ON f.doc_id = c.doc_id
""")
def citation_verify(spark, sf):
    """Citations against the lines that files have; the first failing check is told."""
    f = _docs(spark, sf).select("doc_id", text.line_count(F.col("text")).alias("n"))
    c = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("line_start"),
                                            (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 9 - 2).alias("line_end"), "l_discount")
    j = c.join(f, "doc_id", "left")
    cite = text.format_citation(F.col("doc_id").cast("string"), F.lit(None).cast("string"), F.col("line_start"), F.col("line_end"), F.col("l_discount"))
    return j.select("l_orderkey", "l_linenumber", "doc_id", "line_start", "line_end", scoring.citation_problem(F.col("n"), F.col("line_start"), F.col("line_end")).alias("problem"), cite.alias("citation"))


@query("""
WITH v AS (
  SELECT d.source, d.doc_id, l.doc_id IS NOT NULL AS llm, CASE l.quality WHEN 1 THEN 'high' ELSE 'low' END AS agreement FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT source, count(*) FILTER (NOT llm) AS ast_only, count(*) FILTER (llm) AS cross_validated,
       avg(CASE WHEN llm AND agreement = 'high' THEN 0.95 WHEN llm THEN 0.5 ELSE 0.9 END::DOUBLE) AS confidence, count(*) FILTER (llm) = 0 AS conflict
FROM v GROUP BY source
""")
def cross_validate_scores(spark, sf):
    """Documents as parser findings, labels as model findings."""
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    v = _docs(spark, sf).select("source", "doc_id").join(lab.withColumn("llm", F.lit(True)), "doc_id", "left").withColumn("llm", F.coalesce("llm", F.lit(False)))
    s = scoring.finding_score(F.lit(True), F.col("llm"), F.when(F.col("quality") == 1, "high").otherwise("low"))
    return v.withColumn("s", s).groupBy("source").agg(F.count_if(F.col("s.source") == "ast").alias("ast_only"), F.count_if("llm").alias("cross_validated"), F.avg("s.value").alias("confidence"), (F.count_if("llm") == 0).alias("conflict"))


def _counted(words: list[str]) -> str:
    return " + ".join(f"contains(t, '{w}')::INT" for w in words)


@query(f"""
WITH c AS (SELECT conv_id, turn, lower(text) AS t FROM conversations),
s AS (SELECT conv_id, turn, {_counted(K.INTENTS['lookup'])} AS a, {_counted(K.INTENTS['code_exploration'])} AS b, ({_counted(K.INTENTS['search'])}) * 1.5 AS c FROM c)
SELECT conv_id, turn, CASE WHEN a > b AND a > c THEN 'lookup' WHEN b > a AND b > c THEN 'code_exploration' WHEN c > a AND c > b THEN 'search' ELSE 'general' END AS intent FROM s
""")
def intent_classify(spark, sf):
    """What a message asks for, by counted words."""
    return table(spark, sf, "conversations").select("conv_id", "turn", scoring.intent(F.col("text")).alias("intent"))


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 400 + (event_id % 200) END AS status, event_type = 'signup' AS timed,
                  CASE event_type WHEN 'click' THEN 'Rate limit hit' WHEN 'view' THEN 'got ' || (400 + event_id % 110) ELSE 'Connection lost' END AS msg FROM events),
l AS (SELECT *, lower(msg) AS m FROM e),
k AS (SELECT event_id, CASE WHEN status = 429 THEN 'transient' WHEN status BETWEEN 400 AND 499 THEN 'client' WHEN status BETWEEN 500 AND 599 THEN 'server' WHEN timed THEN 'timeout'
        WHEN m LIKE '%timeout%' OR m LIKE '%timed out%' THEN 'timeout' WHEN m LIKE '%429%' OR m LIKE '%rate limit%' OR m LIKE '%rate\\_limit%' ESCAPE '\\' THEN 'transient'
        WHEN m LIKE '%500%' OR m LIKE '%502%' OR m LIKE '%503%' OR m LIKE '%504%' THEN 'server' WHEN m LIKE '%econnrefused%' OR m LIKE '%connection%' THEN 'transient'
        WHEN m LIKE '%400%' OR m LIKE '%401%' OR m LIKE '%403%' OR m LIKE '%404%' THEN 'client' ELSE 'unknown' END AS kind FROM l)
SELECT event_id, kind, kind IN ('transient', 'server', 'timeout') AS retry FROM k
""")
def error_classify(spark, sf):
    """Errors by status, type and words."""
    e = table(spark, sf, "events")
    t = F.col("event_type")
    status = F.when(t == "error", 400 + F.col("event_id") % 200)
    msg = F.when(t == "click", "Rate limit hit").when(t == "view", F.concat(F.lit("got "), (400 + F.col("event_id") % 110).cast("string"))).otherwise("Connection lost")
    kind = scoring.error_class(status, t == "signup", msg)
    return e.select("event_id", kind.alias("kind"), scoring.retryable(kind).alias("retry"))


@query(r"""
SELECT page_id, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS path,
       regexp_extract_all(replace(regexp_extract(url, '://[^/]*(/[^?#]*)', 1), '/en/', '/{lang}/:id/'), '\{(\w+)\}', 1) || regexp_extract_all(replace(regexp_extract(url, '://[^/]*(/[^?#]*)', 1), '/en/', '/{lang}/:id/'), ':(\w+)', 1) AS params,
       regexp_extract(url, '^.*\.([a-z]+)$', 1) AS ext
FROM pages
""")
def path_parameters(spark, sf):
    """Parameters of route paths, made from page urls."""
    path = F.regexp_extract("url", r"://[^/]*(/[^?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", path.alias("path"), text.path_params(F.replace(path, F.lit("/en/"), F.lit("/{lang}/:id/"))).alias("params"), F.regexp_extract("url", r"^.*\.([a-z]+)$", 1).alias("ext"))


_FINDING = "struct<file: string, purpose: string, confidence: string, n: string>"


@query("""
SELECT event_id, coalesce(json_extract_string(CASE WHEN event_type = 'error' THEN NULL ELSE props END, '$.k'), '') AS k,
       CASE WHEN event_type = 'error' THEN 'low' ELSE 'medium' END AS confidence
FROM events
""")
def llm_json_normalize(spark, sf):
    """Model answers as JSON with defaults; undecodable ones become low-confidence stubs."""
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    v = F.try_parse_json(raw)
    k = F.coalesce(F.try_variant_get(v, "$.k", "string"), F.lit(""))
    return table(spark, sf, "events").select("event_id", k.alias("k"), F.when(v.isNull(), "low").otherwise("medium").alias("confidence"))
