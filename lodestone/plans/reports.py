"""The thirteen report sections as queries, with SQL written from the sections' layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import fixed as K
from lodestone.operators import graph, report
from lodestone.plans.registry import ORACLES, QUERIES, query
from lodestone.plans.standins import EDGES, ENTITIES, MODEL, edges, entities, model
from lodestone.runtime import Scratch

NL = "chr(10)"


def _has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _name(words: list[str]) -> str:
    return _has("lower(name)", words)


def _head(title: str | None, cols: list[str] | None) -> str:
    out = f"'## {title}' || {NL} || {NL}" if title else "''"
    if cols:
        out += f" || '| {' | '.join(cols)} |' || {NL} || '| {' | '.join('---' for _ in cols)} |' || {NL}"
    return out


def _rows(*cells: str) -> str:
    return "'| ' || " + " || ' | ' || ".join(f"coalesce(({c})::VARCHAR, '')" for c in cells) + " || ' |'"


def _block(no: int, title: str | None, source: str, line: str, order: str, cols: list[str] | None = None) -> str:
    return f"SELECT project_id, {no} AS no, {_head(title, cols)} || string_agg({line}, {NL} ORDER BY {order}) || {NL} AS text FROM {source} GROUP BY project_id"


CODE = "'`' || {} || '`'"
NAME, FILE = CODE.format("name"), CODE.format("file_path")
AT = CODE.format("file_path || ':' || start_line")
DASH = "CASE WHEN coalesce({0}, '') = '' THEN '—' ELSE {0} END"


def _located(no: int, title: str, where: str) -> str:
    return _block(no, title, f"(SELECT * FROM entities WHERE {where})", _rows(NAME, "entity_type", AT), "seq", ["Entity", "Type", "Location"])


def _sql(name: str, blocks: list[str], scores: str | None, default: str | None = None) -> str:
    title = K.SECTION_TITLES[name]
    more = ""
    if default:
        more = f", d AS (SELECT project_id, 0 AS no, '{default}' || {NL} AS text FROM projects WHERE project_id NOT IN (SELECT project_id FROM b))"
    source = "(SELECT * FROM b UNION ALL SELECT * FROM d)" if default else "b"
    conf = f"(SELECT round(avg(confidence), 9) FROM ({scores}) s WHERE s.project_id = p.project_id)" if scores else "NULL"
    return f"""
WITH {MODEL}, b AS ({' UNION ALL '.join(blocks)}){more},
t AS (SELECT project_id, string_agg(text, {NL} ORDER BY no) AS text FROM {source} GROUP BY project_id)
SELECT p.project_id, '{name}' AS section_name, length('# {title}' || {NL} || coalesce({NL} || t.text, ''))::INTEGER AS n,
       sha256('# {title}' || {NL} || coalesce({NL} || t.text, '')) AS content_sha, coalesce({conf}, 0.0::DOUBLE) AS confidence
FROM projects p LEFT JOIN t ON t.project_id = p.project_id"""


def _e(where: str) -> str:
    return f"SELECT project_id, confidence FROM entities WHERE {where}"


_CALLS30 = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY seq) AS r FROM edges{}) WHERE r <= {})"


def _node(raw: str, spaces: bool) -> str:
    return f"translate(replace({raw}, '::', '_'), '{'./- ' if spaces else './-'}', '{'____' if spaces else '___'}')"


def _label(raw: str) -> str:
    return f"CASE WHEN contains({raw}, '::') THEN string_split({raw}, '::')[-1] ELSE string_split({raw}, '/')[-1] END"


def _flow(head: str, source: str, arrow: str, spaces: bool) -> str:
    """(project_id, text) of a flow chart."""
    return f"""
SELECT project_id, '{head}' || {NL} || string_agg(line, {NL} ORDER BY seq, sub) AS text FROM (
  SELECT project_id, min(seq * 2 + sub) // 2 AS seq, min(seq * 2 + sub) % 2 AS sub, '    ' || node || '[' || arg_min({_label('raw')}, seq * 2 + sub) || ']' AS line FROM (
    SELECT project_id, seq, 0 AS sub, source_id AS raw, {_node('source_id', spaces)} AS node FROM {source} UNION ALL
    SELECT project_id, seq, 1, target_id, {_node('target_id', spaces)} FROM {source}) GROUP BY project_id, node
  UNION ALL SELECT project_id, seq, 2, '    ' || {_node('source_id', spaces)} || ' ' || {arrow} || ' ' || {_node('target_id', spaces)} FROM {source}) GROUP BY project_id"""


_OVERVIEW = _flow("graph TD", _CALLS30.format("", 30), "CASE WHEN relationship_type = 'calls' THEN '-->|calls|' ELSE '-.->|imports|' END", False)
_DATA = """(
  SELECT *, 1 AS kind FROM entities t WHERE entity_type = 'table' UNION ALL
  SELECT *, 0 FROM entities c WHERE entity_type = 'class' AND NOT EXISTS (
    SELECT 1 FROM entities t WHERE t.entity_type = 'table' AND t.project_id = c.project_id AND t.name = c.name AND t.file_path = c.file_path))"""
_ER = f"""
SELECT project_id, 'erDiagram' || {NL} || string_agg(line, {NL} ORDER BY part, kind, seq) AS text FROM (
  SELECT project_id, 0 AS part, kind, seq, '    ' || name || ' {{' || {NL} || '        string id' || {NL} || '    }}' AS line FROM {_DATA}
  UNION ALL SELECT e.project_id, 1, 0, e.seq, '    ' || s.name || ' ||--o{{ ' || t.name || ' : "' || e.relationship_type || '"' FROM edges e
    JOIN {_DATA} s ON s.id = e.source_id AND s.project_id = e.project_id JOIN {_DATA} t ON t.id = e.target_id AND t.project_id = e.project_id) GROUP BY project_id"""


def _fenced(no: int, title: str, text: str, where: str = "") -> str:
    return f"SELECT project_id, {no}, '## {title}' || {NL} || {NL} || '```mermaid' || {NL} || text || {NL} || '```' || {NL} FROM ({text}) {where}"


_PERSONA = " UNION ALL ".join(f"SELECT project_id, '{p}' AS persona, seq, name FROM entities WHERE {_name(w)}" for p, w in K.PERSONAS.items())
_OUTCOME = "CASE rule_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.OUTCOMES.items()) + f" ELSE '{K.OTHER_OUTCOME}' END"
_PER = "(SELECT project_id, count(*) FILTER ({}) AS n FROM entities GROUP BY project_id)"

SECTION_SQL = {
    "executive_overview": _sql("executive_overview", [
        f"SELECT project_id, 0 AS no, '**Summary:** ' || arg_min(statement, seq) || {NL} AS text FROM purposes GROUP BY project_id",
        f"""SELECT p.project_id, 1, '## At a Glance' || {NL} || {NL} || '- **Entities:** ' || (SELECT count(*) FROM entities e WHERE e.project_id = p.project_id) || {NL}
            || '- **Files:** ' || (SELECT count(DISTINCT file_path) FROM entities e WHERE e.project_id = p.project_id) || {NL} || '- **Languages:** ' || (SELECT count(DISTINCT language) FROM entities e WHERE e.project_id = p.project_id) || {NL}
            || '- **Rules:** ' || (SELECT count(*) FROM rules e WHERE e.project_id = p.project_id) || {NL} || '- **Workflows:** ' || (SELECT count(*) FROM workflows e WHERE e.project_id = p.project_id) || {NL} FROM projects p""",
    ], "SELECT project_id, confidence FROM purposes"),
    "features": _sql("features", [
        _block(0, "Feature Areas", "(SELECT e.project_id, e.file_path, arg_max(p.statement, p.seq) AS statement, count(*) AS n FROM entities e LEFT JOIN purposes p ON p.project_id = e.project_id AND p.file_path = e.file_path WHERE e.entity_type IN ('function', 'method') GROUP BY e.project_id, e.file_path)",
               _rows(FILE, DASH.format("statement"), "n"), "file_path", ["File", "Purpose", "Entities"]),
        _block(1, "Functions", "(SELECT * FROM entities WHERE entity_type = 'function')", _rows(NAME, FILE, DASH.format("signature")), "name, seq", ["Name", "File", "Signature"]),
    ], _e("entity_type IN ('function', 'method')")),
    "personas": _sql("personas", [
        f"""SELECT project_id, 0 AS no, string_agg(line, {NL} ORDER BY persona) AS text FROM (
            SELECT project_id, persona, '## ' || persona || {NL} || {NL} || '### System Interactions' || {NL} || {NL} || string_agg('- `' || name || '`', {NL} ORDER BY seq) || {NL} AS line
            FROM (SELECT *, row_number() OVER (PARTITION BY project_id, persona ORDER BY seq) AS r FROM ({_PERSONA})) WHERE r <= 10 GROUP BY project_id, persona) GROUP BY project_id""",
    ], None, "## General User"),
    "user_stories": _sql("user_stories", [_block(0, "From Business Rules", "rules", f"'- **As a** user, **I want** ' || lower(rule_text) || ', **so that** ' || {_OUTCOME} || '.' || {NL}", "seq")],
                         "SELECT project_id, confidence FROM rules", "No business rules discovered to generate user stories."),
    "security_requirements": _sql("security_requirements", [
        _located(0, "Authentication", _name(K.AUTH_WORDS)), _located(1, "Authorization", _name(K.AUTHZ_WORDS)),
        _block(2, "Access Control Rules", "(SELECT * FROM rules WHERE rule_type = 'access_control')", "'- ' || rule_text", "seq"),
    ], f"{_e(_name(K.AUTH_WORDS))} UNION ALL {_e(_name(K.AUTHZ_WORDS))} UNION ALL SELECT project_id, confidence FROM rules WHERE rule_type = 'access_control'",
        "No authentication or authorization patterns discovered in the codebase."),
    "system_overview": _sql("system_overview", [
        _block(0, "Module Tree", "(SELECT project_id, file_path, count(*) AS n FROM entities GROUP BY project_id, file_path)", f"'- ' || {FILE} || ' (' || n || ' entities)'", "file_path"),
        _fenced(1, "Architecture Diagram", _OVERVIEW),
    ], _e("true")),
    "data_models": _sql("data_models", [
        _block(0, "Entities", _DATA, _rows(NAME, "entity_type", AT, DASH.format("description")), "name, kind, seq", ["Name", "Type", "Location", "Description"]),
        _fenced(1, "Entity-Relationship Diagram", _ER, f"WHERE project_id IN (SELECT project_id FROM {_DATA} GROUP BY project_id HAVING count(*) >= 2)"),
        _block(2, "Relationships", f"(SELECT * FROM edges e WHERE EXISTS (SELECT 1 FROM {_DATA} d WHERE d.project_id = e.project_id AND (d.id = e.source_id OR d.id = e.target_id)))",
               _rows(CODE.format("source_id"), "relationship_type", CODE.format("target_id")), "seq", ["Source", "Relationship", "Target"]),
    ], f"SELECT project_id, confidence FROM {_DATA}", "No data model entities (class, table) discovered in the codebase."),
    "interfaces": _sql("interfaces", [
        _block(0, "Interfaces / Protocols", "(SELECT * FROM entities WHERE entity_type = 'interface')", _rows(NAME, AT, DASH.format("signature")), "name, seq", ["Name", "Location", "Signature"]),
        _block(1, "Service Boundaries", f"(SELECT * FROM entities WHERE entity_type = 'class' AND {_name(K.SERVICE_WORDS)})", _rows(NAME, "entity_type", AT), "name, seq", ["Name", "Type", "Location"]),
    ], f"{_e(chr(39).join(['entity_type = ', 'interface', '']))} UNION ALL SELECT project_id, confidence FROM entities WHERE entity_type = 'class' AND {_name(K.SERVICE_WORDS)}", "No interface entities discovered."),
    "ui_specs": _sql("ui_specs", [
        _block(0, "Screens / Components", f"(SELECT * FROM entities WHERE {_name(K.UI_WORDS)} OR {_has('file_path', K.UI_SUFFIXES)})", _rows(NAME, "entity_type", FILE, DASH.format("language")), "name, seq", ["Name", "Type", "File", "Language"]),
        f"SELECT project_id, 1, '## Summary' || {NL} || {NL} || '**' || count(*) || '** UI components/screens identified.' || {NL} FROM entities WHERE {_name(K.UI_WORDS)} OR {_has('file_path', K.UI_SUFFIXES)} GROUP BY project_id",
    ], _e(f"{_name(K.UI_WORDS)} OR {_has('file_path', K.UI_SUFFIXES)}"), "No UI components or frontend entities discovered in the codebase."),
    "api_specs": _sql("api_specs", [
        _block(0, "Endpoints", "(SELECT * FROM entities WHERE entity_type = 'endpoint')", _rows(NAME, AT, DASH.format("signature"), DASH.format("description")), "name, seq", ["Endpoint", "Location", "Signature", "Description"]),
        _block(1, "Route Handlers", f"(SELECT * FROM entities WHERE entity_type = 'function' AND {_name(K.ROUTE_WORDS)})", _rows(NAME, AT, DASH.format("signature")), "name, seq", ["Handler", "Location", "Signature"]),
    ], f"SELECT project_id, confidence FROM entities WHERE entity_type = 'endpoint' UNION ALL SELECT project_id, confidence FROM entities WHERE entity_type = 'function' AND {_name(K.ROUTE_WORDS)}",
        "No API endpoints or route handlers discovered in the codebase."),
    "integrations": _sql("integrations", [
        _block(0, "External Dependencies", """(SELECT project_id, target_id, cnt, min(seq) AS first, string_agg('`' || source_id || '`', ', ' ORDER BY r) FILTER (r <= 3) || CASE WHEN cnt > 3 THEN '...' ELSE '' END AS used
            FROM (SELECT *, row_number() OVER (PARTITION BY project_id, target_id ORDER BY seq) AS r, count(*) OVER (PARTITION BY project_id, target_id) AS cnt FROM edges WHERE relationship_type = 'imports') GROUP BY project_id, target_id, cnt)""",
               _rows(CODE.format("target_id"), "cnt", "used"), "cnt DESC, first", ["Module", "Importers", "Used By"]),
    ], None, "No integration points discovered."),
    "tech_stories": _sql("tech_stories", [
        _block(0, "From Call Chains", _CALLS30.format(" WHERE relationship_type = 'calls'", 15), f"'- **As a** developer, **I need** `' || source_id || '` to call `' || target_id || '`, **so that** the call chain is maintained.' || {NL}", "seq"),
        _block(1, "From Workflows", "workflows", f"'### ' || name || {NL} || {NL} || steps", "seq"),
    ], "SELECT project_id, confidence FROM workflows", "No technical stories could be generated."),
    "security_considerations": _sql("security_considerations", [
        _located(0, "Potential Vulnerability Patterns", _name(K.VULNERABLE_WORDS)),
        _block(1, "Sensitive Data Handlers", f"(SELECT * FROM entities WHERE {_name(K.SENSITIVE_WORDS)})", _rows(NAME, AT), "seq", ["Entity", "Location"]),
        _block(2, "LLM-Detected Risks", "risks", _rows("title", "severity", "risk_type", CODE.format("file_path || ':' || line")), "seq", ["Risk", "Severity", "Type", "Location"]),
        f"""SELECT p.project_id, 3, '## Coverage Summary' || {NL} || {NL}
            || '- Authentication entities: ' || CASE WHEN EXISTS (SELECT 1 FROM entities WHERE project_id = p.project_id AND {_name(['auth', 'login', 'session'])}) THEN 'Found' ELSE 'Not found' END || {NL}
            || '- Validation rules: ' || CASE WHEN EXISTS (SELECT 1 FROM rules WHERE project_id = p.project_id AND rule_type = 'validation') THEN 'Found' ELSE 'Not found' END || {NL}
            || '- Sensitive data handlers: ' || (SELECT count(*) FROM entities WHERE project_id = p.project_id AND {_name(K.SENSITIVE_WORDS)}) || ' found' || {NL}
            || '- Potential vulnerability patterns: ' || (SELECT count(*) FROM entities WHERE project_id = p.project_id AND {_name(K.VULNERABLE_WORDS)}) || ' found' || {NL} FROM projects p""",
    ], f"{_e(_name(K.VULNERABLE_WORDS))} UNION ALL SELECT project_id, confidence FROM risks"),
}


def _section_query(name: str):
    def run(spark, sf):
        s = report.SECTIONS[name](model(spark, sf))
        return s.select("project_id", "section_name", F.char_length("content").alias("n"), F.sha2("content", 256).alias("content_sha"), F.round("confidence", 9).alias("confidence"))

    run.__doc__ = f"The section {K.SECTION_TITLES[name]} of every project."
    return run


for _n in report.SECTIONS:
    QUERIES[f"section_{_n}"] = _section_query(_n)
    ORACLES[f"section_{_n}"] = SECTION_SQL[_n]


@query(f"WITH {ENTITIES}, {EDGES}, t AS ({_flow('graph TD', _CALLS30.format('', 50), chr(39).join(['CASE relationship_type WHEN ', 'calls', ' THEN ', '-->', ' WHEN ', 'imports', ' THEN ', '-.->', ' ELSE ', '---', ' END']), True)}) SELECT project_id, sha256(text) AS text_sha FROM t")
def mermaid_architecture(spark, sf):
    """The first fifty edges of each project as a flow chart."""
    return graph.architecture_diagram(edges(spark, sf), ["project_id"]).select("project_id", F.sha2("text", 256).alias("text_sha"))


@query(f"WITH {ENTITIES}, {EDGES}, t AS ({_ER}) SELECT project_id, sha256(text) AS text_sha FROM t")
def mermaid_er(spark, sf):
    """Classes and tables as boxes, edges between them."""
    d = report.data_entities(model(spark, sf)).withColumn("seq", F.struct("kind", "seq"))
    return graph.er_diagram(d, edges(spark, sf), ["project_id"]).select("project_id", F.sha2("text", 256).alias("text_sha"))


@query(f"WITH {ENTITIES}, {EDGES}, t AS ({_flow('flowchart LR', _CALLS30.format(' WHERE relationship_type = ' + chr(39) + 'calls' + chr(39), 30), chr(39) + '-->' + chr(39), True)}) SELECT project_id, sha256(text) AS text_sha FROM t")
def mermaid_calls(spark, sf):
    """The first thirty calls of each project."""
    return graph.call_diagram(edges(spark, sf), ["project_id"]).select("project_id", F.sha2("text", 256).alias("text_sha"))


_C30 = _CALLS30.format(" WHERE relationship_type = 'calls'", 30)


@query(f"""
WITH {ENTITIES}, {EDGES}, c AS (SELECT * FROM {_C30}),
w AS (SELECT project_id, label, min(seq * 2 + sub) AS o FROM (SELECT project_id, seq, 0 AS sub, {_label('source_id')} AS label FROM c UNION ALL SELECT project_id, seq, 1, {_label('target_id')} FROM c) GROUP BY ALL),
l AS (SELECT project_id, 0 AS part, o, '    participant ' || label AS line FROM w UNION ALL SELECT project_id, 1, seq, '    ' || {_label('source_id')} || '->>' || {_label('target_id')} || ': calls' FROM c)
SELECT project_id, sha256('sequenceDiagram' || {NL} || string_agg(line, {NL} ORDER BY part, o)) AS text_sha FROM l GROUP BY project_id
""")
def mermaid_sequence(spark, sf):
    """The first thirty calls of each project as a sequence."""
    return graph.sequence_from_calls(edges(spark, sf), ["project_id"]).select("project_id", F.sha2("text", 256).alias("text_sha"))


@query(f"""
WITH {MODEL}, g AS (SELECT unnest({list(K.SECTION_TITLES)}) AS section_name)
SELECT project_id, section_name FROM projects, g
""")
def section_reports(spark, sf):
    """All sections of every project exist and went through the gate."""
    m = model(spark, sf, Scratch(spark, "sections"))
    return report.gated(report.sections(m)).where("gate.score >= 0").select("project_id", "section_name")
