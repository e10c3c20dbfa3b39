"""The thirteen report sections as plans over the graph's tables, one text per project."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import fixed as K
from lodestone.functions.scoring import clamp_confidence, gate
from lodestone.functions.text import any_word, md_code, md_row, md_table_head, rule_story, section_title
from lodestone.operators.graph import er_diagram, overview_diagram
from lodestone.operators.ordered import joined_lines, long_text, top_per

P = "project_id"
DASH = "—"


@dataclass(frozen=True)
class Model:
    """The graph of any number of projects.

    entities(project_id, seq, id, name, entity_type, file_path, start_line, language, signature, description, confidence)
    edges(project_id, seq, id, source_id, target_id, relationship_type)
    purposes(project_id, seq, file_path, statement, confidence)
    rules(project_id, seq, rule_text, rule_type, confidence)
    risks(project_id, seq, title, severity, risk_type, file_path, line, confidence)
    workflows(project_id, seq, name, steps, confidence)
    projects(project_id), each once: those to report on; by default all that the tables name
    """

    entities: DataFrame
    edges: DataFrame
    purposes: DataFrame
    rules: DataFrame
    risks: DataFrame
    workflows: DataFrame
    projects: DataFrame | None = None


def _or_dash(c: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", DASH).otherwise(F.col(c))


def _at() -> Column:
    return md_code(F.concat_ws(":", "file_path", F.col("start_line").cast("string")))


def _block(no: int, title: str | None, df: DataFrame, line: Column, order: list[str], head: list[str] | None = None, level: int = 2, sep: str = "\n") -> DataFrame:
    """(project_id, no, text): a heading, an optional table head, the rows' lines."""
    t = long_text(df, [P], line, order, sep)
    lead = (f"{'#' * level} {title}\n\n" if title else "") + (md_table_head(head) + "\n" if head else "")
    return t.select(P, F.lit(no).alias("no"), F.concat(F.lit(lead), F.col("text"), F.lit("\n")).alias("text"))


def _name(words: list[str]) -> Column:
    return any_word(F.lower("name"), words)


def _projects(m: Model) -> DataFrame:
    if m.projects is not None:
        return m.projects.select(P)
    parts = [getattr(m, t).select(P) for t in ("entities", "edges", "purposes", "rules", "risks", "workflows")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _default(m: Model, blocks: DataFrame, text: str) -> DataFrame:
    """A line for the projects that have no block."""
    none = _projects(m).join(blocks.select(P).distinct(), P, "left_anti")
    return blocks.unionByName(none.select(P, F.lit(0).alias("no"), F.lit(text + "\n").alias("text")))


def _section(m: Model, name: str, blocks: DataFrame, scores: DataFrame | None) -> DataFrame:
    """(project_id, section_name, title, content, confidence)."""
    text = joined_lines(blocks, [P], F.col("text"), ["no"])
    out = _projects(m).join(text, P, "left")
    title = K.SECTION_TITLES[name]
    head = {"security_requirements": "Security Requirements"}.get(name, title)
    out = out.withColumn("content", F.concat_ws("\n", F.lit(f"# {head}\n"), "text"))
    if scores is None:
        out = out.withColumn("confidence", F.lit(0.0))
    else:
        avg = scores.groupBy(P).agg(F.avg("confidence").alias("confidence"))
        out = out.join(avg, P, "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return out.select(P, F.lit(name).alias("section_name"), F.lit(title).alias("title"), "content", "confidence")


def _all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def at_a_glance(m: Model) -> DataFrame:
    e = m.entities.groupBy(P).agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("file_path").alias("files"), F.countDistinct(F.when(F.col("language") != "", F.col("language"))).alias("languages"))
    r = m.rules.groupBy(P).agg(F.count(F.lit(1)).alias("rules"))
    w = m.workflows.groupBy(P).agg(F.count(F.lit(1)).alias("workflows"))
    return _projects(m).join(e, P, "left").join(r, P, "left").join(w, P, "left").na.fill(0)


def executive_overview(m: Model) -> DataFrame:
    first = m.purposes.groupBy(P).agg(F.min_by("statement", "seq").alias("s"))
    summary = first.select(P, F.lit(0).alias("no"), F.concat(F.lit("**Summary:** "), F.col("s"), F.lit("\n")).alias("text"))
    g = at_a_glance(m)
    names = ("entities", "files", "languages", "rules", "workflows")
    lines = F.concat_ws("\n", *(F.concat(F.lit(f"- **{n.capitalize()}:** "), F.col(n).cast("string")) for n in names))
    stats = g.select(P, F.lit(1).alias("no"), F.concat(F.lit("## At a Glance\n\n"), lines, F.lit("\n")).alias("text"))
    return _section(m, "executive_overview", _all(summary, stats), m.purposes)


def features(m: Model) -> DataFrame:
    made = m.entities.where(F.col("entity_type").isin("function", "method"))
    said = m.purposes.groupBy(P, "file_path").agg(F.max_by("statement", "seq").alias("statement"))
    files = made.groupBy(P, "file_path").count().join(said, [P, "file_path"], "left")
    areas = _block(0, "Feature Areas", files, md_row(md_code(F.col("file_path")), _or_dash("statement"), F.col("count")), ["file_path"], ["File", "Purpose", "Entities"])
    funcs = m.entities.where("entity_type = 'function'")
    listed = _block(1, "Functions", funcs, md_row(md_code(F.col("name")), md_code(F.col("file_path")), _or_dash("signature")), ["name", "seq"], ["Name", "File", "Signature"])
    return _section(m, "features", _all(areas, listed), made)


def persona_members(m: Model) -> DataFrame:
    """(project_id, persona, seq, name): an entity may speak for several."""
    labels = F.array_compact(F.array(*(F.when(_name(w), F.lit(p)) for p, w in K.PERSONAS.items())))
    return m.entities.select(P, "seq", "name", F.explode(labels).alias("persona"))


def personas(m: Model) -> DataFrame:
    some = top_per(persona_members(m), [P, "persona"], [F.col("seq")], K.PERSONA_NAMES)
    names = joined_lines(some, [P, "persona"], F.concat(F.lit("- "), md_code(F.col("name"))), ["seq"])
    each = names.select(P, "persona", F.concat(F.lit("## "), F.col("persona"), F.lit("\n\n### System Interactions\n\n"), F.col("text"), F.lit("\n")).alias("line"))
    blocks = joined_lines(each, [P], F.col("line"), ["persona"]).select(P, F.lit(0).alias("no"), "text")
    return _section(m, "personas", _default(m, blocks, "## General User"), None)


def user_stories(m: Model) -> DataFrame:
    block = _block(0, "From Business Rules", m.rules, F.concat(F.lit("- "), rule_story(F.col("rule_text"), F.col("rule_type")), F.lit("\n")), ["seq"])
    return _section(m, "user_stories", _default(m, block, "No business rules discovered to generate user stories."), m.rules)


def _located(no: int, title: str, df: DataFrame, order: list[str]) -> DataFrame:
    return _block(no, title, df, md_row(md_code(F.col("name")), F.col("entity_type"), _at()), order, ["Entity", "Type", "Location"])


def security_requirements(m: Model) -> DataFrame:
    auth, authz = m.entities.where(_name(K.AUTH_WORDS)), m.entities.where(_name(K.AUTHZ_WORDS))
    rules = m.rules.where("rule_type = 'access_control'")
    blocks = _all(
        _located(0, "Authentication", auth, ["seq"]), _located(1, "Authorization", authz, ["seq"]),
        _block(2, "Access Control Rules", rules, F.concat(F.lit("- "), F.col("rule_text")), ["seq"]),
    )
    scores = _all(*(x.select(P, "confidence") for x in (auth, authz, rules)))
    return _section(m, "security_requirements", _default(m, blocks, "No authentication or authorization patterns discovered in the codebase."), scores)


def system_overview(m: Model) -> DataFrame:
    files = m.entities.groupBy(P, "file_path").count()
    tree = _block(0, "Module Tree", files, F.concat(F.lit("- "), md_code(F.col("file_path")), F.lit(" ("), F.col("count").cast("string"), F.lit(" entities)")), ["file_path"])
    chart = overview_diagram(m.edges, [P])
    chart = chart.select(P, F.lit(1).alias("no"), F.concat(F.lit("## Architecture Diagram\n\n```mermaid\n"), F.col("text"), F.lit("\n```\n")).alias("text"))
    return _section(m, "system_overview", _all(tree, chart), m.entities)


def data_entities(m: Model) -> DataFrame:
    """Tables, and classes that are not also a table of their file; classes first."""
    tables = m.entities.where("entity_type = 'table'")
    classes = m.entities.where("entity_type = 'class'").join(tables.select(P, "file_path", "name"), [P, "file_path", "name"], "left_anti")
    cols = m.entities.columns
    return classes.select(*cols, F.lit(0).alias("kind")).unionByName(tables.select(*cols, F.lit(1).alias("kind")))


def data_models(m: Model) -> DataFrame:
    d = data_entities(m)
    listed = _block(0, "Entities", d, md_row(md_code(F.col("name")), F.col("entity_type"), _at(), _or_dash("description")), ["name", "kind", "seq"], ["Name", "Type", "Location", "Description"])
    several = d.groupBy(P).count().where("count >= 2").select(P)
    chart = er_diagram(d.withColumn("seq", F.struct("kind", "seq")), m.edges, [P]).join(several, P, "left_semi")
    chart = chart.select(P, F.lit(1).alias("no"), F.concat(F.lit("## Entity-Relationship Diagram\n\n```mermaid\n"), F.col("text"), F.lit("\n```\n")).alias("text"))
    ids = d.select(P, F.col("id").alias("node")).distinct()
    near = m.edges.join(ids.withColumnRenamed("node", "source_id").withColumn("_a", F.lit(1)), [P, "source_id"], "left").join(ids.withColumnRenamed("node", "target_id").withColumn("_b", F.lit(1)), [P, "target_id"], "left")
    near = near.where("_a = 1 OR _b = 1")
    rels = _block(2, "Relationships", near, md_row(md_code(F.col("source_id")), F.col("relationship_type"), md_code(F.col("target_id"))), ["seq"], ["Source", "Relationship", "Target"])
    return _section(m, "data_models", _default(m, _all(listed, chart, rels), "No data model entities (class, table) discovered in the codebase."), d)


def interfaces(m: Model) -> DataFrame:
    i = m.entities.where("entity_type = 'interface'")
    s = m.entities.where((F.col("entity_type") == "class") & _name(K.SERVICE_WORDS))
    a = _block(0, "Interfaces / Protocols", i, md_row(md_code(F.col("name")), _at(), _or_dash("signature")), ["name", "seq"], ["Name", "Location", "Signature"])
    b = _block(1, "Service Boundaries", s, md_row(md_code(F.col("name")), F.col("entity_type"), _at()), ["name", "seq"], ["Name", "Type", "Location"])
    return _section(m, "interfaces", _default(m, _all(a, b), "No interface entities discovered."), _all(i.select(P, "confidence"), s.select(P, "confidence")))


def ui_specs(m: Model) -> DataFrame:
    ui = m.entities.where(_name(K.UI_WORDS) | any_word(F.col("file_path"), K.UI_SUFFIXES))
    a = _block(0, "Screens / Components", ui, md_row(md_code(F.col("name")), F.col("entity_type"), md_code(F.col("file_path")), _or_dash("language")), ["name", "seq"], ["Name", "Type", "File", "Language"])
    n = ui.groupBy(P).count().select(P, F.lit(1).alias("no"), F.concat(F.lit("## Summary\n\n**"), F.col("count").cast("string"), F.lit("** UI components/screens identified.\n")).alias("text"))
    return _section(m, "ui_specs", _default(m, _all(a, n), "No UI components or frontend entities discovered in the codebase."), ui)


def api_specs(m: Model) -> DataFrame:
    e = m.entities.where("entity_type = 'endpoint'")
    f = m.entities.where((F.col("entity_type") == "function") & _name(K.ROUTE_WORDS))
    a = _block(0, "Endpoints", e, md_row(md_code(F.col("name")), _at(), _or_dash("signature"), _or_dash("description")), ["name", "seq"], ["Endpoint", "Location", "Signature", "Description"])
    b = _block(1, "Route Handlers", f, md_row(md_code(F.col("name")), _at(), _or_dash("signature")), ["name", "seq"], ["Handler", "Location", "Signature"])
    return _section(m, "api_specs", _default(m, _all(a, b), "No API endpoints or route handlers discovered in the codebase."), _all(e.select(P, "confidence"), f.select(P, "confidence")))


def importers(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, target_id, importers, used_by, first): the first three sources of each imported module, by seq."""
    i = edges.where("relationship_type = 'imports'")
    n = i.groupBy(*keys, "target_id").agg(F.count(F.lit(1)).alias("importers"), F.min("seq").alias("first"))
    some = top_per(i, [*keys, "target_id"], [F.col("seq")], 3)
    names = joined_lines(some, [*keys, "target_id"], md_code(F.col("source_id")), ["seq"], ", ")
    more = F.when(F.col("importers") > 3, "...").otherwise("")
    return n.join(names, [*keys, "target_id"]).withColumn("used_by", F.concat("text", more)).drop("text")


def integrations(m: Model) -> DataFrame:
    i = importers(m.edges, [P]).withColumn("_o", -F.col("importers"))
    a = _block(0, "External Dependencies", i, md_row(md_code(F.col("target_id")), F.col("importers"), F.col("used_by")), ["_o", "first"], ["Module", "Importers", "Used By"])
    return _section(m, "integrations", _default(m, a, "No integration points discovered."), None)


def tech_stories(m: Model) -> DataFrame:
    calls = top_per(m.edges.where("relationship_type = 'calls'"), [P], [F.col("seq")], K.STORY_CALLS)
    story = F.concat(F.lit("- **As a** developer, **I need** "), md_code(F.col("source_id")), F.lit(" to call "), md_code(F.col("target_id")), F.lit(", **so that** the call chain is maintained.\n"))
    a = _block(0, "From Call Chains", calls, story, ["seq"])
    steps = F.transform("steps", lambda s: F.concat(F.lit("- Step "), s["order"].cast("string"), F.lit(": "), md_code(s["entity_id"]), F.lit(f" {DASH} "), s["description"], F.lit("\n")))
    b = _block(1, "From Workflows", m.workflows, F.concat(F.lit("### "), F.col("name"), F.lit("\n\n"), F.array_join(steps, "\n")), ["seq"])
    return _section(m, "tech_stories", _default(m, _all(a, b), "No technical stories could be generated."), m.workflows)


def coverage(m: Model) -> DataFrame:
    e = m.entities.groupBy(P).agg(F.bool_or(_name(["auth", "login", "session"])).alias("has_auth"), F.count_if(_name(K.SENSITIVE_WORDS)).alias("sensitive"), F.count_if(_name(K.VULNERABLE_WORDS)).alias("vulnerable"))
    r = m.rules.groupBy(P).agg(F.bool_or(F.col("rule_type") == "validation").alias("has_validation"))
    return _projects(m).join(e, P, "left").join(r, P, "left").na.fill(0).na.fill(False)


def security_considerations(m: Model) -> DataFrame:
    v, s = m.entities.where(_name(K.VULNERABLE_WORDS)), m.entities.where(_name(K.SENSITIVE_WORDS))
    a = _located(0, "Potential Vulnerability Patterns", v, ["seq"])
    b = _block(1, "Sensitive Data Handlers", s, md_row(md_code(F.col("name")), _at()), ["seq"], ["Entity", "Location"])
    where = md_code(F.concat_ws(":", "file_path", F.col("line").cast("string")))
    c = _block(2, "LLM-Detected Risks", m.risks, md_row(F.col("title"), F.col("severity"), F.col("risk_type"), where), ["seq"], ["Risk", "Severity", "Type", "Location"])
    found = lambda x: F.when(F.col(x), "Found").otherwise("Not found")
    g = coverage(m)
    lines = F.concat(
        F.lit("- Authentication entities: "), found("has_auth"), F.lit("\n- Validation rules: "), found("has_validation"),
        F.lit("\n- Sensitive data handlers: "), F.col("sensitive").cast("string"), F.lit(" found\n- Potential vulnerability patterns: "), F.col("vulnerable").cast("string"), F.lit(" found\n"),
    )
    d = g.select(P, F.lit(3).alias("no"), F.concat(F.lit("## Coverage Summary\n\n"), lines).alias("text"))
    return _section(m, "security_considerations", _all(a, b, c, d), _all(v.select(P, "confidence"), m.risks.select(P, "confidence")))


SECTIONS: dict[str, Callable[[Model], DataFrame]] = {
    "executive_overview": executive_overview, "features": features, "personas": personas, "user_stories": user_stories,
    "security_requirements": security_requirements, "system_overview": system_overview, "data_models": data_models, "interfaces": interfaces,
    "ui_specs": ui_specs, "api_specs": api_specs, "integrations": integrations, "tech_stories": tech_stories, "security_considerations": security_considerations,
}


def sections(m: Model, names: list[str] | None = None) -> DataFrame:
    """Sections of every project; unknown names raise."""
    return _all(*(SECTIONS[n](m) for n in (names or SECTIONS)))


def gated(section_rows: DataFrame) -> DataFrame:
    """Section rows with gate(passed, score, ...) by the section's own configuration and the clamped confidence."""
    g = None
    for name, (least, headings) in K.GATES.items():
        this = gate(F.col("content"), least, headings)
        g = F.when(F.col("section_name") == name, this) if g is None else g.when(F.col("section_name") == name, this)
    out = section_rows.withColumn("gate", g.otherwise(gate(F.col("content"), 200, [])))
    return out.withColumn("confidence", clamp_confidence(F.col("confidence"), F.col("gate.score")))


def degraded(failures: DataFrame) -> DataFrame:
    """failures(project_id, section_name, error) as stub sections."""
    t = section_title(F.col("section_name"))
    text = F.concat(F.lit("# "), t, F.lit("\n\n*This section could not be generated. Error: "), F.substring("error", 1, 200), F.lit("*\n"))
    return failures.select(P, "section_name", t.alias("title"), text.alias("content"), F.lit(0.0).alias("confidence"))


def contexts(m: Model) -> DataFrame:
    """(project_id, context): the capped facts that a section writer is given, as JSON, by seq."""
    def some(df: DataFrame, cap: str, *cols: str) -> DataFrame:
        t = top_per(df, [P], [F.col("seq")], K.CONTEXT_CAPS[cap])
        return t.groupBy(P).agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*cols).alias("x")))).alias("l")).select(P, F.transform("l", lambda v: v["x"]).alias(cap))

    out = _projects(m)
    for part in (
        some(m.entities, "entities", "name", "entity_type", "file_path", "start_line", "signature", "description", "confidence"),
        some(m.purposes, "purposes", "file_path", "statement", "confidence"), some(m.rules, "rules", "rule_text", "rule_type", "confidence"),
        some(m.risks, "risks", "title", "severity", "risk_type", "file_path", "line", "confidence"),
        some(m.edges, "relationships", "source_id", "target_id", "relationship_type"), some(m.workflows, "workflows", "name", "steps"),
    ):
        out = out.join(part, P, "left")
    return out.select(P, F.to_json(F.struct(*K_CONTEXT)).alias("context"))


K_CONTEXT = ["entities", "purposes", "rules", "risks", "relationships", "workflows"]
