"""Traversal of an edge table, and diagrams as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import fixed as K
from lodestone.functions.text import node_id, node_label
from lodestone.operators.ordered import joined_lines, top_per
from lodestone.runtime import Scratch


#: A front of at most so many nodes is broadcast to the edges; a larger one is joined by a shuffle.
BROADCAST_FRONT = 100_000


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int, *, callers: bool = False) -> DataFrame:
    """(start, node, distance): nodes within depth call edges of each start(start), nearest distance once.

    A breadth-first search of at most 5 levels. The call edges are written once, as (at, node);
    each level is one join of the front with them, without a shuffle of the edges while the
    front is small, and an anti-join against what was seen; levels cut the lineage.
    The start itself is reported only if a cycle leads back to it, as distance of that cycle.
    """
    depth = max(0, min(int(depth), 5))
    here, there = ("target_id", "source_id") if callers else ("source_id", "target_id")
    scratch = Scratch(edges.sparkSession, "khop")
    seen = start.select("start", F.lit(None).cast("string").alias("node"), F.lit(0).alias("distance")).limit(0)
    front = scratch.keep(start.select("start", F.col("start").alias("at")).distinct(), "level0")
    hops = edges.where("relationship_type = 'calls'").select(F.col(here).alias("at"), F.col(there).alias("node"))
    if depth > 1:
        hops = scratch.keep(hops.distinct(), "hops")
    for d in range(1, depth + 1):
        small = front.count() <= BROADCAST_FRONT
        new = (F.broadcast(front) if small else front).join(hops, "at").select("start", "node").distinct()
        new = new.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(d))
        new = scratch.keep(new, f"level{d}")
        seen = seen.unionByName(new)
        front = new.select("start", F.col("node").alias("at"))
    return seen


def edges_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that leave or reach any of nodes(node), each id once."""
    n = nodes.select("node").distinct()
    out = edges.join(n.select(F.col("node").alias("source_id")), "source_id", "left_semi")
    back = edges.join(n.select(F.col("node").alias("target_id")), "target_id", "left_semi")
    return out.select(edges.columns).unionByName(back.select(edges.columns)).dropDuplicates(["id"])


def _flow(edges: DataFrame, keys: list[str], head: str, arrow, spaces: bool = True) -> DataFrame:
    """A flow chart's text: each node is declared where it is first seen, then the edge."""
    e = edges.select(*keys, "seq", "source_id", "target_id", arrow.alias("arrow"))
    ends = e.select(*keys, "seq", F.posexplode(F.array("source_id", "target_id")).alias("end", "raw")).withColumn("node", node_id(F.col("raw"), spaces))
    decl = ends.groupBy(*keys, "node").agg(F.min_by("raw", F.struct("seq", "end")).alias("raw"), F.min(F.struct("seq", "end")).alias("at"))
    decl = decl.select(*keys, F.col("at.seq").alias("seq"), F.col("at.end").alias("sub"), F.concat(F.lit("    "), F.col("node"), F.lit("["), node_label(F.col("raw")), F.lit("]")).alias("line"))
    link = e.select(*keys, "seq", F.lit(2).alias("sub"), F.concat(F.lit("    "), node_id(F.col("source_id"), spaces), F.lit(" "), F.col("arrow"), F.lit(" "), node_id(F.col("target_id"), spaces)).alias("line"))
    text = joined_lines(decl.unionByName(link), keys, F.col("line"), ["seq", "sub"])
    return text.withColumn("text", F.concat(F.lit(head + "\n"), F.col("text")))


def architecture_diagram(edges: DataFrame, keys: list[str], most: int = K.DIAGRAM_EDGES) -> DataFrame:
    some = top_per(edges, keys, [F.col("seq")], most)
    arrow = F.when(F.col("relationship_type") == "calls", "-->").when(F.col("relationship_type") == "imports", "-.->").otherwise("---")
    return _flow(some, keys, "graph TD", arrow)


def overview_diagram(edges: DataFrame, keys: list[str]) -> DataFrame:
    some = top_per(edges, keys, [F.col("seq")], K.DIAGRAM_CALLS)
    return _flow(some, keys, "graph TD", F.when(F.col("relationship_type") == "calls", "-->|calls|").otherwise("-.->|imports|"), spaces=False)


def call_diagram(edges: DataFrame, keys: list[str], focus: str | None = None) -> DataFrame:
    calls = edges.where("relationship_type = 'calls'")
    some = calls.where((F.col("source_id") == focus) | (F.col("target_id") == focus)) if focus else top_per(calls, keys, [F.col("seq")], K.DIAGRAM_CALLS)
    return _flow(some, keys, "flowchart LR", F.lit("-->"))


def er_diagram(entities: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """entities(id, name, seq): boxes, then edges with both ends among them."""
    name = F.replace("name", F.lit(" "), F.lit("_"))
    box = joined_lines(entities, keys, F.concat(F.lit("    "), name, F.lit(" {\n        string id\n    }")), ["seq"])
    e = entities.select(*keys, "id", name.alias("safe"))
    j = edges.join(e.withColumnsRenamed({"id": "source_id", "safe": "_s"}), [*keys, "source_id"]).join(e.withColumnsRenamed({"id": "target_id", "safe": "_t"}), [*keys, "target_id"])
    line = F.concat(F.lit("    "), F.col("_s"), F.lit(" ||--o{ "), F.col("_t"), F.lit(' : "'), F.col("relationship_type"), F.lit('"'))
    links = joined_lines(j, keys, line, ["seq"]).withColumnRenamed("text", "links")
    return box.join(links, keys, "left").select(*keys, F.concat_ws("\n", F.lit("erDiagram"), "text", "links").alias("text"))


def sequence_from_calls(edges: DataFrame, keys: list[str]) -> DataFrame:
    calls = top_per(edges.where("relationship_type = 'calls'"), keys, [F.col("seq")], K.DIAGRAM_CALLS)
    ends = calls.select(*keys, "seq", F.posexplode(F.array("source_id", "target_id")).alias("end", "raw")).withColumn("label", node_label(F.col("raw")))
    who = ends.groupBy(*keys, "label").agg(F.min(F.struct("seq", "end")).alias("at"))
    who = who.select(*keys, F.lit(0).alias("part"), F.col("at.seq").alias("seq"), F.col("at.end").alias("sub"), F.concat(F.lit("    participant "), F.col("label")).alias("line"))
    said = calls.select(*keys, F.lit(1).alias("part"), "seq", F.lit(0).alias("sub"), F.concat(F.lit("    "), node_label(F.col("source_id")), F.lit("->>"), node_label(F.col("target_id")), F.lit(": calls")).alias("line"))
    text = joined_lines(who.unionByName(said), keys, F.col("line"), ["part", "seq", "sub"])
    return text.withColumn("text", F.concat(F.lit("sequenceDiagram\n"), F.col("text")))


def sequence_from_workflow(flows: DataFrame) -> DataFrame:
    """(id, text) of workflows(id, steps)."""
    label = F.transform("steps", lambda s: node_label(s["entity_id"]))
    who = F.transform(F.array_distinct(label), lambda x: F.concat(F.lit("    participant "), x))
    pairs = F.transform(
        F.filter(F.sequence(F.lit(1), F.size("steps")), lambda i: i < F.size("steps")),
        lambda i: F.concat(F.lit("    "), F.element_at(label, i), F.lit("->>+"), F.element_at(label, i + 1), F.lit(": "), F.element_at("steps", i + 1)["description"]),
    )
    return flows.select("id", F.array_join(F.concat(F.array(F.lit("sequenceDiagram")), who, pairs), "\n").alias("text"))
