"""Building the graph: identities, and edges whose ends are found by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordered import first_per

REACH = 1000  # lines after its start that a declaration without an end may own


def entity_id(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit("::"), name)


def resolve_callers(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """calls(caller_file, caller_line, call_id) with caller_id.

    Of the file's entities whose lines hold the call the first by seq; if none does, the
    file's first. The file is the equi-join key, the range is decided inside the aggregate.
    """
    e = entities.select(F.col("file_path").alias("caller_file"), F.col("id").alias("_id"), "start_line", "end_line", F.col("seq").alias("_seq"))
    within = F.col("caller_line").between(F.col("start_line"), F.coalesce("end_line", F.col("start_line") + REACH))
    j = calls.join(e, "caller_file", "left").withColumn("_out", ~F.coalesce(within, F.lit(False)))
    g = j.groupBy(*calls.columns).agg(F.min_by("_id", F.struct("_out", "_seq")).alias("caller_id"))
    return g


def resolve_callees(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """calls(callee, receiver, caller_file, ...) with callee_id; calls that name no entity go.

    First `receiver.callee` in any file, then the callee in the caller's file, then in any.
    """
    names = entities.select("name", "file_path", "id", "seq")
    anywhere = first_per(names, ["name"]).select("name", "id")
    here = first_per(names, ["name", "file_path"]).select("name", "file_path", "id")
    full = F.when(F.col("receiver").isNotNull() & (F.col("receiver") != ""), F.concat(F.col("receiver"), F.lit("."), F.col("callee")))
    c = calls.withColumn("_full", full)
    c = c.join(anywhere.select(F.col("name").alias("_full"), F.col("id").alias("_a")), "_full", "left")
    c = c.join(here.select(F.col("name").alias("callee"), F.col("file_path").alias("caller_file"), F.col("id").alias("_b")), ["callee", "caller_file"], "left")
    c = c.join(anywhere.select(F.col("name").alias("callee"), F.col("id").alias("_c")), "callee", "left")
    out = c.withColumn("callee_id", F.coalesce("_a", "_b", "_c"))
    return out.where("callee_id IS NOT NULL").select(*calls.columns, "callee_id")


def call_edges(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, source_id, target_id, relationship_type, seq)."""
    c = resolve_callees(resolve_callers(calls, entities), entities).where("caller_id IS NOT NULL")
    return c.select(F.concat_ws(":", F.lit("call"), "caller_id", "callee_id").alias("id"), F.col("caller_id").alias("source_id"),
                    F.col("callee_id").alias("target_id"), F.lit("calls").alias("relationship_type"), "seq")


def import_edges(imports: DataFrame, entities: DataFrame) -> DataFrame:
    """imports(source_file, target, seq): from the file's first entity, or the file, to the module."""
    first = first_per(entities.select("file_path", "id", "seq"), ["file_path"]).select(F.col("file_path").alias("source_file"), F.col("id").alias("_id"))
    j = imports.join(first, "source_file", "left").withColumn("source_id", F.coalesce("_id", "source_file"))
    return j.select(F.concat_ws(":", F.lit("import"), "source_id", "target").alias("id"), "source_id", F.col("target").alias("target_id"),
                    F.lit("imports").alias("relationship_type"), "seq")


def reference_edges(references: DataFrame, tables: DataFrame) -> DataFrame:
    """references(file_path, table, target, kind, seq): foreign keys; a target of no known table gets an id in its own file."""
    by_name = tables.groupBy(F.col("name").alias("target")).agg(F.max_by("id", "seq").alias("_id"))
    tid = lambda t: F.concat(F.col("file_path"), F.lit("::table:"), F.col(t))
    j = references.join(by_name, "target", "left").withColumn("source_id", tid("table")).withColumn("target_id", F.coalesce("_id", tid("target")))
    return j.select(F.concat_ws(":", F.lit("schema_ref"), "source_id", "target_id").alias("id"), "source_id", "target_id",
                    F.lit("references").alias("relationship_type"), "seq", F.col("kind").alias("context"))


def persisted_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges as stored rows: source must be an entity; an unknown target is stored as its raw id."""
    e = entities.select("id", "file_path", "name")
    src = e.select(F.col("id").alias("source_id"), F.col("file_path").alias("source_file"), F.col("name").alias("source_symbol"))
    tgt = e.select(F.col("id").alias("target_id"), F.col("file_path").alias("_f"), F.col("name").alias("_n"))
    j = edges.join(src, "source_id").join(tgt, "target_id", "left")
    return j.select("source_file", "source_symbol", F.coalesce("_f", "target_id").alias("target_file"), F.coalesce("_n", "target_id").alias("target_symbol"), "relationship_type", "seq")


def workflows(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, entity_id, name, steps[order, entity_id, description]) of functions that call two or more entities."""
    calls = edges.where("relationship_type = 'calls'").where("source_id <> target_id")
    callee = entities.select(F.col("id").alias("target_id"), F.col("name").alias("_name"))
    calls = calls.join(callee, "target_id").groupBy("source_id", "target_id", "_name").agg(F.min("seq").alias("seq"))
    g = calls.groupBy(F.col("source_id").alias("entity_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "target_id", "_name"))).alias("t")).where(F.size("t") >= 2)
    f = entities.where(F.col("entity_type").isin("function", "method")).select(F.col("id").alias("entity_id"), "name")
    step = lambda o, i, d: F.struct(o.cast("int").alias("order"), i.alias("entity_id"), d.alias("description"))
    steps = F.concat(
        F.array(step(F.lit(0), F.col("entity_id"), F.concat(F.lit("Entry: "), F.col("name")))),
        F.transform("t", lambda x, i: step(i + 1, x["target_id"], F.concat(F.lit("Calls "), x["_name"]))),
    )
    return g.join(f, "entity_id").select(F.concat(F.lit("workflow:"), F.col("entity_id")).alias("id"), "entity_id", F.concat(F.col("name"), F.lit(" workflow")).alias("name"), steps.alias("steps"))
