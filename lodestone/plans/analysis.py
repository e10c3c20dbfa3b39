"""The run over a source tree: languages and chunks, what is declared, called, imported, stored and served, and the edges between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import extract, ingest, model
from lodestone.operators.stages import Run, Stage, run_stages
from lodestone.plans import sourcecode
from lodestone.plans.registry import ORACLES, query


def _declared(entities: DataFrame) -> DataFrame:
    """Entities with their ids, in the order of their places."""
    return entities.withColumn("id", model.entity_id(F.col("file_path"), F.col("name"))).withColumn("seq", F.struct("file_path", "start_line", "ordinal"))


def _edges(entities: DataFrame, calls: DataFrame, imports: DataFrame | None) -> DataFrame:
    e = _declared(entities)
    found = model.call_edges(calls.select("caller_file", "caller_line", "callee", "receiver", "seq"), e)
    if imports is None:
        return found
    return found.unionByName(model.import_edges(imports.select("source_file", "target", "seq"), e))


def stages(timeout: float | None = None) -> list[Stage]:
    """What a run does. Without entities and calls there are no edges; without imports there are those of calls."""
    one = lambda fn, *needs, **more: Stage(fn.__name__, fn, needs, timeout=timeout, **more)

    def languages(files):
        return ingest.language_stats(files)

    def chunks(files):
        return extract.declaration_chunks(files)

    def units(files):
        return files.select(F.col("path").alias("file_path"), "language", F.lit(1).alias("start_line"), "content", F.xxhash64("path").alias("seq"))

    def entities(units):
        return extract.entities(units)

    def calls(units, entities):
        return extract.calls(units, entities)

    def imports(units):
        return extract.imports(units)

    def tables(units):
        return extract.sql_tables(units).unionByName(extract.orm_models(units))

    def endpoints(units):
        return extract.endpoints(units)

    edges = Stage("edges", _edges, ("entities", "calls"), ("imports",), timeout=timeout)
    return [one(languages, "files"), one(chunks, "files"), one(units, "files"), one(entities, "units"), one(calls, "units", "entities"), one(imports, "units"), one(tables, "units"), one(endpoints, "units"), edges]


def analyse(spark: SparkSession, files: DataFrame, *, most: int = 5, timeout: float | None = None, stage_timeout: float | None = None) -> Run:
    """files(path, language, content) through all stages; the outputs are tables in the shared folder."""
    return run_stages(spark, stages(stage_timeout), {"files": files.select("path", "language", "content")}, most=most, timeout=timeout)


_COUNTS = {
    "languages": "tree_languages", "entities": "extract_entities", "calls": "extract_calls", "imports": "extract_imports", "endpoints": "extract_endpoints",
}


@query(" UNION ALL ".join(
    [f"SELECT '{s}' AS stage, 'completed' AS status, count(*) AS n_rows FROM ({ORACLES[q]})" for s, q in _COUNTS.items()]
    + [f"SELECT 'tables', 'completed', (SELECT count(*) FROM ({ORACLES['extract_sql_ddl']})) + (SELECT count(*) FROM ({ORACLES['extract_orm']}))"]
    + ["SELECT 'units', 'completed', count(*) + 11 FROM part"]
))
def analysis_run(spark, sf):
    """A run over a file for every part: its stages, side by side, and the rows of each."""
    run = analyse(spark, sourcecode.files(spark, sf))
    return run.log.where("stage NOT IN ('chunks', 'edges')").select("stage", "status", "n_rows")
