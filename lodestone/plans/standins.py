"""The graph's tables made from the star-schema tables, for queries that can be checked by SQL.

Parts are entities (brand = project, type = kind, name = name), order lines are edges from
the part to the part with the supplier's number, suppliers are rules, nations are risks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.model import workflows
from lodestone.operators.report import Model
from lodestone.runtime import Scratch


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("p_type")
    kind = F.when(t == "STANDARD", "function").when(t == "ECONOMY", "class").when(t == "MEDIUM", "table").when(t == "PROMO", "endpoint").when(t == "LARGE", "interface").otherwise("method")
    ext = F.when(t == "MEDIUM", ".sql").when(t == "PROMO", ".tsx").otherwise(".py")
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("project_id"), F.col("p_partkey").alias("seq"), F.concat(F.lit("part::"), F.col("p_partkey").cast("string")).alias("id"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), kind.alias("entity_type"), F.concat(F.lower("p_type"), F.lit("/"), F.col("p_size").cast("string"), ext).alias("file_path"),
        F.col("p_size").alias("start_line"), (F.col("p_size") + 5).alias("end_line"), F.when(t == "MEDIUM", "sql").when(t != "PROMO", "python").alias("language"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("def "), F.col("p_name"))).alias("signature"), F.when(F.col("p_size") > 40, F.col("p_type")).alias("description"),
        F.lit(0.9).alias("confidence"),
    )


ENTITIES = """
entities AS (
  SELECT p_brand AS project_id, p_partkey AS seq, 'part::' || p_partkey AS id, replace(p_name, ' ', '_') AS name,
    CASE p_type WHEN 'STANDARD' THEN 'function' WHEN 'ECONOMY' THEN 'class' WHEN 'MEDIUM' THEN 'table' WHEN 'PROMO' THEN 'endpoint' WHEN 'LARGE' THEN 'interface' ELSE 'method' END AS entity_type,
    lower(p_type) || '/' || p_size || CASE p_type WHEN 'MEDIUM' THEN '.sql' WHEN 'PROMO' THEN '.tsx' ELSE '.py' END AS file_path,
    p_size AS start_line, p_size + 5 AS end_line, CASE WHEN p_type = 'MEDIUM' THEN 'sql' WHEN p_type <> 'PROMO' THEN 'python' END AS language,
    CASE WHEN p_size > 25 THEN 'def ' || p_name END AS signature, CASE WHEN p_size > 40 THEN p_type END AS description, 0.9::DOUBLE AS confidence
  FROM part)"""


def edges(spark: SparkSession, sf: str, scratch: Scratch | None = None) -> DataFrame:
    """All edges; with scratch they are made once, for plans that read them several times."""
    f = F.col("l_returnflag")
    kind = F.when(f == "R", "calls").when(f == "A", "imports").otherwise("references")
    pid = lambda c: F.concat(F.lit("part::"), F.col(c).cast("string"))
    e = table(spark, sf, "lineitem").select(pid("l_partkey").alias("source_id"), pid("l_suppkey").alias("target_id"), kind.alias("relationship_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"))
    e = e.groupBy("source_id", "target_id", "relationship_type").agg(F.min("n").alias("n"))
    e = e.join(entities(spark, sf).select(F.col("id").alias("source_id"), "project_id"), "source_id")
    if scratch is not None:
        e = scratch.keep(e, "edges")
    # A place for every edge: ties of the first line go to the ids.
    return e.select(
        "project_id", F.struct("n", "source_id", "target_id", "relationship_type").alias("seq"), F.concat_ws(":", "relationship_type", "source_id", "target_id").alias("id"),
        "source_id", "target_id", "relationship_type", F.lit(0.95).alias("weight"),
    )


EDGES = """
edges AS (
  SELECT e.project_id, l.source_id, l.target_id, l.relationship_type, l.relationship_type || ':' || l.source_id || ':' || l.target_id AS id, l.n,
         row_number() OVER (ORDER BY l.n, l.source_id, l.target_id, l.relationship_type) AS seq
  FROM (SELECT 'part::' || l_partkey AS source_id, 'part::' || l_suppkey AS target_id,
               CASE l_returnflag WHEN 'R' THEN 'calls' WHEN 'A' THEN 'imports' ELSE 'references' END AS relationship_type, min(l_orderkey * 10 + l_linenumber) AS n
        FROM lineitem GROUP BY ALL) l JOIN entities e ON e.id = l.source_id)"""


def model(spark: SparkSession, sf: str, scratch: Scratch | None = None) -> Model:
    e, r = entities(spark, sf), edges(spark, sf, scratch)
    brand = lambda c: F.concat(F.lit("Brand#"), (F.col(c) % 25 + 1).cast("string"))
    said = e.groupBy("project_id", "file_path").agg(F.min("seq").alias("seq"), F.concat(F.lit("Handles "), F.col("file_path")).alias("statement")).withColumn("confidence", F.lit(0.7))
    s = table(spark, sf, "supplier")
    kind = F.element_at(F.array(*map(F.lit, ("validation", "pricing", "workflow", "access_control", "data_constraint", "other"))), (F.col("s_nationkey") % 6 + 1).cast("int"))
    rules = s.select(brand("s_suppkey").alias("project_id"), F.col("s_suppkey").alias("seq"), F.concat(F.lit("Check "), F.col("s_name")).alias("rule_text"), kind.alias("rule_type"), F.when(F.col("s_acctbal") > 5000, 0.9).otherwise(0.7).alias("confidence"))
    n = table(spark, sf, "nation")
    risks = n.select(brand("n_nationkey").alias("project_id"), F.col("n_nationkey").alias("seq"), F.concat(F.lit("Risk "), F.col("n_name")).alias("title"), F.lit("high").alias("severity"), F.lit("security").alias("risk_type"), F.lit("a.py").alias("file_path"), F.col("n_regionkey").alias("line"), F.lit(0.5).alias("confidence"))
    flows = workflows(e, r).join(e.select(F.col("id").alias("entity_id"), "project_id", "seq"), "entity_id").withColumn("confidence", F.lit(0.6))
    # What the six tables name comes from three.
    projects = table(spark, sf, "part").select(F.col("p_brand").alias("project_id")).unionByName(s.select(brand("s_suppkey").alias("project_id"))).unionByName(n.select(brand("n_nationkey").alias("project_id"))).distinct()
    return Model(e, r, said, rules, risks, flows, projects)


MODEL = f"""{ENTITIES}, {EDGES},
purposes AS (SELECT project_id, file_path, min(seq) AS seq, 'Handles ' || file_path AS statement, 0.7::DOUBLE AS confidence FROM entities GROUP BY project_id, file_path),
rules AS (
  SELECT 'Brand#' || (s_suppkey % 25 + 1) AS project_id, s_suppkey AS seq, 'Check ' || s_name AS rule_text,
    ['validation', 'pricing', 'workflow', 'access_control', 'data_constraint', 'other'][s_nationkey % 6 + 1] AS rule_type,
    CASE WHEN s_acctbal > 5000 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM supplier),
risks AS (
  SELECT 'Brand#' || (n_nationkey % 25 + 1) AS project_id, n_nationkey AS seq, 'Risk ' || n_name AS title, 'high' AS severity, 'security' AS risk_type,
    'a.py' AS file_path, n_regionkey AS line, 0.5::DOUBLE AS confidence FROM nation),
callees AS (
  SELECT r.source_id, r.target_id, e.name, min(r.seq) AS seq FROM edges r JOIN entities e ON e.id = r.target_id
  WHERE r.relationship_type = 'calls' AND r.source_id <> r.target_id GROUP BY ALL),
steps AS (
  SELECT source_id, target_id AS entity_id, 'Calls ' || name AS description, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS ord,
         count(*) OVER (PARTITION BY source_id) AS n FROM callees),
workflows AS (
  SELECT f.project_id, f.seq, f.id AS entity_id, f.name || ' workflow' AS name, 0.6::DOUBLE AS confidence,
         '- Step 0: `' || f.id || '` — Entry: ' || f.name || chr(10) || chr(10)
         || string_agg('- Step ' || s.ord || ': `' || s.entity_id || '` — ' || s.description || chr(10), chr(10) ORDER BY s.ord) AS steps, max(s.n) AS n
  FROM entities f JOIN steps s ON s.source_id = f.id WHERE s.n >= 2 AND f.entity_type IN ('function', 'method') GROUP BY f.project_id, f.seq, f.id, f.name),
projects AS (
  SELECT project_id FROM entities UNION SELECT project_id FROM edges UNION SELECT project_id FROM purposes UNION SELECT project_id FROM rules
  UNION SELECT project_id FROM risks UNION SELECT project_id FROM workflows)"""
