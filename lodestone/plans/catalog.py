"""All queries of this library by name, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import analysis, events, exports, graphs, reports, serving, sourcecode, texts  # noqa: F401
from lodestone.plans.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: keyword and vector search fused by reciprocal rank."""
    return graphs.hybrid_retrieve(spark, sf_dir)
