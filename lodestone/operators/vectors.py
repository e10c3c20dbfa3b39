"""A stored exact vector index: cells of near vectors as folders, pruned by the triangle inequality.

Every vector lies in the cell of its nearest pivot, with its distance to it. For a query only cells
can hold something nearer than the bound whose ball comes that near, and in a cell only vectors whose
distance to the pivot differs from the query's by less; all of those are compared, so nothing within
the bound is missed. Many queries are answered at once: each is sent to the cells it needs, by blocks of
at most BLOCK vectors, so no task holds a cell, and folders of cells that no query needs are not read.
Pivots are the cells' number of vectors with the smallest hashes, and all that comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import fixed as K
from lodestone.runtime import ship_package

CELLS = 64
BLOCK = 20_000
#: What rounding may add to a distance; cells and vectors are passed over only beyond it.
SLACK = 1e-6


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(-1, dim)


def _usable(vec: str):
    """Vectors that have no null, NaN or infinite part."""
    return F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def build(vectors: DataFrame, path: str, *, id_col: str = "id", vec: str = "vector", cells: int = CELLS, block: int = BLOCK) -> None:
    """Write the index of vectors, all of one length; those with missing or infinite parts take no part."""
    spark = vectors.sparkSession
    ship_package(spark)
    v = vectors.where(_usable(vec)).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vector"))
    pivots = [r["vector"] for r in v.groupBy("vector").agg(F.xxhash64("vector").alias("h")).orderBy("h").limit(cells).collect()]
    centres = np.array(pivots, np.float64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b["vector"], centres.shape[1])
            cell, away = np.zeros(len(x), np.int32), np.full(len(x), np.inf)
            for i, c in enumerate(centres):
                d = np.sqrt(((x - c) ** 2).sum(axis=1))
                nearer = d < away
                cell[nearer], away[nearer] = i, d[nearer]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(away)], names=[*b.schema.names, "cell", "away"])

    kind = f"id {v.schema['id'].dataType.simpleString()}, vector array<double>, cell int, away double"
    placed = v.mapInArrow(place, kind) if pivots else spark.createDataFrame([], kind)
    placed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    sizes = spark.read.schema(kind).parquet(f"{path}/vectors").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("least"), F.max("away").alias("most"))
    centre = spark.createDataFrame([(i, p) for i, p in enumerate(pivots)], "cell int, centre array<double>")
    sizes.join(centre, "cell").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).write.mode("overwrite").parquet(f"{path}/cells")


def cells_needed(spark: SparkSession, path: str, queries: DataFrame, most: float = K.MAX_DISTANCE) -> DataFrame:
    """queries(query, vector) -> (query, vector, cell, blocks, off: distance to the cell's pivot) of the cells that may hold what is near."""
    ship_package(spark)
    cells = [(r["cell"], r["blocks"], r["least"], r["most"], np.array(r["centre"])) for r in spark.read.parquet(f"{path}/cells").collect()]
    reach = math.sqrt(most) + SLACK
    q = queries.where(_usable("vector")).select("query", F.col("vector").cast("array<double>").alias("vector"))

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, blocks, least, far, centre in cells:
                off = np.sqrt(((_matrix(b["vector"], len(centre)) - centre) ** 2).sum(axis=1))
                hit = np.flatnonzero((off - far < reach) & (least - off < reach))
                got = b.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array([cell] * len(hit), pa.int32()), pa.array([blocks] * len(hit), pa.int32()), pa.array(off[hit])], names=["query", "vector", "cell", "blocks", "off"])

    return q.mapInArrow(aim, f"query {q.schema['query'].dataType.simpleString()}, vector array<double>, cell int, blocks int, off double")


def search(spark: SparkSession, path: str, queries: DataFrame, *, k: int = K.TOP_K, most: float = K.MAX_DISTANCE) -> DataFrame:
    """queries(query, vector) -> (query, id, distance, rank): the k nearest by squared distance under the bound, ties to the smaller id."""
    aimed = cells_needed(spark, path, queries, most)
    aimed = aimed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    stored = spark.read.parquet(f"{path}/vectors")
    blocks = spark.read.parquet(f"{path}/cells").select("cell", "blocks")
    held = stored.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # A row for each cell that is needed: the folders of others are pruned.
    held = held.join(F.broadcast(aimed.select("cell").distinct()), "cell", "left_semi").select("cell", "block", "id", "vector", "away")
    ids = stored.schema["id"].dataType.simpleString()
    query = aimed.schema["query"].dataType.simpleString()
    reach = math.sqrt(most) + SLACK

    def compare(q: pa.Table, v: pa.Table) -> pa.Table:
        kinds = [q.schema.field("query").type, v.schema.field("id").type]
        out: tuple[list, list, list] = ([], [], [])
        if len(q) and len(v):
            names, dim = v["id"].to_pylist(), len(v["vector"][0].as_py())
            x, away = _matrix(v["vector"].combine_chunks(), dim), v["away"].to_numpy()
            for name, y, off in zip(q["query"].to_pylist(), _matrix(q["vector"].combine_chunks(), dim), q["off"].to_pylist(), strict=True):
                near = np.flatnonzero(np.abs(away - off) < reach)
                d = ((x[near] - y) ** 2).sum(axis=1)
                best = sorted((float(d[j]), names[near[j]]) for j in np.flatnonzero(d < most))[:k]
                out[0].extend([name] * len(best))
                out[1].extend(i for _, i in best)
                out[2].extend(s for s, _ in best)
        return pa.table({"query": pa.array(out[0], kinds[0]), "id": pa.array(out[1], kinds[1]), "distance": pa.array(out[2], pa.float64())})

    found = aimed.groupBy("cell", "block").cogroup(held.groupBy("cell", "block")).applyInArrow(compare, f"query {query}, id {ids}, distance double")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))).where(F.col("rank") <= k)
