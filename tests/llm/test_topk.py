import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.topk import TopK, top_k


def _brute(rows, k, scale):
    v = {}
    for i, x in rows:
        if i is None or not x or any(c is None or not np.isfinite(c) for c in x):
            continue
        z = [int(np.floor(float(np.float32(c)) * scale)) for c in x]
        v[i] = min(v.get(i, z), z)
    out = set()
    for q in v:
        if q % 5 == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q and len(v[c]) == len(v[q]))
            out |= {(q, r + 1, c, -p) for r, (p, c) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_as_brute_force(spark, shard_rows):
    g = np.random.default_rng(5)
    rows = [(i, [float(c) for c in np.float32(g.normal(size=8))]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)]  # a very common vector: ties
    rows += [(500, None), (505, []), (510, [1.0] * 7 + [float("nan")]), (515, [float("inf")] * 8), (520, [1.0, None] * 4), (None, [1.0] * 8)]
    rows += [(600, [1.0, 2.0]), (601, [0.5, 0.5]), (5, [0.0] * 8), (5, [0.0] * 8), (605, [1e6] * 8), (610, [3.0, 4.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(4)
    got = top_k(df, F.col("vec_id") % 5 == 0, k=7, shard_rows=shard_rows, block_rows=16).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == _brute(rows, 7, 64)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, F.col("vec_id") % 5 == 0).count() == 0


def test_shards_are_pruned_before_they_move(spark):
    """Of vectors in clusters most pairs of block and shard are never joined, and the results are exact."""
    g = np.random.default_rng(3)
    centres = g.normal(size=(30, 16)) * 4
    rows = [(i, [float(c) for c in np.float32(centres[i % 30] + g.normal(size=16) * 0.2)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    t = TopK(df, F.col("vec_id") % 5 == 0, 64, "vec_id", "embedding", 50, 16)
    got = t.results(7).collect()
    assert {tuple(r) for r in got} == _brute(rows, 7, 64)
    searched = spark.read.parquet(t.scratch.path("first-pairs")).count() + spark.read.parquet(t.scratch.path("pairs")).count()
    assert searched < 0.3 * t.blocks.count() * t.shards.count()
