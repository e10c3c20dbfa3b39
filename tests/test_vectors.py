"""The stored vector index finds what comparing all vectors finds, and passes over cells."""

import math

import numpy as np

from lodestone.operators.vectors import build, cells_needed, search

KIND = "id long, vector array<float>"


def _vectors():
    g = np.random.default_rng(4)
    x = np.concatenate([g.normal(c, 0.15, (60, 6)) for c in g.normal(0, 4, (8, 6))] + [np.zeros((5, 6)), np.zeros((3, 6)) + 0.5]).astype(np.float32)
    return [(i, [float(a) for a in v]) for i, v in enumerate(x)]


def test_against_all_distances(spark, tmp_path):
    rows, path = _vectors(), str(tmp_path / "index")
    odd = [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [math.nan] * 6), (1003, [math.inf] * 6)]
    build(spark.createDataFrame(rows + odd, KIND).repartition(5), path, cells=9, block=25)
    queries = spark.createDataFrame([(i, v) for i, v in rows if i % 7 == 0] + [(5000, [50.0] * 6), (5001, None)], "query long, vector array<float>")
    got = {}
    for r in search(spark, path, queries, k=4, most=0.4).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"], round(r["distance"], 9)))
    for q, y in ((i, v) for i, v in rows if i % 7 == 0):
        d = sorted((float(((np.array(v) - np.array(y)) ** 2).sum()), i) for i, v in rows)
        assert sorted(got[q]) == [(k + 1, i, round(s, 9)) for k, (s, i) in enumerate([x for x in d if x[0] < 0.4][:4])]
    assert 5000 not in got and 5001 not in got
    needed = cells_needed(spark, path, queries, 0.4).groupBy("query").count().collect()
    assert sum(r["count"] for r in needed) < 0.6 * 9 * len(got)


def test_no_vectors(spark, tmp_path):
    build(spark.createDataFrame([], KIND), str(tmp_path / "index"))
    assert spark.read.parquet(f"{tmp_path}/index/cells").count() == 0
