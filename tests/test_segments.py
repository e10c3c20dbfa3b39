"""Segments by blocks and levels are those of a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators.segments import running_sums, segment
from lodestone.runtime import Scratch


def _fold(sizes, limit):
    out, held, total, batch = [], 0, 0, 0
    for t in sizes:
        if held and total + t > limit:
            held, total, batch = 0, 0, batch + 1
        held, total = held + 1, total + t
        out.append(batch)
    return out


def _rows():
    r = random.Random(3)
    groups = {
        "long": [r.randint(0, 30) for _ in range(3000)], "zeros": [0] * 40, "large": [r.choice([0, 0, 500, 7000, 3]) for _ in range(200)], "one": [5], "first large": [0, 0, 900, 0, 0, 900, 0],
        "exact": [50, 50, 50, 50, 100, 0, 100, 0, 0, 1], None: [99, 2, 99, 0, 101, 0, 101, 101, 1],
    }
    return groups, [(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)]


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_against_a_fold(spark, fan):
    groups, rows = _rows()
    df = spark.createDataFrame(rows, "g string, k long, t long").repartition(7).withColumn("extra.x", F.lit(1))
    got = {}
    out = segment(df, group="g", order=["k"], size="t", limit=100, fan=fan)
    assert out.columns == ["g", "k", "t", "extra.x", "segment"]
    for r in out.collect():
        got[r["g"], r["k"]] = r["segment"]
    assert len(got) == len(rows)
    for g, ts in groups.items():
        assert [got[g, i] for i in range(len(ts))] == _fold(ts, 100), g


def test_no_rows_and_nulls(spark):
    none = spark.createDataFrame([], "g string, k long, t long")
    assert segment(none, group="g", order=["k"], size="t", limit=10).count() == 0
    some = spark.createDataFrame([("a", 1, None), ("a", 2, 9), ("a", 3, 9)], "g string, k long, t long")
    assert sorted((r["k"], r["segment"]) for r in segment(some, group="g", order=["k"], size="t", limit=10).collect()) == [(1, 0), (2, 0), (3, 1)]


def test_a_group_is_dealt_over_tasks(spark):
    """Running sums of one group come from many ranges, and its blocks from many tasks."""
    df = spark.range(20_000).select(F.lit("g").alias("g"), "id", (F.col("id") % 7).alias("t"))
    s = running_sums(df, "g", ["id"], "t", Scratch(spark, "sums"))
    assert s.selectExpr("sum(_at)").first()[0] == sum(a for a in __import__("itertools").accumulate([i % 7 for i in range(19_999)]))
    out = segment(df, group="g", order=["id"], size="t", limit=50, fan=4)
    assert out.select("segment").distinct().count() == _fold([i % 7 for i in range(20_000)], 50)[-1] + 1
