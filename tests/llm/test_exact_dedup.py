from pyspark.sql import functions as F

from lodestone.llm.exact_dedup import exact_dedup


def _brute(rows):
    out = {}
    for i, t in rows:
        n = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        out.setdefault(n, []).append(i)
    return {n: (max((x for x in v if x is not None), default=None), len(v)) for n, v in out.items()}


ROWS = [(1, "Abc"), (2, "aBC"), (3, "ÀB"), (4, "àb"), (5, None), (6, ""), (7, "x" * 50_000), (8, "X" * 50_000), (8, "x" * 50_000), (None, "abc"), (9, "solo")]


def _write(spark, rows, path):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash"))
    df.withColumn("keep", F.lit(0)).repartition(3).write.mode("overwrite").parquet(path)
    return path


def _check(out, rows):
    want = _brute(rows)
    assert sum(r["kept"] for r in out) == len(want)
    got = sorted((r["id"] is None, r["id"] or 0, r["keep_id"], r["group_size"]) for r in out)
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    assert got == sorted((i is None, i or 0, *want[low(t)]) for i, t in rows)


def test_groups(spark, tmp_path):
    out = exact_dedup(spark, _write(spark, ROWS, str(tmp_path / "d"))).collect()
    _check(out, ROWS)


def test_colliding_digests_are_told_apart(spark, tmp_path):
    path = _write(spark, ROWS, str(tmp_path / "d"))
    out = exact_dedup(spark, path, digest=lambda t: F.substring(F.sha2(t, 256), 1, 1).substr(1, 0)).collect()
    _check(out, ROWS)


def test_empty_table(spark, tmp_path):
    assert exact_dedup(spark, _write(spark, [], str(tmp_path / "d"))).count() == 0


def test_state_outlives_calls(spark, tmp_path):
    path, state = str(tmp_path / "d"), str(tmp_path / "state")
    _write(spark, ROWS[:4], path)
    exact_dedup(spark, path, state_dir=state).collect()
    spark.createDataFrame([(50, "ABC")], "doc_id long, text string").withColumn("digest", F.lit("")).withColumn("keep", F.lit(0)).write.mode("append").parquet(path)
    out = {r["id"]: r for r in exact_dedup(spark, path, state_dir=state).collect()}
    assert out[1]["keep_id"] == 50 and out[1]["group_size"] == 3 and out[50]["kept"] and not out[1]["kept"]
