"""Stage graphs: order, limit, deadlines on the cluster, isolation and what stands in."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodestone.operators.events import outcome_counts
from lodestone.operators.stages import COMPLETED, DEGRADED, FAILED, SKIPPED, TIMED_OUT, Stage, run_stages
from lodestone.plans.analysis import analyse
from lodestone.plans.sourcecode import files


@F.udf(LongType())
def _slow(x):
    time.sleep(60)
    return x


def test_failures_are_isolated_and_logged(spark):
    some = spark.range(5)

    def broken(some):
        return some.select(F.raise_error(F.lit("no such luck")).alias("x"))

    got = run_stages(spark, [
        Stage("a", lambda some: some.where("id > 1"), ("some",)), Stage("broken", broken, ("some",)), Stage("after", lambda broken: broken, ("broken",)),
        Stage("stub", broken, ("some",), fallback=lambda error: spark.createDataFrame([(error,)], "error string")), Stage("on_stub", lambda stub: stub, ("stub",)),
        Stage("last", lambda a, broken: a if broken is None else None, ("a",), ("broken",)),
    ], {"some": some}, most=2)
    assert got.status == {"a": COMPLETED, "broken": FAILED, "after": SKIPPED, "stub": DEGRADED, "on_stub": COMPLETED, "last": COMPLETED}
    assert got.partial and sorted(r[0] for r in got.outputs["last"].collect()) == [2, 3, 4]
    assert "no such luck" in got.outputs["on_stub"].first()[0]
    log = {r["stage"]: r for r in got.log.collect()}
    assert (log["a"]["n_rows"], log["broken"]["n_rows"], log["after"]["error"]) == (3, None, "needs broken")
    assert "no such luck" in log["broken"]["error"] and log["a"]["duration_ms"] > 0
    assert outcome_counts(got.log, ["run"]).first()["partial"]


def test_a_slow_stage_is_cancelled_on_the_cluster(spark):
    began = time.monotonic()
    got = run_stages(spark, [
        Stage("slow", lambda some: some.select(_slow("id").alias("x")), ("some",), timeout=4), Stage("good", lambda some: some, ("some",)), Stage("after", lambda slow: slow, ("slow",)),
    ], {"some": spark.range(2)})
    assert got.status == {"slow": TIMED_OUT, "good": COMPLETED, "after": SKIPPED}
    assert time.monotonic() - began < 40 and got.outputs["good"].count() == 2
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_limit_and_deadline_of_a_run(spark):
    now, most = [0], [0]

    def counted(some):
        now[0] += 1
        most[0] = max(most[0], now[0])
        time.sleep(0.3)
        now[0] -= 1
        return some

    got = run_stages(spark, [Stage(f"s{i}", counted, ("some",)) for i in range(6)], {"some": spark.range(1)}, most=2)
    assert set(got.status.values()) == {COMPLETED} and most[0] == 2 and not got.partial
    got = run_stages(spark, [Stage("slow", lambda some: some.select(_slow("id")), ("some",)), Stage("next", lambda some: some, ("some",))], {"some": spark.range(1)}, most=1, timeout=3)
    assert got.status == {"slow": TIMED_OUT, "next": SKIPPED}


def test_graphs_that_cannot_run(spark):
    for bad in ([Stage("a", lambda b: b, ("b",)), Stage("b", lambda a: a, ("a",))], [Stage("a", lambda x: x, ("x",))], [Stage("a", lambda: None), Stage("a", lambda: None)]):
        with pytest.raises(ValueError):
            run_stages(spark, bad)
    assert run_stages(spark, []).log.count() == 0


def test_an_analysis_keeps_its_tables(spark):
    got = analyse(spark, files(spark))
    assert set(got.status.values()) == {COMPLETED}
    edges = {(r["source_id"], r["target_id"], r["relationship_type"]) for r in got.outputs["edges"].collect()}
    assert ("app/main.py::items", "app/main.py::helper", "calls") in edges and ("app/service.py::load", "app/service.py::fetch", "calls") in edges
    assert ("app/main.py::get_user", "fastapi", "imports") in edges and got.outputs["chunks"].count() > 20
