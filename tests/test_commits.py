"""Two writers at once: none is lost, readers stay on their snapshot."""

import threading

import pytest
from pyspark.sql import functions as F

from lodestone.sources.commits import Commits, Conflict, claim
from lodestone.sources.store import Store

KIND = "k string, n long"


def _rows(df):
    return sorted((str(r["k"]), r["n"]) for r in df.collect())


def _table(spark, tmp_path):
    t = Commits(spark, str(tmp_path / "t"), KIND, "k")
    t.append(spark.createDataFrame([("a", 1), ("b", 1), (None, 7)], KIND))
    return t


def test_snapshots_and_keys(spark, tmp_path):
    t = _table(spark, tmp_path)
    old = t.read()
    t.append(spark.createDataFrame([("a", 2)], KIND))
    t.change(["b"], lambda now: now.withColumn("n", F.col("n") + 10))
    assert _rows(t.read()) == [("None", 7), ("a", 1), ("a", 2), ("b", 11)]
    assert _rows(old) == _rows(t.read(1)) == [("None", 7), ("a", 1), ("b", 1)]
    t.drop(["a", "never"])
    assert t.version() == 4 and _rows(t.read()) == [("None", 7), ("b", 11)]
    t.append(spark.createDataFrame([("a", 5)], KIND))
    assert _rows(t.read()) == [("None", 7), ("a", 5), ("b", 11)]
    assert t.change(["b"], lambda now: None) is None and t.version() == 5


def test_a_conflict_is_tried_again_on_the_newer_snapshot(spark, tmp_path):
    t, seen = _table(spark, tmp_path), []

    def add(now):
        seen.append(now.first()["n"])
        if len(seen) == 1:  # another writer comes first: once to this key, once to another
            t.change(["b"], lambda x: x.withColumn("n", F.col("n") + 5))
            t.change(["a"], lambda x: x.withColumn("n", F.col("n") + 100))
        return now.withColumn("n", F.col("n") + 1)

    assert t.change(["a"], add) == 4
    assert seen == [1, 101] and _rows(t.read()) == [("None", 7), ("a", 102), ("b", 6)]
    # What the lost attempt wrote is gone.
    assert len([p for p in (tmp_path / "t" / "data").iterdir() if p.name.startswith("_id=")]) == 4


def test_other_keys_and_appends_do_not_conflict(spark, tmp_path):
    t, calls = _table(spark, tmp_path), []

    def add(now):
        calls.append(1)
        t.append(spark.createDataFrame([("b", 2)], KIND))
        return now.withColumn("n", F.col("n") + 1)

    t.change(["a"], add)
    assert calls == [1] and _rows(t.read()) == [("None", 7), ("a", 2), ("b", 1), ("b", 2)]


def test_no_update_is_lost_among_threads(spark, tmp_path):
    t = _table(spark, tmp_path)
    threads = [threading.Thread(target=lambda: t.change(["a"], lambda now: now.withColumn("n", F.col("n") + 1))) for _ in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert _rows(t.read()) == [("None", 7), ("a", 5), ("b", 1)] and t.version() == 5


def test_it_gives_up_after_so_many_attempts(spark, tmp_path):
    t = _table(spark, tmp_path)

    def always_late(now):
        t.append(spark.createDataFrame([("a", 0)], KIND))
        return now

    with pytest.raises(Conflict):
        t.change(["a"], always_late, attempts=2)


def test_claims(spark, tmp_path):
    for name in "xy":
        (tmp_path / name).write_text(name)
    assert claim(spark, str(tmp_path / "x"), str(tmp_path / "z")) and not claim(spark, str(tmp_path / "y"), str(tmp_path / "z"))
    assert (tmp_path / "z").read_text() == "x"


def test_status_is_compared_and_set(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    make = lambda i, status: (i, i, "/", "main", "sha", status, None, None, None)
    s.append("projects", spark.createDataFrame([make("p", "paused"), make("q", "analyzed")], s.read("projects").schema))
    done = []
    threads = [threading.Thread(target=lambda: done.append(s.set_status("p", "analyzing", ["paused", "error"]))) for _ in range(3)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert sorted(done) == [False, False, True]
    assert not s.set_status("missing", "analyzing") and s.set_status("q", "paused")
    assert sorted((r["id"], r["status"]) for r in s.read("projects").collect()) == [("p", "analyzing"), ("q", "paused")]
