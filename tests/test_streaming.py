import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.runtime import settings
from lodestone.streaming import channels, progress, requests
from lodestone.streaming import events as S


def _write(spark, path, rows, kind, mode="append"):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode(mode).parquet(path)


def test_fan_out_isolates_failures(spark, tmp_path):
    kind = "trace_id string, type string, n int"
    path = str(tmp_path / "in")
    _write(spark, path, [("a", "llm_call", 1), ("b", "x", 2)], kind)
    seen = []

    def bad(batch, number):
        raise RuntimeError("sink is down")

    q, failures = S.fan_out(S.read_events(spark, path, kind), {"bad": bad, "good": lambda b, n: seen.append(b.count())}, str(tmp_path / "ck"))
    q.awaitTermination()
    assert seen == [2] and [f[0] for f in failures] == ["bad"]


EVENT = "channel string, offset long, event string, data string"


def _channels(spark, base, rows, **options):
    """Publish rows and return all deliveries so far."""
    _write(spark, f"{base}/in", rows, EVENT)
    out = channels.deliveries(S.read_events(spark, f"{base}/in", EVENT), **options)
    with settings(spark, channels.STATE_STORE):
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start().awaitTermination()
    return {(r["channel"], r["subscriber"], r["offset"], r["event"]) for r in spark.read.schema(out.schema).parquet(f"{base}/out").collect()}


def test_late_subscribers_across_restarts(spark, tmp_path):
    base = str(tmp_path)
    first = [("p", i, "e", "x") for i in range(6)] + [("p", 9, "join", "late"), ("q", 1, "join", "early"), ("q", 2, "e", None), (None, 1, "e", "n")]
    got = _channels(spark, base, first, most=3)
    assert got == {("p", "late", 3, "e"), ("p", "late", 4, "e"), ("p", "late", 5, "e"), ("q", "early", 1, None)}
    assert {(r["channel"], r["offset"]) for r in channels.replay_buffer(spark, f"{base}/ck").collect()} == {("p", 3), ("p", 4), ("p", 5), ("q", 2), (None, 1)}
    # The query starts again: its state is the checkpoint's.
    new = _channels(spark, base, [("p", 11, "join", "later"), ("p", 10, "e", "x"), ("p", 12, "complete", None), ("p", 13, "join", "last"), ("q", 3, "e", None)], most=3) - got
    assert new == {("p", "late", 10, "e"), ("p", "later", 4, "e"), ("p", "later", 5, "e"), ("p", "later", 10, "e"), ("p", "late", 12, None), ("p", "later", 12, None), ("p", "last", 13, None)}
    assert {(r["channel"], r["offset"]) for r in channels.replay_buffer(spark, f"{base}/ck").collect()} == {("q", 2), ("q", 3), (None, 1)}


def test_channels_that_must_be_opened(spark, tmp_path):
    rows = [("p", 1, "e", "lost"), ("p", 2, "open", None), ("p", 3, "e", "a"), ("p", 4, "join", "s"), ("p", 5, "open", None), ("p", 6, "e", "b"), ("p", 7, "join", "t"), ("p", 8, "complete", None), ("p", 9, "e", "lost")]
    assert _channels(spark, str(tmp_path), rows, most=5, opening="open") == {("p", "s", 3, "e"), ("p", "t", 6, "e"), ("p", "t", 8, None)}
    assert channels.replay_buffer(spark, f"{tmp_path}/ck").count() == 0


def test_sessions_and_late_events(spark, tmp_path):
    kind = "ts timestamp, user_id long, event_type string, value double, request_id string"
    t = datetime(2024, 1, 1)
    at = lambda m, u=1, r="r": (t + timedelta(minutes=m), u, "click", 1.0, r)
    path = str(tmp_path / "in")
    _write(spark, path, [at(0), at(10), at(60), at(300, 2, "z")], kind)
    df = S.sessions(S.read_events(spark, path, kind)).select("user_id", F.col("session_window.start").alias("start"), "n")
    q = df.writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["user_id"], r["n"]) for r in spark.table("sess").collect()) == [(1, 1), (1, 2)]
    d = S.dedup_in_flight(S.read_events(spark, path, kind))
    q = d.writeStream.format("memory").queryName("ded").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["request_id"] for r in spark.table("ded").collect()) == ["r", "z"]


def test_costs_stream(spark, tmp_path):
    kind = "trace_id string, type string, data map<string, string>"
    path = str(tmp_path / "in")
    _write(spark, path, [("a", "llm_call", {"input_tokens": "5", "cost": "0.5"}), ("a", "llm_call", {"input_tokens": "x"}), ("a", "other", {"input_tokens": "9"})], kind)
    q = S.trace_costs_stream(S.read_events(spark, path, kind)).writeStream.format("memory").queryName("cost").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["input_tokens"], r["cost"], r["calls"]) for r in spark.table("cost").collect()] == [(5, 0.5, 2)]


def test_repeats_wait_for_the_first_result(spark, tmp_path):
    kind = "key string, at timestamp, kind string, id string, value string"
    base, t = str(tmp_path), datetime(2024, 1, 1)
    at = lambda m, k, what, i=None, v=None: (k, t + timedelta(minutes=m), what, i, v)

    def run(rows):
        _write(spark, f"{base}/in", rows, kind)
        out = requests.in_flight(S.read_events(spark, f"{base}/in", kind), limit="30 minutes")
        with settings(spark, channels.STATE_STORE):
            out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start().awaitTermination()
        return sorted(((r["key"], r["id"], r["kind"], r["value"]) for r in spark.read.schema(out.schema).parquet(f"{base}/out").collect() if r["key"]), key=str)

    got = run([at(0, "a", "request", "1"), at(1, "a", "request", "2"), at(2, "a", "result", None, "done"), at(3, "a", "request", "3"), at(0, "b", "request", "4"), at(1, "c", "result", None, "nobody")])
    assert got == [("a", "1", "result", "done"), ("a", "1", "start", None), ("a", "2", "result", "done"), ("a", "3", "start", None), ("b", "4", "start", None)]
    # After a restart: an error reaches the owner and who waits; an owner that never ends does so by time.
    new = [x for x in run([at(5, "a", "request", "5"), at(6, "a", "error", None, "bad"), at(6, "b", "request", "6"), at(90, "d", "request", "7")]) if x not in got]
    assert [x for x in new if x[0] == "a"] == [("a", "3", "error", "bad"), ("a", "5", "error", "bad")]
    late = [x for x in run([at(91, "e", "request", "8")]) if x[0] == "b" and x not in got]
    assert late == [("b", "4", "error", "timed out"), ("b", "6", "error", "timed out")]


def test_progress_of_a_running_query(spark, tmp_path):
    kind, base, log = "id long", str(tmp_path), progress.ProgressLog()
    spark.streams.addListener(log)
    try:
        runs = []
        for part in ([(1,), (2,), (3,)], [(4,)]):
            _write(spark, f"{base}/in", part, kind)
            q = progress.observed(S.read_events(spark, f"{base}/in", kind, 1)).writeStream.queryName("copy").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
            q.awaitTermination()
            runs.append(str(q.runId))
        for _ in range(100):
            if set(runs) <= set(log.ended):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert log.flush(spark, f"{base}/log") >= 2 and log.flush(spark, f"{base}/log") == 0
    got = progress.percentages(spark.read.parquet(f"{base}/log"), spark.createDataFrame([("copy", 8)], "query string, total long"))
    assert [(r["completed"], r["percent"]) for r in got.orderBy("batch").collect()] == [(3, 37.5), (4, 50.0)]
