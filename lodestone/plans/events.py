"""Queries of the status, replay, cost and conversation operators, and of their streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import events as ev
from lodestone.plans.registry import query
from lodestone.plans.standins import table
from lodestone.runtime import Scratch


def _stage_events(spark, sf):
    """Users as channels, event types as stages, one kind of event is no stage and one has broken JSON."""
    e = table(spark, sf, "events")
    data = F.to_json(F.struct(F.col("event_type").alias("name"), F.col("value").cast("string").alias("message"), F.lit("running").alias("status")))
    data = F.when(F.col("value") < 1, F.lit("{broken")).otherwise(data)
    return e.select("user_id", F.col("event_id").alias("offset"), F.when(F.col("event_type") == "view", "note").otherwise("stage").alias("event"), data.alias("data"))


@query("""
SELECT user_id, event_type AS name, max_by(value, event_id) AS value, min(event_id) AS first FROM events WHERE event_type <> 'view' AND value >= 1 GROUP BY user_id, event_type
""")
def latest_stage_state(spark, sf):
    """W2, ST4, R15, X30: the latest state of each stage, by first sight."""
    return ev.stage_states(_stage_events(spark, sf), ["user_id"]).select("user_id", "name", F.col("message").cast("double").alias("value"), "first")


@query("""
SELECT user_id, event_type AS name, max_by(value, event_id) AS value, min(event_id) AS first FROM events WHERE event_type <> 'view' AND value >= 1 GROUP BY user_id, event_type
""")
def latest_stage_state_stream(spark, sf):
    """ST1, ST4: the same as a stream in update mode; the last update of a key counts."""
    from lodestone.streaming.events import stage_states_stream

    scratch = Scratch(spark, "stages")
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    e = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    data = F.to_json(F.struct(F.col("event_type").alias("name"), F.col("value").cast("string").alias("message"), F.lit("running").alias("status")))
    e = e.select("user_id", F.col("event_id").alias("offset"), F.when(F.col("event_type") == "view", "note").otherwise("stage").alias("event"), F.when(F.col("value") < 1, F.lit("{broken")).otherwise(data).alias("data"))
    out = scratch.path("out")
    (stage_states_stream(e, ["user_id"]).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"))
     .option("checkpointLocation", scratch.path("ck")).trigger(availableNow=True).start().awaitTermination())
    last = spark.read.parquet(out).groupBy("user_id", "name").agg(F.max_by(F.struct("state", "first"), "batch").alias("s"))
    return last.select("user_id", "name", F.col("s.state.message").cast("double").alias("value"), F.col("s.first").alias("first"))


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT user_id, event_id AS "offset" FROM r WHERE r <= 20
""")
def replay_last_n(spark, sf):
    """ST2, O7: the newest events of each channel; here twenty."""
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("offset"))
    return ev.replay(e, ["user_id"], 20)


@query("""
WITH e AS (
  SELECT user_id, event_id, event_type, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part FROM events),
j AS (SELECT user_id, part, event_id AS subscriber FROM e WHERE event_type = 'signup'),
p AS (SELECT user_id, part, event_id, event_type FROM e WHERE event_type NOT IN ('signup', 'error')),
o AS (SELECT user_id, part, min(event_id) AS opened FROM p GROUP BY user_id, part),
d AS (
  SELECT j.*, p.event_id, p.event_type, row_number() OVER (PARTITION BY subscriber, p.event_id < subscriber ORDER BY p.event_id DESC) AS r
  FROM j JOIN o USING (user_id, part) JOIN p USING (user_id, part) WHERE opened < subscriber)
SELECT user_id AS channel, subscriber::VARCHAR AS subscriber, event_id AS "offset", event_type AS event FROM d WHERE event_id > subscriber OR r <= 3
UNION ALL SELECT user_id, subscriber::VARCHAR, subscriber, NULL FROM j LEFT JOIN o USING (user_id, part) WHERE opened IS NULL OR opened > subscriber
UNION ALL SELECT user_id, subscriber::VARCHAR, e.event_id, NULL FROM j JOIN o USING (user_id, part) JOIN e USING (user_id, part) WHERE opened < subscriber AND event_type = 'error'
""")
def channel_deliveries_stream(spark, sf):
    """ST1, ST2, ST3: what late subscribers of a channel get: its newest events (here three), what follows, and its end."""
    from lodestone.runtime import settings
    from lodestone.streaming import channels

    scratch = Scratch(spark, "channels")
    path = f"{sf}/events.parquet"
    e = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    kind = F.when(F.col("event_type") == "signup", channels.JOIN).otherwise(F.col("event_type"))
    e = e.select(F.col("user_id").alias("channel"), F.col("event_id").alias("offset"), kind.alias("event"), F.col("event_id").cast("string").alias("data"))
    out = channels.deliveries(e, most=3, terminal="error")
    with settings(spark, channels.STATE_STORE):
        out.writeStream.format("parquet").option("path", scratch.path("out")).option("checkpointLocation", scratch.path("ck")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(scratch.path("out")).drop("data")


@query("""
SELECT user_id::VARCHAR AS trace_id, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS input_tokens, 0::BIGINT AS output_tokens, round(sum(value), 6) AS cost, count(*) AS calls
FROM events WHERE event_type = 'click' GROUP BY user_id
""")
def trace_cost(spark, sf):
    """A10, ST10: tokens and cost of the model calls of each trace."""
    e = table(spark, sf, "events")
    data = F.create_map(F.lit("input_tokens"), F.get_json_object("props", "$.k"), F.lit("cost"), F.col("value").cast("string"), F.lit("output_tokens"), F.lit("none"))
    t = e.select(F.col("user_id").cast("string").alias("trace_id"), F.when(F.col("event_type") == "click", "llm_call").otherwise("other").alias("type"), data.alias("data"))
    return ev.trace_costs(t).withColumn("cost", F.round("cost", 6))


@query("""
SELECT user_id, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'error') > 0 AND count(*) FILTER (event_type = 'error') > 0 AS partial
FROM events GROUP BY user_id
""")
def stage_outcomes(spark, sf):
    """Stages that went well and that failed."""
    e = table(spark, sf, "events").select("user_id", (F.col("event_type") != "error").alias("ok"))
    return ev.outcome_counts(e, ["user_id"])


@query("""
SELECT l_orderkey, count(*) AS completed, sum(l_quantity)::BIGINT AS total, round_even(count(*) / sum(l_quantity) * 100, 1) AS percent FROM lineitem GROUP BY l_orderkey
""")
def progress_percent(spark, sf):
    """A19, ST5: progress in percent to one decimal, half to even."""
    p = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("completed"), F.sum("l_quantity").cast("long").alias("total"))
    return ev.with_percent(p)


_PROJECT = """
p AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'analyzing' WHEN 'P' THEN 'paused' ELSE 'analyzed' END AS status, o_orderdate AS updated_at FROM orders)"""


def _projects(spark, sf):
    s = F.when(F.col("o_orderstatus") == "O", "analyzing").when(F.col("o_orderstatus") == "P", "paused").otherwise("analyzed")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), s.alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))


@query(f"WITH {_PROJECT} SELECT id, CASE WHEN status IN ('analyzing', 'paused') AND updated_at < TIMESTAMP '1999-01-01' - INTERVAL 900 SECOND THEN 'error' ELSE status END AS status FROM p")
def stuck_recovery(spark, sf):
    """work that has not moved is an error."""
    return ev.recover_stuck(_projects(spark, sf), F.lit("1999-01-01").cast("timestamp")).select("id", "status")


@query(f"""
WITH {_PROJECT}, r AS (SELECT o_orderkey AS id, o_orderpriority FROM orders)
SELECT p.id, CASE WHEN o_orderpriority = '2-HIGH' AND status IN ('analyzed', 'paused') THEN 'analyzing' ELSE status END AS status, o_orderpriority = '2-HIGH' AND status IN ('analyzed', 'paused') AS changed FROM p JOIN r USING (id)
""")
def status_cas(spark, sf):
    """F12, ST6, SK15: status changes where the present status was expected."""
    want = table(spark, sf, "orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("id"), F.array(F.lit("analyzed"), F.lit("paused")).alias("expected"), F.lit("analyzing").alias("status"))
    return ev.compare_and_set(_projects(spark, sf), want).select("id", "status", "changed")


@query("SELECT conv_id, list(turn || ':' || role || ':' || length(text) ORDER BY turn, role, text) AS messages FROM conversations GROUP BY conv_id")
def conversation_history(spark, sf):
    """T5, SC9, R16: a conversation's messages in order."""
    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return g.select("conv_id", F.transform("m", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"], F.char_length(x["text"]).cast("string"))).alias("messages"))


@query("""
SELECT conv_id, sha256(string_agg(role || ':' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, role, text)) AS text_sha FROM conversations WHERE trim(text) <> '' GROUP BY conv_id
""")
def transcript(spark, sf):
    """Messages joined by rules, empty ones left out."""
    from lodestone.operators.ordered import joined_lines

    c = table(spark, sf, "conversations").where(F.trim("text") != "")
    t = joined_lines(c, ["conv_id"], F.concat("role", F.lit(":\n"), "text"), ["turn", "role", "text"], "\n\n---\n\n")
    return t.select("conv_id", F.sha2("text", 256).alias("text_sha"))


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events
WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL
""")
def windowed_counts_stream(spark, sf):
    """Event-time windows as a stream in append mode: hours that the watermark has passed."""
    from lodestone.streaming.events import windowed_counts

    scratch = Scratch(spark, "windows")
    path = f"{sf}/events.parquet"
    e = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    q = windowed_counts(e, size="1 hour").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))
    q.writeStream.format("parquet").outputMode("append").option("path", scratch.path("out")).option("checkpointLocation", scratch.path("ck")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(q.schema).parquet(scratch.path("out"))
