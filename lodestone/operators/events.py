"""Status, replay and cost over event tables; the streaming forms are in lodestone.streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import fixed as K
from lodestone.functions.text import stage_label

STAGE = "name string, label string, status string, message string, duration_ms double, completed int, total int, percent double"


def stage_states(events: DataFrame, keys: list[str]) -> DataFrame:
    """Latest state of each stage of events(keys, offset, event, data json), ordered by first sight.

    Events of other kinds, bad JSON and stages without a name are skipped.
    """
    s = events.where("event = 'stage'").withColumn("s", F.from_json("data", STAGE)).where("s.name IS NOT NULL AND s.name <> ''")
    g = s.groupBy(*keys, F.col("s.name").alias("name")).agg(F.max_by("s", "offset").alias("s"), F.min("offset").alias("first"))
    return g.select(*keys, "name", F.coalesce("s.label", stage_label(F.col("name"))).alias("label"), "s.status", "s.message", "s.duration_ms", "s.percent", "first")


def replay(events: DataFrame, keys: list[str], most: int = K.REPLAY) -> DataFrame:
    """The newest events of each channel, at most so many."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("offset")))
    return events.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def trace_costs(traces: DataFrame) -> DataFrame:
    """Per trace the model calls' tokens and cost; what is missing or no number counts 0."""
    num = lambda k, t: F.coalesce(F.try_element_at("data", F.lit(k)).try_cast(t), F.lit(0).cast(t))
    return traces.where("type = 'llm_call'").groupBy("trace_id").agg(
        F.sum(num("input_tokens", "long")).alias("input_tokens"), F.sum(num("output_tokens", "long")).alias("output_tokens"),
        F.sum(num("cost", "double")).alias("cost"), F.count(F.lit(1)).alias("calls"),
    )


def outcome_counts(stage_log: DataFrame, keys: list[str]) -> DataFrame:
    """ok, failed and whether a run was partial (both)."""
    g = stage_log.groupBy(*keys).agg(F.count_if(F.col("ok")).alias("ok"), F.count_if(~F.col("ok")).alias("failed"))
    return g.withColumn("partial", (F.col("ok") > 0) & (F.col("failed") > 0))


def with_percent(progress: DataFrame) -> DataFrame:
    """progress(completed, total) with percent, to one decimal, half to even; rows of total 0 go."""
    return progress.where("total > 0").withColumn("percent", F.bround(F.col("completed") / F.col("total") * 100, 1))


def recover_stuck(projects: DataFrame, now, seconds: int = K.STUCK_SECONDS) -> DataFrame:
    """projects with status error where work has not moved for so long."""
    stuck = F.col("status").isin("analyzing", "paused") & (F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(seconds)))
    return projects.withColumn("status", F.when(stuck, "error").otherwise(F.col("status")))


def compare_and_set(projects: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(id, expected array, status): projects with the new status where the present one was expected; changed tells."""
    r = requests.withColumnRenamed("status", "_new")
    j = projects.join(r, "id", "left").withColumn("changed", F.coalesce(F.array_contains("expected", F.col("status")), F.lit(False)))
    return j.withColumn("status", F.when(F.col("changed"), F.col("_new")).otherwise(F.col("status"))).select(*projects.columns, "changed")


def average_confidence(df: DataFrame, keys: list[str], value: str = "confidence") -> DataFrame:
    """Mean of the values above 0, else 0."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col(value) > 0, F.col(value))), F.lit(0.0)).alias("avg_confidence"))
