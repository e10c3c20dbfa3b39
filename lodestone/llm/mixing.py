"""Mixing sources to target weights.

Method: every row gets a hash-random key. A source's key range is dealt into 2^bits ranges
(hash values are uniform, so ranges stay small whatever the source holds); ranges are summed
map-side, and prefix sums over the range totals, in two levels so that no task holds a whole
source, give each range its place. Whole epochs of a source are repeated as its target asks,
and the rest is cut where the running word count is nearest to what is left of the budget, so a
source ends within half a document of its target. All ranges before that place are taken, none
after it; only the rows of the one range that holds it are sorted and summed, which gives each
source the key of its last row. So texts are never shuffled, and never cut.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share the corpus'
total. A target above cap x its source's size is cut to that, and the excess is shared again
by weight. That fixed point is min(cap x size, weight x level); the level is found exactly
from prefix sums over sources ordered by cap x size / weight.

Defined results: null text has size 0; empty sources get target 0 and rows of size 0 count as
taken 0; null source is a source of its own; rows that repeat an id share its key and are
ordered by size and text hash, so reruns agree; an empty table gives no rows. Extra columns
pass through, but for those whose name starts with _mix_, which are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm.text import all_of, named, null_last_key, without_reserved, word_count
from lodestone.runtime import Scratch

WEIGHTS = (5, 2, 1)
CAP = 3
BITS = 16
COARSE = 8  # of a range's bits, those that the first level of prefix sums takes
#: Plans of at most so many sources are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes(_mix_source, source_size) -> with target, by the rule above."""
    everyone = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    order = W.orderBy("_mix_source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("double")).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    s = s.withColumn("ratio", F.col("limit") / F.col("w"))
    rising = W.orderBy("ratio", "_mix_source")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    s = (
        s.withColumn("rn", F.row_number().over(rising))
        .withColumn("left", F.sum("source_size").over(everyone) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("free", F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("free"))
    )
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")),
                     F.when(F.col("level") <= F.col("ratio"), F.col("rn"))).over(everyone)
    s = s.withColumn("target", F.coalesce(F.least("limit", F.col("w") * level), F.col("limit")))
    return s.select("_mix_source", "source_size", "target")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    cap: int = CAP,
    bits: int = BITS,
    salt: str = "",
) -> DataFrame:
    """docs with _mix_size, _mix_source_size, _mix_target, _mix_copies (times the mix takes a row)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    docs = without_reserved(docs, "_mix_")
    key = F.md5(F.concat(F.coalesce(named(id_col).cast("string"), F.lit("")), F.lit(salt)))
    part = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    rows = (
        docs.withColumn("_mix_source", null_last_key(named(source_col)))
        .withColumn("_mix_range", F.shiftright(part, 32 - bits))
        .withColumn("_mix_size", word_count(named(text_col)))
        .withColumn("_mix_at", F.struct(key.alias("key"), F.col("_mix_size").alias("size"), F.xxhash64(named(text_col)).alias("hash")))
    )
    grid = scratch.keep(
        rows.groupBy("_mix_source", "_mix_range").agg(F.sum("_mix_size").alias("_mix_range_size")), "grid", files=32
    )
    sizes = grid.groupBy("_mix_source").agg(F.sum("_mix_range_size").alias("source_size"))
    plan = source_targets(sizes, weights, cap).withColumnsRenamed({"source_size": "_mix_source_size", "target": "_mix_target"})
    epochs = F.when(F.col("_mix_source_size") > 0, F.floor(F.col("_mix_target") / F.col("_mix_source_size"))).otherwise(0)
    plan = plan.withColumn("_mix_epochs", epochs.cast("long"))
    plan = scratch.keep(plan.withColumn("_mix_rest", F.col("_mix_target") - F.col("_mix_epochs") * F.col("_mix_source_size")), "plan")
    sources = plan.count()
    small = (lambda df: F.broadcast(df)) if sources <= BROADCAST_SOURCES else (lambda df: df)

    # The range of each source that holds its cut, and the words before that range.
    grid = grid.withColumn("coarse", F.shiftright("_mix_range", max(0, bits - COARSE)))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(earlier(w)), F.lit(0))
    blocks = grid.groupBy("_mix_source", "coarse").agg(F.sum("_mix_range_size").alias("words"))
    blocks = blocks.withColumn("start", before("words", W.partitionBy("_mix_source").orderBy("coarse")))
    inside = before("_mix_range_size", W.partitionBy("_mix_source", "coarse").orderBy("_mix_range"))
    ranges = grid.withColumn("inside", inside).join(blocks.select("_mix_source", "coarse", "start"), ["_mix_source", "coarse"])
    ranges = ranges.join(small(plan.select("_mix_source", "_mix_rest")), "_mix_source").withColumn("_mix_offset", F.col("start") + F.col("inside"))
    holds = (F.col("_mix_offset") <= F.col("_mix_rest")) & (F.col("_mix_offset") + F.col("_mix_range_size") > F.col("_mix_rest"))
    cut = scratch.keep(ranges.where(holds).select("_mix_source", F.col("_mix_range").alias("_mix_cut"), "_mix_offset", "_mix_rest"), "cut", files=1)

    # The rows of those ranges, in order of their keys: the last one that is taken.
    near = rows.select("_mix_source", "_mix_range", "_mix_size", "_mix_at").join(small(cut), "_mix_source").where("_mix_range = _mix_cut")
    sofar = F.col("_mix_offset") + before("_mix_size", W.partitionBy("_mix_source").orderBy("_mix_at"))
    near = near.withColumn("sofar", sofar).where((F.col("_mix_rest") > 0) & (2 * F.col("sofar") + F.col("_mix_size") <= 2 * F.col("_mix_rest")))
    last = near.groupBy("_mix_source").agg(F.max("_mix_at").alias("_mix_last"))
    plan = plan.join(cut.select("_mix_source", "_mix_cut"), "_mix_source", "left").join(last, "_mix_source", "left")
    plan = scratch.keep(plan, "decisions", files=1)

    placed = rows.join(small(plan), "_mix_source")
    taken = (F.col("_mix_range") < F.col("_mix_cut")) | ((F.col("_mix_range") == F.col("_mix_cut")) & (F.col("_mix_at") <= F.col("_mix_last")))
    extra = F.coalesce((F.col("_mix_rest") > 0) & taken, F.lit(False))
    return placed.withColumn("_mix_copies", F.col("_mix_epochs") + extra.cast("long")).select(
        *all_of(docs), "_mix_size", "_mix_source_size", "_mix_target", "_mix_copies"
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' columns, each row as often as the mix takes it."""
    m = mix(docs, **options)
    times = F.sequence(F.lit(1).cast("long"), F.col("_mix_copies"))
    return m.where("_mix_copies > 0").withColumn("_mix_epoch", F.explode(times)).drop("_mix_size", "_mix_source_size", "_mix_target", "_mix_copies", "_mix_epoch")
