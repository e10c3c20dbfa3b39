"""Importance resampling of documents towards a target distribution of hashed n-grams.

Method: every distinct text becomes a position table: its words are exploded with their places,
and window lead() per text concatenates the following words to each, for every order up to
max_order. The n-grams' CRC-32 names one of a fixed number of buckets. Bucket counts of the corpus
and of the target give each bucket a gain, the scaled logarithm of the smoothed ratio of its two
shares; gains are joined to the n-grams, and a text's weight is the floored mean of its gains. Weights plus
Gumbel noise from a hash of the id give scores, and the highest scores are drawn, which is a
sample without replacement in proportion to exp(weight / 1000).

Scale: copies of a text are collapsed first, so a group of copies costs one text; the exchange that
does so also leaves each text's words in one task, and explode and window follow without another.
The position table's buckets are kept as they come, without a hash table beside the window: its
sorts spill. Gains are a bounded table (buckets rows), which is broadcast. Weights meet the rows by the
text's MD5 in a plain join that skew handling may split. Ranks come from counts by score, summed
over the distinct scores (integers within the gains' range and the noise), and row numbers within one
score, so no task sorts the table.

Defined results: null text has no words; a text without n-grams has weight 0; null ids take the
noise of the empty string and come after the others of their score; rows that repeat an id and text have the same
score and are drawn in an arbitrary order among themselves; an empty table gives no rows; an
empty target counts nothing in any bucket; extra columns pass through, but for those whose
name starts with _res_, which are dropped. Texts that differ count as one only if their MD5 collides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm.text import all_of, ascii_lower, named, without_reserved
from lodestone.runtime import Scratch

#: What stands between words: ASCII characters other than letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_ORDER = 2
BUCKETS = 10_000
SCALE = 1_000
SEED = "7"
MIN_WORDS = 20
PERCENT = 25


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def distinct_texts(text: Column, rows: DataFrame) -> DataFrame:
    """_res_key, its text and its number of rows, one task per text."""
    keyed = rows.select(F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("_res_key"), F.coalesce(text, F.lit("")).alias("text"))
    return keyed.groupBy("_res_key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def bucket_counts(texts: DataFrame, max_order: int = MAX_ORDER, buckets: int = BUCKETS) -> DataFrame:
    """texts(_res_key, text, copies) -> _res_key, copies, bucket, n: a text's n-grams by bucket; a bucket may have several rows."""
    # The outer forms, as for the others Spark makes each array a second time, for a filter.
    table = texts.select("_res_key", "copies", F.posexplode_outer(words(F.col("text"))).alias("pos", "word"))
    along = W.partitionBy("_res_key").orderBy("pos")
    grams = [F.col("word")]
    for k in range(1, max_order):
        # Null past the text's end, and so is every longer n-gram from there on.
        grams.append(F.concat(grams[-1], F.lit(" "), F.lead("word", k).over(along)))
    places = F.array(*[F.pmod(F.crc32(g), F.lit(buckets)).cast("int") for g in grams])
    table = table.select("_res_key", "copies", places.alias("places"))
    found = table.select("_res_key", "copies", F.explode_outer("places").alias("bucket")).where("bucket IS NOT NULL")
    # Not summed by text and bucket: that saved a third of the rows of 0.5 GB, and a hash table of
    # n-grams beside the window's sort would leave the window no memory.
    return found.withColumn("n", F.lit(1).cast("long"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """corpus and target(bucket, n) -> bucket, gain."""
    s, t = (d.groupBy("bucket").agg(F.sum("n").alias(c)) for d, c in ((corpus, "s"), (target, "t")))
    everywhere = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # over the buckets
    both = s.join(t, "bucket", "full").na.fill(0, ["s", "t"])
    both = both.withColumns({"all_s": F.sum("s").over(everywhere), "all_t": F.sum("t").over(everywhere)})
    up = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.col("all_t") + buckets).cast("double")
    return both.select("bucket", F.floor(F.lit(float(scale)) * F.ln(up / down)).cast("long").alias("gain"))


def noise(row_id: Column, seed: str = SEED, scale: int = SCALE) -> Column:
    """Gumbel noise from a hash of the seed and the id, scaled and floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(scale)) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    max_order: int = MAX_ORDER,
    buckets: int = BUCKETS,
    scale: int = SCALE,
    seed: str = SEED,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """docs with _res_n (n-grams), _res_weight, _res_score and _res_rank (from 1; null if not drawn)."""
    scratch = Scratch(docs.sparkSession, "resample")
    docs = without_reserved(docs, "_res_")
    counts = scratch.keep(bucket_counts(distinct_texts(named(text_col), docs), max_order, buckets), "counts")
    aim = bucket_counts(distinct_texts(named(target_text_col), target), max_order, buckets)
    weighted = lambda d: d.select("bucket", (F.col("n") * F.col("copies")).alias("n"))
    gain = scratch.keep(gains(weighted(counts), weighted(aim), buckets, scale), "gains", files=1)

    total = counts.join(F.broadcast(gain), "bucket").groupBy("_res_key").agg(
        F.sum("n").alias("_res_n"), F.sum(F.col("n") * F.col("gain")).alias("g")
    )
    # div cuts towards zero; what is taken off first makes it a floor.
    weight = F.expr("(g - pmod(g, _res_n)) div _res_n")
    weights = scratch.keep(total.select("_res_key", "_res_n", weight.alias("_res_weight")), "weights")
    scratch.drop("counts")
    rows = docs.withColumn("_res_key", F.unhex(F.md5(F.coalesce(named(text_col), F.lit("")))))
    rows = rows.join(weights, "_res_key", "left").withColumns({
        "_res_n": F.coalesce("_res_n", F.lit(0).cast("long")), "_res_weight": F.coalesce("_res_weight", F.lit(0).cast("long"))
    })
    rows = rows.withColumn("_res_score", F.col("_res_weight") + noise(named(id_col), seed, scale))
    out = drawn(rows, id_col, F.col("_res_n") >= least_grams(min_words, max_order), percent, scratch)
    return out.select(*all_of(docs), "_res_n", "_res_weight", "_res_score", "_res_rank")


def least_grams(min_words: int, max_order: int) -> int:
    """The n-grams of a text of min_words words."""
    return sum(max(0, min_words - k) for k in range(max_order))


def drawn(rows: DataFrame, id_col: str, may: Column, percent: int, scratch: Scratch) -> DataFrame:
    """rows with _res_rank: the place among the highest percent of those that may be drawn, ties to the smaller id."""
    rows = rows.withColumn("_res_may", may)
    tally = scratch.keep(rows.where("_res_may").groupBy("_res_score").agg(F.count(F.lit(1)).alias("n")), "scores", files=1)
    # One row for each distinct score; the gains' and the noise's range bound those, not the rows.
    higher = W.orderBy(F.desc("_res_score")).rowsBetween(W.unboundedPreceding, -1)
    places = tally.select(
        "_res_score", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("_res_above"), F.expr(f"({int(percent)} * sum(n) OVER ()) div 100").alias("_res_draw")
    ).where("_res_above < _res_draw")
    rows = rows.join(F.broadcast(places), "_res_score", "left")
    order = W.partitionBy("_res_score", "_res_may").orderBy(named(id_col).asc_nulls_last(), "_res_key")
    rank = F.col("_res_above") + F.row_number().over(order)
    return rows.withColumn("_res_rank", rank).withColumn("_res_rank", F.when(F.col("_res_may") & (F.col("_res_rank") <= F.col("_res_draw")), F.col("_res_rank")))
