"""Exact deduplication as a stateful stream [native].

Method: a Structured Streaming aggregation, keyed by the digest of the normalised text,
keeps in RocksDB state without expiry, per digest: the group's size, its largest stable
identifier and the content locator (file, row) of the row that has it. Digest hits are then
checked byte by byte: the keeper's text is fetched by its locator and every row of the group
is compared with it. Rows that differ in spite of equal digests are grouped anew by their
full text, so a collision never merges two texts.

Defined results: null text counts as empty, so null and empty texts are one group. Null
identifiers order before all others. Of equal texts the row with the largest identifier
stays; if rows repeat that identifier, the one that is last by (file, row) stays, so exactly
one row of each group is kept. Extra columns are never read; an empty table gives no rows.
Only digests, identifiers and locators are shuffled for all rows; texts pass a Bloom filter
of the hit digests, of at most 8 MB, so that little more than the hits' texts move, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.text import ascii_lower
from lodestone.runtime import BLOOM_JOINS, Scratch, settings

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # Every state partition would reserve megabytes of disk for logs that stay small.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(df: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    norm = ascii_lower(F.col(text_col))
    return df.select(
        F.col(id_col).alias("id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        norm.alias("norm"),
        digest(norm).alias("digest"),
    )


def ingest(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    sink: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=_sha256,
    files_per_batch: int | None = None,
) -> None:
    """Run the stream over the files that are new since the last call with this checkpoint.

    Each micro-batch writes the digests whose state it changed to sink/batch=N.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # The last letter as a class: a pattern is accepted for one file and for a folder alike.
    rows = _rows(reader.parquet(f"{path[:-1]}[{path[-1]}]"), id_col, text_col, digest)
    state = rows.groupBy("digest").agg(
        F.max(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n")
    )

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    with settings(spark, _STATE):
        (
            state.writeStream.outputMode("update")
            .foreachBatch(put)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )


def current_state(spark: SparkSession, sink: str) -> DataFrame:
    """The newest state of each digest: digest, keep(id, file, row), n."""
    kind = "digest string, keep struct<id: {}, file: string, row: bigint>, n bigint"
    try:
        seen = spark.read.parquet(sink)
    except Exception as e:  # an empty input never ran a batch
        if "UNABLE_TO_INFER_SCHEMA" not in str(e) and "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], kind.format("bigint"))
    return (
        seen.groupBy("digest")
        .agg(F.max(F.struct("batch", "keep", "n")).alias("s"))
        .select("digest", "s.keep", "s.n")
    )


def exact_dedup(
    spark: SparkSession,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=_sha256,
    files_per_batch: int | None = None,
    state_dir: str | None = None,
) -> DataFrame:
    """One row per row of the Parquet table at path: id, keep_id, group_size, kept, digest.

    With state_dir, later calls on a folder that has grown read only new files into the state.
    """
    scratch = Scratch(spark, "exact-dedup")
    base = state_dir or scratch.path("stream")
    ingest(
        spark, path, f"{base}/checkpoint", f"{base}/sink",
        id_col=id_col, text_col=text_col, digest=digest, files_per_batch=files_per_batch,
    )
    state = scratch.keep(current_state(spark, f"{base}/sink"), "state")
    docs = _rows(spark.read.parquet(path), id_col, text_col, digest)
    hits = state.where("n > 1")
    with settings(spark, BLOOM_JOINS):
        hit_rows = scratch.keep(docs.join(hits.select("digest", "keep"), "digest"), "hits")
        is_kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
        keepers = hit_rows.where(is_kept).select("digest", F.col("norm").alias("kept_norm"))
        other = hit_rows.drop("keep").join(keepers, "digest").where(F.col("norm") != F.col("kept_norm"))
        other = scratch.keep(other.drop("kept_norm"), "collisions")
    scratch.drop("hits")
    rows = docs.drop("norm")
    if other.isEmpty():
        groups = rows.join(state, "digest")
        return _result(groups.withColumn("keep_id", F.col("keep.id")))
    apart = other.groupBy("digest").agg(F.count(F.lit(1)).alias("apart"))
    state = state.join(apart, "digest", "left").withColumn("n", F.col("n") - F.coalesce("apart", F.lit(0)))
    regrouped = other.groupBy("digest", "norm").agg(
        F.max(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n")
    )
    moved = other.join(regrouped, ["digest", "norm"]).select("id", "file", "row", "digest", "keep", "n")
    stayed = rows.join(other.select("file", "row"), ["file", "row"], "left_anti").join(state, "digest")
    both = stayed.select(moved.columns).unionByName(moved)
    return _result(both.withColumn("keep_id", F.col("keep.id")))


def _result(groups: DataFrame) -> DataFrame:
    mine = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    return groups.select("id", "keep_id", F.col("n").alias("group_size"), mine.alias("kept"), "digest")
