"""The corpus pipeline: five stages over documents, each on all that the one before it kept.

run(spark, sf_dir) applies STAGES to documents.parquet. Each stage takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet in the shared folder and read again as
the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm import bpe, jaccard, language, line_dedup, mixing
from lodestone.runtime import Scratch

#: Near duplicates: shingles of so many words, and the least Jaccard similarity in percent.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; the others keep their row.

    Learns from the non-null lang of the documents that are not held out, like the query.
    """
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    return language.predict(docs, model).where(~F.col("_lid_rejected")).drop("_lid_lang", "_lid_score", "_lid_rejected")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; a document of which no word is left goes too; n_chars follows the text."""
    out = line_dedup.drop_recurring_lines(docs)
    left = (F.size("_line_gone") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    chars = F.when(F.size("_line_gone") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(left).withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays.

    Documents without words link with nothing and all stay. Components are told apart by their sets,
    so unlinked documents with a null id or with one and the same id all stay.
    """
    out = jaccard.jaccard_components(docs, n_words=NEAR_WORDS, percent=NEAR_PERCENT)
    first = (F.col("_jac_n") == 0) | F.col("doc_id").eqNullSafe(F.col("_jac_component"))
    out = out.where(first)
    # Ids may be null or repeated, so one row stays per component of sets, not per id.
    order = W.partitionBy("_jac_comp", "_jac_alone").orderBy(F.xxhash64("text"))
    alone = F.when(F.col("_jac_n") == 0, F.monotonically_increasing_id())
    out = out.withColumn("_jac_alone", alone).withColumn("_jac_at", F.row_number().over(order))
    return out.where("_jac_at = 1").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight; a document that is taken twice has two rows."""
    return mixing.mixed_rows(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them: doc_id, source, n_tokens, ids, digests."""
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.encode(docs, codec, with_ids=True).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", language_id),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_bpe),
]

#: SQL cannot express the first stage; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
